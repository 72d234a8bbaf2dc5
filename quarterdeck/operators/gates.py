"""Quality gates and readiness over metrics, parsers and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metrics by kind of support.
CORE = ("operating_margin", "net_margin", "debt_to_equity", "current_ratio", "fcf", "fcf_margin")
SENSITIVE = ("revenue_growth", "roe", "roa")
DISCLOSURE = ("ebitda_margin", "net_debt_to_ebitda")
VALUATION = ("pe_ratio", "ev_to_ebitda", "dividend_yield")
PROPER_ROLES = ("financial_statements", "financial_supplement", "annual_report")
SUPPORT_CLASSES = {"core_statement_based": CORE, "methodology_sensitive": SENSITIVE, "explicit_disclosure_required": DISCLOSURE, "market_valuation_required": VALUATION}
#: Package states that block a company's sources, and the output scopes that each output needs.
BLOCKED_PACKAGES = ("NOT_READY", "SOURCE_BLOCKED")
OUTPUTS = {"financial_facts": "statement_based_financials", "financial_metrics": "statement_based_financials", "market_analysis": "market_technical_analysis", "peer_comparison": "peer_comparison", "llm_payload": "llm_summary"}


def metric_quality(audited: DataFrame) -> DataFrame:
    """Coverage of the core metrics less penalties, and pass, partial, missing or fail, an entity."""
    code, status = F.col("metric_code"), F.col("status")
    core = code.isin(*CORE)
    rows = audited.groupBy("entity").agg(
        F.count_if(core).alias("eligible"), F.count_if(core & (status == "valid")).alias("calculated"), F.count_if(core & (status == "questionable")).alias("questionable"), F.count_if(core & (status == "missing")).alias("missing_expected"),
        F.count_if(status == "invalid").alias("invalid"), F.count_if(code.isin(*VALUATION) | (code.isin(*DISCLOSURE) & (status == "missing"))).alias("unsupported"), F.count_if(code.isin(*SENSITIVE)).alias("sensitive"), F.count_if(code.isin(*VALUATION) & F.col("value").isNotNull()).alias("blockers"),
    )
    coverage = F.coalesce(F.try_divide("calculated", "eligible"), F.lit(0.0))
    score = coverage - F.when(F.col("invalid") > 0, 0.2).otherwise(0.0) - F.when(F.col("blockers") > 0, 0.4).otherwise(0.0)
    verdict = F.when((F.col("blockers") > 0) | (F.col("invalid") > 0), "fail").when(F.col("calculated") == 0, "missing").when((F.col("missing_expected") > 0) | (F.col("questionable") > 0), "partial").otherwise("pass")
    return rows.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4)).withColumn("status", verdict)


def metric_quality_items(audited: DataFrame) -> DataFrame:
    """entity, kind, metric_code, period, status, support_class, reason and required (array of facts): the metrics behind metric_quality's
    counts, as unsupported_by_policy, missing_but_expected or methodology_sensitive.  Required facts are given for those expected.
    """
    from .metrics import AUDIT_INPUTS

    code, missing = F.col("metric_code"), F.col("status") == "missing"
    kind = (
        F.when(code.isin(*VALUATION) | (code.isin(*DISCLOSURE) & missing), "unsupported_by_policy")
        .when(code.isin(*CORE) & missing, "missing_but_expected")
        .when(code.isin(*SENSITIVE), "methodology_sensitive")
    )
    support = F.coalesce(*[F.when(code.isin(*codes), name) for name, codes in SUPPORT_CLASSES.items()])
    reason = (
        F.when(code.isin(*VALUATION), "market_or_valuation_inputs_required")
        .when(code.isin(*DISCLOSURE), "explicit_disclosure_required")
        .when(code.isin(*CORE), "missing_expected_statement_inputs")
    )
    needs = F.create_map(*[x for name in CORE for x in (F.lit(name), F.array(*map(F.lit, AUDIT_INPUTS[name])))])
    required = F.coalesce(F.try_element_at(needs, code), F.array().cast("array<string>"))
    rows = audited.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return rows.select("entity", "kind", "metric_code", "period", "status", support.alias("support_class"), reason.alias("reason"), required.alias("required"))


def readiness_scopes(metric: DataFrame, parser: DataFrame, checks: DataFrame, *, market: DataFrame | None = None, peers: DataFrame | None = None, sources: DataFrame | None = None, threshold: float = 0.75) -> DataFrame:
    """(entity, scope, status, supported, blockers): five output scopes of each entity.

    market: entity, candles; peers: entity, compared_metrics; sources: entity, documents_blocked; an entity that isn't in one has
    no candles, comparable metrics or blocked documents.  Blocked documents, a failed parser or check hold the statement
    scope back and are its blockers.  Valuation needs inputs that no report holds.
    """
    rows = metric.select("entity", "calculated", "score", "blockers").join(parser.select("entity", F.col("status").alias("parser_status")), "entity").join(checks.select("entity", "failed_checks"), "entity", "left")
    for part, column in ((market, "candles"), (peers, "compared_metrics"), (sources, "documents_blocked")):
        rows = rows.hint("merge").join(part.select("entity", column).hint("merge"), "entity", "left") if part is not None else rows.withColumn(column, F.lit(None))
    blocked = F.coalesce(F.col("documents_blocked").cast("boolean"), F.lit(False))
    held = F.array_compact(F.array(F.when(blocked, "source_or_document_blocked"), F.when(F.col("parser_status").isin("parser_blocked", "fail"), "parser_blocked"), F.when(F.coalesce("failed_checks", F.lit(0)) > 0, "consistency_checks_failed")))
    rows = rows.withColumn("held", held)
    statement = F.when(F.size("held") > 0, F.when(F.col("calculated") > 0, "LOW_CONFIDENCE").otherwise("UNSUPPORTED")).when((F.col("score") >= threshold) & (F.col("calculated") > 0) & (F.col("blockers") == 0), "AUTO_READY").when(F.col("calculated") == 0, "UNSUPPORTED").otherwise("AUTO_PARTIAL")
    some = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) > 0
    scopes = {
        "statement_based_financials": statement, "market_technical_analysis": F.when(some("candles"), "AUTO_READY").otherwise("UNSUPPORTED"), "market_valuation": F.lit("UNAVAILABLE"),
        "peer_comparison": F.when(some("compared_metrics"), "AUTO_PARTIAL").otherwise("UNSUPPORTED"), "llm_summary": F.when(statement.isin("AUTO_READY", "AUTO_PARTIAL"), "AUTO_READY").otherwise("AUTO_PARTIAL"),
    }
    each = F.array(*[F.struct(F.lit(n).alias("scope"), s.alias("status"), (F.array_join("held", ",") if n == "statement_based_financials" else F.lit("")).alias("blockers")) for n, s in scopes.items()])
    return rows.select("entity", F.inline(each)).withColumn("supported", F.col("status").isin("AUTO_READY", "AUTO_PARTIAL"))


def auto_support(source_score: DataFrame, parser: DataFrame, metric: DataFrame, checks: DataFrame) -> DataFrame:
    """Weighted score and overall state an entity; source_score: entity, source_score, documents."""
    rows = parser.select("entity", F.col("status").alias("parser_status"), F.col("score").alias("parser_score"), "confident_ratio", "conflicts", "canonical").join(metric.select("entity", F.col("score").alias("metric_score"), F.col("status").alias("metric_status")), "entity").join(checks.select("entity", "penalty"), "entity", "left").join(source_score, "entity", "left")
    score = F.coalesce("source_score", F.lit(0.0)) * 0.25 + F.col("parser_score") * 0.45 + F.col("metric_score") * 0.30 - F.coalesce("penalty", F.lit(0.0))
    state = F.when(F.coalesce("documents", F.lit(0)) == 0, "SOURCE_BLOCKED").when(F.col("parser_status") == "parser_blocked", "PARSER_BLOCKED").when((F.col("confident_ratio") < 0.7) | (F.col("conflicts") > 0), "LOW_CONFIDENCE").otherwise("AUTO_PARTIAL")
    return rows.select("entity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"), state.alias("status"), "parser_status", "metric_status")


def support_report(parser: DataFrame, metric: DataFrame, checks: DataFrame, scopes: DataFrame, documents: DataFrame) -> DataFrame:
    """entity, status, document_status, fact_status, blockers (sorted array) and a flag for each of OUTPUTS.

    documents: entity, package_status, documents, passed, usable (those that passed or did in part), press, proper (those of either
    role).  Entities without a row there have no documents; without checks none failed; without scopes they support no output.
    """
    seen = documents.select("entity", "package_status", "documents", "passed", "usable", "press", "proper")
    supported = scopes.where("supported").groupBy("entity").agg(F.collect_set("scope").alias("scopes"))
    rows = parser.select("entity", F.col("status").alias("parser_status"), F.col("blockers").alias("parser_blockers"), "confident_ratio", "key_coverage", "conflicts", "canonical")
    rows = rows.join(metric.select("entity", "calculated", F.col("blockers").alias("metric_blockers")).hint("merge"), "entity")
    for part in (checks.select("entity", "failed_checks"), supported, seen):
        rows = rows.join(part.hint("merge"), "entity", "left")
    counts = ("documents", "passed", "usable", "press", "proper", "failed_checks")
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in counts})
    held = F.coalesce(F.col("package_status").isin(*BLOCKED_PACKAGES), F.lit(False))
    documents_status = F.when(held | (F.col("documents") == 0) | (F.col("usable") == 0), "blocked").when(F.col("passed") == F.col("documents"), "pass").otherwise("partial")
    rows = rows.withColumn("document_status", documents_status)
    own = F.array_compact(
        F.array(
            F.when(held, F.concat(F.lit("source_package_"), F.lower("package_status"))),
            F.when(F.col("documents") == 0, "no_documents"),
            F.when((F.col("document_status") == "blocked") & (F.col("documents") > 0), "no_document_passed"),
            F.when((F.col("press") > 0) & (F.col("proper") == 0), "press_releases_only"),
            F.when(F.col("metric_blockers") > 0, "valuation_without_market_inputs"),
            F.when(F.col("failed_checks") > 0, "consistency_checks_failed"),
        )
    )
    parsers = F.filter(F.split(F.coalesce("parser_blockers", F.lit("")), ","), lambda x: x != "")
    rows = rows.withColumn("blockers", F.array_sort(F.array_distinct(F.concat(own, parsers))))
    status = (
        F.when(F.col("document_status") == "blocked", "SOURCE_BLOCKED")
        .when(F.col("parser_status") == "parser_blocked", "PARSER_BLOCKED")
        .when((F.col("confident_ratio") < 0.7) | (F.col("conflicts") > 0), "LOW_CONFIDENCE")
        .otherwise("AUTO_PARTIAL")
    )
    facts = F.when(F.col("key_coverage") >= 0.8, "sufficient").when(F.col("canonical") > 0, "partial").otherwise("missing")
    has = lambda scope: F.coalesce(F.array_contains("scopes", scope), F.lit(False))
    outputs = {name: has(scope) & (F.col("calculated") > 0) if name == "financial_metrics" else has(scope) for name, scope in OUTPUTS.items()}
    return rows.select("entity", status.alias("status"), "document_status", facts.alias("fact_status"), "blockers", *[flag.alias(name) for name, flag in outputs.items()])


def peer_source_score(coverage: DataFrame, periods: list[str]) -> DataFrame:
    """Points for interim and year-end sources less penalties, and readiness; coverage: entity, period, source_role, trusted_domain, expected_file_type.

    The best ready candidate by (score, trusted sources, entity) is marked.
    """
    role, interim = F.col("source_role"), ("financial_statements", "financial_supplement")
    there = role.isNotNull() & (role != "missing")
    asked = F.col("period").isin(*periods)
    rows = coverage.groupBy("entity").agg(
        F.count_distinct(F.when(F.col("period").isin(*periods[:3]) & role.isin(*interim), F.col("period"))).alias("interim"), F.bool_or((F.col("period") == periods[-1]) & role.isin(*PROPER_ROLES)).alias("year_end"), F.count_if(there).alias("n"), F.count_if(role == "press_release").alias("press"),
        F.count_if(there & ~F.coalesce("trusted_domain", F.lit(False))).alias("untrusted"), F.count_if(role.isin(*PROPER_ROLES) & (F.col("expected_file_type") == "unknown")).alias("unknown_type"), F.count_if(asked & there & F.coalesce("trusted_domain", F.lit(False))).alias("trusted"), F.count_if(asked & role.isin(*PROPER_ROLES)).alias("proper"),
    )
    less = lambda test, k: F.when(test, k).otherwise(0)
    score = F.col("interim") + less(F.col("year_end"), 2) - less((F.col("n") > 0) & (F.col("press") == F.col("n")), 2) - less(F.col("untrusted") > 0, 3) - less(F.col("unknown_type") > 0, 2)
    readiness = F.when(F.col("year_end") & (F.col("interim") > 0), "READY_CANDIDATE").when(F.col("proper") > 0, "PARTIAL_CANDIDATE").otherwise("NOT_SUITABLE")
    rows = rows.select("entity", score.cast("long").alias("score"), "trusted", readiness.alias("readiness"))
    best = rows.where(F.col("readiness") == "READY_CANDIDATE").agg(F.max_by("entity", F.struct("score", "trusted", "entity")).alias("best"))
    return rows.join(F.broadcast(best), F.lit(True), "left").select("entity", "score", "trusted", "readiness", F.coalesce(F.col("entity") == F.col("best"), F.lit(False)).alias("recommended"))  # best is one row
