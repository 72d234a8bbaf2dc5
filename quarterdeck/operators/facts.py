"""Fact tables: scans, dedupe, reconciliation, comparison, coverage and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.numbers import economic_value

#: Fixed values.
QUALITY_FLAGS = ("exact", "derived", "low_confidence_parse", "manual_review_required", "missing", "conflicting_sources", "fixture", "high_confidence", "manual_verified", "reviewed")
SAFE_FLAGS = ("exact", "derived", "high_confidence", "manual_verified", "reviewed")
DROPPED_FLAGS = ("fixture", "low_confidence_parse", "conflicting_sources")
TEXT_FALLBACK = "text_table_fallback_semantic_gate"
ROLE_PRIORITY = {"manual_verified": 100, "financial_statements": 80, "financial_supplement": 70, "annual_report": 60, "press_release": 30, "fixture": 10}
OTHER_PRIORITY = 50
KEY_FACTS = ("revenue", "operating_profit", "net_income", "total_assets", "total_equity", "total_debt", "cash_and_equivalents", "current_assets", "current_liabilities", "operating_cash_flow", "capex", "ebitda")
KEY = ("entity", "period", "metric_code")


def scan_facts(df: DataFrame, period_from: str, period_to: str) -> DataFrame:
    """Normalise raw fact rows (all strings) and keep those of the range."""
    flag = F.lower(F.trim("quality_flag"))
    filled = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    return df.where(P.in_range(F.col("period"), period_from, period_to)).select(
        "entity", "period", F.regexp_replace(F.lower(F.trim("metric_code")), " ", "_").alias("metric_code"), F.col("value").try_cast("double").alias("value"),
        F.when(flag.isin(*QUALITY_FLAGS), flag).otherwise("manual_review_required").alias("quality_flag"), filled("currency", "RUB").alias("currency"),
        F.coalesce(F.col("unit_multiplier").try_cast("double"), F.lit(1.0)).alias("unit_multiplier"), filled("period_type", "quarter").alias("period_type"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"),
    )


def upsert_facts(existing: DataFrame, new: DataFrame, provenance: str) -> DataFrame:
    """Merge on (entity, document, period, metric, standard): own rows are overwritten, others' stay, the rest is added."""
    key = ["entity", "document_id", "period", "metric_code", "reporting_standard"]
    old = existing.select(*key, F.struct("value", "provenance").alias("old"))
    fresh = new.select(*key, F.col("value").alias("new_value"))
    rows = old.join(fresh, key, "full_outer")
    own = F.col("old.provenance") == provenance
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new_value").isNull(), "kept").when(own, "updated").otherwise("kept_foreign")
    return rows.select(
        *key, F.when(action.isin("inserted", "updated"), F.col("new_value")).otherwise(F.col("old.value")).alias("value"),
        F.when(action.isin("inserted", "updated"), F.lit(provenance)).otherwise(F.col("old.provenance")).alias("provenance"), action.alias("action"),
    )


def filter_eligible_facts(facts: DataFrame, period_from: str, period_to: str, *, standard: str = "IFRS", text_fallback: bool = False) -> DataFrame:
    """Facts that ratios may use: of the range, the quarter before it, and the year end before its last Q4."""
    a, b = P.range_bounds(period_from, period_to)
    i = P.period_index(F.col("period"))
    near = i.between(a - 1, b)
    if period_to.endswith("Q4"):
        near = near | (i == b - 4)
    keep = near & (F.col("reporting_standard") == standard) & ~F.col("quality_flag").isin(*DROPPED_FLAGS) & F.col("value").isNotNull()
    if not text_fallback and "extraction_method" in facts.columns:
        keep = keep & (F.coalesce("extraction_method", F.lit("")) != TEXT_FALLBACK)
    return facts.where(keep)


def fact_rank(flag: Column, method: Column | None = None) -> Column:
    """3 for safe flags, 1 for rows of the text fallback, else 2."""
    fallback = F.lit(False) if method is None else F.coalesce(method == "text_table_fallback", F.lit(False))
    return F.when(fallback, 1).when(flag.isin(*SAFE_FLAGS), 3).otherwise(2)


def rank_facts(facts: DataFrame, order: list[str]) -> DataFrame:
    """One fact a (entity, period, metric): highest trust (with extraction_method where there is one), then the first by order."""
    method = F.col("extraction_method") if "extraction_method" in facts.columns else None
    w = Window.partitionBy(*KEY).orderBy(F.desc(fact_rank(F.col("quality_flag"), method)), *order)
    return facts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def dedupe_candidates(facts: DataFrame) -> DataFrame:
    """Best confidence a (document, period, metric); of equals the largest value's row."""
    w = Window.partitionBy("document_id", "period", "metric_code").orderBy(F.desc("confidence"), F.desc("value"))
    return facts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def source_priority() -> Column:
    out = F.lit(OTHER_PRIORITY)
    for role, n in ROLE_PRIORITY.items():
        out = F.when(F.col("source_role") == role, n).otherwise(out)
    return F.coalesce(out, F.lit(OTHER_PRIORITY))


def reconcile_sources(facts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One fact a (entity, period, standard, metric, type): the top source's value, or none where top sources differ."""
    key = ["entity", "period", "reporting_standard", "metric_code", "period_type"]
    ranked = facts.withColumn("priority", source_priority())
    top = F.max("priority").over(Window.partitionBy(*key))
    ranked = ranked.withColumn("top", F.col("priority") == top)
    is_top = F.col("top")
    grouped = ranked.groupBy(*key).agg(
        F.count_if(is_top).alias("top_sources"), F.count_if(~is_top).alias("secondary_sources"), F.min(F.when(is_top, F.col("value"))).alias("low"), F.max(F.when(is_top, F.col("value"))).alias("high"),
        F.min_by("value", F.when(is_top, F.col("document_id"))).alias("first_value"), F.min_by("quality_flag", F.when(is_top, F.col("document_id"))).alias("first_flag"), F.min_by("confidence", F.when(is_top, F.col("document_id"))).alias("first_confidence"),
        F.array_join(F.array_sort(F.collect_list(F.when(is_top, F.col("document_id")))), ",").alias("references"), F.array_join(F.array_sort(F.collect_list(F.when(~is_top, F.col("document_id")))), ",").alias("secondary_references"),
    )
    conflict = (F.col("top_sources") > 1) & (F.col("high") - F.col("low") > tolerance)
    return grouped.select(
        *key, F.when(~conflict, F.col("first_value")).alias("value"), F.when(conflict, "conflicting_sources").otherwise(F.col("first_flag")).alias("quality_flag"),
        F.when(conflict, F.least("first_confidence", F.lit(0.5))).otherwise(F.col("first_confidence")).alias("confidence"), "references", "secondary_references", conflict.alias("is_conflict"),
    )


def conflict_breakdown(facts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Conflicting keys with their candidates' values and roles, and the likely reason."""
    key = ["entity", "period", "metric_code", "period_type"]
    rows = facts.groupBy(*key).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("candidates"), F.countDistinct("source_role").alias("roles"), F.array_join(F.array_sort(F.collect_set("source_role")), ",").alias("source_roles"))
    rows = rows.where(F.col("high") - F.col("low") > tolerance)
    return rows.withColumn("likely_reason", F.when(F.col("roles") > 1, "different_source_roles").otherwise("different_documents")).withColumn("advice", F.when(F.col("roles") > 1, "prefer_financial_statements").otherwise("review_documents")).drop("roles")


def primary_existing_fact(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity", "period", "metric_code", "period_type", "reporting_standard").orderBy(F.desc(source_priority()), F.desc("confidence"), "document_id")
    return facts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.lit(1e-6) * F.greatest(F.abs(a), F.abs(b)))


def compare_fact_sets(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Full outer compare on the whole key; what is left over pairs again without the period type."""
    key = ["entity", "period", "metric_code", "reporting_standard"]
    c = candidates.select(*key, F.col("period_type").alias("c_type"), F.col("value").alias("c_value"), F.col("source_role").alias("c_role"))
    e = existing.select(*key, F.col("period_type").alias("e_type"), F.col("value").alias("e_value"), F.col("source_role").alias("e_role"))
    same = (*key, "t")
    cw, ew = c.withColumn("t", F.col("c_type")), e.withColumn("t", F.col("e_type"))
    paired = cw.join(ew, [*same], "inner").drop("t")
    left_c = cw.join(ew.select(*same), [*same], "left_anti").drop("t")
    left_e = ew.join(cw.select(*same), [*same], "left_anti").drop("t")
    rows = paired.select(*key, "c_type", "c_value", "c_role", "e_type", "e_value", "e_role").unionByName(left_c.join(left_e, key, "full_outer").select(*key, "c_type", "c_value", "c_role", "e_type", "e_value", "e_role"))
    conflicts = F.array_compact(F.array(
        F.when(F.col("c_value").isNull(), "missing_in_candidates"), F.when(F.col("e_value").isNull(), "missing_in_existing"), F.when(~close_to(F.col("c_value"), F.col("e_value")), "value_conflict"),
        F.when(F.col("c_type") != F.col("e_type"), "period_type_conflict"), F.when(F.col("c_role") != F.col("e_role"), "source_role_conflict"),
    ))
    return rows.withColumn("conflicts", conflicts)


def persist_plan(compared: DataFrame) -> DataFrame:
    has = lambda x: F.array_contains("conflicts", x)
    action = F.when(has("value_conflict") | has("period_type_conflict"), "block").when(has("missing_in_existing"), "add").when(has("missing_in_candidates"), "skip").when(has("source_role_conflict"), "review").otherwise("corroborate")
    gate = F.when(action == "block", "resolve_conflict").when(action == "review", "manual_review").when(action == "add", "promotion_gate")
    return compared.withColumn("action", action).withColumn("required_gate", gate)


#: The trust bucket of facts that only text lines gave.
FALLBACK_BUCKET = "text_table_fallback_semantic_gate"


def trust_buckets(candidates: DataFrame) -> DataFrame:
    """(entity, bucket, candidates): candidates by the kind of their source, else how they were extracted, else unknown."""
    kind = F.coalesce(F.nullif("fact_source_kind", F.lit("")), F.nullif("extraction_method", F.lit("")), F.lit("unknown"))
    return candidates.groupBy("entity", kind.alias("bucket")).agg(F.count(F.lit(1)).alias("candidates"))


def persist_eligibility(compared: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Per entity: hard and soft conflicts, candidates, those of the fallback bucket, eligibility and next action.

    buckets: of trust_buckets.  Hard conflicts block; no candidates, soft conflicts, or more than half from text lines need review.
    """
    has = lambda x: F.array_contains("conflicts", x)
    rows = compared.groupBy("entity").agg(F.count_if(has("value_conflict") | has("period_type_conflict")).alias("hard_conflicts"), F.count_if(has("source_role_conflict")).alias("soft_conflicts"), F.count("c_value").alias("candidates"))
    if buckets is None:
        rows = rows.withColumns({"fallback": F.lit(0).cast("long"), "bucketed": F.lit(0).cast("long")})
    else:
        counts = buckets.groupBy("entity").agg(F.sum(F.when(F.col("bucket") == FALLBACK_BUCKET, F.col("candidates")).otherwise(0)).alias("fallback"), F.sum("candidates").alias("bucketed"))
        rows = rows.hint("merge").join(counts.hint("merge"), "entity", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fallback", "bucketed")})
    state = F.when(F.col("hard_conflicts") > 0, "blocked").when((F.col("candidates") == 0) | (F.col("soft_conflicts") > 0) | (2 * F.col("fallback") > F.col("bucketed")), "needs_review").otherwise("eligible")
    action = F.when(F.col("eligibility") == "blocked", "resolve_conflicts").when(F.col("eligibility") == "needs_review", "review_fallback_bucket").otherwise("run_gated_persist")
    return rows.withColumn("eligibility", state).withColumn("next_action", action).drop("bucketed")


def derive_total_debt(wide: DataFrame) -> DataFrame:
    """Explicit total, else one of the two pairs of parts that don't count the current portion twice."""
    col = lambda c: F.col(c) if c in wide.columns else F.lit(None).cast("double")
    pair1 = col("short_term_debt_including_current_portion") + col("long_term_debt_net_of_current_portion")
    pair2 = F.coalesce(col("total_short_term_debt_excluding_current_portion"), col("total_short_term_debt")) + F.coalesce(col("gross_long_term_debt"), col("total_long_term_debt_gross"))
    how = F.when(col("total_debt").isNotNull(), "explicit_total_debt").when(pair1.isNotNull(), "short_including_current + long_net").when(pair2.isNotNull(), "short_excluding_current + long_gross")
    return wide.withColumn("derived_total_debt", F.coalesce(col("total_debt"), pair1, pair2)).withColumn("derivation", how)


def fact_coverage_grid(facts: DataFrame, period_from: str, period_to: str, codes=KEY_FACTS) -> DataFrame:
    """Every entity's wanted periods and facts: missing, extracted, low_confidence or conflicting."""
    a, b = P.range_bounds(period_from, period_to)
    grid = facts.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(a), F.lit(b))).alias("i")).select("entity", P.period_from_index(F.col("i")).alias("period"), F.explode(F.array(*map(F.lit, codes))).alias("metric_code"))
    rows = grid.join(facts.select(*KEY, "value", "quality_flag").hint("merge"), [*KEY], "left")
    status = F.when(F.col("quality_flag").isNull(), "missing").when(F.col("quality_flag") == "conflicting_sources", "conflicting").when(F.col("quality_flag") == "low_confidence_parse", "low_confidence").otherwise("extracted")
    return rows.withColumn("status", status)


def missing_expected_facts(facts: DataFrame, expected=KEY_FACTS) -> DataFrame:
    entities = facts.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, expected))).alias("metric_code"))
    return entities.join(facts.select("entity", "metric_code").hint("merge"), ["entity", "metric_code"], "left_anti")


def fact_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"), F.count_if(F.col("quality_flag") == "low_confidence_parse").alias("low_confidence"),
        F.count_if(F.col("quality_flag") == "derived").alias("derived"), F.count_if(F.col("period_type") == "balance_sheet_snapshot").alias("snapshots"), F.count_if(F.col("period_type") == "ytd").alias("ytd"), F.count_if(F.col("period_type") == "annual").alias("annual"), F.countDistinct("period").alias("periods"),
    )


def extraction_status(summary: DataFrame) -> DataFrame:
    status = F.when(F.col("facts") == 0, "FAIL").when((F.col("low_confidence") > 0) | (F.col("high_confidence") < F.col("facts")), "PARTIAL").otherwise("PASS")
    return summary.select("entity", "facts", "low_confidence", status.alias("status"))


def parser_quality(facts: DataFrame, key_facts=KEY_FACTS, *, min_facts: int = 10, min_ratio: float = 0.8) -> DataFrame:
    """Score and status an entity: share of confident facts, key coverage of its periods, conflicts."""
    canonical = F.col("quality_flag") != "low_confidence_parse"
    sure = canonical & F.col("quality_flag").isin("exact", "derived") & (F.coalesce("confidence", F.lit(1.0)) >= 0.7)
    rows = facts.groupBy("entity").agg(
        F.count_if(canonical).alias("canonical"), F.count_if(sure).alias("confident"), F.count_if(F.col("quality_flag") == "conflicting_sources").alias("conflicts"),
        F.countDistinct("period").alias("periods"), F.countDistinct(F.when(canonical & F.col("metric_code").isin(*key_facts), F.struct("period", "metric_code"))).alias("found"),
    )
    ratio = F.coalesce(F.try_divide("confident", "canonical"), F.lit(0.0))
    coverage = F.coalesce(F.try_divide("found", F.col("periods") * len(key_facts)), F.lit(0.0))
    rows = rows.withColumn("confident_ratio", F.round(ratio, 4)).withColumn("key_coverage", F.round(coverage, 4))
    blockers = F.array_compact(F.array(F.when(F.col("canonical") == 0, "no_canonical_facts"), F.when(ratio < min_ratio, "low_confidence_ratio"), F.when(F.col("conflicts") > 0, "conflicts")))
    score = F.least(F.col("canonical") / min_facts, F.lit(1.0)) * 0.25 + ratio * 0.25 + coverage * 0.25 + F.when(F.col("conflicts") == 0, 0.15).otherwise(0.0) + F.when(F.col("canonical") > 0, 0.10).otherwise(0.0)
    status = F.when(F.col("canonical") == 0, "parser_blocked").when(F.size(blockers) > 0, "fail").when((coverage < 1) | (F.col("canonical") < min_facts), "partial").otherwise("pass")
    return rows.select("entity", "canonical", "confident", "conflicts", "confident_ratio", "key_coverage", F.round(score, 4).alias("score"), F.array_join(blockers, ",").alias("blockers"), status.alias("status"))


#: Roles that no primary fact may come from, and roles of documents that are counted.
FORBIDDEN_ROLES = ("press_release", "fixture")
COUNTED_ROLES = ("financial_statements", "financial_supplement", "annual_report", "press_release")


def parser_completeness(facts: DataFrame) -> DataFrame:
    """entity, source_location_complete, period_type_complete, statement_context_complete (false without canonical facts) and
    forbidden_roles (sorted array) of the facts that aren't of low confidence.

    facts: also trace, statement_type, source_role; empty strings count as null.
    """
    canonical = F.coalesce(F.col("quality_flag") != "low_confidence_parse", F.lit(True))
    lacks = lambda c: F.count_if(canonical & (F.coalesce(c, F.lit("")) == ""))
    forbidden = F.collect_set(F.when(canonical & F.col("source_role").isin(*FORBIDDEN_ROLES), F.col("source_role")))
    rows = facts.groupBy("entity").agg(F.count_if(canonical).alias("n"), lacks("trace").alias("t"), lacks("period_type").alias("p"), lacks("statement_type").alias("s"), F.array_sort(forbidden).alias("forbidden_roles"))
    whole = lambda c: (F.col("n") > 0) & (F.col(c) == 0)
    return rows.select("entity", whole("t").alias("source_location_complete"), whole("p").alias("period_type_complete"), whole("s").alias("statement_context_complete"), "forbidden_roles")


def traced_parser_quality(quality: DataFrame, completeness: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """parser_quality with what parser_completeness adds: its blockers, its status, and a tenth of the score for whole traces.

    documents: entity, of whatever columns; an entity without any is blocked (None: not asked).  blockers is a sorted array; a lack
    of statement context only makes a pass partial.
    """
    rows = quality.hint("merge").join(completeness.hint("merge"), "entity", "left")
    if documents is not None:
        rows = rows.join(documents.select("entity").distinct().withColumn("documented", F.lit(True)).hint("merge"), "entity", "left")
    else:
        rows = rows.withColumn("documented", F.lit(True))
    flags = ("source_location_complete", "period_type_complete", "statement_context_complete")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {"forbidden_roles": F.coalesce("forbidden_roles", F.array().cast("array<string>"))})
    own = F.array_compact(
        F.array(
            F.when(F.col("documented").isNull(), "no_source_documents"),
            F.when(F.size("forbidden_roles") > 0, "forbidden_source_roles"),
            F.when(~F.col("source_location_complete"), "source_location_missing"),
            F.when(~F.col("period_type_complete"), "period_type_missing"),
        )
    )
    blockers = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("blockers", ","), lambda x: x != ""), own)))
    score = F.col("score") - F.when((F.col("canonical") > 0) & ~(F.col("source_location_complete") & F.col("period_type_complete")), 0.10).otherwise(0.0)
    rows = rows.withColumns({"score": F.round(score, 4), "blockers": blockers})
    status = (
        F.when(F.col("canonical") == 0, "parser_blocked")
        .when(F.size("blockers") > 0, "fail")
        .when((F.col("status") == "pass") & ~F.col("statement_context_complete"), "partial")
        .otherwise(F.col("status"))
    )
    return rows.withColumn("status", status).select("entity", "score", "status", "blockers", *flags, "forbidden_roles")


def coverage_warnings(grid: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of fact_coverage_grid with warnings (array): not_extracted, or what a fact's trace lacks: source_url, source_location.

    facts: also source_url, trace; empty strings count as null.  Several facts of one key: what any of them lacks.
    """
    lacks = lambda c: F.bool_or(F.coalesce(c, F.lit("")) == "")
    traces = facts.groupBy(*KEY).agg(lacks("source_url").alias("u"), lacks("trace").alias("t"))
    rows = grid.hint("merge").join(traces.hint("merge"), [*KEY], "left")
    found = F.array_compact(F.array(F.when(F.col("u"), "source_url_missing"), F.when(F.col("t"), "source_location_missing")))
    return rows.withColumn("warnings", F.when(F.col("status") == "missing", F.array(F.lit("not_extracted"))).otherwise(found)).drop("u", "t")


def source_summary(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Per entity of either: documents by status and role, and facts by role, confidence, conflict and trace.

    documents: entity, status, source_role; facts: also source_role, source_url, trace.  A parsed document counts as downloaded too; a
    fact without a confidence isn't of low confidence.
    """
    role, status = F.col("source_role"), F.col("status")
    docs = documents.groupBy("entity").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(status.isin("downloaded", "parsed")).alias("downloaded"), F.count_if(status == "parsed").alias("parsed"), *[F.count_if(role == r).alias(f"documents_{r}") for r in COUNTED_ROLES]
    )
    flag, confidence = F.col("quality_flag"), F.col("confidence")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    found = facts.groupBy("entity").agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(role == "financial_statements").alias("facts_financial_statements"),
        F.count_if(role == "press_release").alias("facts_press_release"),
        F.count_if(flag.isin("exact", "derived") & (F.coalesce(confidence, F.lit(1.0)) >= 0.7)).alias("confident"),
        F.count_if((F.coalesce(flag, F.lit("")) == "low_confidence_parse") | (F.coalesce(confidence, F.lit(1.0)) < 0.7)).alias("low_confidence"),
        F.count_if(flag == "conflicting_sources").alias("conflicts"),
        F.count_if((F.col("period_type") == "quarter") & (flag == "derived")).alias("derived_quarters"),
        F.count_if(blank("source_url") | blank("trace")).alias("untraced"),
    )
    rows = docs.hint("merge").join(found.hint("merge"), "entity", "full_outer")
    return rows.select("entity", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in rows.columns if c != "entity"])


def extraction_verdict(summary: DataFrame, grid: DataFrame) -> DataFrame:
    """entity, status and missing_key_facts of source_summary, with the gaps of fact_coverage_grid.

    FAIL without documents, facts, confident facts or facts from statements, with press releases only, or where a fact has no
    trace; PASS if no key fact is missing, of low confidence or in conflict; else PARTIAL.
    """
    gaps = grid.groupBy("entity").agg(F.count_if(F.col("status") == "missing").alias("missing_key_facts"))
    rows = summary.hint("merge").join(gaps.hint("merge"), "entity", "left").withColumn("missing_key_facts", F.coalesce("missing_key_facts", F.lit(0).cast("long")))
    none = lambda c: F.col(c) == 0
    fail = none("documents") | none("facts") | none("confident") | none("facts_financial_statements") | (F.col("documents") == F.col("documents_press_release")) | (F.col("untraced") > 0)
    good = none("missing_key_facts") & none("low_confidence") & none("conflicts")
    return rows.select("entity", "missing_key_facts", F.when(fail, "FAIL").when(good, "PASS").otherwise("PARTIAL").alias("status"))


def consistency_checks(facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row a check and period: passed, and the two sides; checks without their inputs are left out."""
    codes = ["current_assets", "total_assets", "total_debt", "cash_and_equivalents", "total_liabilities", "total_equity"]
    wide = facts.where(F.col("value").isNotNull()).withColumn("v", economic_value(F.col("value"), F.col("unit_multiplier"))).groupBy("entity", "period").pivot("metric_code", codes).agg(F.max("v"))
    checks = [
        ("current_assets_lte_total_assets", F.col("current_assets"), F.col("total_assets"), F.col("current_assets") <= F.col("total_assets") + tolerance),
        ("total_debt_non_negative", F.col("total_debt"), F.lit(0.0), F.col("total_debt") >= -tolerance), ("cash_and_equivalents_non_negative", F.col("cash_and_equivalents"), F.lit(0.0), F.col("cash_and_equivalents") >= -tolerance),
        ("assets_equal_liabilities_plus_equity", F.col("total_assets"), F.col("total_liabilities") + F.col("total_equity"), F.abs(F.col("total_assets") - F.col("total_liabilities") - F.col("total_equity")) <= F.greatest(F.lit(tolerance), F.abs("total_assets") * 0.01)),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("check"), a.alias("left"), b.alias("right"), ok.alias("passed")) for n, a, b, ok in checks])
    return wide.select("entity", "period", F.inline(F.filter(each, lambda x: x["passed"].isNotNull())))


def metric_recompute_checks(metrics: DataFrame, facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """entity, period, check, left (the metric), right (what its inputs give) and passed, for free cash flow and debt to equity.

    Metrics without a value, without both inputs, or over no equity are left out.
    """
    codes = ["operating_cash_flow", "capex", "total_debt", "total_equity"]
    wide = facts.where(F.col("value").isNotNull()).withColumn("v", economic_value(F.col("value"), F.col("unit_multiplier"))).groupBy("entity", "period").pivot("metric_code", codes).agg(F.max("v"))
    asked = metrics.where(F.col("metric_code").isin("fcf", "debt_to_equity") & F.col("value").isNotNull()).select("entity", "period", "metric_code", "value")
    again = F.when(F.col("metric_code") == "fcf", F.col("operating_cash_flow") - F.col("capex")).otherwise(F.try_divide("total_debt", "total_equity"))
    rows = asked.hint("merge").join(wide.hint("merge"), ["entity", "period"]).withColumn("right", again).where(F.col("right").isNotNull())
    good = F.abs(F.col("value") - F.col("right")) <= F.greatest(F.lit(tolerance), F.abs("right") * 0.0001)
    return rows.select("entity", "period", F.concat("metric_code", F.lit("_recomputed")).alias("check"), F.col("value").alias("left"), "right", good.alias("passed"))


def duplicate_spread(facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Keys with several values and whether these are within a thousandth."""
    rows = facts.where(F.col("value").isNotNull()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("value").alias("low"), F.max("value").alias("high")).where("copies > 1")
    return rows.withColumn("passed", F.col("high") - F.col("low") <= F.greatest(F.lit(tolerance), F.abs("high") * 0.001))


def consistency_penalty(checks: DataFrame) -> DataFrame:
    return checks.groupBy("entity").agg(F.count_if("passed").alias("passed_checks"), F.count_if(~F.col("passed")).alias("failed_checks")).withColumn("penalty", F.least(F.lit(1.0), F.round(F.col("failed_checks") * 0.05, 4)))


def verify_golden(checks: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against actual values within the larger of 0.01 and 1 %."""
    rows = checks.join(actual.select(*KEY, F.col("value").alias("actual")), [*KEY], "left")
    ok = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.greatest(F.lit(0.01), F.abs("expected") * 0.01), F.lit(False))
    return rows.withColumn("passed", ok).withColumn("reason", F.when(F.col("actual").isNull(), "missing_actual").when(~ok, "value_outside_tolerance"))


def golden_accuracy(verified: DataFrame) -> DataFrame:
    return verified.groupBy("entity").agg(F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed_checks"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("accuracy")).withColumn("status", F.when(F.col("accuracy") == 1, "PASS").otherwise("FAIL"))


#: What tells golden checks apart; tables may lack the last three.
GOLDEN_KEY = ("entity", "period", "metric_code", "period_type", "source_role", "origin")


def sync_golden(existing: DataFrame, items: DataFrame) -> DataFrame:
    """Null-safe merge: review items fill actual values, the analyst's own fields stay, new items are added."""
    key = [c for c in GOLDEN_KEY if c in existing.columns and c in items.columns]
    e, i = existing.alias("e"), items.alias("i")
    on = None
    for c in key:
        test = F.col(f"e.{c}").eqNullSafe(F.col(f"i.{c}"))
        on = test if on is None else on & test
    return e.join(i, on, "full_outer").select(*[F.coalesce(F.col(f"e.{c}"), F.col(f"i.{c}")).alias(c) for c in key], F.coalesce("i.actual", "e.actual").alias("actual"), F.col("e.expected").alias("expected"), F.when(F.col("e.entity").isNull(), "added").when(F.col("i.entity").isNull(), "unchanged").otherwise("filled").alias("action"))


def review_pack(facts: DataFrame, categories: dict[str, tuple[str, ...]], limit: int) -> DataFrame:
    """A stratified pick an entity: the first fact of each category and period in turn, then others by (period, metric)."""
    order = F.lit(len(categories))
    for n, codes in reversed([*enumerate(categories.values())]):
        order = F.when(F.col("metric_code").isin(*codes), n).otherwise(order)
    rows = facts.withColumn("category", order)
    first = F.row_number().over(Window.partitionBy("entity", "category", "period").orderBy("metric_code", "value"))
    rows = rows.withColumn("stage", F.when((first == 1) & (F.col("category") < len(categories)), F.col("category")).otherwise(len(categories)))
    place = F.row_number().over(Window.partitionBy("entity").orderBy("stage", "period", "metric_code", "value"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("entity", "place", "period", "metric_code", "value", "stage")


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """Documents of one content hash collapse onto the first; a null text is a document of its own.

    With columns period and url, rows of one (period, url) collapse too, onto the first of them.
    """
    rows = docs.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    first = F.coalesce("first_id", "doc_id")
    if {"period", "url"} <= set(docs.columns):
        rows = rows.select("doc_id", "content_hash", "period", "url")  # no join carries texts
        linked = F.col("url").isNotNull() & F.col("period").isNotNull()
        links = rows.where(linked).groupBy("period", "url").agg(F.min("doc_id").alias("link_id"))
        alone = rows.where(~linked).select("doc_id", "content_hash", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("link_id"))  # of one key, they'd meet in one task
        rows = rows.where(linked).hint("merge").join(links.hint("merge"), ["period", "url"]).select("doc_id", "content_hash", "link_id").unionByName(alone)
        first = F.least(first, "link_id")
    else:
        rows = rows.select("doc_id", "content_hash")
    firsts = rows.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return rows.hint("merge").join(firsts.hint("merge"), "content_hash", "left").select("doc_id", "content_hash", first.alias("first_id"), (first != F.col("doc_id")).alias("is_duplicate"))


def resolve_document_periods(facts: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """The latest period found in each document, unless one is forced."""
    latest = facts.groupBy("document_id").agg(F.max(P.period_index(F.col("period"))).alias("i"))
    if forced is not None:
        latest = latest.join(forced.select("document_id", F.col("period").alias("forced")), "document_id", "left")
    else:
        latest = latest.withColumn("forced", F.lit(None).cast("string"))
    return latest.select("document_id", F.coalesce("forced", P.period_from_index(F.col("i"))).alias("period"))


def relabel_periods(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """A document's periods, newest first, become the target, the target less one quarter, and so on (a Q4 target: years)."""
    place = F.dense_rank().over(Window.partitionBy("document_id").orderBy(F.desc(P.period_index(F.col("period"))))) - 1
    rows = facts.withColumn("place", place).join(targets.select("document_id", P.period_index(F.col("period")).alias("target")), "document_id")
    step = F.when(F.pmod("target", F.lit(4)) == 3, 4).otherwise(1)
    return rows.withColumn("new_period", P.period_from_index(F.col("target") - F.col("place") * step)).drop("place", "target")


def ytd_to_quarter(facts: DataFrame) -> DataFrame:
    """Standalone quarters from year-to-date values three months apart in one year; both must be year-to-date."""
    i = P.period_index(F.col("period"))
    w = Window.partitionBy("entity", "metric_code", F.floor(i / 4)).orderBy(i)
    rows = facts.where(F.col("period_type") == "ytd").withColumn("i", i)
    rows = rows.withColumns({"before": F.lag("value").over(w), "gap": F.col("i") - F.lag("i").over(w), "least": F.least("confidence", F.lag("confidence").over(w))})
    return rows.where((F.col("gap") == 1) & F.col("value").isNotNull() & F.col("before").isNotNull()).select("entity", "period", "metric_code", (F.col("value") - F.col("before")).alias("value"), F.lit("quarter").alias("period_type"), F.lit("derived").alias("quality_flag"), F.col("least").alias("confidence"))


def periods_between(spark: SparkSession, period_from: str, period_to: str) -> DataFrame:
    a, b = P.range_bounds(period_from, period_to)
    return spark.range(a, b + 1).select(P.period_from_index(F.col("id")).alias("period"))


def augment_analysis(old: DataFrame, added: DataFrame) -> DataFrame:
    """The facts of an analysis with more documents: the largest value of each key, and what that changes."""
    from .metrics import result_delta

    best = lambda df: df.groupBy(*KEY).agg(F.max("value").alias("value"))
    return result_delta(best(old), best(old.unionByName(added)))
