"""Portfolio roll-ups, searches, catalogues and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.numbers import contains_any
from ..functions.text import matching_text, topic_tags

#: Fixed values.
BANK_MARKERS = ("bank", "банк", "credit institution", "кредитн")
FINANCIAL_MARKERS = ("exchange", "бирж", "insurance", "страх", "leasing", "лизинг", "financial", "финанс")
CLASS_TICKERS = {"industrial_ifrs_retail": ("MGNT", "X5", "FIVE"), "industrial_ifrs_oil_gas": ("LKOH", "GAZP", "ROSN", "SIBN", "TATN", "NVTK"), "industrial_ifrs_metals_mining": ("GMKN", "PLZL", "CHMF", "MAGN", "PHOR")}


def resolve_entity(hits: DataFrame) -> DataFrame:
    return hits.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("e")).select("q", F.when(F.col("n") == 1, F.col("e")).alias("entity"))


def issuer_class(registry: DataFrame) -> DataFrame:
    identity = F.lower(F.concat_ws(" ", "sector", "subsector", "name", F.array_join("aliases", " ")))
    out = F.when(contains_any(identity, BANK_MARKERS), "bank_ifrs").when(contains_any(identity, FINANCIAL_MARKERS), "financial_non_bank_ifrs")
    for name, tickers in CLASS_TICKERS.items():
        out = out.when(F.col("entity").isin(*tickers), name)
    return registry.select("entity", out.otherwise("industrial_ifrs_general").alias("issuer_class"))


def load_registry(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows, and new ones whose entity isn't there."""
    return existing.unionByName(new.join(existing.select("entity"), "entity", "left_anti"))


def tag_topics(docs: DataFrame, topics=None) -> DataFrame:
    # bound in a projection of its own, so that the two patterns of the normal form run once a text
    normal = docs.select("doc_id", matching_text(F.col("text")).alias("normal"))
    return normal.select("doc_id", topic_tags(F.col("normal"), topics).alias("tags")).withColumn("relevance", F.when(F.size("tags") >= 2, "high").when(F.size("tags") == 1, "medium").otherwise("low"))


def topic_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("tags").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("items"))


def top_n_by_value(registry: DataFrame, n: int) -> DataFrame:
    """The n entities of largest non-zero capitalisation, ranked."""
    rows = registry.where(F.coalesce("capitalisation", F.lit(0.0)) != 0).orderBy(F.desc("capitalisation"), "entity").limit(n)
    return rows.select("entity", "name", "capitalisation", F.row_number().over(Window.orderBy(F.desc("capitalisation"), "entity")).alias("rank"))  # over n rows


def documents_status(facts: DataFrame, period_from: str, period_to: str) -> DataFrame:
    """Which asked periods each entity has documents for."""
    a, b = P.range_bounds(period_from, period_to)
    got = facts.groupBy("entity").agg(F.count_distinct(F.when(P.period_index(F.col("period")).between(a, b), F.col("period"))).alias("periods"))
    return got.withColumn("status", F.when(F.col("periods") == b - a + 1, "complete").when(F.col("periods") == 0, "missing").otherwise("partial"))


def blocker_summary(items: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Blockers by number of entities, with the first five; items: entity, blockers (array)."""
    order = F.lit(99)
    for code, n in priority.items():
        order = F.when(F.col("blocker") == code, n).otherwise(order)
    rows = items.select("entity", F.explode("blockers").alias("blocker")).distinct()
    place = F.row_number().over(Window.partitionBy("blocker").orderBy("entity"))
    sample = rows.withColumn("p", place).where("p <= 5").groupBy("blocker").agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("sample"))
    counts = rows.groupBy("blocker").agg(F.count(F.lit(1)).alias("entities"))
    return counts.join(sample.hint("merge"), "blocker").withColumn("priority", order)


#: What makes a document cached, the roles that count, and per count of ready_counts the column and its values.
CACHED = ("downloaded", "parsed", "validated")
STATEMENT_ROLES = ("financial_statements", "financial_supplement", "annual_report")
READY = {
    "source_ready_count": ("source_status", ("READY",)), "cached_documents_ready_count": ("documents_status", ("CACHED_VALIDATED",)), "statement_scope_auto_ready_count": ("statement_status", ("AUTO_READY",)),
    "statement_scope_auto_partial_count": ("statement_status", ("AUTO_PARTIAL",)), "market_technical_ready_count": ("market_status", ("AUTO_READY",)), "valuation_unavailable_count": ("valuation_status", ("UNAVAILABLE", "UNSUPPORTED")),
}


def cached_documents_status(entities: DataFrame, documents: DataFrame, period_from: str, period_to: str) -> DataFrame:
    """entity and documents_status: NOT_CACHED, else CACHED_VALIDATED or CACHED_PARTIAL by whether the cached documents cover every
    quarter of the range, with _MANUAL if all, _WITH_MANUAL if some were uploaded by hand.

    documents: entity, period, source_type, status, source_role; fixtures, other roles and documents not downloaded don't count.
    """
    a, b = P.range_bounds(period_from, period_to)
    kind = F.coalesce("source_type", F.lit(""))
    kept = documents.where(F.col("status").isin(*CACHED) & F.col("source_role").isin(*STATEMENT_ROLES) & (kind != "fixture")).withColumn("i", P.period_index(F.col("period"))).where(F.col("i").between(a, b))
    seen = kept.groupBy("entity").agg(F.count_distinct("i").alias("n"), F.bool_and(kind == "manual_upload").alias("all_manual"), F.bool_or(kind == "manual_upload").alias("some_manual"))
    rows = entities.select("entity").distinct().hint("merge").join(seen.hint("merge"), "entity", "left")
    cover = F.when(F.col("n") == b - a + 1, "CACHED_VALIDATED").otherwise("CACHED_PARTIAL")
    by_hand = F.when(F.col("all_manual"), "_MANUAL").when(F.col("some_manual"), "_WITH_MANUAL").otherwise("")
    return rows.select("entity", F.when(F.col("n").isNull(), "NOT_CACHED").otherwise(F.concat(cover, by_hand)).alias("documents_status"))


def ready_counts(statuses: DataFrame) -> DataFrame:
    """One row: entities scanned, and those in each state of READY; statuses: entity and READY's columns.  Null states count nowhere."""
    return statuses.agg(F.count(F.lit(1)).alias("companies_scanned"), *[F.count_if(F.col(c).isin(*values)).alias(name) for name, (c, values) in READY.items()])


def scope_readiness(audited: DataFrame, quality: DataFrame, statement: DataFrame, items: DataFrame, packages: DataFrame) -> DataFrame:
    """entity, status, score, legacy_score (valid share of all metrics), missing_facts, next_action and weakest of each entity of quality.

    statement: entity, status (of the statement scope); items of metric_quality_items; packages: entity, status.  missing_facts counts
    the pairs of a metric that is expected but missing and a fact it needs.  The weakest is the entity that isn't ready with the
    lowest score, then most missing facts, then name.
    """
    share = audited.groupBy("entity").agg(F.round(F.count_if(F.col("status") == "valid") / F.count(F.lit(1)), 4).alias("legacy_score"))
    wanted = items.where(F.col("kind") == "missing_but_expected").select("entity", "metric_code", F.explode("required").alias("fact"))
    gaps = wanted.groupBy("entity").agg(F.count_distinct("fact", "metric_code").alias("missing_facts"), F.collect_set("fact").alias("facts"))
    rows = quality.select("entity", "score")
    for part in (statement.select("entity", "status"), share, gaps, packages.select("entity", F.col("status").alias("package"))):
        rows = rows.join(part.hint("merge"), "entity", "left")
    rows = rows.withColumns({"status": F.coalesce("status", F.lit("UNSUPPORTED")), "missing_facts": F.coalesce("missing_facts", F.lit(0).cast("long")), "facts": F.coalesce("facts", F.array().cast("array<string>"))})
    has = lambda *names: [F.array_contains("facts", n) for n in names]
    assets, liabilities = has("current_assets", "current_liabilities")
    profit, income, cash, capex = has("operating_profit", "net_income", "operating_cash_flow", "capex")
    action = (
        F.when(F.coalesce("package", F.lit("")) != "READY", "resolve_source_package")
        .when(F.col("status") == "AUTO_READY", "extend_other_scopes")
        .when(assets & liabilities, "inspect_balance_sheet")
        .when(profit | income, "inspect_income_statement")
        .when(cash | capex, "inspect_cash_flow")
        .otherwise("review_missing_inputs")
    )
    rows = rows.withColumn("next_action", action)
    worst = rows.where(F.col("status") != "AUTO_READY").agg(F.min_by("entity", F.struct("score", -F.col("missing_facts"), "entity")).alias("worst"))
    rows = rows.join(F.broadcast(worst), F.lit(True), "left")  # worst is one row
    return rows.select("entity", "status", "score", "legacy_score", "missing_facts", "next_action", F.coalesce(F.col("entity") == F.col("worst"), F.lit(False)).alias("weakest"))


def with_links(top: DataFrame, ids: DataFrame, portal: str) -> DataFrame:
    """Rows of top_n_by_value with the company's page and report lists on a disclosure portal, or only terms to search for.

    ids: entity, company_id, names (array).  Files of types 4, 3 and 2 are consolidated, standalone and annual reports.  search_terms are
    the names, the entity and its own name, each once; without a company_id the links are null.
    """
    rows = top.hint("merge").join(ids.select("entity", "company_id", "names").hint("merge"), "entity", "left")
    number = F.nullif(F.trim("company_id"), F.lit(""))
    terms = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(F.col("entity"), F.col("name")))
    terms = F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != ""))
    files = {f"files_type_{t}_url": F.concat(F.lit(f"{portal}/files.aspx?id="), number, F.lit(f"&type={t}")) for t in (4, 3, 2)}
    status = F.when(number.isNotNull(), "known_company_id").otherwise("search_only")
    return rows.withColumns({"company_url": F.concat(F.lit(f"{portal}/company.aspx?id="), number), **files, "search_terms": terms, "link_status": status}).drop("company_id", "names")


def coverage_level(summary: DataFrame) -> DataFrame:
    """An ordered cascade on counts of calculated and blocked metrics, and the blockers behind it."""
    level = F.when(F.col("calculated_count") == 0, "no_coverage").when(F.col("calculated_count") < F.col("missing_count"), "limited").when(F.col("blocked_count") > 0, "partial").otherwise("full")
    blockers = F.array_compact(F.array(F.when(F.col("missing_count") > 0, "missing_facts"), F.when(F.col("blocked_count") > 0, "period_semantics"), F.when(F.col("unsupported_count") > 0, "sector_policy"), F.lit("valuation_inputs")))
    return summary.select("entity", level.alias("level"), blockers.alias("blockers"))


def coverage_counts(levels: DataFrame, names=("full", "partial", "limited", "no_coverage")) -> DataFrame:
    """Entities a level; levels without any stay, with zero."""
    dim = levels.sparkSession.createDataFrame([(n,) for n in names], "level string")
    return dim.join(levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0).cast("long")).alias("entities"))


def metric_feed(ratios: DataFrame, facts: DataFrame) -> DataFrame:
    """Ratios, then facts; of one (entity, kind, code, period) the first stays."""
    r = ratios.select("entity", F.lit("ratio").alias("kind"), "metric_code", "period", "value", F.when(F.col("status") == "calculated", "exact").otherwise("missing").alias("quality_flag"), F.lit(0).alias("o"))
    f = facts.select("entity", F.lit("fact").alias("kind"), "metric_code", "period", "value", "quality_flag", F.lit(1).alias("o"))
    w = Window.partitionBy("entity", "kind", "metric_code", "period").orderBy("o", F.desc("value"))
    return r.unionByName(f).withColumn("p", F.row_number().over(w)).where("p = 1").drop("p", "o")


def data_quality(facts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Union of quality flags and one overall state an entity."""
    rows = facts.select("entity", "quality_flag").unionByName(metrics.select("entity", "quality_flag")).groupBy("entity").agg(F.array_sort(F.collect_set("quality_flag")).alias("flags"))
    has = lambda x: F.array_contains("flags", x)
    overall = F.when(has("fixture"), "fixture").when(has("conflicting_sources"), "conflicting").when(has("low_confidence_parse"), "low_confidence").when(has("missing"), "partial").otherwise("good")
    return rows.select("entity", F.array_join("flags", ",").alias("flags"), overall.alias("overall"))


def analysis_history(results: DataFrame, limit: int) -> DataFrame:
    """The newest results of each company; results: entity, result_id, created."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("created"), F.desc("result_id")))
    return results.withColumn("place", place).where(F.col("place") <= limit)


def assemble_payload(facts: DataFrame, metrics: DataFrame, quality: DataFrame) -> DataFrame:
    """One JSON document an entity from its facts, metrics and quality."""
    f = facts.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("period", "metric_code", "value", "quality_flag"))).alias("facts"))
    m = metrics.where(F.col("value").isNotNull()).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("period", "metric_code", "value"))).alias("metrics"))
    rows = f.join(m, "entity", "left").join(quality, "entity", "left")
    return rows.select("entity", F.to_json(F.struct("entity", "facts", "metrics", "overall")).alias("payload"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line an entity and period range, in a folder an entity."""
    reports.write.mode("overwrite").partitionBy("entity").json(path)


def source_catalog(catalog: DataFrame, banks: DataFrame) -> DataFrame:
    """Catalogue rows overlaid with bank rows: a bank's own fields come first."""
    own = banks.select("entity", F.col("status").alias("bank_status"), F.col("hint").alias("bank_hint"))
    rows = catalog.join(own, "entity", "left")
    return rows.select("entity", "name", F.coalesce("bank_status", "status").alias("status"), F.coalesce("bank_hint", F.lit("manual_upload")).alias("hint"), F.col("bank_status").isNotNull().alias("is_bank_row"))


def ready_blockers(audited: DataFrame, facts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(entity, fact, metric) → periods in which the metric is missing for want of the fact. inputs: metric_code, input."""
    wanted = audited.where(F.col("status") == "missing").join(inputs, "metric_code").withColumnRenamed("input", "fact_code")
    gaps = wanted.join(facts.select("entity", "period", F.col("metric_code").alias("fact_code")), ["entity", "period", "fact_code"], "left_anti")
    return gaps.groupBy("entity", "fact_code", "metric_code").agg(F.array_join(F.array_sort(F.collect_set("period")), ",").alias("periods"))


# Levels that make a company's main status, and what a blocker asks for.
MAIN_STATUS = {"FULL_STATEMENT_READY": "READY", "PARTIAL_STATEMENT_READY": "PARTIAL"}
ACTIONS = {
    "missing_fy_report": "Improve FY/12M source acquisition, provider access, or use manual upload fallback for an official FY report.",
    "image_only_primary_statement_pages": "Design OCR/table-image extraction or obtain an alternative machine-readable official source.",
}
READY_ACTION = "Package current official pipeline, comparison evidence, and scoped readiness for demo/API presentation."


def portfolio_companies(coverage: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a company: main_status, coverage_level, outputs, blockers, notes and recommended_action.

    coverage: entity, coverage_level, blockers (array), main_blocker, outputs (array), next_action; evidence: entity and counts
    statement_tables, fact_candidates, matched_facts, manual_documents, candles, peers, compared_metrics, of which any may
    be null.  Companies without evidence keep what coverage says; a company of a level that isn't ready is blocked.
    """
    rows = coverage.hint("merge").join(evidence.hint("merge"), "entity", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    none = F.array().cast("array<string>")
    found = F.array_compact(F.array(
        F.when(has("statement_tables"), "statement_tables"), F.when(has("statement_tables"), "dataframe_artifacts"), F.when(has("fact_candidates"), "fact_candidates"), F.when(has("matched_facts"), "fact_candidate_comparison"),
        F.when(has("manual_documents"), "manual_document_analysis"), F.when(has("candles"), "market_technical_analysis"), F.when(has("peers"), "peer_selection"), F.when(has("compared_metrics"), "peer_comparison_report"),
    ))
    status = F.lit("BLOCKED")
    for level, name in MAIN_STATUS.items():
        status = F.when(F.col("coverage_level") == level, name).otherwise(status)
    ready = F.col("coverage_level") == "FULL_STATEMENT_READY"
    notes = F.array_compact(F.array(F.when(ready, "scoped_readiness_only"), F.when(has("matched_facts"), "candidates_are_audit_only"), F.when(has("manual_documents"), "manual_upload_is_lower_trust")))
    action = F.when(ready, READY_ACTION)
    for blocker, text in ACTIONS.items():
        action = action.when(F.col("main_blocker") == blocker, text)
    return rows.select(
        "entity", status.alias("main_status"), "coverage_level", F.array_sort(F.array_distinct(F.concat(F.coalesce("outputs", none), found))).alias("outputs"), F.array_distinct(F.coalesce("blockers", none)).alias("blockers"), notes.alias("notes"),
        action.otherwise(F.coalesce("next_action", F.lit("Review blockers."))).alias("recommended_action"),
    )


def portfolio_report(companies: DataFrame, sample: int = 5) -> DataFrame:
    """(section, key, companies, entities): totals of portfolio_companies by main status, coverage level, output and blocker, and
    over all, with the first few companies of each, by name.

    All sections are counted in one pass, in which a company counts once for each of its keys.  An empty portfolio has a total of 0.
    """
    label = lambda name, c: F.struct(F.lit(name).alias("section"), c.alias("key"))
    of = F.concat(
        F.array(label("total", F.lit("companies")), label("main_status", F.col("main_status")), label("coverage_level", F.col("coverage_level"))),
        F.transform("blockers", lambda b: label("blocker", b)), F.transform("outputs", lambda o: label("output", o)),
    )
    rows = companies.select("entity", F.explode(of).alias("x")).select("entity", "x.section", "x.key")
    counts = rows.groupBy("section", "key").agg(F.count(F.lit(1)).alias("companies"))
    place = F.row_number().over(Window.partitionBy("section", "key").orderBy("entity"))
    first = rows.withColumn("place", place).where(F.col("place") <= sample).groupBy("section", "key").agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("entities"))
    empty = companies.groupBy().agg(F.count(F.lit(1)).alias("companies")).where("companies = 0").select(F.lit("total").alias("section"), F.lit("companies").alias("key"), "companies", F.lit("").alias("entities"))
    return counts.hint("merge").join(first.hint("merge"), ["section", "key"]).unionByName(empty)


# Blockers of sources and of parsers, the order in which blockers count, and what each asks for.
SOURCE_BLOCKERS = (
    "company_not_resolved", "ambiguous_company_identity", "no_trusted_source_candidates", "missing_period_report", "missing_fy_report", "source_package_not_ready", "tls_download_failed", "document_validation_failed", "wrong_document_role",
)
PARSER_BLOCKERS = (
    "no_cached_documents", "no_primary_statement_tables", "image_only_primary_statement_pages", "table_extraction_failed", "toc_or_notes_only", "no_safe_fact_candidates", "text_fallback_requires_gate", "notes_rejected", "ambiguous_period_column",
    "missing_source_location", "low_confidence_labels", "missing_expected_statement_facts",
)
BLOCKER_ORDER = {
    "company_not_resolved": 0, "ambiguous_company_identity": 1, "missing_fy_report": 2, "missing_period_report": 3, "source_package_not_ready": 4, "image_only_primary_statement_pages": 5, "no_cached_documents": 6, "no_primary_statement_tables": 7,
    "no_safe_fact_candidates": 8, "missing_expected_statement_facts": 9, "official_source_missing": 10, "manual_upload_available": 11, "unavailable_valuation_inputs": 50,
}
BLOCKER_ACTIONS = {
    "missing_fy_report": "Improve official FY/12M report discovery or source acquisition.",
    "missing_period_report": "Improve financial report discovery for missing periods.",
    "source_package_not_ready": "Verify source package candidates before downstream parsing.",
    "no_cached_documents": "Run explicit download/validation stage for trusted candidates.",
    "image_only_primary_statement_pages": "Design an OCR/table-image extraction module.",
    "no_primary_statement_tables": "Improve statement table extraction for primary statements.",
    "no_safe_fact_candidates": "Improve DataFrame parser or semantic extraction gates after table artifacts are clean.",
    "missing_expected_statement_facts": "Extend statement fact mapping for expected statement inputs.",
    "official_source_missing": "Manual upload is available, but official source discovery/source package remains unresolved.",
    "manual_upload_available": "Use manual upload only as a fallback; keep official source acquisition as separate work.",
    "unavailable_valuation_inputs": "Build a separate valuation input module; do not treat as parser work.",
}
OTHER_ACTION, NO_BLOCKER_ACTION = "Inspect blocker details and add the narrowest safe pipeline improvement.", "Coverage is usable for the available scoped outputs."
LAST_ORDER, VALUATION_BLOCKER = 100, "unavailable_valuation_inputs"


def _chosen(names: dict, key: Column, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), F.lit(other))


def coverage_levels(items: DataFrame) -> DataFrame:
    """entity, coverage_level (of six), supported and unsupported outputs, blockers, main_blocker and next_action.

    items: entity, statement_scope, market_scope, documents, table_status, fact_status, blockers (array).  Statements that are
    ready count first, then blockers of sources, tables with all facts, blockers of parsers or tables that failed, any documents or
    facts, and a market analysis.  The main blocker is the first by BLOCKER_ORDER, then name.  Nulls count as nothing known.
    """
    none = F.array().cast("array<string>")
    rows = items.withColumn("blockers", F.array_distinct(F.coalesce("blockers", none)))
    any_of = lambda names: F.arrays_overlap("blockers", F.array(*map(F.lit, names)))
    said = lambda c, *names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    market = said("market_scope", "AUTO_READY", "AUTO_PARTIAL")
    level = (
        F.when(said("statement_scope", "AUTO_READY"), "FULL_STATEMENT_READY").when(any_of(SOURCE_BLOCKERS), "SOURCE_BLOCKED").when(said("table_status", "TABLES_READY", "TABLES_PARTIAL") & said("fact_status", "FACTS_READY"), "FULL_STATEMENT_READY")
        .when(any_of(PARSER_BLOCKERS) | said("table_status", "IMAGE_ONLY_PRIMARY_STATEMENTS", "NO_PRIMARY_STATEMENTS", "EXTRACTION_FAILED"), "PARSER_BLOCKED")
        .when((F.coalesce("documents", F.lit(0)) > 0) | said("fact_status", "FACTS_READY", "FACTS_PARTIAL"), "PARTIAL_STATEMENT_READY").when(market, "MARKET_ONLY").otherwise("UNSUPPORTED")
    )
    rows = rows.withColumn("coverage_level", level)
    ready = F.col("coverage_level").isin("FULL_STATEMENT_READY", "PARTIAL_STATEMENT_READY")
    listed = lambda *tests: F.array_sort(F.array_compact(F.array(*[F.when(t, name) if t is not None else F.lit(name) for name, t in tests])))
    supported = listed(("financial_facts", ready), ("financial_metrics", ready), ("market_analysis", market), ("manual_document_analysis", F.array_contains("blockers", "manual_upload_available")))
    held = any_of(SOURCE_BLOCKERS + PARSER_BLOCKERS)
    missing = listed(("valuation_metrics", None), ("peer_comparison", None), ("llm_payload", None), ("financial_facts", held), ("financial_metrics", held), ("market_analysis", said("market_scope", "UNSUPPORTED")))
    main = F.array_min(F.transform("blockers", lambda b: F.struct(_chosen(BLOCKER_ORDER, b, LAST_ORDER).alias("o"), b.alias("b"))))["b"]
    action = F.when(main.isNull(), NO_BLOCKER_ACTION).otherwise(_chosen(BLOCKER_ACTIONS, main, OTHER_ACTION))
    return rows.select("entity", "coverage_level", supported.alias("supported"), missing.alias("unsupported"), "blockers", main.alias("main_blocker"), action.alias("next_action"))


def blocker_actions(levels: DataFrame, sample: int = 5, top: int = 5) -> DataFrame:
    """blocker, entities, sample (the first few by name), priority, action, place, is_top and is_next, a row a blocker.

    levels: entity, blockers (array).  Blockers rank by entities, BLOCKER_ORDER and name; is_next marks the first that isn't the
    want of valuation inputs, or that if there is no other.
    """
    rows = levels.select("entity", F.explode(F.array_distinct("blockers")).alias("blocker"))
    counts = rows.groupBy("blocker").agg(F.count_distinct("entity").alias("entities"))
    placed = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("blocker").orderBy("entity"))).where(F.col("n") <= sample)
    shown = placed.groupBy("blocker").agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("sample"))
    out = counts.hint("merge").join(shown.hint("merge"), "blocker").withColumn("priority", _chosen(BLOCKER_ORDER, F.col("blocker"), LAST_ORDER))
    order = (F.desc("entities"), "priority", "blocker")
    apart = (F.col("blocker") == VALUATION_BLOCKER).cast("int")
    first = F.row_number().over(Window.orderBy(apart, *order)) == 1  # over the names of blockers
    place = F.row_number().over(Window.orderBy(*order))
    return out.withColumns({"action": _chosen(BLOCKER_ACTIONS, F.col("blocker"), OTHER_ACTION), "place": place, "is_next": first}).withColumn("is_top", F.col("place") <= top)
