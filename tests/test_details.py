"""Nulls, ties, repeats and empty tables of the operators behind verdicts."""

import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import candidates as D
from quarterdeck.operators import facts as A
from quarterdeck.operators import gates as G
from quarterdeck.operators import metrics as M
from quarterdeck.operators import peers as E

METRICS = "entity string, period string, metric_code string, value double, quality_flag string, warning string"
FACTS = "entity string, period string, metric_code string, value double, quality_flag string, period_type string, confidence double, statement_type string, source_role string, source_url string, trace string"
DOCUMENTS = "entity string, status string, source_role string"


def fact(entity="a", code="revenue", flag="exact", kind="ytd", role="financial_statements", url="u", trace="p", confidence=0.9, family="income_statement"):
    return (entity, "2020Q1", code, 1.0, flag, kind, confidence, family, role, url, trace)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_findings_keep_own_warnings_first(spark):
    metrics = spark.createDataFrame(
        [
            ("a", "2020Q1", "roe", 0.1, "exact", "Average equity unavailable"), ("a", "2020Q1", "net_margin", 0.1, "exact", None), ("a", "2020Q1", "fcf", None, "missing", None),
            ("a", "2020Q1", "pe_ratio", None, "missing", "no price"), ("a", "2020Q1", None, 1.0, None, None), (None, "2020Q1", "roa", 0.1, "exact", None), ("a", "2020Q1", "current_ratio", 1.0, "exact", None),
        ],
        METRICS,
    )
    facts = spark.createDataFrame([fact(code="net_income"), fact(code="revenue", flag=None, kind="annual"), fact(code="total_equity"), fact(code="current_assets", kind="quarter")], FACTS)
    rows = by(M.audit_findings(metrics, facts), "entity", "metric_code")
    roe = rows["a", "roe"]
    assert roe.warnings == ["Average equity unavailable", "income_over_snapshots"] and roe.questionable_reason == "average_balance_sheet_unavailable" and roe.fix_type == "requires_manual_policy"
    assert (rows["a", "net_margin"].status, rows["a", "net_margin"].warnings) == ("invalid", ["mixed_period_coverage"])
    assert (rows["a", "fcf"].status, rows["a", "fcf"].warnings, rows["a", "fcf"].questionable_reason) == ("missing", [], None)
    assert rows["a", "pe_ratio"].warnings == ["no price"]
    assert rows["a", None].status == "valid"
    assert rows[None, "roa"].questionable_reason == "ytd_income_with_snapshot_balance_sheet"  # a null entity meets no facts
    assert rows["a", "current_ratio"].warnings == ["snapshot_inputs_required"]
    got = by(M.questionable_breakdown(M.audit_findings(metrics, facts)), "reason")
    assert {k: (r.rows, r.metrics) for k, r in got.items()} == {"average_balance_sheet_unavailable": (1, ["roe"]), "ytd_income_with_snapshot_balance_sheet": (1, ["roa"])}
    assert M.audit_findings(metrics.limit(0), facts).count() == 0 and M.audit_findings(metrics, facts.limit(0)).count() == 7


def test_parser_traces(spark):
    facts = spark.createDataFrame(
        [fact("a"), fact("b", trace=""), fact("b", flag="low_confidence_parse", role="press_release"), fact("c", kind=None, role="fixture"), fact("d", family=None), fact("e", flag="low_confidence_parse"), fact("f", flag=None)], FACTS
    )
    rows = by(A.parser_completeness(facts), "entity")
    assert not rows["b"].source_location_complete and rows["b"].forbidden_roles == []  # rows of low confidence don't count
    assert not rows["c"].period_type_complete and rows["c"].forbidden_roles == ["fixture"]
    assert not rows["d"].statement_context_complete and not rows["e"].source_location_complete and rows["f"].source_location_complete
    quality = spark.createDataFrame([(e, 20, 0.95, s, b) for e, s, b in (("a", "pass", ""), ("b", "pass", ""), ("c", "fail", "conflicts"), ("d", "pass", ""), ("x", "partial", ""))], "entity string, canonical long, score double, status string, blockers string")
    got = by(A.traced_parser_quality(quality, A.parser_completeness(facts), facts.where("entity <> 'd'")), "entity")
    assert (got["a"].status, got["a"].score, got["a"].blockers) == ("pass", 0.95, [])
    assert (got["b"].status, got["b"].score, got["b"].blockers) == ("fail", 0.85, ["source_location_missing"])
    assert got["c"].blockers == ["conflicts", "forbidden_source_roles", "period_type_missing"]
    assert got["d"].blockers == ["no_source_documents"]
    assert got["x"].blockers == ["no_source_documents", "period_type_missing", "source_location_missing"]
    assert A.traced_parser_quality(quality, A.parser_completeness(facts).limit(0)).where("status <> 'fail'").count() == 0
    only_context = A.traced_parser_quality(quality, A.parser_completeness(facts)).where("entity = 'd'").first()
    assert only_context.status == "partial" and only_context.blockers == []


def test_verdicts(spark):
    documents = spark.createDataFrame([("a", "parsed", "financial_statements"), ("b", "parsed", "press_release"), ("c", None, None), ("a", "downloaded", "press_release")], DOCUMENTS)
    facts = spark.createDataFrame([fact("a"), fact("b"), fact("d"), fact("a", code="capex", confidence=None)], FACTS)
    summary = A.source_summary(facts, documents)
    rows = by(summary, "entity")
    assert (rows["a"].documents, rows["a"].downloaded, rows["a"].parsed, rows["a"].facts, rows["a"].low_confidence) == (2, 2, 1, 2, 0)
    assert (rows["c"].facts, rows["d"].documents) == (0, 0)
    grid = spark.createDataFrame([("a", "extracted"), ("b", "extracted")], "entity string, status string")
    got = by(A.extraction_verdict(summary, grid), "entity")
    assert {e: r.status for e, r in got.items()} == {"a": "PASS", "b": "FAIL", "c": "FAIL", "d": "FAIL"}
    gap = spark.createDataFrame([("a", "missing")], "entity string, status string")
    assert A.extraction_verdict(summary, gap).where("entity = 'a'").first().status == "PARTIAL"
    untraced = A.source_summary(facts.unionByName(spark.createDataFrame([fact("a", url=None)], FACTS)), documents)
    assert A.extraction_verdict(untraced, grid).where("entity = 'a'").first().status == "FAIL"
    assert A.source_summary(facts.limit(0), documents.limit(0)).count() == 0


def test_promotion_keeps_null_keys_apart(spark):
    kind = "entity string, period string, metric_code string, value double, quality_flag string, confidence double, provenance string"
    existing = spark.createDataFrame([("a", "p", "revenue", 1.0, "exact", 0.9, "reviewed_manual_upload"), (None, "p", "revenue", 2.0, "exact", 0.9, "parser"), ("a", "p", "capex", 3.0, "exact", 0.9, "parser")], kind)
    reviewed = spark.createDataFrame(
        [("a", "p", "revenue", 5.0, "eligible"), (None, "p", "revenue", 6.0, "eligible"), ("a", "p", "capex", 7.0, "eligible"), ("a", "p", "ebitda", 8.0, "eligible"), ("a", "p", None, 9.0, "eligible"), ("b", "p", "revenue", None, "blocked")],
        "entity string, period string, metric_code string, value double, review_status string",
    )
    promoted = D.promote_reviewed(existing, reviewed, ["revenue", "capex"])
    assert sorted((r.metric_code or "", r.action) for r in promoted.collect()) == [("", "skipped"), ("capex", "skipped"), ("ebitda", "skipped"), ("revenue", "blocked"), ("revenue", "promoted"), ("revenue", "promoted")]
    assert sorted(r.value for r in D.promoted_table(existing, promoted).collect()) == [2.0, 3.0, 5.0, 6.0]
    counts = by(D.promotion_counts(promoted), "entity")
    assert (counts["a"].promoted, counts["a"].skipped, counts["b"].blocked) == (1, 3, 1)


def test_period_of_the_surest_table(spark):
    documents = spark.createDataFrame([("a", "2020Q1"), ("b", "2020Q2"), ("c", None)], "document_id string, period string")
    tables = spark.createDataFrame(
        [("a", 2, "2019Q4", None, "header", 0.5), ("a", 1, "2019Q3", "2018Q3", "title", 0.5), ("a", 0, None, None, "none", 0.9), ("b", 1, "2019Q1", None, "title", None), ("z", 1, "2019Q1", None, "title", 1.0)],
        "document_id string, table_id int, effective_period string, comparative_period string, period_source string, period_confidence double",
    )
    rows = by(D.period_resolution(documents, tables), "document_id")
    assert rows["a"][1:] == ("2019Q3", "2018Q3", "title", 0.5) and rows["b"][1:] == ("2019Q1", None, "title", 0.0)
    assert rows["c"][1:] == (None, None, "upload_default", 0.1)
    assert D.period_resolution(documents, tables.limit(0)).where("period_source = 'upload_default'").count() == 3


def test_comparison_status_without_peers_or_reports(spark):
    targets = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "entity string")
    peers = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "d")], "target string, peer string")
    known = spark.createDataFrame([("a", "available"), ("b", "available"), ("c", "available_but_low_coverage")], "entity string, status string")
    table = spark.createDataFrame([("a", "a", "target", "roe", "calculated"), ("a", "b", "peer", "roe", "calculated"), ("a", "b", "peer", "pe_ratio", "calculated"), ("b", "b", "target", "roe", "missing")], "target string, entity string, role string, metric_code string, status string")
    rows = by(E.comparison_status(targets, peers, known, table), "entity")
    assert rows["a"][1:6] == (3, 1, 1, "partial", "PARTIAL") and rows["a"].missing_peers == ["d"]
    assert rows["a"].blockers == ["peer_ratios_low_coverage", "peer_ratios_report_missing", "valuation_inputs_unavailable"]
    assert rows["b"].readiness == "NOT_READY" and "comparison_table_metrics_unavailable" in rows["b"].blockers
    assert rows["c"].data_status == "not_ready" and {"peer_selection_not_ready", "target_ratios_low_coverage"} <= set(rows["c"].blockers)
    assert E.comparison_status(targets, peers.limit(0), known.limit(0), table.limit(0)).where("readiness = 'NOT_READY'").count() == 3


def test_support_report_without_documents(spark):
    parser = spark.createDataFrame([(e, "pass", "", 0.9, 0.9, 0, 12) for e in "ab"] + [("c", "parser_blocked", "no_canonical_facts,low_confidence_ratio", 0.0, 0.0, 0, 0)], "entity string, status string, blockers string, confident_ratio double, key_coverage double, conflicts long, canonical long")
    metric = spark.createDataFrame([("a", 3, 0), ("b", 0, 1), ("c", 0, 0)], "entity string, calculated long, blockers long")
    checks = spark.createDataFrame([("a", 1)], "entity string, failed_checks long")
    scopes = spark.createDataFrame([("a", "statement_based_financials", True), ("b", "statement_based_financials", True), ("a", "llm_summary", False)], "entity string, scope string, supported boolean")
    documents = spark.createDataFrame([("a", "READY", 2, 1, 2, 1, 0), ("c", "SOURCE_BLOCKED", 1, 1, 1, 0, 1)], "entity string, package_status string, documents long, passed long, usable long, press long, proper long")
    rows = by(G.support_report(parser, metric, checks, scopes, documents), "entity")
    assert (rows["a"].status, rows["a"].document_status, rows["a"].fact_status) == ("AUTO_PARTIAL", "partial", "sufficient")
    assert rows["a"].blockers == ["consistency_checks_failed", "press_releases_only"] and rows["a"].financial_metrics and not rows["a"].llm_payload
    assert rows["b"].status == "SOURCE_BLOCKED" and rows["b"].blockers == ["no_documents", "valuation_without_market_inputs"] and rows["b"].financial_facts and not rows["b"].financial_metrics
    assert rows["c"].fact_status == "missing" and rows["c"].blockers == ["low_confidence_ratio", "no_canonical_facts", "no_document_passed", "source_package_source_blocked"]


def test_families_and_warnings_of_empty_tables(spark):
    none = spark.createDataFrame([], FACTS)
    assert D.family_completeness(D.statement_coverage(none), none).count() == 0 and D.missing_families(D.statement_coverage(none)).count() == 0
    grid = spark.createDataFrame([("a", "2020Q1", "revenue", "missing"), ("a", "2020Q1", "capex", "extracted")], "entity string, period string, metric_code string, status string")
    facts = spark.createDataFrame([fact("a", "capex"), fact("a", "capex", url=None)], FACTS)
    assert {r.metric_code: r.warnings for r in A.coverage_warnings(grid, facts).collect()} == {"revenue": ["not_extracted"], "capex": ["source_url_missing"]}
    items = spark.createDataFrame([("a", ["x", "x", None]), ("b", ["y", "x"]), ("c", None)], "entity string, blockers array<string>")
    assert [(r.blocker, r.entities) for r in D.support_blockers(items.withColumn("blockers", F.array_compact("blockers"))).collect()] == [("x", 2), ("y", 1)]
