"""Small literal cases of the column functions and of operators that the shared tables don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from quarterdeck.functions import numbers as N
from quarterdeck.functions import periods as P
from quarterdeck.functions import text as X
from quarterdeck.operators import facts as A
from quarterdeck.operators import market as K
from quarterdeck.operators import metrics as M
from quarterdeck.operators import portfolio as C


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_periods(spark):
    assert column(spark, ["2021Q1", "2020Q4", "2021Q5", None, "x"], P.previous_period) == ["2020Q4", "2020Q3", None, None, None]
    assert column(spark, ["2021", "2021q2 ", "21", None], P.normalize_user_period) == ["2021Q4", "2021Q2", None, None]
    assert column(spark, ["2021", "2022Q1", "2019"], lambda v: P.in_range_or_year(v, "2021Q3", "2021Q4")) == [True, False, False]
    with pytest.raises(ValueError):
        P.range_bounds("2021Q4", "2021Q1")
    with pytest.raises(ValueError):
        P.literal_index("2021Q5")


def test_numbers(spark):
    raw = ["(1,234)", "1,234.5", "12,5", "1 234", "−7", "n/a", "", None, "12,345,678 RUB", "-"]
    assert column(spark, raw, N.parse_number) == [-1234.0, 1234.5, 12.5, 1234.0, -7.0, None, None, None, 12345678.0, None]
    assert column(spark, ["in billions", "млн руб.", "тыс.", "x", None], N.unit_multiplier) == [1e9, 1e6, 1e3, 1.0, 1.0]
    assert column(spark, ["RUB", "usd", "eur", None], N.detect_currency) == ["RUB", "USD", None, None]
    show = lambda kind: lambda v: N.display_value(v, F.lit(kind))
    assert column(spark, [0.125, None], show("percent"), "double") == ["12.5%", None]
    assert column(spark, [1234567.0], show("currency"), "double") == ["1,234,567 RUB"] and column(spark, [1.5], show("ratio"), "double") == ["1.50x"]


def test_text(spark):
    html = """<a class='x' href="/r.pdf"><b>Annual</b>  report
 2020</a><A HREF='q'>t</A>"""
    assert [tuple(x) for x in column(spark, [html], X.html_links)[0]] == [("/r.pdf", "Annual report 2020"), ("q", "t")]
    role = lambda v: X.link_role(v, "IFRS")
    assert [r.role for r in column(spark, ["IFRS consolidated financial statements", "годовой отчет", "x"], role)] == ["financial_statements", "annual_report", "unknown"]
    assert column(spark, ["2021 Q3", "nine months 2019", "2019", "annual report 2020"], X.link_period) == ["2021Q3", "2019Q3", None, "2020Q4"]
    assert column(spark, ["Total debt and bonds; income tax", None], lambda c: X.topic_tags(X.matching_text(c))) == [["debt_disclosure", "tax_disclosure"], []]
    assert column(spark, ["Recommendation: sell, not buy", "**HOLD** buy", "buy or hold", "", None], X.verdict) == ["SELL", "HOLD", "BUY", "N/A", "N/A"]
    assert column(spark, ["Total assets", "total current assets", "assets", "x"], lambda v: X.match_label(v, [("assets", "a"), ("total assets", "t"), ("current assets", "c")])) == ["t", "c", "a", None]


def facts(spark, rows):
    full = [(e, p, c, v, t, q, 1.0, 0.9, "IFRS") for e, p, c, v, t, q in rows]
    return spark.createDataFrame(full, "entity string, period string, metric_code string, value double, period_type string, quality_flag string, unit_multiplier double, confidence double, reporting_standard string")


def test_strict_ratios_edges(spark):
    snap, rows = "balance_sheet_snapshot", []
    for e, revenue, debt_flag, equity in (("A", 0.0, "exact", 10.0), ("B", 5.0, "derived", 0.0)):
        rows += [(e, "2021Q4", "revenue", revenue, "annual", "exact"), (e, "2021Q4", "net_income", 2.0, "annual", "exact"), (e, "2021Q4", "total_debt", 4.0, snap, debt_flag), (e, "2021Q4", "total_equity", equity, snap, "exact"), (e, "2020Q4", "total_equity", 6.0, snap, "exact"), (e, "2021Q4", "operating_cash_flow", 9.0, "annual", "exact"), (e, "2021Q4", "capex", -3.0, "annual", "exact"), (e, "2021Q3", "revenue", 1.0, "ytd", "exact")]
    got = {(r.entity, r.metric_code): (r.value, r.status, r.reason) for r in M.strict_ratios(facts(spark, rows), "2021Q4", "2021Q4").collect()}
    assert got["A", "net_margin"] == (None, "blocked_by_zero_denominator", "division_by_zero")
    assert got["A", "roe"] == (2.0 / 8.0, "calculated", None) and got["A", "fcf"] == (6.0, "calculated", None)
    assert got["B", "debt_to_equity"][2] == "explicit_total_debt_missing_no_component_derivation"
    assert got["A", "revenue_growth"] == (None, "blocked_by_period_semantics", "incomparable_revenue_period_type")
    assert got["A", "ebitda_margin"][1] == "unsupported_by_policy"


def test_consistency_and_reconcile(spark):
    snap = "balance_sheet_snapshot"
    rows = facts(spark, [("A", "2021Q1", "total_assets", 100.0, snap, "exact"), ("A", "2021Q1", "total_liabilities", 60.0, snap, "exact"), ("A", "2021Q1", "total_equity", 39.5, snap, "exact"), ("A", "2021Q1", "current_assets", 120.0, snap, "exact"), ("A", "2021Q1", "total_debt", -1.0, snap, "exact")])
    got = {r.check: r.passed for r in A.consistency_checks(rows).collect()}
    assert got == {"current_assets_lte_total_assets": False, "total_debt_non_negative": False, "assets_equal_liabilities_plus_equity": True}
    two = rows.where("metric_code = 'total_assets'")
    pair = two.withColumn("source_role", F.lit("annual_report")).withColumn("document_id", F.lit("d1")).unionByName(two.withColumn("value", F.lit(101.0)).withColumn("source_role", F.lit("annual_report")).withColumn("document_id", F.lit("d2")))
    r = A.reconcile_sources(pair).first()
    assert r.value is None and r.quality_flag == "conflicting_sources" and r.confidence == 0.5
    higher = pair.withColumn("source_role", F.when(F.col("document_id") == "d2", "manual_verified").otherwise(F.col("source_role")))
    assert A.reconcile_sources(higher).first().value == 101.0


def test_market_edges(spark):
    rows = [("T", f"2021-01-{d:02d}", str(100 + d), "10", "5") for d in range(1, 20)] + [("T", "2021-01-20", "bad", "0", None)]
    raw = spark.createDataFrame(rows, "ticker string, tradedate string, close string, volume string, value string")
    candles = K.normalize_candles(raw)
    last = K.latest_indicators(candles).first()
    assert last.rsi_14 == 100.0 and last.ma_20 is None and last.max_drawdown == 0.0 and last.n == 19
    liquid = {r.metric_code: r.value for r in K.liquidity_metrics(candles).collect()}
    assert liquid["trading_days_count"] == 20 and liquid["zero_volume_days_count"] == 1 and liquid["bid_ask_spread"] is None
    away = K.period_alignment(candles, "2020Q1", "2020Q2").first()
    assert not away.aligned and away.covered_days == 0 and away.source == "market_cache_unaligned"
    page = lambda d0, n: candles.orderBy("date").limit(n).withColumn("date", F.date_add("date", d0))
    assert K.union_pages(page(0, 5), page(3, 3), page(30, 4), page_size=5).count() == 6


def test_payload_and_reports(spark, tmp_path):
    rows = facts(spark, [("A", "2021Q1", "revenue", 2.0, "ytd", "exact"), ("B", "2021Q1", "revenue", 3.0, "ytd", "fixture")])
    metrics = M.metrics_engine(rows)
    reports = C.assemble_payload(rows, metrics, C.data_quality(rows, metrics))
    payload = {r.entity: json.loads(r.payload) for r in reports.collect()}
    assert payload["A"]["facts"][0]["value"] == 2.0 and payload["B"]["overall"] == "fixture"
    C.write_reports(reports, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
