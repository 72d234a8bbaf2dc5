"""Grids, text lines, merged rows, concepts, documents, engines and entities, on small cases and against plain rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import engines, entities, grids, portfolio, text_rows
from quarterdeck.operators.concepts import score_concepts
from quarterdeck.operators.validation import STOPWORDS, document_markers

# ---- grids


def number(text):
    n = re.sub(r"[^0-9,.\-\s]", "", text.strip("()")).strip()
    n = (n.replace(",", "") if "," in n and "." in n or re.fullmatch(r"[^,]*(,[^,]{3})+", n) else n.replace(",", ".")).replace(" ", "")
    try:
        return float(n)
    except ValueError:
        return None


def inline(text):
    words = text.split(" ")
    k = 0
    while k < 2 and k < len(words) and number(words[-1 - k]) is not None:
        k += 1
    return (" ".join(words[:-k]), words[-k:]) if 0 < k < len(words) else None


def marked(text, words):
    return any(w in re.sub(r"[^\w\s]", " ", text.lower()) for w in words)


def plain_grid(rows):
    rows = [[" ".join((c or "").split()) for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    fragment = lambda c: inline(c)[0] if inline(c) else "" if number(c) is not None else c
    heads = 0
    for r in rows[:3]:
        if any(inline(c) for c in r) or not (marked(" ".join(r), grids.DATE_MARKERS + grids.NOTE_MARKERS) or (any(fragment(c) for c in r) and sum(number(c) is not None for c in r) <= 1)):
            break
        heads += 1
    heads = max(heads, 1)
    merged = []
    for i in range(width):
        said = list(dict.fromkeys(r[i] for r in rows[:heads] if r[i]))
        merged.append(" ".join(said) or f"col_{i}")
    names = [x if merged[: i + 1].count(x) == 1 else f"{x}__{merged[: i + 1].count(x)}" for i, x in enumerate(merged)]
    shown = [c for c in rows[0] if c]
    data = rows[heads:]
    dated = [i for i, x in enumerate(names) if marked(x, grids.DATE_MARKERS)]
    numeric = [i for i in range(width) if any(number(r[i]) is not None for r in data)]
    first = dated[0] if dated else numeric[0] if numeric else (width if data else 0)
    notes = {i for i, x in enumerate(names) if marked(x, grids.NOTE_MARKERS)}
    active = [i for i in range(first, width) if i not in notes]
    out, rebuilt, labels = [], False, False
    for k, r in enumerate(data):
        head = [c for i, c in enumerate(r[:first]) if i not in notes and c]
        parts = [fragment(c) for c in head if fragment(c)]
        label = " ".join(parts)
        rebuilt |= bool(label) and (len(parts) > 1 or (first > 0 and not r[0]))
        own = None
        if not any(number(r[i]) is not None for i in active):
            own = next((inline(c) for c in head if inline(c)), None) or inline(label)
        values = {names[i]: r[i] for i in active}
        if own:
            values |= {names[i]: v for i, v in zip(active, own[1])}
        line = own[0] if own else label
        labels |= bool(line)
        note = next((r[i] for i in sorted(notes) if r[i]), None)
        cells = {c: v for c, v in values.items() if v}
        if line or note or cells:
            out.append((k, line or None, note, cells, own is not None, heads))
    poor = len(set(merged)) < width or len(set(shown)) < len(shown) or rebuilt or not labels
    return [(*r, "degraded" if poor else "standard") for r in out]


def test_grids_as_the_plain_rule(spark):
    r = random.Random(6)
    cells = ["", None, "2021", "2020", "Note", "Item", "Revenue", "Total  assets", "5", "1,234", "(70)", "Cash 10 20", "Profit 7", "31 December", "note 3", "x-y", "12.5%"]
    rows = [(k, 0, [[r.choice(cells) for _ in range(r.randint(0, 5))] for _ in range(r.randint(0, 7))]) for k in range(150)]
    df = spark.createDataFrame(rows, "document_id int, table_index int, rows array<array<string>>")
    got = {}
    for g in grids.normalize_table_grid(df).collect():
        got.setdefault(g.document_id, []).append((g.row_index, g.line, g.note_ref, g.cells, g.recovered, g.header_rows, g.quality))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: plain_grid(x) for k, _, x in rows if plain_grid(x)}
    assert grids.normalize_table_grid(df.limit(0)).count() == 0


# ---- text lines and merged rows

TABLE = "document_id string, table_index int, statement_type string, period string, extraction_method string, quality_flag string, source_location string, page_number int, table_title string, headers array<string>, lines array<string>, unit string, currency string, unit_multiplier double, is_bank boolean"


def raw_table(name, lines, *, kind="income_statement", period="2021Q4", title="Statement of profit or loss", headers=("2021", "2020"), unit="million", currency=None, bank=False, page=1):
    return (name, 0, kind, period, "text_table_fallback", "raw_text_table", "file", page, title, list(headers) if headers is not None else None, lines, unit, currency, 1e6, bank)


def findings(spark, *tables):
    return text_rows.text_line_facts(spark.createDataFrame(list(tables), TABLE)).collect()


def test_text_lines_of_a_statement(spark):
    got = findings(spark, raw_table("a", ["Revenue 5 1,000 900", "Operating", "profit 20 (10)", "Basic earnings per share 3 2", "EBITDA 4 5", "Net income (7)", None, "Profit before tax 100 20,000 30,000"]))
    facts = {(g.metric_code, g.line_index, g.width): (g.value, g.raw_value, g.confidence, g.column_name) for g in got if g.outcome == "fact"}
    assert facts["revenue", 0, 1] == (1e9, "1,000", 0.94, "current_first") and facts["operating_profit", 1, 2] == (2e7, "20", 0.94, "current_first") and facts["net_income", 5, 1][0] == -7e6
    reasons = {(g.line_index, g.width): g.reason for g in got if g.outcome == "rejected"}
    assert reasons[3, 1] == "per_share_row_not_statement_fact" and reasons[4, 1] == "unsupported_metric_for_text_fallback" and reasons[7, 1] == "ambiguous_period_column"


def test_text_lines_of_banks_periods_and_units(spark):
    got = findings(
        spark, raw_table("bank", ["Total assets 12,345 6,789"], kind="balance_sheet", title="Balance sheet", headers=("31 December 2021", "31 December 2020"), bank=True),
        raw_table("second", ["Total assets 1 2"], kind="balance_sheet", title="Balance sheet", headers=("2020", "2021")), raw_table("third", ["for the six months", "Revenue 101,000 202,000 303,000 404,000"], period="2021Q2"),
        raw_table("unitless", ["Revenue 10 9"], unit=None), raw_table("unknown", ["Total equity 10 9"], kind="balance_sheet", title="Balance sheet", headers=None),
    )
    by = {}
    for g in got:
        by.setdefault(g.document_id, []).append((g.outcome, g.period, g.value, g.reason))
    assert sorted(by["bank"]) == [("fact", "2020Q4", 6789e6, None), ("fact", "2021Q4", 12345e6, None)]
    assert by["second"] == [("fact", "2021Q4", 2e6, None)] and ("fact", "2021Q2", 303e9, None) in by["third"]
    assert by["unitless"] == [("rejected", None, None, "unit_or_currency_basis_missing")] and by["unknown"] == [("rejected", None, None, "ambiguous_period_column")]


def test_text_tables_refused_as_a_whole(spark):
    grid = raw_table("grid", ["Revenue 1 2"])
    grid = (*grid[:4], "grid", *grid[5:])
    got = findings(spark, grid, raw_table("kind", [], kind="notes"), raw_table("page", ["Revenue 1 2"], page=None), raw_table("notes", ["Revenue 1 2"], title="Notes to the statement of income"), raw_table("title", None, title=None))
    assert {g.document_id: (g.outcome, g.reason) for g in got} == {
        "grid": ("table_rejected", "not_text_fallback_raw_table"), "kind": ("table_rejected", "unsupported_statement_type_for_text_fallback"), "page": ("table_rejected", "missing_traceability"),
        "notes": ("table_rejected", "notes_fallback_not_eligible_for_fact_normalization"), "title": ("table_rejected", "primary_statement_marker_not_detected"),
    }


def test_merged_rows(spark):
    rows = [
        ("income_statement", "Revenue 5 100 90 Operating profit", "20", "10"), ("cash_flow", "Net cash from operating activities 1,000 (90) Capital expenditures (20)", None, None), ("balance_sheet", "100 90 Current assets Cash and cash equivalents", "5", "6"),
        ("balance_sheet", "100 90 Total assets", "5", "6"), ("balance_sheet", "1 2 Total liabilities 3 4 Total equity", "5", "6"), ("income_statement", None, "1", None), ("income_statement", "Revenue 5 10", "1", None), (None, "Revenue 1 2 Net profit 3 4", None, None),
    ]
    df = spark.createDataFrame([("d", 0, k, *r) for k, r in enumerate(rows)], "document_id string, table_index int, row_index int, statement_type string, line string, current string, comparative string")
    got = {}
    for g in text_rows.split_merged_rows(df).orderBy("row_index", "part").collect():
        got.setdefault(g.row_index, []).append((g.line, g.current, g.comparative, g.mode))
    assert got == {
        0: [("Revenue", "100", "90", "embedded"), ("Operating profit", "20", "10", "embedded")], 1: [("Net cash from operating activities", "1,000", "(90)", "merged"), ("Capital expenditures", "(20)", None, "merged")],
        2: [("Non-current assets", "100", "90", "leading_total"), ("Cash and cash equivalents", "5", "6", "leading_total")], 3: [("Current assets", "100", "90", "leading_total"), ("Total assets", "5", "6", "leading_total")],
        4: [("Current liabilities", "1", "2", "leading_total"), ("Total liabilities", "3", "4", "leading_total"), ("Total equity", "5", "6", "leading_total")], 5: [(None, "1", None, None)], 6: [("Revenue 5 10", "1", None, None)],
        7: [("Revenue 1 2 Net profit 3 4", None, None, None)],
    }


# ---- concepts and documents


def test_concepts(spark):
    rows = [
        ("Revenue", "profit_or_loss", "annual", True, True, True, "ZZZ"), ("PROFIT  for the year", "statement_text", "annual", True, True, True, "lkoh"), ("Profit for the year attributable to owners", "profit_or_loss", "annual", True, True, True, None),
        ("Total assets", "financial_position", "annual", True, True, True, ""), ("Total assets", "financial_position", "balance_sheet_snapshot", None, True, True, "GAZP"), ("Capital expenditures2", "cash_flow", "annual", True, True, True, "GAZP"), (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "raw_label string, statement_context string, period_type string, unit_detected boolean, currency_detected boolean, source_location_exists boolean, ticker string")
    got = [(g.concept_code, g.confidence, g.is_strong, g.reason, g.issuer_rules) for g in score_concepts(df.coalesce(1)).collect()]
    assert got == [
        ("revenue", 0.9, True, None, None), ("net_income", 0.9, True, None, "LKOH"), ("net_income", 0.0, False, "excluded_label_pattern", None), ("total_assets", 0.65, False, "period_type_allowed", None),
        ("total_assets", 0.65, False, "unit_detected", "GAZP"), (None, 0.0, False, "no_concept_label_match", None), (None, 0.0, False, "no_concept_label_match", None),
    ]


def test_documents(spark):
    schema = "document_id int, text string, names array<string>, source_url string, file_name string, file_type string, content_hash string, report_period string, reporting_standard string, source_role string, source string, period string"
    good = "Lukoil PJSC\nConsolidated Financial Statements under IFRS for the year ended 31 December 2021. Statement of cash flows. Notes to the statements."
    rows = [
        (1, good, ["LKOH", "Lukoil"], "https://a.org/x", "r.pdf", "pdf", "h", None, "IFRS", "financial_statements", "x", "y"), (2, "Annual report", ["LKOH"], "https://b.org/x", "r.xlsx", "pdf", None, None, "IFRS", "financial_statements", "x", "y"),
        (3, None, None, None, None, None, None, None, None, None, None, None), (4, "press release " * 20_000, ["press"], "https://a.org", "r.pdf", "pdf", "h", "2021Q4", "IFRS", "press_release", "x", "y"),
    ]
    got = {g.document_id: g for g in document_markers(spark.createDataFrame(rows, schema), ("a.org",)).collect()}
    assert got[1].validation_status == "pass" and got[1].score == 1.0 and got[1].detected_period == "2021Q4" and got[1].period == "y" and all(got[1].markers[m] for m in ("company", "ifrs", "consolidated", "primary", "notes", "period"))
    assert (got[2].validation_status, got[2].detected_role, got[2].detected_standard) == ("fail", "annual_report", "IFRS")
    assert got[3].validation_status == "fail" and not any(got[3].markers.values()) and got[3].detected_role == "other"
    assert got[4].markers["company"] and not got[4].markers["period"] and got[4].validation_status == "pass"


# ---- engines


def test_engine_rows_merge_one_to_one(spark):
    schema = "document_id string, table_index int, page_number int, statement_type string, statement_family string, table_role string, period string, comparative_period string, unit string, currency string, engine string, row_index int, row_kind string, metric_code string, label string, current string, comparative string, confidence double"
    line = "statement_line_item"

    def row(table, k, label, current, comparative=None, *, engine="native", page=1, kind="income_statement", period="2021Q4", unit=None):
        return ("d", table, page, kind, None, "primary_statement", period, None, unit, None, engine, k, line, None, label, current, comparative, 0.9)

    old = [row(0, 0, "Revenue", "100"), row(0, 1, "Cost of sales", None), row(0, 2, "Gross profit", "40"), row(0, 3, "Finance costs paid", None), row(0, 4, "", "7")]
    new = [
        row(0, 0, "Revenue", "100", "90", engine="ocr", unit="million"), row(0, 1, "Revenue", "100", "80", engine="ocr"), row(0, 2, "Gross profits", "40", "30", engine="ocr"), row(0, 3, "and charges", "5", engine="ocr"), row(0, 4, "Tax", "7", engine="ocr"),
        row(0, 5, "Something else", "1", engine="ocr"), row(1, 0, "Total assets", "9", engine="ocr", kind="balance_sheet"), row(2, 0, "Lost", "9", engine="ocr", kind="unknown", page=5), row(3, 0, "Revenue", "3", engine="ocr", period="2020Q4"),
    ]
    got = engines.merge_engine_tables(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), {"native": 2, "ocr": 1}).collect()
    shown = sorted(((g.table_index, g.origin, g.row_index, g.label, g.current, g.comparative, g.mode, g.reason) for g in got if g.origin in ("merged", "existing")), key=str)
    assert shown == sorted([
        (0, "merged", 0, "Revenue", "100", "90", "fused_row", None), (0, "existing", 1, "Cost of sales", None, None, None, None), (0, "merged", 2, "Gross profits", "40", "30", "semantic_row_identity_merge", None),
        (0, "merged", 3, "Finance costs paid and charges", "5", None, "continuation_row_merge", None), (0, "merged", 4, "Tax", "7", None, "fused_row", None),
    ], key=str)
    others = {(g.table_index, g.row_index, g.label): (g.origin, g.reason) for g in got if g.origin not in ("merged", "existing")}
    assert others[0, 1, "Revenue"][0] == "appended" and others[0, 5, "Something else"] == ("appended", None) and others[1, 0, "Total assets"] == ("added", None)
    assert others[0, 0, "Revenue"] == ("evidence", "period_conflict") and not any(g.label == "Lost" for g in got)
    assert {g.unit for g in got if g.table_index == 0} == {"million"}
    empty = spark.createDataFrame([], schema)
    assert engines.merge_engine_tables(empty, spark.createDataFrame(new[:1], schema), {}).head().origin == "added"
    assert engines.merge_engine_tables(spark.createDataFrame(old, schema), empty, {}).count() == len(old)


# ---- entities


def test_entities_in_texts_as_the_plain_rule(spark):
    r = random.Random(9)
    words = ["gaz", "prom", "gazprom", "oil", "bank", "north", "the", "sea", "ab", "x", "lukoil", "severstal"]
    texts = [(k, " ".join(r.choice(words) + r.choice(["", "", ",", "-"]) for _ in range(r.randint(0, 12)))) for k in range(80)] + [(100, None), (101, "a gazproms"), (1, "ab x"), (1, "ab x")]
    names = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 4)))) for k in range(60)] + [(60, None), (61, "!!"), (62, "x"), (63, "ab x"), (64, "prom oil"), (64, "gazprom")]
    norm = lambda t: re.sub(r"[^0-9a-z]+", " ", (t or "").lower()).strip()

    def says(text, name):
        t, n = norm(text), norm(name)
        tokens = {w for w in n.split() if len(w) >= 3 and w not in STOPWORDS}
        return bool(n) and ((len(n) >= 3 and n in t) or (len(tokens) >= 2 and tokens <= set(t.split())) or (len(tokens) == 1 and len(min(tokens)) >= 5 and min(tokens) in t.split()))

    want = sorted((d, e) for d, t in texts for e in {e for e, n in names if says(t, n)})
    got = entities.match_entity_in_text(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(names, "entity int, name string"))
    assert sorted(tuple(g) for g in got.collect()) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_searches_as_the_plain_rule(spark):
    r = random.Random(10)
    registry = [(f"T{k}", "".join(r.choice("ab c") for _ in range(r.randint(0, 7))), [r.choice(["ab", "Abc", "", None])], k % 7 != 0) for k in range(40)]
    asked = [("".join(r.choice("abcT1") for _ in range(r.randint(0, 4))),) for _ in range(30)] + [(None,), (" T1 ",), ("t11xx",)]
    clean = lambda x: (x or "").strip(" ").lower()
    want = set()
    for q in {a[0] for a in asked}:
        hits = []
        for e, n, aliases, active in registry:
            names = [clean(x) for x in (e, n, *aliases) if clean(x)]
            if active and clean(q) and any(clean(q) in x or x in clean(q) for x in names):
                hits.append((0 if clean(q) in names else 1, e))
        want |= {(q, e, rank, place) for place, (rank, e) in enumerate(sorted(hits)[:20], 1)}
    got = entities.search_entities(spark.createDataFrame(registry, "entity string, name string, aliases array<string>, is_active boolean"), spark.createDataFrame(asked, "q string"))
    assert {tuple(g) for g in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ---- portfolio


def test_portfolio_report(spark):
    coverage = spark.createDataFrame([("A", "FULL_STATEMENT_READY", ["valuation_inputs"], None, ["x"], None), ("B", "SOURCE_ONLY", ["missing_fy_report", "missing_fy_report"], "missing_fy_report", None, None), ("C", None, None, None, None, "Wait.")], "entity string, coverage_level string, blockers array<string>, main_blocker string, outputs array<string>, next_action string")
    counts = ("statement_tables", "fact_candidates", "matched_facts", "manual_documents", "candles", "peers", "compared_metrics")
    evidence = spark.createDataFrame([("A", 3, 0, 2, 1, None, 4, 0)], "entity string, " + ", ".join(f"{c} int" for c in counts))
    companies = portfolio.portfolio_companies(coverage, evidence)
    by = {g.entity: g for g in companies.collect()}
    assert by["A"].main_status == "READY" and by["A"].outputs == ["dataframe_artifacts", "fact_candidate_comparison", "manual_document_analysis", "peer_selection", "statement_tables", "x"]
    assert by["B"].blockers == ["missing_fy_report"] and by["B"].recommended_action.startswith("Improve FY") and (by["C"].main_status, by["C"].recommended_action) == ("BLOCKED", "Wait.")
    got = {(g.section, g.key): (g.companies, g.entities) for g in portfolio.portfolio_report(companies).collect()}
    assert got["total", "companies"] == (3, "A,B,C") and got["main_status", "BLOCKED"] == (2, "B,C") and got["blocker", "missing_fy_report"] == (1, "B")
    assert [tuple(g) for g in portfolio.portfolio_report(companies.limit(0)).collect()] == [("total", "companies", 0, "")]


def test_spaced_numbers(spark):
    from quarterdeck.functions.text import group_spaced_numbers

    cases = {
        "1 234 5 678": ["1 234", "5 678"], "7 1 234 5 678": ["7", "1 234", "5 678"], "12 345,6 1 234,5": ["12 345,6", "1 234,5"], "1 22 333 4": ["1", "22", "333", "4"], "5": ["5"], "1 2": ["1", "2"], "(1 234) (5 678)": ["(1 234)", "(5 678)"],
        "100 200 300": ["100", "200", "300"], "1 234 567 8 901 234": ["1 234 567", "8 901 234"],
    }
    df = spark.createDataFrame([(k, k.split(" ")) for k in cases], "k string, t array<string>")
    assert {g.k: g.v for g in df.select("k", group_spaced_numbers(F.col("t")).alias("v")).collect()} == cases


def test_gap_audit_and_matrix(spark):
    from quarterdeck.operators import gaps

    audited = spark.createDataFrame([("A", "2021Q1", "fcf", "missing"), ("B", "2021Q1", "fcf", "valid"), ("A", "2021Q1", "pe_ratio", "missing"), ("B", "2021Q1", "roe", "valid"), ("A", "2021Q1", "roe", "valid"), ("Z", "2021Q1", "fcf", None)], "entity string, period string, metric_code string, status string")
    facts = spark.createDataFrame([("A", "2021Q1", "operating_cash_flow", 1.0, "p1"), ("A", "2021Q1", "operating_cash_flow", 2.0, "p1"), ("A", "2021Q1", "capex", None, "p"), ("B", "2021Q1", "operating_cash_flow", 1.0, "p"), ("B", "2021Q1", "capex", 1.0, None)], "entity string, period string, metric_code string, value double, trace string")
    rows = gaps.metric_input_audit(audited, facts)
    got = {(r.entity, r.metric_code): (r.status, r.available, r.missing, r.traced) for r in rows.collect()}
    assert got["A", "fcf"] == ("missing", ["operating_cash_flow"], ["capex"], True) and got["B", "fcf"] == ("calculated", ["capex", "operating_cash_flow"], [], False)
    assert got["A", "pe_ratio"][1:] == ([], [], False) and got["Z", "fcf"][0] == "missing"
    groups = spark.createDataFrame([("g", "A"), ("g", "B"), ("g", "C"), ("h", "B")], "group string, entity string")
    matrix = gaps.gap_matrix(rows, groups)
    shown = {(r.group, r.metric_code): (r.statuses, r.missing_inputs, r.impact) for r in matrix.collect()}
    assert shown["g", "fcf"] == ({"A": "missing", "B": "valid", "C": "missing"}, {"A": ["capex"], "C": []}, "high") and shown["g", "pe_ratio"][2] == "valuation_module" and ("h", "fcf") not in shown
    assert [(r.entity, r.fact, r.metrics, r.periods, r.pairs, r.score) for r in gaps.fact_priorities(matrix).collect()] == [("A", "capex", 1, 1, 1, 4 + 2 + 3 + 2)]
    assert [(r.entity, r.input, r.metrics, r.place) for r in gaps.top_missing_inputs(rows).collect()] == [("A", "capex", 1, 1), ("A", "net_income", 1, 2), ("A", "total_equity", 1, 3), ("B", "net_income", 1, 4), ("B", "total_equity", 1, 5), ("Z", "capex", 1, 6), ("Z", "operating_cash_flow", 1, 7)]
    assert gaps.gap_matrix(rows.limit(0), groups).count() == 0


def test_market_report_statuses(spark):
    import datetime

    from quarterdeck.operators import market

    days = [datetime.date(2021, 1, 1) + datetime.timedelta(days=k) for k in range(365)]
    rows = [(t, d, 10.0, 11.0, 9.0, 10.0 + k % 7, 100.0, 1000.0) for t in ("A", "B", "C") for k, d in enumerate(days if t != "C" else days[:30])]
    candles = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, value double")
    context = spark.createDataFrame([("A", True, True), ("B", False, True), ("D", True, True)], "ticker string, official boolean, valuation boolean")
    got = {r.ticker: (r.audit_status, r.technical_status, r.warnings) for r in market.market_report(candles, "2021Q1", "2021Q4", context).collect()}
    assert got["A"] == ("PASS", "PASS", "") and got["B"] == ("PARTIAL", "PASS", "source_is_not_the_exchange") and got["D"][:2] == ("FAIL", "FAIL")
    assert got["C"][:2] == ("PARTIAL", "PARTIAL") and "date_to_not_present" in got["C"][2]


def test_coverage_levels_and_blockers(spark):
    rows = [
        ("A", "AUTO_READY", None, 0, None, None, ["missing_fy_report"]), ("B", None, None, 3, "TABLES_READY", "FACTS_READY", ["missing_fy_report", "missing_fy_report"]), ("C", None, "AUTO_READY", 3, "TABLES_PARTIAL", "FACTS_READY", ["unavailable_valuation_inputs"]),
        ("D", None, None, 3, "EXTRACTION_FAILED", None, None), ("E", None, None, 1, None, None, ["zzz"]), ("F", None, "AUTO_PARTIAL", None, None, None, []), ("G", None, "UNSUPPORTED", 0, None, "NO_FACTS", None),
    ]
    levels = portfolio.coverage_levels(spark.createDataFrame(rows, "entity string, statement_scope string, market_scope string, documents int, table_status string, fact_status string, blockers array<string>"))
    got = {r.entity: (r.coverage_level, r.main_blocker) for r in levels.collect()}
    assert got == {
        "A": ("FULL_STATEMENT_READY", "missing_fy_report"), "B": ("SOURCE_BLOCKED", "missing_fy_report"), "C": ("FULL_STATEMENT_READY", "unavailable_valuation_inputs"), "D": ("PARSER_BLOCKED", None), "E": ("PARTIAL_STATEMENT_READY", "zzz"), "F": ("MARKET_ONLY", None),
        "G": ("UNSUPPORTED", None),
    }
    actions = {r.blocker: (r.entities, r.sample, r.place, r.is_next) for r in portfolio.blocker_actions(levels).collect()}
    assert actions == {"missing_fy_report": (2, "A,B", 1, True), "unavailable_valuation_inputs": (1, "C", 2, False), "zzz": (1, "E", 3, False)}


def test_tables_of_pages_with_spans(spark):
    from quarterdeck.sources.html import html_grids, parse_tables

    html = "<table><tr><th>a<th colspan=2>b</tr><tr><td rowspan=3>c<td>d<td rowspan='x'>e</tr><tr><td colspan=2>f<table><tr><td>in</td></tr></table> g</tr></table><p>x<table><td rowspan=2 colspan=2>open &amp; wide"
    assert parse_tables(html) == [
        (0, 0, 0, "a"), (0, 0, 1, "b"), (0, 0, 2, "b"), (0, 1, 0, "c"), (0, 1, 1, "d"), (0, 1, 2, "e"), (0, 2, 0, "c"), (0, 2, 1, "f g"), (0, 2, 2, "f g"), (1, 0, 0, "in"), (2, 0, 0, "open & wide"), (2, 0, 1, "open & wide"),
    ]
    assert parse_tables(None) == parse_tables("") == parse_tables("<tr><td>x</table>") == []
    assert parse_tables("<table><tr><td>a</tr><tr></tr><tr><td>b<td>c</table>") == [(0, 0, 0, "a"), (0, 2, 0, "b"), (0, 2, 1, "c")]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>Item<td>2021<td>2020<tr><td>Cash<td>5<td>6</table>")], "page_id long, html string")
    got = {(g.document_id, g.table_index): g.rows for g in html_grids(pages).collect()}
    assert got[1, 0] == [["a", "b", "b"], ["c", "d", "e"], ["c", "f g", "f g"]] and got[3, 0] == [["Item", "2021", "2020"], ["Cash", "5", "6"]] and len(got) == 4
    records = {(g.document_id, g.table_index): (g.line, g.cells) for g in grids.normalize_table_grid(html_grids(pages)).collect()}
    assert records[3, 0] == ("Cash", {"2021": "5", "2020": "6"})
