"""Work that is done once a row: plans that stay small under filters, and heavy steps that aren't copied."""

from pyspark.sql import functions as F

from quarterdeck.functions.numbers import parse_number
from quarterdeck.functions.text import match_label
from quarterdeck.operators import statements as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def statement_rows(spark):
    cells = F.array(F.struct(F.lit("2021Q4").alias("key"), F.lit("1 200").alias("raw")), F.struct(F.lit("2020Q4").alias("key"), F.lit("7").alias("raw")))
    text = lambda v: F.lit(v)
    return spark.range(3).select(
        F.col("id").alias("document_id"), F.col("id").alias("row_index"), text("balance_sheet").alias("statement_type"), text("Total assets").alias("label"), cells.alias("cells"), F.lit(None).cast("string").alias("note_ref"), text("2021Q4").alias("period"),
        F.lit(1).alias("page_number"), F.lit(1000.0).alias("unit_multiplier"), text("bank").alias("issuer_class"), F.lit(0.9).alias("label_confidence"), F.lit(0.9).alias("ownership_confidence"), F.lit(0.9).alias("period_confidence"), (F.col("id") == 1).alias("low_trust"),
    )


def test_filters_do_not_copy_the_parsing(spark):
    facts = R.parse_statement_rows(statement_rows(spark), match_label(F.col("label"), [("total assets", "total_assets")]))
    facts = facts.where((F.col("outcome") == "fact") & (F.length("raw_value") >= 5)).withColumn("low_trust", F.col("row_index") == 1)
    found = R.suspicious_facts(facts)
    assert len(plan(found)) < 400_000  # 5.9 million when each filter had a copy
    assert [(r["row_index"], r["raw_value"], r["reasons"]) for r in found.collect()] == [(1, "1 200", ["lower_trust_text_fallback_statement_row"])]


def test_numbers_are_read_without_exceptions(spark):
    cases = {"": None, "-": None, "1 200": 1200.0, "(1,200)": -1200.0, "1,5": 1.5, "1,234.5": 1234.5, "5.": 5.0, ".5": 0.5, "1.2.3": None, "--1": None, "7-": None, "words": None, "12\t": 12.0, "1\t2": None, "(0)": -0.0, "−3": -3.0, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", parse_number(F.col("raw")).alias("n"))
    assert {r["raw"]: r["n"] for r in rows.collect()} == cases
    assert "RLIKE" in plan(rows).upper()  # what is no number never reaches the cast


def test_grids_bind_their_heavy_steps(spark):
    from quarterdeck.operators.grids import normalize_table_grid

    rows = "array(array('Item', '2021', '2020'), array('Revenue', '1 200', '(30)'), array('Net profit 40 5', null, ''))"
    found = normalize_table_grid(spark.range(1).selectExpr("id document_id", "0 table_index", f"{rows} rows"))
    lines = [l for l in plan(found).split("\n") if "RLIKE" in l.upper() or "regexp_replace" in l]
    assert lines and all("Generate" in l for l in lines)  # none stands in a plain projection, which filters and later steps copy
    assert [(r["line"], r["cells"], r["recovered"]) for r in found.orderBy("row_index").collect()] == [("Revenue", {"2021": "1 200", "2020": "(30)"}, False), ("Net profit", {"2021": "40", "2020": "5"}, True)]


def test_text_lines_are_read_in_one_pass(spark):
    from quarterdeck.operators.text_rows import text_line_facts

    lines = "array('Consolidated statement of profit or loss 2021 2020', 'Operating', 'profit 1200 900')"
    t = spark.range(2).selectExpr(
        "id document_id", "0 table_index", "'income_statement' statement_type", "'2021Q4' period", "if(id = 0, 'text_table_fallback', 'grid') extraction_method", "'raw_text_table' quality_flag", "'file' source_location", "1 page_number", "'Table' table_title",
        "cast(null as array<string>) headers", f"{lines} lines", "'million' unit", "cast(null as string) currency", "1e6D unit_multiplier", "false is_bank",
    )
    found = text_line_facts(t)
    assert plan(found).count("Range (") == 1  # three when single lines, wider ones and refused tables each read all
    got = {(r["document_id"], r["line_index"], r["width"], r["outcome"], r["raw_label"], r["value"], r["reason"]) for r in found.collect()}
    assert got == {(0, 1, 2, "fact", "Operating profit", 1.2e9, None), (1, None, None, "table_rejected", None, None, "not_text_fallback_raw_table")}


def test_spaced_numbers_bind_their_tokens(spark):
    from quarterdeck.functions.text import group_spaced_numbers

    cases = {"7 1 200 3 400": ["7", "1 200", "3 400"], "12 345,6 1 234,5": ["12 345,6", "1 234,5"], "1 22 333 4": ["1", "22", "333", "4"], "5": ["5"]}
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", group_spaced_numbers(F.split("line", " ")).alias("numbers"))
    assert {r["line"]: r["numbers"] for r in rows.collect()} == cases
    assert plan(rows).count("split(line") == 1


def test_mentions_need_no_array_of_a_texts_words(spark):
    from quarterdeck.operators.validation import document_markers, mentions

    cases = [("bank of acme holdings", "acme holdings", True), ("acme and its holdings", "acme holdings", True), ("acmes and holdings", "acme holdings", False), ("rosneft", "rosneft", True), ("xx ab", "ab", False), ("", "acme", False), ("acme", "", False), (None, "acme", False)]
    rows = spark.createDataFrame(cases, "t string, n string, want boolean").select("want", mentions(F.col("t"), F.col("n")).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())
    docs = spark.range(1).selectExpr("'Acme annual report 31 December 2021' text", "array('ACM') names", "'https://a.b/c.pdf' source_url", "'c.pdf' file_name", "'pdf' file_type", "'h' content_hash", "cast(null as string) report_period", "'IFRS' reporting_standard", "'annual_report' source_role")
    found = document_markers(docs.union(docs.limit(0)), ("a.b",))
    assert "array_distinct(split(" not in plan(found)
    assert found.first()["detected_role"] == "annual_report"


def test_engine_rows_meet_in_one_join(spark, monkeypatch):
    from quarterdeck.operators import engines

    written = {}
    write = engines.kept
    monkeypatch.setattr(engines, "kept", lambda df, name: written.setdefault(name, []).append(plan(df)) or write(df, name))
    columns = "'d' document_id, 0 table_index, 1 page_number, 'income_statement' statement_type, cast(null as string) statement_family, 'primary_statement' table_role, '2021Q4' period, cast(null as string) comparative_period, cast(null as string) unit, cast(null as string) currency"
    row = lambda engine, k, label, current, metric="null": spark.sql(f"select {columns}, '{engine}' engine, {k} row_index, 'statement_line_item' row_kind, cast({metric} as string) metric_code, {label} label, {current} current, cast(null as string) comparative, 0.9D confidence")
    old = row("native", 0, "'Deferred tax'", "cast(null as string)").union(row("native", 1, "''", "'7'")).union(row("native", 2, "'2021'", "'5'")).union(row("native", 3, "'Sales'", "'1'", "'revenue'")).union(row("native", 4, "'Other'", "'3'"))
    new = row("ocr", 0, "'of the group'", "'9'").union(row("ocr", 1, "'Interest'", "'7'")).union(row("ocr", 2, "'2021'", "'5'")).union(row("ocr", 3, "'Turnover'", "'1'", "'revenue'")).union(row("ocr", 4, "'Rent'", "'3'"))
    got = engines.merge_engine_tables(old, new, {})
    assert written["engine-pairs"][0].count("Join ") <= 2  # six when each way to meet joined the rows again
    assert plan(got).count("left_anti") + plan(got).count("LeftAnti") == 0  # every row is read once, not again by what is left of it
    shown = sorted((r["row_index"], r["origin"], r["label"], r["mode"]) for r in got.collect() if r["origin"] != "appended")
    assert shown == [(0, "merged", "Deferred tax of the group", "continuation_row_merge"), (1, "merged", "Interest", "fused_row"), (2, "merged", "2021", "fused_row"), (3, "merged", "Turnover", "semantic_row_identity_merge"), (4, "existing", "Other", None)]
    assert [(r["row_index"], r["label"]) for r in got.collect() if r["origin"] == "appended"] == [(4, "Rent")]


def test_statement_rows_read_each_number_once(spark):
    from quarterdeck.functions.text import match_normal

    cell = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("raw"))
    cases = {0: [("note", "7"), ("amount", "(1,5)")], 1: [("2021Q4", "1 200"), ("2021 year", "5 000")], 2: [("a", "12"), ("b", "34")], 3: [("x", "n/a"), ("y", None)], 4: [("31 December 2021", "900"), ("31 December 2020", "800")], 5: [("2021q4", "100"), ("2021 Q4", "200")]}
    cells = F.coalesce(*[F.when(F.col("id") == n, F.array(*[cell(k, v) for k, v in row])) for n, row in cases.items()])
    base = statement_rows(spark)
    rows = spark.range(7).select(*[cells.alias("cells") if c == "cells" else F.col("id").alias(c) if c in ("document_id", "row_index") else F.lit(base.first()[c]).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    found = R.parse_statement_rows(rows, lambda plain: match_normal(plain, [("total assets", "total_assets"), ("assets", "other")]))
    assert plan(found).count("[^0-9,.\\-\\s]") == 1  # three when the number of a cell was read for each use
    assert "array_max" not in plan(found)
    got = {r["row_index"]: (r["value"], r["raw_value"], r["reason"], r["metric_code"]) for r in found.collect()}
    ambiguous = (None, None, "ambiguous_period_column", None)  # two notes, two columns of the period
    assert {n: got[n] for n in (0, 1, 2, 4, 5)} == {0: (-1500.0, "(1,5)", None, "total_assets"), 1: (1_200_000.0, "1 200", None, "total_assets"), 2: ambiguous, 4: (900_000.0, "900", None, "total_assets"), 5: ambiguous}
    assert got[3][0] is None and got[3][2] is not None


def test_readiness_and_labels_need_no_arrays(spark):
    from quarterdeck.functions.text import matching_text

    facts = R.parse_statement_rows(statement_rows(spark), match_label(F.col("label"), [("assets", "other"), ("total assets", "total_assets")]))
    ready = R.analysis_readiness(facts, ["total_assets", "revenue"])
    assert plan(ready).count("[^0-9,.\\-\\s]") == 1 and "array_max" not in plan(ready)
    assert [(r["facts"], r["missing"]) for r in ready.collect()] == [(1, "revenue")] * 3
    labels = {"Total  Assets": "b", "net total assets": "b", "assets": "a", "x assets": "a", "Ёлка—2": "c", "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in labels], "label string").select("label", match_label(F.col("label"), [("assets", "a"), ("total assets", "b"), ("елка 2", "c"), ("елка", "d")]).alias("m"), matching_text(F.col("label")).alias("t"))
    assert {r["label"]: r["m"] for r in rows.collect()} == labels
    assert plan(rows).count("regexp_replace") == 2  # one pass a normal form; it was two


def test_concept_patterns_are_tried_at_the_start_only(spark):
    import re

    from quarterdeck.operators.concepts import CONCEPTS, ISSUERS, _any, score_concepts

    own = [patterns for _, _, patterns, _, _ in CONCEPTS] + [patterns for issuer in ISSUERS.values() for patterns in issuer[0].values()]
    assert all(_any(patterns).startswith("^(?:") for patterns in own)  # each alternative was tried at every place of a label
    labels = ["revenue", "total revenue", "sales (including excise and export tariffs), net", "profit for the year attributable", "net sales", "чистые процентные доходы", "ebitda x", ""]
    for patterns in [*own, ("^a$|b", "^c"), ("x", "^y"), ("attributable to", "comprehensive")]:
        assert [bool(re.search(_any(patterns), label)) for label in labels] == [any(re.search(p, label) for p in patterns) for label in labels]
    rows = spark.createDataFrame([("Total Revenue",), ("revenues",)], "raw_label string").selectExpr("raw_label", "'profit_or_loss' statement_context", "'annual' period_type", "true unit_detected", "true currency_detected", "true source_location_exists", "'' ticker")
    assert {r["raw_label"]: r["concept_code"] for r in score_concepts(rows).collect()} == {"Total Revenue": None, "revenues": "revenue"}


def test_duplicates_are_found_without_carrying_texts(spark):
    from quarterdeck.operators.facts import dedupe_documents

    rows = [(1, "a", "p", "u"), (2, "b", "p", "u"), (3, "a", "p", None), (4, None, "p", None), (5, None, None, "u"), (6, "c", "p", None), (7, "c", "q", "u")]
    found = dedupe_documents(spark.createDataFrame(rows, "doc_id int, text string, period string, url string"))
    assert {r["doc_id"]: (r["first_id"], r["is_duplicate"]) for r in found.collect()} == {1: (1, False), 2: (1, True), 3: (1, True), 4: (4, False), 5: (5, False), 6: (6, False), 7: (6, True)}
    lines = plan(found).split("\n")
    fed = [lines[n + 1] for n, line in enumerate(lines) if "Join " in line]
    assert fed and all(any(w in line for w in ("Project", "Union", "Aggregate")) for line in fed)  # whole rows, with their texts, were joined


def test_facts_shuffle_lines_once_and_sum_them_by_kind(spark, tmp_path):
    from datetime import datetime

    from quarterdeck.sources import fixtures

    line = "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    lines = [(1, 2.0, 100.0, 0.1, 0.05, "R"), (1, 1.0, 50.5, 0.02, 0.01, "A"), (2, 3.0, 70.0, None, 0.05, "N"), (2, 4.0, 80.0, 0.05, None, "A"), (3, 5.0, 9.99, 0.1, 0.08, None), (4, None, None, 0.1, 0.1, "A"), (9, 1.0, 1.0, 0.0, 0.0, "A")]
    tables = {
        "lineitem": (lines, line), "customer": ([(1, 4), (2, 4), (3, None)], "c_custkey long, c_nationkey long"),
        "orders": ([(1, 1, "O", datetime(1996, 1, 5)), (2, 2, "F", datetime(1996, 2, 5)), (3, 2, None, datetime(1996, 3, 5)), (4, 1, "O", datetime(1997, 1, 5)), (5, 7, "O", datetime(1997, 1, 5))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = fixtures._facts(spark, str(tmp_path))
    got = {(r["period"], r["metric_code"]): round(r["value"], 4) for r in found.collect()}
    net = 90.0 + 50.5 * 0.98 + 80.0 * 0.95 + 9.99 * 0.9  # without the line that has no discount
    taxed = 100 * 0.05 + 50.5 * 0.01 + 70 * 0.05 + 9.99 * 0.08
    want = {
        "revenue": net, "operating_profit": 50.5 * 0.98 + 76.0 - taxed, "net_income": net - (15.0 + 50.5 * 0.03 + 9.99 * 0.18) - 100, "ebitda": 50.5 * 0.98 + 76.0, "operating_cash_flow": 15000.0, "capex": taxed,
        "current_assets": 130.5, "current_liabilities": 70.0, "total_assets": 310.49, "total_debt": 150.5, "total_equity": 150.0, "cash_and_equivalents": 10 + 1.01 + 4 + 0.999,
    }
    assert {k[1]: v for k, v in got.items() if k[0] == "1996Q1"} == {k: round(v, 4) for k, v in want.items()}
    assert {k[1]: v for k, v in got.items() if k[0] == "1997Q1"} == {"current_liabilities": 0.0, "total_equity": 0.0}
    before = plan(found).split("Aggregate")[-1]  # what lies below the sums of lines
    assert before.count("Join ") == 2 and "Relation [l_orderkey" in before.split("Join ")[1] and "Relation [c_custkey" not in before.split("Join ")[1]  # lines met the orders, then all of them the customers


def test_readiness_derives_no_prices(spark, monkeypatch):
    from quarterdeck.plans.gate_queries import m23_readiness_scopes
    from quarterdeck.sources import fixtures

    monkeypatch.setitem(spark.__dict__, "_quarterdeck_tables", {})
    monkeypatch.setattr(fixtures, "_candles", lambda *_: 1 / 0)  # all opening and closing prices were derived to learn who has any
    got = m23_readiness_scopes(spark, "/root/testdata/sf0.001").where("scope = 'market_technical_analysis' and supported").count()
    assert got > 0


def test_readiness_is_counted_without_objects(spark):
    rows = [(1, "fact", "revenue"), (1, "fact", "x"), (1, "rejected", None), (2, "evidence", None), (None, "fact", "b"), (None, "fact", "a"), (3, "rejected", None)]
    outcomes = spark.createDataFrame(rows, "document_id long, outcome string, metric_code string")
    got = R.analysis_readiness(outcomes, ["revenue", "b", "a", "a"])
    found = {r["document_id"]: (r["facts"], r["rejected"], r["evidence"], r["missing"], r["llm_ready"], r["grade"]) for r in got.collect()}
    assert found == {1: (2, 1, 0, "a,b", "true", "strong"), 2: (0, 0, 1, "a,b,revenue", "limited_evidence_only", "weak"), None: (2, 0, 0, "revenue", "true", "strong"), 3: (0, 1, 0, "a,b,revenue", "false", "blocked")}
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["missing"] for r in R.analysis_readiness(outcomes, []).collect()} == {""}


def test_names_meet_few_words_of_texts(spark):
    from quarterdeck.operators import entities
    from quarterdeck.operators.validation import entity_text

    texts = [(1, "Northern, Oil & Gas"), (1, "Northern, Oil & Gas"), (2, "the sea-bank of Ёлка"), (3, None), (4, "?!"), (5, "gas of the north sea bank")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    assert [r["t"] for r in docs.select(entity_text(F.col("text")).alias("t")).collect()] == ["northern oil gas", "northern oil gas", "the sea bank of елка", "", "", "gas of the north sea bank"]
    names = spark.createDataFrame([("a", "Northern oil"), ("a", "oil, gas"), ("b", "Oil gas"), ("b", "OIL GAS"), ("c", "sea bank"), ("d", "елка"), ("e", "of"), ("f", None), ("g", "gas sea north")], "entity string, name string")
    found = entities.match_entity_in_text(docs, names)
    got = sorted((r["doc_id"], r["entity"]) for r in found.collect())
    assert got == [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "d"), (5, "c"), (5, "g")]  # two names of "a" stand in a text, and one row
    assert plan(found).count("coalesce(text#") == 2  # once a reading; more when filters had copies
    assert "LeftSemi" in plan(found)  # words that no name needs are dropped before they are shuffled
    index = plan(entities.contained(names.select(F.col("name").alias("n")), "n", docs.select(F.col("text").alias("w")), "w"))
    assert "LeftSemi" in index


def test_engine_rows_are_dealt_by_document_once(spark, monkeypatch):
    from quarterdeck.operators import engines

    written = {}
    write = engines.kept
    monkeypatch.setattr(engines, "kept", lambda df, name: written.setdefault(name, []).append(plan(df)) or write(df, name))
    schema = "document_id string, table_index int, page_number int, statement_type string, statement_family string, table_role string, period string, comparative_period string, unit string, currency string, engine string, row_index int, row_kind string, metric_code string, label string, current string, comparative string, confidence double"
    row = lambda d, table, k, label, engine="ocr", page=1, unit=None, kind="income_statement": (d, table, page, kind, None, "primary_statement", "2021Q4", None, unit, None, engine, k, "statement_line_item", None, label, "1", None, 0.9)
    old = [row("d", 7, 0, "Sales", "native"), row("d", 7, 1, "Rent", "native"), row("e", 7, 0, "Sales", "native"), row("d", 8, 0, "Sales", "native", page=2)]
    # two engines' rows of one place, a row twice that none takes, a second table for the same one, a table of its own
    new = [row("d", 0, 0, "Sales", unit="million"), row("d", 0, 0, "Sales", "camelot"), row("d", 0, 1, "Tax"), row("d", 0, 1, "Tax"), row("d", 1, 0, "Rents"), row("e", 3, 0, "Cash", page=9)]
    got = engines.merge_engine_tables(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), {})
    shown = sorted((r["document_id"], r["table_index"], r["origin"], r["row_index"], r["label"], r["engines"], r["unit"] or "") for r in got.collect())
    assert shown == [
        ("d", 7, "appended", 1, "Tax", "ocr", "million"), ("d", 7, "appended", 1, "Tax", "ocr", "million"), ("d", 7, "merged", 0, "Sales", "camelot,native", "million"), ("d", 7, "merged", 0, "Sales", "native,ocr", "million"),
        ("d", 7, "merged", 1, "Rents", "native,ocr", "million"), ("d", 8, "existing", 0, "Sales", "native", ""), ("e", 3, "added", 0, "Cash", "ocr", ""), ("e", 7, "existing", 0, "Sales", "native", ""),
    ]
    for text in (plan(got), written["engine-pairs"][0]):  # once, not for each join in turn
        assert "Join " not in text and text.count("RepartitionByExpression") == 1
