"""Queries of grids, text lines, concepts, documents and engines; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engines as G
from ..operators import portfolio as C
from ..operators.concepts import CONCEPTS, ISSUERS, score_concepts
from ..operators.grids import normalize_table_grid
from ..operators.statements import download_acceptance
from ..operators.text_rows import split_merged_rows, text_line_facts
from ..operators.validation import MARKERS, STATEMENTS_RU, document_markers
from ..sources import fixtures as S
from ..storage import kept
from .queries import query

# ---- grids ----

GRID_LINES = """
ln as (
  select l_orderkey k, o_custkey c, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 i, p_name || ' ' || lower(p_type) as name,
         replace(format('{:,}', floor(l_extendedprice)::bigint), ',', ',') a, (l_quantity::bigint)::varchar b, l_linenumber % 2 = 0 noted, l_linenumber::varchar note, 2021 + year(o_orderdate) % 6 y
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""


@query(
    """select c document_id, k table_index, i row_index, case when k % 5 = 4 then name || ' extra' else name end line, case when k % 5 = 0 and noted then note end note_ref,
       case k % 5 when 0 then (y || '=' || a || ';' || (y - 1) || '=' || b) when 1 then ('At year end ' || y || '=' || a || ';At year end ' || (y - 1) || '=' || b) when 2 then ('Amount=' || a || ';Tax=' || b)
         when 3 then (y || '=' || a || ';' || (y - 1) || '=' || b) else (y || '=' || a || ';' || y || '__2=' || b) end cells,
       k % 5 = 3 recovered, case when k % 5 = 1 then 2 else 1 end header_rows, case when k % 5 in (1, 4) then 'degraded' else 'standard' end quality from ln""",
    GRID_LINES.strip(),
)
def t32_normalize_table_grid(spark, sf_dir):
    """One grid an order: years as columns, two header rows, no dates, values within labels, split labels under equal years."""
    parts = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    orders = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("document_id"), (F.year("o_orderdate") % 6 + 2021).cast("string").alias("y"), (F.year("o_orderdate") % 6 + 2020).cast("string").alias("z"))
    k, note = F.col("l_orderkey") % 5, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string"))
    a, b = F.format_number(F.floor("l_extendedprice"), 0), F.col("l_quantity").cast("long").cast("string")
    empty = F.lit("")
    row = (
        F.when(k == 0, F.array("name", note, a, b)).when(k == 1, F.array(F.concat(F.lit("  "), "name"), a, b)).when(k == 2, F.array("name", a, b)).when(k == 3, F.array(F.concat_ws(" ", "name", a, b))).otherwise(F.array(F.col("name"), F.lit("extra"), a, b, empty))
    )
    lines = S.table(spark, sf_dir, "lineitem").hint("merge").join(parts.hint("merge"), "l_partkey")
    lines = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", row.alias("row")).alias("x"))
    grids = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias("data")).hint("merge").join(orders.hint("merge"), "l_orderkey")
    heads = (
        F.when(k == 0, F.array(F.array(empty, F.lit("Note"), F.col("y"), F.col("z")))).when(k == 1, F.array(F.array(F.lit("Item"), F.lit("At year end"), F.lit("At year  end")), F.array(empty, F.col("y"), F.col("z"))))
        .when(k == 2, F.array(F.array(F.lit("Item"), F.lit("Amount"), F.lit("Tax")))).when(k == 3, F.array(F.array(F.lit("Item"), F.col("y"), F.col("z")))).otherwise(F.array(F.array(F.lit("Item"), F.lit("Part"), F.col("y"), F.col("y"))))
    )
    blank = F.array(F.array(F.lit(None).cast("string"), empty))
    found = normalize_table_grid(grids.select("document_id", F.col("l_orderkey").alias("table_index"), F.concat(heads, blank, "data").alias("rows")))
    shown = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("document_id", "table_index", "row_index", "line", "note_ref", shown.alias("cells"), "recovered", "header_rows", "quality")


# ---- text lines ----

_D = "coalesce(n_chars, 0)::varchar"
_TEXT_FACTS = [  # (line, width, label, metric, current, comparative, confidence, single): numbers as SQL
    (1, 1, "'Revenue'", "revenue", "a", "b", 0.94), (2, 2, "'Operating profit'", "operating_profit", "a", "'(' || b || ')'", 0.94),
    (5, 1, "'Net income'", "net_income", "'(' || b || ')'", None, 0.94), (6, 1, "'Profit before tax'", "profit_before_tax", "a", None, 0.94),
]
_PER_SHARE = [
    (2, 3, "'Operating profit ' || a || ' (' || b || ') Basic earnings per share'"), (3, 2, "'profit ' || a || ' (' || b || ') Basic earnings per share'"), (3, 3, "'profit ' || a || ' (' || b || ') Basic earnings per share 3 2 Net income'"),
    (4, 1, "'Basic earnings per share'"), (4, 2, "'Basic earnings per share 3 2 Net income'"), (4, 3, "'Basic earnings per share 3 2 Net income (' || b || ') Profit before tax'"),
]


def _text_facts_sql() -> str:
    parts = ["select d document_id, null::int line_index, null::int width, 'table_rejected' outcome, null raw_label, null metric_code, null period, null raw_value, null::double as value, null column_name, why reason from base where why is not null"]
    value = lambda raw: f"case when starts_with({raw}, '(') then -1 else 1 end * replace(replace({raw}, '(', ''), ')', '')::double * 1e6"
    for line, width, label, metric, now, before, _ in _TEXT_FACTS:
        column = "case when bank then 'current_first' else 'current_first' end" if before else "'single_current_period_value'"
        parts.append(f"select d, {line}, {width}, 'fact', {label}, '{metric}', '2021Q4', {now}, {value(now)}, {column}, null from base where why is null and unit is not null")
        if before:
            parts.append(f"select d, {line}, {width}, 'fact', {label}, '{metric}', '2020Q4', {before}, {value(before)}, 'comparative_second', null from base where why is null and unit is not null and bank")
        parts.append(f"select d, {line}, {width}, 'rejected', {label}, '{metric}', null, null, null, null, 'unit_or_currency_basis_missing' from base where why is null and unit is null")
    for line, width, label in _PER_SHARE:
        parts.append(f"select d, {line}, {width}, 'rejected', {label}, null, null, null, null, null, 'per_share_row_not_statement_fact' from base where why is null")
    return "\nunion all ".join(parts)


@query(
    _text_facts_sql(),
    "base as (select doc_id d, (coalesce(n_chars, 0) + 1000)::varchar a, (doc_id + 1000)::varchar b, doc_id % 3 = 0 bank, case when doc_id % 5 <> 0 then 'million' end unit,"
    " case when doc_id % 11 = 0 then 'not_text_fallback_raw_table' when doc_id % 13 = 0 then 'missing_traceability' when doc_id % 17 = 0 then 'notes_fallback_not_eligible_for_fact_normalization' when doc_id % 19 = 0 then 'primary_statement_marker_not_detected' end why from documents)",
)
def t15_text_line_facts(spark, sf_dir):
    """Each document as a raw text table: the lines of a statement before all lines of its text."""
    d = F.col("doc_id")
    a, b = (F.coalesce("n_chars", F.lit(0)) + 1000).cast("string"), (d + 1000).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = F.array(F.when(d % 19 == 0, "Table 2021 2020").otherwise("Consolidated statement of profit or loss 2021 2020"), text("Revenue 5 ", a, " ", b), F.lit("Operating"), text("profit ", a, " (", b, ")"), F.lit("Basic earnings per share 3 2"), text("Net income (", b, ")"), text("Profit before tax ", a))
    tables = S.table(spark, sf_dir, "documents").select(
        d.alias("document_id"), F.lit(0).alias("table_index"), F.lit("income_statement").alias("statement_type"), F.lit("2021Q4").alias("period"), F.when(d % 11 == 0, "grid").otherwise("text_table_fallback").alias("extraction_method"), F.lit("raw_text_table").alias("quality_flag"),
        F.lit("file").alias("source_location"), F.when(d % 13 != 0, 1).alias("page_number"), F.when(d % 17 == 0, "Notes to the report").otherwise("Table").alias("table_title"), F.lit(None).cast("array<string>").alias("headers"),
        F.concat(head, F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"), F.when(d % 5 != 0, "million").alias("unit"), F.lit(None).cast("string").alias("currency"), F.lit(1e6).alias("unit_multiplier"), (d % 3 == 0).alias("is_bank"),
    )
    found = text_line_facts(tables)
    return found.select("document_id", "line_index", "width", "outcome", "raw_label", "metric_code", "period", "raw_value", "value", "column_name", "reason")


MERGED = "m as (select o_custkey d, o_orderkey k, (o_orderkey + o_custkey) % 7 s, (floor(o_totalprice) + 100)::bigint::varchar a, (o_custkey + 100)::varchar b, floor(o_totalprice / 3)::bigint::varchar own from orders)"


@query(
    """select d document_id, k row_index, part, line, cur as current, comp as comparative, mode from (
       select *, unnest(case s when 0 then [{'part': 0, 'line': 'Revenue', 'cur': a, 'comp': b, 'mode': 'embedded'}, {'part': 1, 'line': 'Operating profit', 'cur': own, 'comp': null, 'mode': 'embedded'}]
         when 1 then [{'part': 0, 'line': 'Revenue', 'cur': a, 'comp': b, 'mode': 'merged'}, {'part': 1, 'line': 'Net profit', 'cur': '(' || b || ')', 'comp': null, 'mode': 'merged'}, {'part': 2, 'line': 'Operating expenses', 'cur': b, 'comp': a, 'mode': 'merged'}]
         when 2 then [{'part': 0, 'line': 'Non-current assets', 'cur': a, 'comp': b, 'mode': 'leading_total'}, {'part': 1, 'line': 'Cash and cash equivalents', 'cur': own, 'comp': null, 'mode': 'leading_total'}]
         when 3 then [{'part': 0, 'line': 'Current liabilities', 'cur': a, 'comp': b, 'mode': 'leading_total'}, {'part': 1, 'line': 'Total liabilities', 'cur': b, 'comp': a, 'mode': 'leading_total'}, {'part': 2, 'line': 'Total equity', 'cur': own, 'comp': null, 'mode': 'leading_total'}]
         when 4 then [{'part': 0, 'line': 'Revenue ' || a || ' ' || b, 'cur': own, 'comp': null, 'mode': null}]
         when 5 then [{'part': 0, 'line': 'Revenue ' || a || ' ' || b || ' Unknown thing', 'cur': own, 'comp': null, 'mode': null}]
         else [{'part': 0, 'line': a || ' ' || b || ' Total assets', 'cur': own, 'comp': null, 'mode': null}] end, recursive := true) from m)""",
    MERGED,
)
def t18_split_merged_rows(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    s = (F.col("o_orderkey") + F.col("o_custkey")) % 7
    a, b = (F.floor("o_totalprice") + 100).cast("string"), (F.col("o_custkey") + 100).cast("string")
    join = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    minus = F.concat(F.lit("("), b, F.lit(")"))
    line = (
        F.when(s == 0, join("Revenue", "5", a, b, "Operating profit")).when(s == 1, join("Revenue", a, b, "Net profit", minus, "Operating expenses", b, a)).when(s == 2, join(a, b, "Current assets", "Cash and cash equivalents"))
        .when(s == 3, join(a, b, "Total liabilities", b, a, "Total equity")).when(s == 4, join("Revenue", a, b)).when(s == 5, join("Revenue", a, b, "Unknown thing")).otherwise(join(a, b, "Total assets"))
    )
    kind = F.when(s.isin(2, 3), "balance_sheet").otherwise("income_statement")
    own = F.when(s != 1, F.floor(F.col("o_totalprice") / 3).cast("string"))
    rows = o.select(F.col("o_custkey").alias("document_id"), F.lit(0).alias("table_index"), F.col("o_orderkey").alias("row_index"), kind.alias("statement_type"), line.alias("line"), own.alias("current"), F.lit(None).cast("string").alias("comparative"))
    return split_merged_rows(rows).drop("table_index")


# ---- concepts ----

LABELS = (
    "Revenue", "  Sales (including excise and export tariffs), net", "Profit for the year attributable to owners", "Profit for the  year", "Total Assets", "Capital expenditures2", "EBITDA", "Net cash from operating activities", "Operating profit on non-banking activities",
    "Чистые процентные доходы", "Sundry items", "Short-term borrowings, promissory notes and current portion of long-term borrowings", "Derived total debt", "Total debt",
)
CONTEXTS = ("profit_or_loss", "financial_position", "statement_text", "segment_information_note", "cash_flow")
PERIOD_TYPES = ("ytd", "annual", "balance_sheet_snapshot", "quarter")
TICKERS = ("LKOH", "tatn", "GAZP", "ZZZZ", "")


def _concepts_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    alt = lambda xs: q("|".join(f"(?:{x})" for x in xs)) if xs else "null"
    concepts = ", ".join(f"({n}, {q(code)}, {names(contexts)}, {alt(patterns)}, {alt(excluded)}, {names(periods)})" for n, (code, contexts, patterns, excluded, periods) in enumerate(CONCEPTS))
    more = ", ".join(f"({q(t)}, {at}, {q(code)}, {alt(xs)})" for t, issuer in ISSUERS.items() for at in (0, 1) for code, xs in issuer[at].items())
    aliases = ", ".join(f"({q(t)}, {q(a)}, {q(b)})" for t, issuer in ISSUERS.items() for a, b in issuer[2].items())
    pick = lambda xs, by: f"{names(xs)}[({by}) % {len(xs)} + 1]"
    return f"""
concepts(n, code, contexts, pattern, excluded, periods) as (values {concepts}),
more(ticker, part, code, pattern) as (values {more}),
aliases(ticker, alias, context) as (values {aliases}),
labels as (
  select l_orderkey k, l_linenumber i, l_partkey p, l_suppkey s, {pick(LABELS, "l_partkey")} raw, {pick(CONTEXTS, "l_orderkey")} context, {pick(PERIOD_TYPES, "l_suppkey")} period_type, upper({pick(TICKERS, "l_linenumber")}) ticker,
         l_partkey % 4 <> 0 unit, l_suppkey % 5 <> 0 currency, l_orderkey % 6 <> 0 located from lineitem),
kinds as (select distinct raw, ticker, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) label from labels),
found as (
  select raw, k.ticker, c.n, c.code, contexts, periods,
         coalesce(regexp_matches(label, c.excluded), false) or exists (select 1 from more m where m.ticker = k.ticker and m.code = c.code and m.part = 1 and regexp_matches(label, m.pattern)) excluded
  from kinds k, concepts c where regexp_matches(label, c.pattern) or exists (select 1 from more m where m.ticker = k.ticker and m.code = c.code and m.part = 0 and regexp_matches(label, m.pattern))
  qualify row_number() over (partition by raw, k.ticker order by c.n) = 1),
scored as (
  select l.*, f.code, f.excluded, list_contains(f.contexts, coalesce(a.context, l.context)) c_ok, list_contains(f.periods, l.period_type) p_ok
  from labels l left join found f on f.raw = l.raw and f.ticker = l.ticker left join aliases a on a.ticker = l.ticker and a.alias = l.context)"""


@query(
    """select k order_key, i line_number, p part_key, s supplier_key, code concept_code, case when code is null or excluded then 0.0 when c_ok and p_ok and unit and currency and located then 0.9 else 0.65 end::double confidence,
       case when code is null then 'no_concept_label_match' when excluded then 'excluded_label_pattern' when not c_ok then 'statement_context_allowed' when not p_ok then 'period_type_allowed' when not unit then 'unit_detected'
         when not currency then 'currency_detected' when not located then 'source_location_exists' end reason, case when code is not null and ticker in ('LKOH', 'TATN', 'GAZP') then ticker end issuer_rules from scored""",
    _concepts_sql().strip(),
)
def t8_score_concepts(spark, sf_dir):
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col(by) % len(names) + 1).cast("int"))
    rows = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_key"), pick(LABELS, "l_partkey").alias("raw_label"), pick(CONTEXTS, "l_orderkey").alias("statement_context"),
        pick(PERIOD_TYPES, "l_suppkey").alias("period_type"), pick(TICKERS, "l_linenumber").alias("ticker"), (F.col("l_partkey") % 4 != 0).alias("unit_detected"), (F.col("l_suppkey") % 5 != 0).alias("currency_detected"), (F.col("l_orderkey") % 6 != 0).alias("source_location_exists"),
    )
    return score_concepts(rows).select("order_key", "line_number", "part_key", "supplier_key", "concept_code", "confidence", "reason", "issuer_rules")


# ---- documents ----

HOSTS = ("www.example.org", "reports.example.org")
STATED = ("financial_statements", "annual_report", "press_release", "issuer_report")
OPENINGS = (
    "Consolidated financial statements, IFRS. Statement of cash flows. Notes to the statements for the year ended 31 December 2021. ", "Annual report 2020. ", "Press release: financial results. ",
    "РСБУ. Бухгалтерский баланс. Примечания. 2021. ", "Independent auditor; International Financial Reporting Standards. Consolidated  financial statements. Acme Holdings ", "",
)


def _documents(spark, sf_dir):
    """Documents as reports: every sixth opens in another way; host, file, role and standard by the id."""
    d = F.col("doc_id")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    return S.table(spark, sf_dir, "documents").select(
        d.alias("document_id"), F.concat(pick(OPENINGS, d), F.coalesce("text", F.lit(""))).alias("text"), F.array(F.lit("ACH"), F.lit("Acme Holdings PJSC"), F.lit(None).cast("string")).alias("names"),
        F.concat(F.lit("https://"), pick((*HOSTS, "other.net"), d), F.lit("/a.pdf")).alias("source_url"), F.when(d % 4 == 0, "report.xlsx").otherwise("report.pdf").alias("file_name"), F.lit("pdf").alias("file_type"), F.when(d % 7 != 0, "h").alias("content_hash"),
        F.lit(None).cast("string").alias("report_period"), F.when(d % 6 == 3, "RAS").otherwise("IFRS").alias("reporting_standard"), pick(STATED, F.floor(d / 6)).alias("source_role"),
    )


def _markers_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    any_of = lambda words: "(" + " or ".join(f"contains(t, {q(w)})" for w in words) + ")"
    pick = lambda xs, by: "[" + ", ".join(map(q, xs)) + f"][({by}) % {len(xs)} + 1]"
    marks = ", ".join(f"{any_of(words)} m_{name}" for name, words in MARKERS.items())
    return f"""
report as (
  select doc_id d, {pick(OPENINGS, "doc_id")} || coalesce(text, '') body, doc_id % 3 <> 2 trusted, doc_id % 4 <> 0 fits, doc_id % 7 <> 0 hashed, case when doc_id % 6 = 3 then 'RAS' else 'IFRS' end stated, {pick(STATED, "doc_id // 6")} stated_role from documents),
normal as (select *, trim(regexp_replace(regexp_replace(replace(lower(body), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) t from report),
names as (select *, trim(regexp_replace(t, '[^0-9a-zа-я]+', ' ', 'g')) e from normal),
marked as (
  select *, {marks}, {any_of(STATEMENTS_RU)} m_ru, contains(e, 'ach') or contains(e, 'acme holdings pjsc') or list_has_all(string_split(e, ' '), ['acme', 'holdings']) m_company,
         regexp_matches(body, '\\b20[0-9][0-9]\\b') m_period from names),
judged as (
  select *, case when m_consolidated or m_ru then 'financial_statements' when m_annual_report then 'annual_report' when m_press_release then 'press_release' else stated_role end as role, case when m_ifrs then 'IFRS' when m_ras then 'RAS' else stated end standard from marked),
validated as (
  select *, round(case when trusted then 0.15::double else 0 end + case when body <> '' then 0.15::double else 0 end + case when hashed then 0.1::double else 0 end + case when fits then 0.1::double else 0 end + case when m_company then 0.15::double else 0 end
      + case when standard = stated then 0.15::double else 0 end + case when role = stated_role then case when stated_role in ('financial_statements', 'annual_report') then 0.15::double else 0.1::double end else 0 end + case when m_period then 0.05::double else 0 end, 4) score,
      case stated_role when 'financial_statements' then case when stated = 'RAS' then m_ras and m_primary else m_ifrs and m_consolidated end when 'annual_report' then m_annual_report when 'press_release' then m_press_release else true end needs
  from judged),
documents_validated as (select *, case when score >= 0.75 and needs then 'pass' when score >= 0.5 then 'partial' else 'fail' end status from validated)"""


_SHOWN = ("company", *MARKERS, "period")


@query("select d document_id, " + ", ".join(f"m_{m} {m}_marker" for m in _SHOWN) + ", role as detected_role, standard detected_standard, score, status validation_status from documents_validated", _markers_sql().strip())
def t19_document_markers(spark, sf_dir):
    found = document_markers(_documents(spark, sf_dir), HOSTS)
    return found.select("document_id", *[F.col("markers")[m].alias(f"{m}_marker") for m in _SHOWN], "detected_role", "detected_standard", "score", "validation_status")


@query(
    """select d document_id, reason is null accepted, reason from (select d, case when status <> 'pass' then 'document_validation_' || status when stated <> standard then 'reporting_standard_mismatch'
       when stated_role = 'financial_statements' then case when role <> 'financial_statements' then 'document_role_not_financial_statements' end
       when role = 'financial_statements' and m_company and m_period and (m_ifrs or m_ras) and m_consolidated and m_primary and m_notes then null else 'embedded_financial_statements_not_proven' end reason from documents_validated)""",
    _markers_sql().strip(),
)
def c13_acceptance_of_documents(spark, sf_dir):
    return download_acceptance(document_markers(_documents(spark, sf_dir), HOSTS)).select("document_id", "accepted", "reason")


# ---- engines ----

ENGINE_ROWS = """
ex as (
  select o_custkey d, l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) i, floor(l_extendedprice)::bigint::varchar v, floor(l_extendedprice / 2)::bigint::varchar h
  from lineitem join orders on l_orderkey = o_orderkey),
labelled as (select *, 'r' || k || 'n' || i as label, i % 5 s, case when k % 5 = 1 then 'add' when k % 5 = 0 and k % 7 = 0 then 'ignore' when k % 5 = 2 then 'conflict' else 'merge' end fate from ex),
unit as (select distinct k, case when k % 3 = 0 then 'million' when fate = 'merge' then 'thousand' end unit, fate from labelled)"""


@query(
    """select o.*, u.unit from (
         select d document_id, k table_index, i row_index, case when fate = 'merge' and s in (0, 2, 4) then 'merged' else 'existing' end origin, case when fate = 'merge' and s = 2 then label || 's' else label end as label, v as current,
           case when fate = 'merge' and s in (0, 2, 4) then h end comparative, case when fate = 'merge' and s in (0, 2, 4) then 'camelot,native' else 'native' end engines, case when fate = 'merge' and s in (0, 2, 4) then 'merged_engines' else 'single_engine' end fusion_status,
           case when fate = 'merge' then case s when 0 then 'fused_row' when 2 then 'semantic_row_identity_merge' when 4 then 'fused_row' end end as mode, null reason from labelled
         union all
         select d, case when fate = 'add' then k + 1000000000 else k end, i, case when fate = 'add' then 'added' when fate = 'conflict' or s = 1 then 'evidence' else 'appended' end, case s when 2 then label || 's' when 3 then 'x' || label when 4 then '' else label end,
           case when s = 1 then h else v end, h, case when fate = 'merge' and s = 1 then 'camelot,native' else 'camelot' end, case when fate = 'conflict' or fate = 'merge' and s = 1 then 'conflict_retained_as_evidence' else 'single_engine' end, null,
           case when fate = 'conflict' then 'period_conflict' when fate = 'merge' and s = 1 then 'weak_alignment' end from labelled where fate in ('add', 'conflict') or fate = 'merge' and s in (1, 3)) o
       left join unit u on u.k = o.table_index""",
    ENGINE_ROWS.strip(),
)
def f14_merge_engine_tables(spark, sf_dir):
    """One table an order from a native engine, and again from another: equal rows, changed values, plural labels, other rows and
    rows without labels; tables of an unknown statement, on other pages and of another period."""
    orders = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("document_id"))
    place = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
    lines = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", place.alias("row_index")).hint("merge").join(orders.hint("merge"), "l_orderkey")
    k, none = F.col("l_orderkey"), F.lit(None).cast("string")
    rows = lines.select("document_id", k.alias("table_index"), "row_index", F.floor("l_extendedprice").cast("string").alias("current"), F.floor(F.col("l_extendedprice") / 2).cast("string").alias("half"))
    rows = rows.withColumn("label", F.concat(F.lit("r"), F.col("table_index").cast("string"), F.lit("n"), F.col("row_index").cast("string")))
    rows = kept(rows, "engine-lines")
    t, s = F.col("table_index"), F.col("row_index") % 5
    same = {"statement_family": none, "table_role": F.lit("primary_statement"), "row_kind": F.lit("statement_line_item"), "metric_code": none, "comparative_period": none, "currency": none}
    old = rows.withColumns(same | {"page_number": t, "statement_type": F.lit("income_statement"), "period": F.lit("2021Q4"), "engine": F.lit("native"), "comparative": none, "confidence": F.lit(0.9), "unit": F.when(t % 3 == 0, "million")}).drop("half")
    label = F.when(s == 2, F.concat("label", F.lit("s"))).when(s == 3, F.concat(F.lit("x"), "label")).when(s == 4, "").otherwise(F.col("label"))
    lost = (t % 5 == 1) | ((t % 5 == 0) & (t % 7 == 0))
    new = rows.withColumns(same | {
        "page_number": F.when(lost, -t - 1).otherwise(t), "statement_type": F.when(t % 5 == 0, "unknown").otherwise("income_statement"), "period": F.when(t % 5 == 2, "2020Q4").otherwise("2021Q4"), "engine": F.lit("camelot"), "comparative": F.col("half"),
        "confidence": F.lit(0.8), "unit": F.lit("thousand"), "label": label, "current": F.when(s == 1, F.col("half")).otherwise(F.col("current")),
    }).withColumn("table_index", F.when(t % 5 == 1, t + 1_000_000_000).otherwise(t)).drop("half")
    found = G.merge_engine_tables(old, new, {"native": 2, "camelot": 1})
    return found.select("document_id", "table_index", "row_index", "origin", "label", "current", "comparative", "engines", "fusion_status", "mode", "reason", "unit")


# ---- portfolio ----

COVERAGE = """
cov as (
  select o_custkey c, 'C' || o_custkey entity, count(*) n, count(*) filter (o_orderstatus = 'F') f, count(*) filter (month(o_orderdate) = 12) dec, sum(o_totalprice) > 2000000 large from orders group by 1, 2),
levels as (
  select *, case when n >= 12 then 'FULL_STATEMENT_READY' when n >= 7 then 'PARTIAL_STATEMENT_READY' when n >= 4 then 'SOURCE_ONLY' else 'NO_COVERAGE' end level,
         list_filter([case when dec = 0 then 'missing_fy_report' end, case when f = 0 then 'image_only_primary_statement_pages' end, case when not large then 'valuation_inputs' end], lambda x: x is not null) blockers from cov),
companies as (
  select entity, case level when 'FULL_STATEMENT_READY' then 'READY' when 'PARTIAL_STATEMENT_READY' then 'PARTIAL' else 'BLOCKED' end main_status, level, blockers,
         list_sort(list_distinct(list_filter([case when n >= 7 then 'fact_candidates' end, case when f > 0 then 'statement_tables' end, case when f > 0 then 'dataframe_artifacts' end, case when n > f then 'fact_candidates' end, case when c % 5 = 0 then 'manual_document_analysis' end], lambda x: x is not null))) outputs,
         list_filter([case when level = 'FULL_STATEMENT_READY' then 'scoped_readiness_only' end, case when c % 5 = 0 then 'manual_upload_is_lower_trust' end], lambda x: x is not null) notes from levels)"""


def _companies(spark, sf_dir):
    """One company a customer: coverage and evidence by its orders."""
    o = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.month("o_orderdate") == 12).alias("dec"), F.sum("o_totalprice").alias("sum"))
    entity, n = F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity"), F.col("n")
    level = F.when(n >= 12, "FULL_STATEMENT_READY").when(n >= 7, "PARTIAL_STATEMENT_READY").when(n >= 4, "SOURCE_ONLY").otherwise("NO_COVERAGE")
    blockers = F.array_compact(F.array(F.when(F.col("dec") == 0, "missing_fy_report"), F.when(F.col("f") == 0, "image_only_primary_statement_pages"), F.when(~(F.col("sum") > 2_000_000), "valuation_inputs")))
    none = F.lit(None).cast("string")
    coverage = o.select(entity, level.alias("coverage_level"), blockers.alias("blockers"), F.get(blockers, F.lit(0)).alias("main_blocker"), F.array_compact(F.array(F.when(n >= 7, "fact_candidates"))).alias("outputs"), none.alias("next_action"))
    zero = {c: F.lit(0) for c in ("matched_facts", "candles", "peers", "compared_metrics")}
    evidence = o.select(entity, F.col("f").alias("statement_tables"), (n - F.col("f")).alias("fact_candidates"), F.when(F.col("o_custkey") % 5 == 0, 1).alias("manual_documents")).withColumns(zero)
    return C.portfolio_companies(coverage, evidence)


@query("select entity, main_status, level coverage_level, array_to_string(outputs, ',') outputs, array_to_string(blockers, ',') blockers, array_to_string(notes, ',') notes from companies", COVERAGE.strip())
def c17_portfolio_companies(spark, sf_dir):
    return _companies(spark, sf_dir).select("entity", "main_status", "coverage_level", *[F.array_join(c, ",").alias(c) for c in ("outputs", "blockers", "notes")])


@query(
    """select section, k as "key", count(*) companies, array_to_string(list_sort(list(entity))[1:5], ',') entities from (
       select entity, 'total' as section, 'companies' k from companies union all select entity, 'main_status', main_status from companies union all select entity, 'coverage_level', level from companies
       union all select entity, 'blocker', unnest(blockers) from companies union all select entity, 'output', unnest(outputs) from companies) group by all""",
    COVERAGE.strip(),
)
def c17_portfolio_report(spark, sf_dir):
    return C.portfolio_report(_companies(spark, sf_dir))


COVERED = """
cv as (
  select o_custkey c, 'C' || o_custkey entity, count(*) n, count(*) filter (o_orderstatus = 'F') f, count(*) filter (month(o_orderdate) = 12) dec, sum(o_totalprice) > 2000000 large from orders group by 1, 2),
cs as (
  select *, n >= 12 and f * 2 >= n auto, c % 3 = 0 market, case when f = 0 then 'NO_PRIMARY_STATEMENTS' when dec = 0 then 'TABLES_PARTIAL' when c % 11 <> 0 then 'TABLES_READY' end tables, case when n >= 7 then 'FACTS_READY' when n >= 4 then 'FACTS_PARTIAL' else 'NO_FACTS' end fstat,
         list_filter([case when dec = 0 and n < 7 then 'missing_fy_report' end, case when f = 0 then 'no_primary_statement_tables' end, case when n < 2 then 'no_safe_fact_candidates' end, case when not large then 'unavailable_valuation_inputs' end, case when c % 5 = 0 then 'manual_upload_available' end,
           case when c % 13 = 0 then 'odd_thing' end], lambda x: x is not null) b from cv),
cl as (
  select *, list_contains(b, 'missing_fy_report') src, list_has_any(b, ['no_primary_statement_tables', 'no_safe_fact_candidates']) par from cs),
levelled as (
  select *, case when auto then 'FULL_STATEMENT_READY' when src then 'SOURCE_BLOCKED' when tables in ('TABLES_READY', 'TABLES_PARTIAL') and fstat = 'FACTS_READY' then 'FULL_STATEMENT_READY' when par or tables = 'NO_PRIMARY_STATEMENTS' then 'PARSER_BLOCKED'
    when f > 0 or fstat in ('FACTS_READY', 'FACTS_PARTIAL') then 'PARTIAL_STATEMENT_READY' when market then 'MARKET_ONLY' else 'UNSUPPORTED' end lv from cl),
orders_of(b, o) as (values ('missing_fy_report', 2), ('no_primary_statement_tables', 7), ('no_safe_fact_candidates', 8), ('manual_upload_available', 11), ('unavailable_valuation_inputs', 50), ('odd_thing', 100))"""


def _covered(spark, sf_dir):
    """Coverage of companies, one a customer, by their orders."""
    o = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.month("o_orderdate") == 12).alias("dec"), F.sum("o_totalprice").alias("sum"))
    c, n, f = F.col("o_custkey"), F.col("n"), F.col("f")
    tables = F.when(f == 0, "NO_PRIMARY_STATEMENTS").when(F.col("dec") == 0, "TABLES_PARTIAL").when(c % 11 != 0, "TABLES_READY")
    blockers = F.array_compact(F.array(
        F.when((F.col("dec") == 0) & (n < 7), "missing_fy_report"), F.when(f == 0, "no_primary_statement_tables"), F.when(n < 2, "no_safe_fact_candidates"), F.when(~(F.col("sum") > 2_000_000), "unavailable_valuation_inputs"), F.when(c % 5 == 0, "manual_upload_available"),
        F.when(c % 13 == 0, "odd_thing"),
    ))
    items = o.select(
        F.concat(F.lit("C"), c.cast("string")).alias("entity"), F.when((n >= 12) & (f * 2 >= n), "AUTO_READY").otherwise("AUTO_PARTIAL").alias("statement_scope"), F.when(c % 3 == 0, "AUTO_READY").otherwise("UNSUPPORTED").alias("market_scope"), f.alias("documents"),
        tables.alias("table_status"), F.when(n >= 7, "FACTS_READY").when(n >= 4, "FACTS_PARTIAL").otherwise("NO_FACTS").alias("fact_status"), blockers.alias("blockers"),
    )
    return C.coverage_levels(items)


@query(
    """select entity, lv coverage_level, array_to_string(list_sort(list_filter([case when lv in ('FULL_STATEMENT_READY', 'PARTIAL_STATEMENT_READY') then 'financial_facts' end, case when lv in ('FULL_STATEMENT_READY', 'PARTIAL_STATEMENT_READY') then 'financial_metrics' end,
         case when market then 'market_analysis' end, case when c % 5 = 0 then 'manual_document_analysis' end], lambda x: x is not null)), ',') supported,
       array_to_string(list_sort(list_filter(['valuation_metrics', 'peer_comparison', 'llm_payload', case when src or par then 'financial_facts' end, case when src or par then 'financial_metrics' end, case when not market then 'market_analysis' end], lambda x: x is not null)), ',') unsupported,
       array_to_string(b, ',') blockers, (select arg_min(o.b, (o.o, o.b)) from orders_of o where list_contains(levelled.b, o.b)) main_blocker from levelled""",
    COVERED.strip(),
)
def c2_coverage_levels(spark, sf_dir):
    listed = [F.array_join(c, ",").alias(c) for c in ("supported", "unsupported", "blockers")]
    return _covered(spark, sf_dir).select("entity", "coverage_level", *listed, "main_blocker")


@query(
    """select blocker, entities, sample, priority, place, place <= 5 is_top, row_number() over (order by blocker = 'unavailable_valuation_inputs', entities desc, priority, blocker) = 1 is_next from (
         select *, row_number() over (order by entities desc, priority, blocker) place from (
           select x.b blocker, count(*) entities, array_to_string(list_sort(list(entity))[1:5], ',') sample, any_value(o.o) priority from (select entity, unnest(b) b from levelled) x join orders_of o on o.b = x.b group by 1))""",
    COVERED.strip(),
)
def c3_blocker_actions(spark, sf_dir):
    return C.blocker_actions(_covered(spark, sf_dir)).drop("action")
