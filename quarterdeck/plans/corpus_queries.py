"""Queries of texts, catalogues and roll-ups; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts as A
from ..operators import gaps as H
from ..operators import metrics as M
from ..operators import portfolio as C
from ..operators.entities import match_entity_in_text
from ..operators.grids import normalize_table_grid
from ..sources import fixtures as S
from ..sources.html import html_grids, html_tables
from .queries import AUDIT_LIST, AUDITED, FACTS, GAPS, REGISTRY, SOURCES, _audited, _engine, _gap_rows, query

INPUTS = "(values " + ", ".join(f"('{c}', '{i}')" for c, names in M.AUDIT_INPUTS.items() for i in names) + ") n(code, input)"


PAGE_CELLS = """
cell(t, r, c) as (values (0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 1, 1), (0, 1, 2), (0, 2, 0), (0, 2, 1), (0, 2, 2), (1, 0, 0)),
page_cells as (
  select page_id, t, r, c, case when t = 1 then 'in' when r = 0 then case c when 0 then 'Id' else 'Url' end when c = 0 then page_id::varchar when r = 1 then case c when 1 then url else length(html)::varchar end else 'nested tail' end as text
  from pages, cell)"""


def _pages(spark, sf_dir):
    """All pages whole, each after a table about itself: a head over two columns, an id over two rows, a table in a cell."""
    own = ["<p>x</p><TABLE border=1><tr><th> Id<th colspan='2'><b>Url</b></tr><tr><td rowspan=2>", F.col("page_id").cast("string"), "</td>\n<td>", F.replace("url", F.lit("&"), F.lit("&amp;")), "<td>", F.length("html").cast("string"), "<tr><td colspan=2>nested\n<table><tr><td>in</table> tail</table>"]
    return S.table(spark, sf_dir, "pages").select("page_id", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in own], F.coalesce("html", F.lit(""))).alias("html"))


@query('select page_id, t::int "table", r::int "row", c::int cell, text from page_cells', PAGE_CELLS.strip())
def s10_html_tables(spark, sf_dir):
    return html_tables(_pages(spark, sf_dir))


@query()
def s10_page_grids(spark, sf_dir):
    """The records of the tables of all pages."""
    found = normalize_table_grid(html_grids(_pages(spark, sf_dir)))
    return found.select("document_id", "table_index", "row_index", "line", F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("cells"))


@query()
def t1_normalize_financial_text(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", X.normalize_financial_text(F.col("text")).alias("text"))


NAMES = "ents as (select item_id entity, trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[^0-9a-zа-я]+', ' ', 'g')) n from benchmark), etok as (select *, list_distinct(list_filter(string_split(n, ' '), lambda t: length(t) >= 3 and t not in ('ao', 'company', 'group', 'inc', 'jsc', 'llc', 'pjsc', 'public', 'the'))) tokens from ents where n <> ''), dtok as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-zа-я]+', ' ', 'g')) t from documents)"


@query("select doc_id, entity from (select *, list_distinct(string_split(t, ' ')) words from dtok) d join etok on (length(n) >= 3 and contains(t, n)) or (len(tokens) >= 2 and list_has_all(words, tokens)) or (len(tokens) = 1 and length(tokens[1]) >= 5 and list_contains(words, tokens[1]))", NAMES)
def t20_match_entity_in_text(spark, sf_dir):
    names = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))
    return match_entity_in_text(S.table(spark, sf_dir, "documents"), names)


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_orderkey % 4 when 0 then a || '|' || b when 1 then '7|' || a || '|' || b when 2 then '12 345,6|1 234,5' else '1|22|333|4' end numbers from (select *, replace(format('{:,}', cast(floor(l_extendedprice) as bigint)), ',', ' ') a, replace(format('{:,}', cast(floor(l_extendedprice * 1.0) as bigint) + 1000), ',', ' ') b from lineitem) where length(a) >= 5 and length(a) - length(replace(a, ' ', '')) = length(b) - length(replace(b, ' ', ''))"
)
def t35_group_spaced_numbers(spark, sf_dir):
    spaced = lambda c: F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))
    rows = S.table(spark, sf_dir, "lineitem").withColumns({"a": spaced(F.floor("l_extendedprice")), "b": spaced(F.floor("l_extendedprice") + 1000)})
    rows = rows.where((F.length("a") >= 5) & (F.size(F.split("a", " ")) == F.size(F.split("b", " "))))
    k = F.col("l_orderkey") % 4
    line = F.when(k == 0, F.concat_ws(" ", "a", "b")).when(k == 1, F.concat_ws(" ", F.lit("7"), "a", "b")).when(k == 2, F.lit("12 345,6 1 234,5")).otherwise(F.lit("1 22 333 4"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(X.group_spaced_numbers(F.split(line, " ")), "|").alias("numbers"))


@query("select entity, name, case when is_bank then 'bank_' || subsector else sector end status, case when is_bank then 'upload ' || name else 'manual_upload' end hint, is_bank is_bank_row from registry", REGISTRY)
def c9_source_catalog(spark, sf_dir):
    rows = S.registry(spark, sf_dir)
    banks = rows.where("is_bank").select("entity", F.concat(F.lit("bank_"), "subsector").alias("status"), F.concat(F.lit("upload "), "name").alias("hint"))
    return C.source_catalog(rows.select("entity", "name", F.col("sector").alias("status")), banks)


@query(f"select a.entity, n.input fact_code, a.metric_code, string_agg(distinct a.period, ',' order by a.period) periods from audited a join {INPUTS} on n.code = a.metric_code where a.status = 'missing' and not exists (select 1 from facts f where f.entity = a.entity and f.period = a.period and f.metric_code = n.input) group by all", *AUDITED)
def c6_ready_blockers(spark, sf_dir):
    inputs = spark.createDataFrame([(c, i) for c, names in M.AUDIT_INPUTS.items() for i in names], "metric_code string, input string")
    return C.ready_blockers(_audited(spark, sf_dir), S.facts(spark, sf_dir), F.broadcast(inputs))  # fixed rules


@query(
    "select entity, period, metric_code, status, array_to_string(available, ',') available, array_to_string(missing, ',') missing, len(available) > 0 and not list_has_any(available, loose) traced from gaps",
    *AUDITED, AUDIT_LIST, GAPS,
)
def m29_statement_metric_audit(spark, sf_dir):
    rows = _gap_rows(spark, sf_dir)
    return rows.select("entity", "period", "metric_code", "status", F.array_join("available", ",").alias("available"), F.array_join("missing", ",").alias("missing"), "traced")


@query(
    "select entity, count(*) filter (status = 'calculated') calculated, count(*) filter (status = 'missing') missing, count(*) filter (status = 'questionable') questionable, count(*) filter (len(available) > 0 and not list_has_any(available, loose)) traced from gaps group by 1",
    *AUDITED, AUDIT_LIST, GAPS,
)
def m29_input_summary(spark, sf_dir):
    return H.input_summary(_gap_rows(spark, sf_dir))


@query(
    "select *, row_number() over (order by metrics desc, entity, input) place from (select entity, input, count(*) metrics from (select entity, unnest(missing) input from gaps) group by 1, 2) qualify place <= 15",
    *AUDITED, AUDIT_LIST, GAPS,
)
def m29_top_missing_inputs(spark, sf_dir):
    return H.top_missing_inputs(_gap_rows(spark, sf_dir))


@query(
    "select entity, period, metric_code, ov old_value, nv new_value, case when ov is null then 'added' when nv is null then 'removed' when ov = nv then 'unchanged' else 'changed' end kind, nv - ov absolute_change, (nv - ov) / nullif(abs(ov), 0) relative_change from (select entity, period, metric_code, max(value) nv, max(value) filter (document_id like '%|X' and k % 2 = 0) ov from (select * from sources where (document_id like '%|X' and k % 2 = 0) or document_id like '%|Y') group by all)",
    FACTS, SOURCES,
)
def f33_augment_analysis(spark, sf_dir):
    rows = S.two_sources(spark, sf_dir)
    old = rows.where(F.col("document_id").endswith("|X") & (F.col("k") % 2 == 0))
    return A.augment_analysis(old, rows.where(F.col("document_id").endswith("|Y")))


@query(
    "select entity, period, metric_code || '_recomputed' as \"check\", round(value, 6) \"left\", round(e, 6) \"right\", abs(value - e) <= greatest(0.01, abs(e) * 0.0001) passed from (select g.entity, g.period, g.metric_code, case when g.metric_code = 'fcf' and (g.k // 1) % 5 = 0 then g.value * 1.01 else g.value end as value,"
    " case when g.metric_code = 'fcf' then fw.operating_cash_flow - fw.capex else fw.total_debt / nullif(fw.total_equity, 0) end e from (select *, length(entity) + (substr(period, 1, 4)::int) k from engine where metric_code in ('fcf', 'debt_to_equity') and value is not null) g join fw using (entity, period)) where e is not null",
    *AUDITED,
)
def f23_metric_recompute(spark, sf_dir):
    """Some cash flows are changed by a hundredth, so that checks fail too."""
    k = F.length("entity") + F.substring("period", 1, 4).cast("int")
    metrics = _engine(spark, sf_dir).withColumn("value", F.when((F.col("metric_code") == "fcf") & (k % 5 == 0), F.col("value") * 1.01).otherwise(F.col("value")))
    return A.metric_recompute_checks(metrics, S.facts(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("left", "right")})
