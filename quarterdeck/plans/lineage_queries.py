"""Queries of metric warnings, lineage and gaps; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import fixtures as S
from .queries import ENGINE, FACTS, HISTORY, WIDE, _engine, query

#: Inputs of each metric, as the oracle takes them.
NEEDS = (
    "needs as (select * from (values ('revenue_growth', ['revenue']), ('ebitda_margin', ['ebitda', 'revenue']), ('operating_margin', ['operating_profit', 'revenue']), ('net_margin', ['net_income', 'revenue']), ('roe', ['net_income', 'total_equity']), ('roa', ['net_income', 'total_assets']), ('debt_to_equity', ['total_debt', 'total_equity']),"
    " ('net_debt_to_ebitda', ['total_debt', 'cash_and_equivalents', 'ebitda']), ('current_ratio', ['current_assets', 'current_liabilities']), ('fcf', ['operating_cash_flow', 'capex']), ('fcf_margin', ['operating_cash_flow', 'capex', 'revenue'])) v(code, ins))"
)
TYPED = "typed as (select entity, period, metric_code, case when k % 4 = 1 and metric_code in ('revenue', 'total_debt', 'capex') then 'quarter' when k % 6 = 5 then null else period_type end t from facts)"


def _typed(spark, sf_dir):
    k, code = F.col("k"), F.col("metric_code")
    return S.facts(spark, sf_dir).withColumn("period_type", F.when((k % 4 == 1) & code.isin("revenue", "total_debt", "capex"), "quarter").when(k % 6 != 5, F.col("period_type")))


@query(
    "select entity, period, metric_code, case when metric_code in ('current_ratio', 'debt_to_equity') and warning is not null then null else round(value, 6) end as value, case when warning is not null and quality_flag = 'exact' then 'derived' else quality_flag end quality_flag, warning from (select e.*, case"
    " when e.metric_code in ('ebitda_margin', 'operating_margin', 'net_margin', 'fcf', 'fcf_margin') and len(ts) > 1 then 'mixed period coverage: ' || e.metric_code || ': ' || array_to_string(ts, ', ') when e.metric_code in ('current_ratio', 'debt_to_equity') and len(ts) > 0 and ts <> ['balance_sheet_snapshot'] and ts <> ['quarter'] then 'balance_sheet_snapshot inputs of one period are required'"
    " when e.metric_code in ('roe', 'roa') and ni in ('ytd', 'annual') then upper(e.metric_code) || ' uses ' || ni || ' income with snapshots' end warning from engine e left join (select t.entity, t.period, code, list_sort(list(distinct t.t) filter (t.t is not null)) ts from typed t join needs on list_contains(ins, t.metric_code) group by all) x on x.entity = e.entity and x.period = e.period and x.code = e.metric_code"
    " left join (select entity, period, max(t) ni from typed where metric_code = 'net_income' group by all) y on y.entity = e.entity and y.period = e.period)",
    FACTS, WIDE, HISTORY, ENGINE, NEEDS, TYPED,
)
def m5_period_compat_warnings(spark, sf_dir):
    return M.period_compat_warnings(_engine(spark, sf_dir), _typed(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "select e.entity, e.period, e.metric_code, coalesce(array_to_string(ins, ','), '') required, coalesce(x.inputs, '') inputs from engine e left join needs on code = e.metric_code left join (select f.entity, f.period, code c, string_agg(f.metric_code || '=' || f.entity || '|X/' || f.quality_flag || '/' || f.period_type, ',' order by f.metric_code) inputs from facts f join needs on list_contains(ins, f.metric_code) group by all) x on x.entity = e.entity and x.period = e.period and x.c = e.metric_code",
    FACTS, WIDE, HISTORY, ENGINE, NEEDS,
)
def m7_metric_lineage(spark, sf_dir):
    facts = S.facts(spark, sf_dir).withColumn("document_id", F.concat("entity", F.lit("|X")))
    rows = M.metric_lineage(_engine(spark, sf_dir), facts)
    flat = F.transform(F.array_sort(F.map_entries("inputs")), lambda e: F.concat_ws("/", F.concat_ws("=", e["key"], e["value"]["document_id"]), e["value"]["quality_flag"], e["value"]["period_type"]))
    return rows.select("entity", "period", "metric_code", F.array_join("required", ",").alias("required"), F.coalesce(F.array_join(flat, ","), F.lit("")).alias("inputs"))


@query(
    "select e.entity, e.period, e.metric_code, case when e.metric_code in ('ebitda_margin', 'net_debt_to_ebitda') then 'missing_ebitda' when e.metric_code = 'ev_to_ebitda' then case when list_contains(have, 'ebitda') then 'missing_ev' else 'missing_ebitda' end when e.metric_code = 'pe_ratio' then 'missing_market_cap' when e.metric_code = 'dividend_yield' then 'missing_dividend'"
    " when e.metric_code = 'revenue_growth' and list_contains(have, 'revenue') then 'incompatible_period_semantics' when len(lacks) > 0 then 'missing_input_fact' when kinds > 1 then 'incompatible_period_semantics' else 'not_applicable_to_current_data' end reason,"
    " case when e.metric_code in ('ebitda_margin', 'net_debt_to_ebitda') then 'ebitda' when e.metric_code = 'ev_to_ebitda' then case when list_contains(have, 'ebitda') then 'ev' else 'ebitda,ev' end when e.metric_code = 'pe_ratio' then 'market_cap' when e.metric_code = 'dividend_yield' then 'dividends,price' when e.metric_code = 'revenue_growth' and list_contains(have, 'revenue') then 'previous_revenue' else coalesce(array_to_string(lacks, ','), '') end blocking"
    " from (select * from engine where value is null or quality_flag = 'missing') e left join (select entity, period, list(metric_code) have from facts group by all) h on h.entity = e.entity and h.period = e.period"
    " left join (select p.entity, p.period, code, list_sort(list_filter(any_value(ins), lambda i: not list_contains(list(p.metric_code), i))) lacks, count(distinct case when list_contains(ins, p.metric_code) then p.period_type end) kinds from facts p, needs group by p.entity, p.period, code) n on n.entity = e.entity and n.period = e.period and n.code = e.metric_code",
    FACTS, WIDE, HISTORY, ENGINE, NEEDS,
)
def m18_missing_details(spark, sf_dir):
    rows = M.missing_details(_engine(spark, sf_dir), S.facts(spark, sf_dir))
    return rows.select("entity", "period", "metric_code", "reason", F.array_join("blocking", ",").alias("blocking"))
