"""What metrics lack: input audits, gap matrices over peer groups, and which facts to get first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import AUDIT_INPUTS, VALUATION

# Facts that parsers find surely, and those that depend on method; inputs that no report parser can bring.
SURE_FACTS = ("current_assets", "current_liabilities", "total_assets", "total_equity", "total_debt", "cash_and_equivalents", "revenue", "operating_profit", "net_income")
METHOD_FACTS = ("operating_cash_flow", "capex")
NOT_PARSED = ("market_cap", "enterprise_value", "dividend_per_share", "price", "previous_revenue", "ebitda")
TOP_INPUTS = 15


def _inputs(code: Column) -> Column:
    known = F.create_map(*[x for name, facts in AUDIT_INPUTS.items() for x in (F.lit(name), F.array(*map(F.lit, facts)))])
    return F.coalesce(F.try_element_at(known, code), F.array().cast("array<string>"))


def metric_input_audit(audited: DataFrame, facts: DataFrame) -> DataFrame:
    """audited (entity, period, metric_code, status) with status calculated for valid, required, available and missing inputs
    (arrays in order of name), and traced: all inputs that are there have a trace.

    facts: entity, period, metric_code, value, trace.  A fact without a value isn't there; a metric without inputs, or of
    which none is there, is not traced.  Facts are gathered once a quarter; repeated facts count once.
    """
    there = F.col("value").isNotNull()
    have = facts.groupBy("entity", "period").agg(F.collect_set(F.when(there, F.col("metric_code"))).alias("have"), F.collect_set(F.when(there & (F.coalesce("trace", F.lit("")) == ""), F.col("metric_code"))).alias("loose"))
    rows = audited.select("entity", "period", "metric_code", F.when(F.col("status") == "valid", "calculated").otherwise(F.coalesce("status", F.lit("missing"))).alias("status"), F.array_sort(_inputs(F.col("metric_code"))).alias("required"))
    none = F.array().cast("array<string>")
    joined = rows.hint("merge").join(have.hint("merge"), ["entity", "period"], "left").withColumns({"have": F.coalesce("have", none), "loose": F.coalesce("loose", none)})
    available = F.array_intersect("required", "have")
    traced = (F.size(available) > 0) & ~F.arrays_overlap(available, "loose")
    return joined.select("entity", "period", "metric_code", "status", "required", available.alias("available"), F.array_except("required", "have").alias("missing"), traced.alias("traced"))


def input_summary(rows: DataFrame) -> DataFrame:
    """Per entity of metric_input_audit: metrics calculated, missing and questionable, and those with all inputs traced."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("entity").agg(count("calculated"), count("missing"), count("questionable"), F.count_if("traced").alias("traced"))


def top_missing_inputs(rows: DataFrame, limit: int = TOP_INPUTS) -> DataFrame:
    """(entity, input, metrics, place): the inputs that most metrics lack, over all entities; equals by entity and name."""
    counts = rows.select("entity", F.explode("missing").alias("input")).groupBy("entity", "input").agg(F.count(F.lit(1)).alias("metrics"))
    first = counts.orderBy(F.desc("metrics"), "entity", "input").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("metrics"), "entity", "input")))  # over limit rows


def gap_matrix(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, period, metric_code, statuses, missing_inputs, impact): maps over the entities of a peer group, a row for
    each metric and quarter that any of the group has and not all of it has valid.

    rows: of metric_input_audit; groups: group, entity.  An entity without a row counts as missing, with unknown
    inputs (an empty array).  impact says what closing the gap gives comparison: valuation_module, high (some have it and some
    don't), medium (none has it) or low (nothing is missing).
    """
    status = F.when(F.col("status") == "calculated", "valid").otherwise(F.col("status"))
    known = rows.select("entity", "period", "metric_code", status.alias("status"), "missing")
    asked = known.hint("merge").join(groups.hint("merge"), "entity").select("group", "period", "metric_code").distinct()
    grid = asked.hint("merge").join(groups.distinct().hint("merge"), "group")
    cells = grid.hint("merge").join(known.hint("merge"), ["entity", "period", "metric_code"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    gone = F.col("status") == "missing"
    out = cells.groupBy("group", "period", "metric_code").agg(
        F.array_sort(F.collect_list(F.struct("entity", "status"))).alias("s"), F.array_sort(F.collect_list(F.when(gone, F.struct("entity", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))))).alias("m"),
        F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("n"),
    )
    impact = F.when(F.col("metric_code").isin(*VALUATION), "valuation_module").when((F.col("valid") > 0) & (F.col("gone") > 0), "high").when(F.col("gone") > 0, "medium").otherwise("low")
    return out.where(F.col("valid") < F.col("n")).select("group", "period", "metric_code", F.map_from_entries("s").alias("statuses"), F.map_from_entries("m").alias("missing_inputs"), impact.alias("impact"))


def fact_priorities(matrix: DataFrame) -> DataFrame:
    """(entity, fact, metrics, periods, pairs, unlocks, score): facts that would close gaps of gap_matrix.

    pairs counts the other entities with which a comparison would become possible; the score is 4 a metric, 2 a quarter, 3 a
    pair, and 5, 2 or 1 for how surely parsers find the fact.  Valuation metrics and inputs that no parser brings are left out.
    """
    gaps = matrix.where(~F.col("metric_code").isin(*VALUATION)).select("period", "metric_code", "statuses", F.explode("missing_inputs").alias("entity", "inputs"))
    ready = F.transform(F.filter(F.map_entries("statuses"), lambda e: e["value"] == "valid"), lambda e: e["key"])
    rows = gaps.select("entity", "period", "metric_code", ready.alias("others"), F.explode("inputs").alias("fact")).where(~F.col("fact").isin(*NOT_PARSED))
    counts = rows.groupBy("entity", "fact").agg(
        F.countDistinct("metric_code").alias("metrics"), F.countDistinct("period").alias("periods"), F.size(F.array_distinct(F.flatten(F.collect_set("others")))).cast("long").alias("pairs"), F.array_join(F.array_sort(F.collect_set("metric_code")), ",").alias("unlocks")
    )
    sure = F.when(F.col("fact").isin(*SURE_FACTS), 5).when(F.col("fact").isin(*METHOD_FACTS), 2).otherwise(1)
    return counts.withColumn("score", 4 * F.col("metrics") + 2 * F.col("periods") + 3 * F.col("pairs") + sure)
