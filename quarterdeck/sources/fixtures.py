"""Adapters: company facts, candles and a registry derived from the shared test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import once

FLOWS = ("revenue", "operating_profit", "net_income", "ebitda", "operating_cash_flow", "capex")
BALANCES = ("current_assets", "current_liabilities", "total_assets", "total_debt", "total_equity", "cash_and_equivalents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement facts of the tables, derived once a session: many queries read them several times."""
    return once(spark, ("facts", sf_dir), lambda: _facts(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement facts in long form: sums over order lines by customer nation and quarter.

    Money is summed in decimals, so the order of rows doesn't matter.  Orders get their nation before they meet their lines, so lines
    are shuffled once and not sorted.  Four sums a line are taken by all that tells lines apart (missing rates too, which leave a
    product without a value); the measures are made of those few sums.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("cast(l_extendedprice as decimal(12,2)) ext"), F.expr("cast(l_discount as decimal(4,2)) disc"), F.expr("cast(l_tax as decimal(4,2)) tax"), F.expr("cast(l_quantity as decimal(6,0)) qty"), F.col("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderstatus").alias("status"), F.expr("year(o_orderdate) * 4 + quarter(o_orderdate) - 1").alias("idx"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    alike = ["nation", "idx", "flag", "status", F.isnull("disc").alias("no_disc"), F.isnull("tax").alias("no_tax")]
    sums = (
        lines.join(orders.join(customers, "o_custkey").drop("o_custkey").hint("shuffle_hash"), "l_orderkey").groupBy(*alike)
        .agg(F.sum("ext").alias("ext"), F.sum(F.expr("ext * disc")).alias("less"), F.sum(F.expr("ext * tax")).alias("taxed"), F.sum("qty").alias("qty"))
        .withColumn("net", F.expr("case when not no_disc then ext - less end"))
    )
    wide = (
        sums.groupBy("nation", "idx")
        .agg(
            F.expr("sum(net)").alias("revenue"),
            F.expr("sum(case when flag <> 'R' then net else 0 end) - sum(taxed)").alias("operating_profit"),
            F.expr("sum(net) - sum(case when not no_tax then less + taxed end) - sum(case when flag = 'R' then ext else 0 end)").alias("net_income"),
            F.expr("sum(case when flag = 'A' then ext else 0 end)").alias("current_assets"),
            F.expr("sum(case when flag = 'N' then ext else 0 end)").alias("current_liabilities"),
            F.expr("sum(ext)").alias("total_assets"),
            F.expr("sum(case when status = 'O' then ext else 0 end)").alias("total_debt"),
            F.expr("sum(case when status = 'F' then ext else 0 end)").alias("total_equity"),
            F.expr("sum(less)").alias("cash_and_equivalents"),
            F.expr("sum(1000 * qty)").alias("operating_cash_flow"),
            F.expr("sum(taxed)").alias("capex"),
        )
        .withColumn("ebitda", F.expr("case when nation % 4 = 0 then operating_profit + capex end"))
    )
    codes = [*FLOWS, *BALANCES]
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in codes)
    long = wide.select("nation", "idx", F.expr(f"stack({len(codes)}, {pairs}) as (metric_code, value)"))
    k = F.expr("nation + 7 * idx")
    quality = F.when(k % 13 == 0, "low_confidence_parse").when(k % 17 == 0, "fixture").when(k % 5 == 0, "derived").otherwise("exact")
    balance = F.col("metric_code").isin(*BALANCES)
    return long.where(F.col("value").isNotNull() & ~((F.col("metric_code") == "current_liabilities") & (k % 11 == 0))).select(
        F.concat(F.lit("N"), F.col("nation")).alias("entity"), F.expr("concat(idx div 4, 'Q', idx % 4 + 1)").alias("period"), F.col("idx").cast("int").alias("idx"), "metric_code", "value",
        F.when(balance, "balance_sheet").otherwise("income_statement").alias("statement_type"),
        F.when(balance, "balance_sheet_snapshot").when(F.col("idx") % 4 == 3, "annual").otherwise("ytd").alias("period_type"),
        quality.alias("quality_flag"), F.lit(1.0).alias("unit_multiplier"), F.lit("RUB").alias("currency"), F.lit("IFRS").alias("reporting_standard"),
        F.when(quality == "low_confidence_parse", 0.5).otherwise(0.9).alias("confidence"), F.col("nation").cast("int").alias("nation"), k.cast("int").alias("k"),
    )


FACTS_SQL = """
fact_lines as (
  select c_nationkey nation, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 idx, cast(l_extendedprice as decimal(12,2)) ext,
         cast(l_discount as decimal(4,2)) disc, cast(l_tax as decimal(4,2)) tax, cast(l_quantity as decimal(6,0)) qty, l_returnflag flag, o_orderstatus status
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
fact_wide as (
  select nation, idx, sum(ext * (1 - disc)) revenue,
         sum(case when flag <> 'R' then ext * (1 - disc) else 0 end) - sum(ext * tax) operating_profit,
         sum(ext * (1 - disc)) - sum(ext * (disc + tax)) - sum(case when flag = 'R' then ext else 0 end) net_income,
         sum(case when flag = 'A' then ext else 0 end) current_assets, sum(case when flag = 'N' then ext else 0 end) current_liabilities,
         sum(ext) total_assets, sum(case when status = 'O' then ext else 0 end) total_debt, sum(case when status = 'F' then ext else 0 end) total_equity,
         sum(ext * disc) cash_and_equivalents, sum(1000 * qty) operating_cash_flow, sum(ext * tax) capex,
         case when nation % 4 = 0 then sum(case when flag <> 'R' then ext * (1 - disc) else 0 end) end ebitda
  from fact_lines group by nation, idx),
fact_long as (
""" + "\n  union all ".join(f"select nation, idx, '{c}' metric_code, cast({c} as double) as value from fact_wide" for c in [*FLOWS, *BALANCES]) + """),
facts as (
  select 'N' || nation entity, (idx // 4) || 'Q' || (idx % 4 + 1) period, cast(idx as integer) idx, metric_code, value,
         case when metric_code in ('current_assets','current_liabilities','total_assets','total_debt','total_equity','cash_and_equivalents') then 'balance_sheet' else 'income_statement' end statement_type,
         case when metric_code in ('current_assets','current_liabilities','total_assets','total_debt','total_equity','cash_and_equivalents') then 'balance_sheet_snapshot'
              when idx % 4 = 3 then 'annual' else 'ytd' end period_type,
         case when (nation + 7 * idx) % 13 = 0 then 'low_confidence_parse' when (nation + 7 * idx) % 17 = 0 then 'fixture' when (nation + 7 * idx) % 5 = 0 then 'derived' else 'exact' end quality_flag,
         cast(1.0 as double) unit_multiplier, 'RUB' currency, 'IFRS' reporting_standard,
         case when (nation + 7 * idx) % 13 = 0 then cast(0.5 as double) else cast(0.9 as double) end confidence, cast(nation as integer) nation, cast(nation + 7 * idx as integer) k
  from fact_long where value is not null and not (metric_code = 'current_liabilities' and (nation + 7 * idx) % 11 = 0))"""


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily candles of the tables, derived once a session."""
    return once(spark, ("candles", sf_dir), lambda: _candles(spark, sf_dir))


def candle_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, days): how many daily candles a ticker has, without their prices; counted once a session."""
    days = lambda: _candle_lines(spark, sf_dir).select("ticker", F.col("l_shipdate").cast("date").alias("date")).distinct().groupBy("ticker").agg(F.count(F.lit(1)).alias("days"))
    return once(spark, ("candle-days", sf_dir), days)


def _candle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return table(spark, sf_dir, "lineitem").join(brands.hint("shuffle_hash"), "l_partkey")


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles by part brand: first and last unit price of the day by (order, line, part, supplier, price)."""
    lines = _candle_lines(spark, sf_dir)
    rows = lines.select("ticker", F.col("l_shipdate").cast("date").alias("date"), F.expr("l_extendedprice / l_quantity").alias("price"), "l_quantity", F.expr("cast(l_extendedprice as decimal(12,2))").alias("ext"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    return rows.groupBy("ticker", "date").agg(
        F.min(order)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(order)["price"].alias("close"), F.sum("l_quantity").alias("volume"), F.sum("ext").cast("double").alias("value")
    )


CANDLES_SQL = """
candle_lines as (
  select p_brand ticker, cast(l_shipdate as date) as date, l_extendedprice / l_quantity price, l_quantity, cast(l_extendedprice as decimal(12,2)) ext,
         row_number() over (partition by p_brand, cast(l_shipdate as date) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) a,
         row_number() over (partition by p_brand, cast(l_shipdate as date) order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice / l_quantity desc) z
  from lineitem join part on l_partkey = p_partkey),
candles as (
  select ticker, date, max(case when a = 1 then price end) as open, max(price) high, min(price) low, max(case when z = 1 then price end) as close,
         sum(l_quantity) volume, cast(sum(ext) as double) as value from candle_lines group by ticker, date)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities: one a nation; sector is its region; three aliases; every fifth is a bank; capitalisation is its suppliers' balance."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    caps = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum(F.expr("cast(s_acctbal as decimal(12,2))")).cast("double").alias("capitalisation"))
    return nations.join(caps, "n_nationkey", "left").select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("entity"), F.col("n_name").alias("name"), F.col("r_name").alias("sector"), F.concat(F.lit("S"), F.col("n_nationkey") % 3).alias("subsector"),
        F.array(F.col("n_name"), F.lower("n_name"), F.concat(F.lit("N"), F.col("n_nationkey"))).alias("aliases"), (F.col("n_nationkey") % 5 == 0).alias("is_bank"), (F.col("n_nationkey") % 11 != 7).alias("is_active"), "capitalisation",
    )


REGISTRY_SQL = """
registry as (
  select 'N' || n_nationkey entity, n_name as name, r_name sector, 'S' || (n_nationkey % 3) subsector, n_nationkey % 5 = 0 is_bank, n_nationkey % 11 <> 7 is_active,
         (select cast(sum(cast(s_acctbal as decimal(12,2))) as double) from supplier where s_nationkey = n_nationkey) capitalisation
  from nation join region on n_regionkey = r_regionkey)"""


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts from two sources: all as financial statements, and two thirds again with other roles and some changes."""
    base = facts(spark, sf_dir)
    k = F.col("k")
    first = base.withColumn("source_role", F.lit("financial_statements")).withColumn("document_id", F.concat("entity", F.lit("|X")))
    second = (
        base.where(k % 3 != 0).withColumn("source_role", F.when(k % 2 == 0, "press_release").otherwise("financial_statements")).withColumn("value", F.when(k % 7 == 0, F.col("value") * 1.05).otherwise(F.col("value")))
        .withColumn("period_type", F.when(k % 19 == 0, "quarter").otherwise(F.col("period_type"))).withColumn("document_id", F.concat("entity", F.lit("|Y")))
    )
    return first.unionByName(second)


TWO_SOURCES_SQL = """
sources as (
  select *, 'financial_statements' source_role, entity || '|X' document_id from facts
  union all
  select entity, period, idx, metric_code, case when k % 7 = 0 then value * 1.05 else value end as value, statement_type, case when k % 19 = 0 then 'quarter' else period_type end period_type,
         quality_flag, unit_multiplier, currency, reporting_standard, confidence, nation, k, case when k % 2 = 0 then 'press_release' else 'financial_statements' end, entity || '|Y'
  from facts where k % 3 <> 0)"""
