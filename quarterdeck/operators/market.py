"""Market windows: indicators, liquidity and period alignment of daily candles, a ticker a window partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P

#: Candles that each indicator needs.
REQUIREMENTS = {"daily_return": 2, "volatility_20d": 20, "volatility_60d": 60, "ma_20": 20, "ma_50": 50, "ma_200": 200, "rsi_14": 15, "max_drawdown": 2, "support_level": 20, "resistance_level": 20}


def normalize_candles(df: DataFrame) -> DataFrame:
    """Known date columns are renamed, numbers that don't parse are null, dates are cast."""
    for old in ("begin", "tradedate"):
        if old in df.columns and "date" not in df.columns:
            df = df.withColumnRenamed(old, "date")
    numbers = [c for c in ("open", "high", "low", "close", "volume", "value") if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers}).withColumn("date", F.col("date").cast("date"))


def union_pages(*pages: DataFrame, page_size: int = 500) -> DataFrame:
    """Pages of candles until a short one; of a repeated date the earliest page's row stays."""
    whole = None
    for n, page in enumerate(pages):
        numbered = page.withColumn("page", F.lit(n))
        whole = numbered if whole is None else whole.unionByName(numbered)
    sizes = whole.groupBy("ticker", "page").agg(F.count(F.lit(1)).alias("rows"))
    short = sizes.where(F.col("rows") < page_size).groupBy("ticker").agg(F.min("page").alias("last"))
    kept = whole.join(short, "ticker", "left").where(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    first = F.row_number().over(Window.partitionBy("ticker", "date").orderBy("page"))
    return kept.withColumn("first", first).where(F.col("first") == 1).drop("first", "page", "last")


def upsert_candles(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and the new candles whose (ticker, date, source) it lacks; of repeated new ones the first by close."""
    key = [c for c in ("ticker", "date", "source") if c in existing.columns and c in new.columns]
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*sorted(rest, key=lambda c: c != "close"))).alias("r")).select(*key, "r.*")
    return existing.unionByName(once.join(existing.select(*key), key, "left_anti"))


def _tail(n: int):
    return Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - n, 0)


def indicators(candles: DataFrame) -> DataFrame:
    """All indicators at every candle, by one sort: closes that are null are left out before price windows."""
    by_date = Window.partitionBy("ticker").orderBy("date")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, 0)
    priced = candles.where(F.col("close").isNotNull()).withColumn("delta", F.col("close") - F.lag("close").over(by_date)).withColumn("daily_return", F.try_divide(F.col("close"), F.lag("close").over(by_date)) - 1)
    priced = priced.withColumns({"gain": F.greatest("delta", F.lit(0.0)), "loss": F.greatest(-F.col("delta"), F.lit(0.0)), "n": F.row_number().over(by_date), "peak": F.max("close").over(so_far)})
    full = lambda n, c: F.when(F.col("n") >= n, c)
    gain, loss = F.avg("gain").over(_tail(14)), F.avg("loss").over(_tail(14))
    out = {f"volatility_{n}d": full(n + 1, F.stddev_samp("daily_return").over(_tail(n)) * math.sqrt(252)) for n in (20, 60)}
    out |= {f"ma_{n}": full(n, F.avg("close").over(_tail(n))) for n in (20, 50, 200)}
    out |= {"rsi_14": full(15, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))), "support_level": F.min("close").over(_tail(20)), "resistance_level": F.max("close").over(_tail(20))}
    out |= {"drawdown": F.col("close") / F.col("peak") - 1}
    priced = priced.withColumns(out)
    return priced.withColumn("max_drawdown", F.min("drawdown").over(so_far)).drop("delta", "gain", "loss", "peak", "drawdown")


def latest_indicators(candles: DataFrame) -> DataFrame:
    """A row a ticker: the last candle's indicators."""
    names = [*REQUIREMENTS]
    rows = indicators(candles)
    last = F.max_by(F.struct("close", "n", *names), "date")
    return rows.groupBy("ticker").agg(last.alias("x"), F.max("date").alias("last_date")).select("ticker", "last_date", "x.*")


def average_volume_turnover(candles: DataFrame, rows: int = 20) -> DataFrame:
    """Means over the last rows of any kind; nulls among them are skipped, not replaced by older rows."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return candles.withColumn("place", place).where(F.col("place") <= rows).groupBy("ticker").agg(F.avg("volume").alias("average_daily_volume"), F.avg("value").alias("average_daily_turnover"))


def indicator_audit(candles: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """A row an indicator and ticker: value, needed and available candles, status."""
    latest = latest_indicators(candles)
    counts = candles.groupBy("ticker").agg(F.count(F.lit(1)).alias("available"))
    pairs = ", ".join(f"'{c}', {n}, {c}" for c, n in REQUIREMENTS.items())
    rows = counts.join(latest, "ticker", "left").select("ticker", "available", F.expr(f"stack({len(REQUIREMENTS)}, {pairs}) as (indicator_code, required, value)"))
    if aligned is not None:
        rows = rows.join(aligned.select("ticker", "aligned"), "ticker", "left")
    else:
        rows = rows.withColumn("aligned", F.lit(True))
    odd = ((F.col("indicator_code") == "max_drawdown") & (F.col("value") > 0)) | ((F.col("indicator_code") == "rsi_14") & ~F.col("value").between(0, 100))
    status = F.when(odd, "questionable").when(F.col("value").isNull() | (F.col("available") < F.col("required")), "missing").when(F.coalesce("aligned", F.lit(False)), "valid").otherwise("not_applicable_to_requested_period")
    return rows.withColumn("status", status).drop("aligned")


def liquidity_metrics(candles: DataFrame) -> DataFrame:
    """Six metrics a ticker; the spread needs an order book and is always missing."""
    wide = candles.groupBy("ticker").agg(
        F.avg("volume").alias("average_daily_volume"), F.avg("value").alias("average_daily_turnover"), F.median("value").alias("median_daily_turnover"),
        F.count(F.lit(1)).cast("double").alias("trading_days_count"), F.count_if(F.coalesce("volume", F.lit(0.0)) == 0).cast("double").alias("zero_volume_days_count"),
    )
    names = wide.columns[1:]
    pairs = ", ".join(f"'{c}', {c}" for c in names) + ", 'bid_ask_spread', cast(null as double)"
    return wide.select("ticker", F.expr(f"stack({len(names) + 1}, {pairs}) as (metric_code, value)")).withColumn("status", F.when(F.col("metric_code") == "bid_ask_spread", "missing").otherwise("valid"))


def _days(period_from: str, period_to: str) -> tuple[Column, Column]:
    P.range_bounds(period_from, period_to)
    return P.first_day(F.lit(period_from)), P.last_day(F.lit(period_to))


def period_alignment(candles: DataFrame, period_from: str, period_to: str, source: str = "market_cache") -> DataFrame:
    """Overlap of a ticker's candles with the requested days; the source's name says when there is none."""
    first, last = _days(period_from, period_to)
    rows = candles.groupBy("ticker").agg(F.min("date").alias("actual_from"), F.max("date").alias("actual_to"), F.bool_or(F.col("date").between(first, last)).alias("inside"))
    covered = F.greatest(F.datediff(F.least(last, F.col("actual_to")), F.greatest(first, F.col("actual_from"))) + 1, F.lit(0))
    rows = rows.withColumn("covered_days", covered).withColumn("coverage_ratio", F.round(F.col("covered_days") / (F.datediff(last, first) + 1), 6)).withColumn("aligned", F.col("inside") & (F.col("covered_days") > 0))
    return rows.withColumn("source", F.when(F.col("aligned"), source).otherwise(f"{source}_unaligned")).drop("inside")


def market_report(candles: DataFrame, period_from: str, period_to: str, context: DataFrame | None = None) -> DataFrame:
    """Counts of indicator and liquidity states, the last candle, the two statuses and warnings, a row a ticker.

    context: ticker, official (the source is the exchange's), valuation (its inputs are at hand); unknown ones count as
    official, without valuation inputs.  The audit passes where the source is official, the period aligned, no indicator missing and
    valuation at hand; a ticker of context without candles fails both.
    """
    aligned = period_alignment(candles, period_from, period_to)
    audit = indicator_audit(candles, aligned).groupBy("ticker").agg(
        F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "not_applicable_to_requested_period").alias("not_applicable"),
        F.count_if(F.col("indicator_code").isin("ma_20", "ma_50", "rsi_14", "support_level", "resistance_level") & (F.col("status") != "valid")).alias("core_gaps"),
    )
    last = candles.groupBy("ticker").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"), F.count(F.lit(1)).alias("candles"))
    rows = last.hint("merge").join(audit.hint("merge"), "ticker").hint("merge").join(aligned.select("ticker", "aligned", "covered_days").hint("merge"), "ticker")
    if context is not None:
        rows = rows.hint("merge").join(context.select("ticker", "official", "valuation").hint("merge"), "ticker", "full_outer")
    else:
        rows = rows.withColumns({"official": F.lit(True), "valuation": F.lit(False)})
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("candles", "valid", "missing", "not_applicable")}
    rows = rows.withColumns(zero | {"aligned": F.coalesce("aligned", F.lit(False)), "official": F.coalesce("official", F.lit(True)), "valuation": F.coalesce("valuation", F.lit(False))})
    empty = F.col("candles") == 0
    technical = F.when(empty, "FAIL").when(~F.col("aligned") | (F.col("core_gaps") > 0), "PARTIAL").otherwise("PASS")
    audited = F.when(empty, "FAIL").when(~F.col("official") | ~F.col("aligned") | (F.col("missing") > 0) | ~F.col("valuation"), "PARTIAL").otherwise("PASS")
    late = F.col("last_date") < _days(period_from, period_to)[1]
    warnings = F.array_compact(F.array(F.when(late, "date_to_not_present_if_non_trading_or_provider_omitted"), F.when(~F.col("official"), "source_is_not_the_exchange"), F.when(~F.col("valuation"), "valuation_inputs_missing")))
    return rows.withColumns({"audit_status": audited, "technical_status": technical, "warnings": F.array_join(warnings, ",")}).drop("core_gaps", "official", "valuation")


def candle_range(candles: DataFrame, period_from: str, period_to: str) -> DataFrame:
    first, last = _days(period_from, period_to)
    return candles.where(F.col("date").between(first, last))
