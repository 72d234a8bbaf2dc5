"""Peer selection and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_COVERAGE = 2


def select_peers(targets: DataFrame, registry: DataFrame, explicit: DataFrame | None = None, top: int = 5) -> DataFrame:
    """(target, peer, place, selection): explicit active peers by rank, else the same sector, subsector mates first."""
    active = registry.where("is_active")
    out = None
    rest = targets
    if explicit is not None:
        named = explicit.join(active.select(F.col("entity").alias("peer")), "peer").withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("rank", "peer")))
        out = named.select("target", "peer", "place", F.lit("explicit").alias("selection"))
        rest = targets.join(named.select(F.col("target").alias("entity")), "entity", "left_anti")
    t = rest.select(F.col("entity").alias("target"), "sector", F.col("subsector").alias("t_subsector"))
    pairs = t.join(active.select(F.col("entity").alias("peer"), "sector", "subsector"), "sector").where("peer <> target")
    place = F.row_number().over(Window.partitionBy("target").orderBy((F.col("subsector") != F.col("t_subsector")).cast("int"), "peer"))
    by_sector = pairs.withColumn("place", place).select("target", "peer", "place", F.lit("sector").alias("selection"))
    out = by_sector if out is None else out.unionByName(by_sector)
    return out.where(F.col("place") <= top)


def ratio_availability(entities: DataFrame, summary: DataFrame) -> DataFrame:
    rows = entities.select("entity").join(summary.select("entity", "calculated_count"), "entity", "left")
    status = F.when(F.col("calculated_count").isNull(), "missing_report").when(F.col("calculated_count") < LOW_COVERAGE, "available_but_low_coverage").otherwise("available")
    return rows.select("entity", F.coalesce("calculated_count", F.lit(0).cast("long")).alias("calculated_count"), status.alias("status"))


def comparison_table(peers: DataFrame, ratios: DataFrame, period: str, codes) -> DataFrame:
    """Target and peers by metric at one period; cells that aren't there say why."""
    members = peers.select("target", F.col("peer").alias("entity"), F.lit("peer").alias("role")).unionByName(peers.select("target", F.col("target").alias("entity"), F.lit("target").alias("role")).distinct())
    grid = members.select("*", F.explode(F.array(*map(F.lit, codes))).alias("metric_code"))
    known = ratios.where(F.col("period") == period).select("entity", "metric_code", "value", "status")
    return grid.join(known.hint("merge"), ["entity", "metric_code"], "left").select("target", "entity", "role", "metric_code", "value", F.coalesce("status", F.lit("metric_missing")).alias("status"))


def comparison_readiness(table: DataFrame) -> DataFrame:
    """Per target: metrics that the target and at least one peer have, and whether that is enough."""
    per = table.groupBy("target", "metric_code").agg(F.bool_or((F.col("role") == "target") & F.col("value").isNotNull()).alias("t"), F.count_if((F.col("role") == "peer") & F.col("value").isNotNull()).alias("p"))
    rows = per.groupBy("target").agg(F.count_if(F.col("t") & (F.col("p") > 0)).alias("compared_metrics"), F.count_if(~F.col("t")).alias("target_gaps"))
    return rows.withColumn("readiness", F.when(F.col("compared_metrics") == 0, "blocked").when(F.col("target_gaps") > 0, "partial").otherwise("ready"))


def comparison_status(targets: DataFrame, peers: DataFrame, availability: DataFrame, table: DataFrame) -> DataFrame:
    """entity, peers, usable_peers, compared_metrics, data_status, readiness, blockers and missing_peers (sorted arrays) of each target.

    targets: entity; peers of select_peers; availability of ratio_availability; table of comparison_table.  A target or peer without a
    row in availability has no report.  Two usable peers, and more than half of all, make ready data; without peers, without the
    target's report or without any calculated metric nothing is ready.
    """
    known = availability.select("entity", F.col("status").alias("report"))
    mates = peers.select("target", F.col("peer").alias("entity")).join(known.hint("merge"), "entity", "left").withColumn("report", F.coalesce("report", F.lit("missing_report")))
    counts = mates.groupBy(F.col("target").alias("entity")).agg(
        F.count(F.lit(1)).alias("peers"),
        F.count_if(F.col("report") == "available").alias("usable_peers"),
        F.count_if(F.col("report") == "available_but_low_coverage").alias("low_peers"),
        F.array_sort(F.collect_set(F.when(F.col("report") == "missing_report", F.col("entity")))).alias("missing_peers"),
    )
    done = (F.col("status") == "calculated") & ~F.col("metric_code").isin(*VALUATION)
    cells = table.groupBy(F.col("target").alias("entity")).agg(F.count_if(done).alias("calculated"), F.count_if(done & (F.col("role") == "peer")).alias("compared_metrics"))
    rows = targets.select("entity").distinct()
    for part in (known, counts, cells):
        rows = rows.join(part.hint("merge"), "entity", "left")
    numbers = ("peers", "usable_peers", "low_peers", "calculated", "compared_metrics")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers}).withColumns({
        "report": F.coalesce("report", F.lit("missing_report")), "missing_peers": F.coalesce("missing_peers", F.array().cast("array<string>")),
    })
    alone, empty = F.col("peers") == 0, F.col("calculated") == 0
    data = (
        F.when((F.col("report") == "missing_report") | alone, "not_ready")
        .when((F.col("usable_peers") >= 2) & (2 * F.col("usable_peers") > F.col("peers")), "ready")
        .otherwise("partial")
    )
    ready = F.when((F.col("data_status") == "not_ready") | empty, "NOT_READY").when(F.col("usable_peers") >= 2, "READY_WITH_LIMITATIONS").otherwise("PARTIAL")
    blockers = F.array(
        F.when(alone, "peer_selection_not_ready"),
        F.when(F.col("report") == "missing_report", "target_ratios_report_missing"),
        F.when(F.col("report") == "available_but_low_coverage", "target_ratios_low_coverage"),
        F.when(F.size("missing_peers") > 0, "peer_ratios_report_missing"),
        F.when(F.col("low_peers") > 0, "peer_ratios_low_coverage"),
        F.when(empty, "comparison_table_metrics_unavailable"),
        F.lit("valuation_inputs_unavailable"),
    )
    rows = rows.withColumn("data_status", data).withColumn("blockers", F.array_sort(F.array_compact(blockers)))
    return rows.select("entity", "peers", "usable_peers", "compared_metrics", "data_status", ready.alias("readiness"), "blockers", "missing_peers")


def valuation_cells(table: DataFrame) -> DataFrame:
    """The table with valuation cells unavailable, and why: no input of theirs comes from a report."""
    market = F.col("metric_code").isin(*VALUATION)
    status = F.when(market, "unavailable").otherwise(F.col("status"))
    reason = F.when(market, "valuation_inputs_unavailable").when(F.col("value").isNull(), F.col("status"))
    return table.withColumns({"value": F.when(~market, F.col("value")), "status": status, "reason": reason})


def peer_counts(table: DataFrame) -> DataFrame:
    """target, peer_count, available_peer_count and missing_peers (sorted array) of peer_table; targets without peers aren't in it."""
    gone = F.col("quality_flag") == "missing"
    return table.groupBy("target").agg(
        F.count(F.lit(1)).alias("peer_count"), F.count_if(~gone).alias("available_peer_count"), F.array_sort(F.collect_set(F.when(gone, F.col("peer")))).alias("missing_peers")
    )


def peer_table(peers: DataFrame, wide: DataFrame, period: str, codes) -> DataFrame:
    rows = peers.join(wide.where(F.col("period") == period).select(F.col("entity").alias("peer"), *codes, F.lit(True).alias("there")), "peer", "left")
    return rows.select("target", "peer", "place", *codes, F.when(F.col("there").isNull(), "missing").otherwise("exact").alias("quality_flag"))


# Metrics that two entities are never compared on, flags that spoil an input, and roles that a source may have.
VALUATION = ("pe_ratio", "ev_to_ebitda", "dividend_yield")
EBITDA = ("ebitda_margin", "net_debt_to_ebitda", "ev_to_ebitda")
BAD_FLAGS = ("low_confidence_parse", "conflicting_sources", "fixture")
GOOD_ROLES = ("financial_statements", "financial_supplement", "annual_report", "manual_verified")
#: Comparable metrics from which on a pair is worth reading, and valid ones below which an entity's cover is narrow.
ENOUGH, NARROW = 5, 10


def period_signature(facts: DataFrame, inputs: DataFrame) -> DataFrame:
    """entity, period, metric_code, period_type, coverage, low, traced, good_roles: what stands behind each metric.

    facts: entity, period, metric_code, period_type, ytd_months, quality_flag, trace, source_role; inputs: metric_code, input.
    One period type is the type; year-to-date inputs of one length cover so many months, annual ones 12M, others name their
    type; several types, or none, are mixed.  low: an input of a bad flag; traced: all inputs have a trace; good_roles: all have
    a role that a source of comparisons may have.
    """
    of = facts.select("entity", "period", F.col("metric_code").alias("input"), "period_type", "ytd_months", "quality_flag", "trace", "source_role")
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = inputs.hint("merge").join(of.hint("merge"), "input").groupBy("entity", "period", "metric_code").agg(
        F.array_sort(F.collect_set("period_type")).alias("types"), F.collect_set("ytd_months").alias("months"), F.bool_or(sure(F.col("quality_flag").isin(*BAD_FLAGS))).alias("low"),
        F.bool_and(F.coalesce("trace", F.lit("")) != "").alias("traced"), F.bool_and(sure(F.col("source_role").isin(*GOOD_ROLES))).alias("good_roles"),
    )
    one = F.when(F.size("types") == 1, F.get("types", F.lit(0)))
    cover = F.when((one == "ytd") & (F.size("months") == 1), F.concat(F.get("months", F.lit(0)).cast("string"), F.lit("M"))).when(one == "annual", "12M").otherwise(F.coalesce(one, F.lit("mixed")))
    return rows.select("entity", "period", "metric_code", F.coalesce(one, F.lit("mixed")).alias("period_type"), cover.alias("coverage"), "low", "traced", "good_roles")


def pair_compatibility(audited: DataFrame, signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """target, peer, period, metric_code, target_value, peer_value, comparable, reason, period_type, coverage, target_valid and
    peer_valid of every metric and quarter that one of a pair has.

    pairs: target, peer.  The first reason counts: valuation and ebitda metrics, then for the target and then for the peer a
    missing or questionable metric, inputs of bad flags, inputs without a trace, sources of other roles; last, differing
    period types or coverage.  An entity is not compared with itself; repeated pairs count once.
    """
    side = signatures.select("entity", "period", "metric_code", "period_type", "coverage", "low", "traced", "good_roles")
    rows = audited.select("entity", "period", "metric_code", "value", "status").hint("merge").join(side.hint("merge"), ["entity", "period", "metric_code"], "left")
    fields = ("value", "status", "period_type", "coverage", "low", "traced", "good_roles")
    asked = pairs.select("target", "peer").where("target <> peer").distinct()

    def of(who: str) -> DataFrame:
        own = rows.select(F.col("entity").alias(who), "period", "metric_code", F.struct(*fields).alias(f"{who}_x"))
        return asked.hint("merge").join(own.hint("merge"), who)

    key = ["target", "peer", "period", "metric_code"]
    both = of("target").hint("merge").join(of("peer").hint("merge"), key, "full_outer")
    sure = lambda c: F.coalesce(c, F.lit(False))
    code = F.col("metric_code")
    reason = F.when(code.isin(*VALUATION), "valuation_inputs_missing").when(code.isin(*EBITDA), "ebitda_missing")
    for who in ("target", "peer"):
        x = lambda c, who=who: F.col(f"{who}_x.{c}")
        reason = (
            reason.when(sure(x("status") == "questionable"), f"questionable_for_{who}").when(~sure(x("status") == "valid"), f"missing_for_{who}").when(sure(x("low")), f"low_quality_inputs_for_{who}")
            .when(~sure(x("traced")), f"traceability_missing_for_{who}").when(~sure(x("good_roles")), f"unacceptable_source_role_for_{who}")
        )
    same = F.col("target_x.period_type").eqNullSafe(F.col("peer_x.period_type")) & F.col("target_x.coverage").eqNullSafe(F.col("peer_x.coverage"))
    out = both.withColumn("reason", reason.when(~same, "incompatible_period_coverage"))
    fine = F.col("reason").isNull()
    shown = lambda c: F.when(fine, F.col(f"target_x.{c}")).alias(c)
    valid = lambda who: sure(F.col(f"{who}_x.status") == "valid").alias(f"{who}_valid")
    return out.select(*key, F.col("target_x.value").alias("target_value"), F.col("peer_x.value").alias("peer_value"), fine.alias("comparable"), "reason", shown("period_type"), shown("coverage"), valid("target"), valid("peer"))


def pair_report(compared: DataFrame, documents: DataFrame, last_period: str) -> DataFrame:
    """A row a pair: comparable and excluded metrics, gaps a side, full_year, status, readiness and warnings.

    compared: of pair_compatibility; documents: entity, period of the reports at hand.  A pair compares a full year where the
    peer's last quarter is there; fewer than ENOUGH comparable metrics aren't ready, and without a full year they are limited.
    """
    whole = documents.where(F.col("period") == last_period).select(F.col("entity").alias("peer"), F.lit(True).alias("full")).distinct()
    rows = compared.groupBy("target", "peer").agg(
        F.count_if("comparable").alias("comparable"), F.count_if(~F.col("comparable")).alias("excluded"), F.count_if(~F.col("comparable") & ~F.col("target_valid")).alias("target_gaps"),
        F.count_if(~F.col("comparable") & ~F.col("peer_valid")).alias("peer_gaps"), F.count_if("peer_valid").alias("peer_metrics"), F.bool_or(F.col("reason") == "ebitda_missing").alias("ebitda"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )
    rows = rows.hint("merge").join(whole.hint("merge"), "peer", "left").withColumn("full_year", F.coalesce("full", F.lit(False)))
    n = F.col("comparable")
    readiness = F.when(n < ENOUGH, "not_ready").when(~F.col("full_year"), "limited").otherwise("usable_with_warnings")
    warnings = F.array_compact(F.array(
        F.when(F.coalesce("ebitda", F.lit(False)), "ebitda_metrics_unavailable"), F.when(F.col("peer_metrics") < NARROW, "narrow_peer_coverage"), F.when(n == 0, "no_compatible_metrics"), F.lit("partial_comparison"), F.when(~F.col("full_year"), "peer_year_end_missing"),
        F.lit("valuation_unavailable"),
    ))
    return rows.select("target", "peer", "comparable", "excluded", "target_gaps", "peer_gaps", "full_year", F.when(n > 0, "PARTIAL").otherwise("NOT_READY").alias("status"), readiness.alias("readiness"), F.array_join(warnings, ",").alias("warnings"), "reasons")
