"""Ratios and metric audits over facts of all entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.numbers import display_value, economic_value

#: Metric, its output format, and its plain numerator and denominator where it has them.
FORMULAS = {
    "revenue_growth": ("percent", "revenue - prev_revenue", "prev_revenue"),
    "ebitda_margin": ("percent", "ebitda", "revenue"),
    "operating_margin": ("percent", "operating_profit", "revenue"),
    "net_margin": ("percent", "net_income", "revenue"),
    "roe": ("percent", "net_income_ttm", "average_equity"),
    "roa": ("percent", "net_income_ttm", "average_assets"),
    "debt_to_equity": ("ratio", "total_debt", "total_equity"),
    "net_debt_to_ebitda": ("ratio", "total_debt - cash_and_equivalents", "ebitda_ttm"),
    "current_ratio": ("ratio", "current_assets", "current_liabilities"),
    "fcf": ("currency", "operating_cash_flow - capex", None),
    "fcf_margin": ("percent", "operating_cash_flow - capex", "revenue"),
    "pe_ratio": ("ratio", None, None),
    "ev_to_ebitda": ("ratio", None, None),
    "dividend_yield": ("percent", None, None),
    "net_interest_margin": ("percent", None, None),
    "cost_to_income": ("percent", None, None),
    "loan_to_deposit": ("ratio", None, None),
    "equity_to_assets": ("percent", None, None),
    "net_margin_like": ("percent", None, None),
}
STRICT_CODES = ("roe", "roa", "debt_to_equity", "current_ratio", "fcf", "fcf_margin", "ebitda_margin", "operating_margin", "net_margin", "revenue_growth")
BANK_UNSUPPORTED = ("debt_to_equity", "current_ratio", "fcf", "fcf_margin", "ebitda_margin", "operating_margin", "net_margin", "revenue_growth")
VALUATION = ("pe_ratio", "ev_to_ebitda", "dividend_yield")
CODES = ("revenue", "operating_profit", "net_income", "ebitda", "operating_cash_flow", "capex", "current_assets", "current_liabilities", "total_assets", "total_debt", "total_equity", "cash_and_equivalents")


def wide_facts(facts: DataFrame, codes=CODES) -> DataFrame:
    """One row an entity and period: a column a code; the code list is given, so no scan looks for it."""
    rows = facts.withColumn("v", economic_value(F.col("value"), F.col("unit_multiplier")))
    return rows.groupBy("entity", "period").pivot("metric_code", list(codes)).agg(F.max("v"))


def _with_history(wide: DataFrame) -> DataFrame:
    """Adds calendar-previous values, means with them, and sums over the last four periods that are present."""
    i = P.period_index(F.col("period"))
    rows = wide.withColumn("i", i)
    before = rows.select("entity", (F.col("i") + 1).alias("i"), *[F.col(c).alias(f"prev_{c}") for c in ("revenue", "total_equity", "total_assets")])
    last4 = Window.partitionBy("entity").orderBy("i").rowsBetween(-3, 0)
    ttm = {f"{c}_ttm": F.when((F.count(F.lit(1)).over(last4) == 4) & (F.count(c).over(last4) == 4), F.sum(c).over(last4)) for c in ("net_income", "ebitda")}
    rows = rows.withColumns(ttm).join(before, ["entity", "i"], "left")
    mean = lambda c: F.when(F.col(f"prev_{c}").isNull(), F.col(c)).otherwise((F.col(c) + F.col(f"prev_{c}")) / 2)
    return rows.withColumns({"average_equity": mean("total_equity"), "average_assets": mean("total_assets")})


def metrics_engine(facts: DataFrame) -> DataFrame:
    """All formulas for each entity and period: value, display, quality flag and warnings.

    A missing or zero input gives no value and a warning; market and bank formulas have no inputs here.
    """
    rows = _with_history(wide_facts(facts))
    out = []
    for code, (kind, num, den) in FORMULAS.items():
        n = F.expr(num) if num else F.lit(None).cast("double")
        d = F.expr(den) if den else None
        if num is None:
            value, fault = F.lit(None).cast("double"), F.lit("market valuation input unavailable" if code in VALUATION else "formula unavailable")
        elif d is None:
            value, fault = n, F.when(n.isNull(), "missing input")
        else:
            value, fault = F.try_divide(n, d), F.when(n.isNull() | d.isNull(), "missing input").when(d == 0, "denominator_zero")
        negative = F.when(value.isNotNull() & (d < 0), "negative denominator") if d is not None else F.lit(None).cast("string")
        current = F.lit(None).cast("string")
        if code in ("roe", "roa"):
            base = "total_equity" if code == "roe" else "total_assets"
            current = F.when(F.col(base).isNotNull() & F.col(f"prev_{base}").isNull(), "average unavailable, current used")
        quality = F.when(value.isNull(), "missing").when(current.isNotNull(), "derived").otherwise("exact")
        warnings = F.array_join(F.array_compact(F.array(current, fault, negative)), "; ")
        out.append(F.struct(F.lit(code).alias("metric_code"), value.alias("value"), F.lit(kind).alias("output_format"), quality.alias("quality_flag"), warnings.alias("warnings")))
    return rows.select("entity", "period", F.inline(F.array(*out))).withColumn("display_value", display_value(F.col("value"), F.col("output_format")))


def quarter_growth(wide: DataFrame, code: str = "revenue") -> DataFrame:
    """(x - x of the calendar quarter before) / that; null without it."""
    rows = wide.select("entity", "period", P.period_index(F.col("period")).alias("i"), F.col(code).alias("x"))
    before = rows.select("entity", (F.col("i") + 1).alias("i"), F.col("x").alias("p"))
    return rows.join(before, ["entity", "i"], "left").select("entity", "period", F.try_divide(F.col("x") - F.col("p"), F.col("p")).alias("growth"))


def ttm_sum(wide: DataFrame, code: str, period_from: str, period_to: str) -> DataFrame:
    """For each asked period: the sum over the last four present periods at or before it, null unless all four have the code."""
    a, b = P.range_bounds(period_from, period_to)
    rows = wide.select("entity", P.period_index(F.col("period")).alias("i"), F.col(code).alias("x"))
    last4 = Window.partitionBy("entity").orderBy("i").rowsBetween(-3, 0)
    sums = rows.select("entity", "i", F.when((F.count(F.lit(1)).over(last4) == 4) & (F.count("x").over(last4) == 4), F.sum("x").over(last4)).alias("ttm"), F.lit(True).alias("present"))
    grid = wide.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(a), F.lit(b))).alias("i"))
    both = sums.join(grid.withColumn("asked", F.lit(True)).hint("merge"), ["entity", "i"], "full_outer")
    latest = F.last(F.when(F.col("present"), F.struct("ttm")), ignorenulls=True).over(Window.partitionBy("entity").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("latest", latest).where("asked").select("entity", P.period_from_index(F.col("i")).alias("period"), F.col("latest.ttm").alias("ttm"))


def average_or_current(wide: DataFrame, code: str) -> DataFrame:
    rows = wide.select("entity", "period", P.period_index(F.col("period")).alias("i"), F.col(code).alias("x"))
    before = rows.select("entity", (F.col("i") + 1).alias("i"), F.col("x").alias("p"))
    value = F.when(F.col("p").isNull(), F.col("x")).otherwise((F.col("x") + F.col("p")) / 2)
    return rows.join(before, ["entity", "i"], "left").select("entity", "period", value.alias("average"), F.when(F.col("x").isNotNull(), F.when(F.col("p").isNull(), "derived").otherwise("exact")).alias("quality_flag"))


def strict_ratios(facts: DataFrame, period_from: str, period_to: str, banks: DataFrame | None = None, *, inputs: bool = False) -> DataFrame:
    """Ten metrics for every entity and period of the range, with status and reason.

    facts: one row a (entity, period, metric), eligible ones.  banks: entities to which industrial metrics don't apply.
    inputs: also missing_inputs, an array of the facts for want of which a metric isn't there (empty for all others).
    """
    a, b = P.range_bounds(period_from, period_to)
    value = economic_value(F.col("value"), F.col("unit_multiplier"))
    cell = F.struct(value.alias("v"), F.col("period_type").alias("t"), F.col("quality_flag").alias("q"))
    wide = facts.withColumn("cell", cell).groupBy("entity", P.period_index(F.col("period")).alias("i")).pivot("metric_code", list(CODES)).agg(F.first("cell"))
    grid = facts.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(a), F.lit(b))).alias("i"))
    base = ("revenue", "total_equity", "total_assets")
    # the quarter and the year before come from one sort of an entity's quarters, asked for or not
    back = lambda c, n: F.first(c).over(Window.partitionBy("entity").orderBy("i").rangeBetween(-n, -n))
    rows = wide.join(grid.withColumn("asked", F.lit(True)).hint("merge"), ["entity", "i"], "full_outer")
    rows = rows.withColumns({f"q_{c}": back(c, 1) for c in base} | {f"y_{c}": back(c, 4) for c in base}).where("asked").drop("asked")
    if banks is not None:
        rows = rows.join(banks.select("entity", F.lit(True).alias("bank")), "entity", "left")
    else:
        rows = rows.withColumn("bank", F.lit(None).cast("boolean"))
    out = F.array(*[_strict(code, inputs) for code in STRICT_CODES])
    return rows.select("entity", P.period_from_index(F.col("i")).alias("period"), F.inline(out))


def _lacking(code: str) -> Column:
    """The facts for want of which the metric isn't there: the one that its reason names, else all its inputs without a fact."""
    names = lambda *n: F.array(*map(F.lit, n))
    if code in ("roe", "roa"):  # the snapshot a quarter or a year before goes by the name of its fact too
        return F.when(F.col("net_income").isNull(), names("net_income")).otherwise(names("total_equity" if code == "roe" else "total_assets"))
    if code == "revenue_growth":
        return F.when(F.col("revenue").isNull(), names("revenue")).otherwise(names("previous_revenue"))
    gone = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in AUDIT_INPUTS[code]]))
    if code == "ebitda_margin":
        return F.when(F.col("ebitda").isNull(), names("ebitda")).otherwise(gone)
    return F.when(F.size(gone) > 0, gone).otherwise(names("total_debt"))  # a total that is there, but derived


def _strict(code: str, inputs: bool = False) -> Column:
    c = F.col
    snapshot = lambda *names: [c(f"{n}.t") == "balance_sheet_snapshot" for n in names]
    missing, blocker, extra = [], F.lit(None).cast("string"), []
    if code in ("roe", "roa"):
        name = "total_equity" if code == "roe" else "total_assets"
        annual = (c("net_income.t") == "annual") & (F.pmod("i", F.lit(4)) == 3) & c(f"y_{name}").isNotNull()
        prior = F.when(F.coalesce(annual, F.lit(False)), c(f"y_{name}")).otherwise(c(f"q_{name}"))
        missing = [(c("net_income").isNull(), "missing_inputs"), (c(name).isNull(), "missing_inputs"), (prior.isNull(), "missing_average_base_snapshot")]
        blocker = F.when(~c("net_income.t").isin("annual", "ytd"), "income_period_type_not_supported").when(~(snapshot(name)[0] & (prior["t"] == "balance_sheet_snapshot")), "balance_sheet_snapshot_required")
        num, den = c("net_income.v"), (c(f"{name}.v") + prior["v"]) / 2
    elif code == "revenue_growth":
        missing = [(c("revenue").isNull(), "missing_inputs"), (c("q_revenue").isNull(), "previous_comparable_revenue_missing")]
        blocker = F.when(c("revenue.t") != c("q_revenue.t"), "incomparable_revenue_period_type")
        num, den = c("revenue.v") - c("q_revenue.v"), c("q_revenue.v")
    else:
        names = {"fcf": ["operating_cash_flow", "capex"], "fcf_margin": ["operating_cash_flow", "capex", "revenue"], "debt_to_equity": ["total_debt", "total_equity"], "current_ratio": ["current_assets", "current_liabilities"], "ebitda_margin": ["ebitda", "revenue"], "operating_margin": ["operating_profit", "revenue"], "net_margin": ["net_income", "revenue"]}[code]
        if code == "ebitda_margin":
            extra = [(c("ebitda").isNull(), "unsupported_by_policy", "explicit_ebitda_missing_no_proxy_allowed")]
        missing = [(c(n).isNull(), "missing_inputs") for n in names]
        if code == "debt_to_equity":
            missing.append((c("total_debt.q") == "derived", "explicit_total_debt_missing_no_component_derivation"))
        if code in ("current_ratio", "debt_to_equity"):
            blocker = F.when(~(snapshot(*names)[0] & snapshot(*names)[1]), "balance_sheet_snapshot_required")
        else:
            blocker = F.when(F.size(F.array_distinct(F.array(*[c(f"{n}.t") for n in names]))) > 1, "mixed_period_types")
        fcf = c("operating_cash_flow.v") + F.when(c("capex.v") < 0, c("capex.v")).otherwise(-c("capex.v"))
        num = fcf if code.startswith("fcf") else c(f"{names[0]}.v")
        den = F.lit(1.0) if code == "fcf" else c("revenue.v") if code == "fcf_margin" else c(f"{names[1]}.v")
    tests = [(c("bank"), "unsupported_by_sector_policy", "industrial_metric_not_applicable_to_bank")] if code in BANK_UNSUPPORTED else []
    tests += extra + [(t, "missing", r) for t, r in missing] + [(blocker.isNotNull(), "blocked_by_period_semantics", blocker), (den == 0, "blocked_by_zero_denominator", "division_by_zero")]
    status = reason = None
    for test, s, r in tests:
        r = r if isinstance(r, Column) else F.lit(r)
        status = F.when(test, s) if status is None else status.when(test, s)
        reason = F.when(test, r) if reason is None else reason.when(test, r)
    status = status.otherwise("calculated")
    lacking = []
    if inputs:
        gone = status.isin("missing", "unsupported_by_policy")
        lacking = [F.when(gone, _lacking(code)).otherwise(F.array().cast("array<string>")).alias("missing_inputs")]
    return F.struct(F.lit(code).alias("metric_code"), F.when(status == "calculated", F.try_divide(num, den)).alias("value"), status.alias("status"), reason.alias("reason"), *lacking)


def bank_ratios(facts: DataFrame) -> DataFrame:
    """Five ratios on wide bank facts; operating expenses count by size, not sign."""
    pairs = {"net_interest_margin": ("net_interest_income", "average_interest_earning_assets"), "cost_to_income": ("operating_expenses", "operating_income"), "loan_to_deposit": ("loans_to_customers", "customer_accounts"), "equity_to_assets": ("total_equity", "total_assets"), "net_margin_like": ("net_income", "operating_income")}
    codes = sorted({c for p in pairs.values() for c in p})
    wide = facts.groupBy("entity", "period").pivot("metric_code", codes).agg(F.max(economic_value(F.col("value"), F.col("unit_multiplier"))))
    out = []
    for code, (n, d) in pairs.items():
        num = F.abs(n) if code == "cost_to_income" else F.col(n)
        status = F.when(F.col(n).isNull() | F.col(d).isNull(), "missing").when(F.col(d) == 0, "blocked_by_zero_denominator").otherwise("calculated")
        out.append(F.struct(F.lit(code).alias("metric_code"), F.try_divide(num, F.col(d)).alias("value"), status.alias("status")))
    return wide.select("entity", "period", F.inline(F.array(*out)))


def status_summary(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("entity").agg(
        F.count_if(F.col("status") == "calculated").alias("calculated_count"), F.count_if(F.col("status") == "missing").alias("missing_count"), F.count_if(F.col("status").startswith("unsupported")).alias("unsupported_count"),
        F.count_if(F.col("status").startswith("blocked")).alias("blocked_count"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status").startswith("blocked"), F.col("reason")))), ",").alias("blockers"),
    )


#: The facts that each audited metric reads.
AUDIT_INPUTS = {
    "revenue_growth": ("revenue",), "ebitda_margin": ("ebitda", "revenue"), "operating_margin": ("operating_profit", "revenue"), "net_margin": ("net_income", "revenue"), "roe": ("net_income", "total_equity"),
    "roa": ("net_income", "total_assets"), "debt_to_equity": ("total_debt", "total_equity"), "net_debt_to_ebitda": ("total_debt", "cash_and_equivalents", "ebitda"), "current_ratio": ("current_assets", "current_liabilities"),
    "fcf": ("operating_cash_flow", "capex"), "fcf_margin": ("operating_cash_flow", "capex", "revenue"),
}


def _with_inputs(metrics: DataFrame, facts: DataFrame, *kept: str) -> DataFrame:
    """Metrics beside what is known of their inputs' flags and period types."""
    inputs = F.create_map(*[x for code, names in AUDIT_INPUTS.items() for x in (F.lit(code), F.array(*map(F.lit, names)))])
    # a quarter's facts meet its metrics as one array, so that no row is made for each input
    known = facts.groupBy("entity", "period").agg(F.collect_list(F.struct(F.col("metric_code").alias("input"), F.col("quality_flag").alias("flag"), F.col("period_type").alias("type"))).alias("all"))
    rows = metrics.select("entity", "period", "metric_code", "value", "quality_flag", *kept).hint("merge").join(known.hint("merge"), ["entity", "period"], "left")
    names = F.coalesce(F.try_element_at(inputs, F.col("metric_code")), F.array().cast("array<string>"))
    rows = rows.withColumn("x", F.filter(F.coalesce("all", F.array().cast("array<struct<input:string,flag:string,type:string>>")), lambda x: F.array_contains(names, x["input"]))).drop("all")
    flagged = lambda flag: F.exists("x", lambda x: F.coalesce(x["flag"] == flag, F.lit(False)))
    types = F.array_distinct(F.array_compact(F.transform("x", lambda x: x["type"])))
    revenue = F.array_max(F.transform(F.filter("x", lambda x: x["input"] == "revenue"), lambda x: x["type"]))
    other = F.exists("x", lambda x: ~F.coalesce(x["flag"].isin("exact", "derived"), F.lit(False)))
    return rows.select(
        "entity", "period", "metric_code", "value", "quality_flag", *kept, other.alias("other"), flagged("conflicting_sources").alias("conflict"), flagged("low_confidence_parse").alias("low"), flagged("derived").alias("derived"), F.size(types).alias("types"),
        F.forall(types, lambda t: t == "balance_sheet_snapshot").alias("snapshots"), revenue.alias("revenue_type"),
    )


def _audit_status() -> Column:
    code = F.col("metric_code")
    return (
        F.when(code.isin(*VALUATION), F.when(F.col("value").isNull(), "missing").otherwise("invalid")).when(F.col("value").isNull() | (F.col("quality_flag") == "missing"), "missing").when(F.col("conflict"), "invalid").when(F.col("low"), "questionable")
        .when(code.isin("ebitda_margin", "operating_margin", "net_margin", "fcf", "fcf_margin"), F.when(F.col("types") == 1, "valid").otherwise("invalid")).when((code == "revenue_growth") & F.col("revenue_type").isin("ytd", "annual"), "questionable")
        .when(code.isin("roe", "roa"), "questionable").when(code.isin("current_ratio", "debt_to_equity"), F.when(F.col("snapshots"), "valid").otherwise("invalid")).when(code == "net_debt_to_ebitda", "missing").otherwise("valid")
    )


def audit_metrics(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """Each metric's status from its value and its inputs' flags and period types: valid, questionable, invalid, missing."""
    rows = _with_inputs(metrics, facts).withColumn("status", _audit_status())
    return rows.select("entity", "period", "metric_code", "value", "status", "derived")


def audit_findings(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """entity, period, metric_code, status, warnings (array), questionable_reason and fix_type of each audited metric.

    metrics may have a column warning (of period_compat_warnings); it comes before the audit's own.  The first cause that fits makes
    the audit's warning, and the first that fits the reason; reasons and fix types are null but for questionable metrics.  Facts without a flag count as unverified.
    """
    own = ("warning",) if "warning" in metrics.columns else ()
    rows = _with_inputs(metrics, facts, *own).withColumn("status", _audit_status())
    code, status = F.col("metric_code"), F.col("status")
    said = F.col("warning") if own else F.lit(None).cast("string")
    found = (
        F.when(code.isin(*VALUATION), F.when(said.isNull(), "valuation_inputs_unavailable"))
        .when(F.col("value").isNull() | (F.col("quality_flag") == "missing"), F.lit(None).cast("string"))
        .when(F.col("conflict"), "conflicting_input")
        .when(F.col("low"), "low_confidence_input")
        .when(status == "invalid", F.when(code.isin("current_ratio", "debt_to_equity"), "snapshot_inputs_required").otherwise("mixed_period_coverage"))
        .when((code == "revenue_growth") & (status == "questionable"), "growth_of_cumulative_periods")
        .when(code.isin("roe", "roa"), "income_over_snapshots")
        .when(code == "net_debt_to_ebitda", "ebitda_unavailable")
    )
    average = F.coalesce(F.lower(said).rlike("average.*unavailable"), F.lit(False))
    reason = F.when(
        status == "questionable",
        F.when(F.col("derived"), "derived_input_used")
        .when(F.col("other"), "unverified_fact_input")
        .when(code.isin("roe", "roa"), F.when(average, "average_balance_sheet_unavailable").otherwise("ytd_income_with_snapshot_balance_sheet"))
        .when((code == "revenue_growth") & F.col("revenue_type").isin("ytd", "annual"), "incomplete_period_coverage")
        .otherwise("methodology_warning"),
    )
    policy = ("derived_input_used", "average_balance_sheet_unavailable", "ytd_income_with_snapshot_balance_sheet")
    why = F.col("questionable_reason")
    fix = F.when(why.isin(*policy), "requires_manual_policy").when(why == "incomplete_period_coverage", "period_semantics").when(why.isNotNull(), "cannot_fix")
    rows = rows.withColumns({"warnings": F.array_compact(F.array(said, found)), "questionable_reason": reason})
    return rows.select("entity", "period", "metric_code", "status", "warnings", "questionable_reason", fix.alias("fix_type"))


def questionable_breakdown(findings: DataFrame) -> DataFrame:
    """reason, fix_type, rows, entities and metrics (sorted array) of the questionable metrics of audit_findings."""
    rows = findings.where(F.col("status") == "questionable")
    return rows.groupBy(F.col("questionable_reason").alias("reason"), "fix_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"), F.array_sort(F.collect_set("metric_code")).alias("metrics")
    )


def metric_status_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("entity").agg(*[F.count_if(F.col("status") == s).alias(f"metrics_{s}_count") for s in ("valid", "questionable", "invalid", "missing")])


def metric_decisions(audited: DataFrame) -> DataFrame:
    """Per metric: periods by status and whether it can be used."""
    n = {s: F.col(f"periods_{s}") for s in ("valid", "questionable", "missing", "invalid")}
    rows = audited.groupBy("metric_code").agg(*[F.count_if(F.col("status") == s).alias(f"periods_{s}") for s in n], F.bool_or("derived").alias("derived"))
    code = F.col("metric_code")
    decision = (
        F.when(code.isin(*VALUATION), "requires_market_data").when(code.isin("ebitda_margin", "net_debt_to_ebitda"), "requires_explicit_disclosure").when(code.isin("roe", "roa") & (n["questionable"] > 0), "needs_methodology_decision")
        .when((code == "revenue_growth") & (n["questionable"] > 0), "usable_with_warning").when(n["invalid"] > 0, "needs_methodology_decision").when((n["valid"] > 0) & (n["missing"] == 0) & (n["questionable"] == 0), F.when(F.col("derived"), "usable_with_warning").otherwise("usable"))
        .when(n["valid"] > 0, "usable_with_warning").otherwise("not_available")
    )
    return rows.withColumn("decision", decision).drop("derived")


def decision_notes(decisions: DataFrame) -> DataFrame:
    """Decisions of metric_decisions with a note: what each rests on."""
    code, decision = F.col("metric_code"), F.col("decision")
    note = (
        F.when(decision == "requires_market_data", "needs market value or dividends")
        .when(decision == "requires_explicit_disclosure", "no EBITDA is stated in the reports")
        .when(code.isin("roe", "roa") & (F.col("periods_questionable") > 0), "depends on how income is annualised and balances averaged")
        .when((code == "revenue_growth") & (F.col("periods_questionable") > 0), "growth of cumulative figures, not of single quarters")
        .when(F.col("periods_invalid") > 0, "inputs of some quarter don't cover the same period")
        .when(decision == "usable", "every quarter is valid")
        .when(decision == "not_available", "no quarter is valid")
        .when((F.col("periods_missing") == 0) & (F.col("periods_questionable") == 0), "an input is derived")
        .otherwise("some quarters are missing or open to question")
    )
    return decisions.withColumn("note", note)


def metric_coverage_grid(metrics: DataFrame, codes=STRICT_CODES) -> DataFrame:
    """Every entity's periods and key metrics: calculated, derived or missing."""
    grid = metrics.select("entity", "period").distinct().select("entity", "period", F.explode(F.array(*map(F.lit, codes))).alias("metric_code"))
    rows = grid.join(metrics.select("entity", "period", "metric_code", "value", "quality_flag").hint("merge"), ["entity", "period", "metric_code"], "left")
    return rows.select("entity", "period", "metric_code", F.when(F.col("value").isNull(), "missing").when(F.col("quality_flag") == "derived", "derived").otherwise("calculated").alias("status"))


def result_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed metrics of two results."""
    key = ["entity", "period", "metric_code"]
    rows = old.select(*key, F.col("value").alias("old_value"), F.lit(True).alias("o")).join(new.select(*key, F.col("value").alias("new_value"), F.lit(True).alias("n")), key, "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    change = F.col("new_value") - F.col("old_value")
    return rows.select(*key, "old_value", "new_value", kind.alias("kind"), change.alias("absolute_change"), F.try_divide(change, F.abs("old_value")).alias("relative_change"))


def delta_summary(old: DataFrame, new: DataFrame, old_warnings: DataFrame, new_warnings: DataFrame) -> DataFrame:
    """Per entity of either result: metrics added, removed, changed and unchanged, quarters that only the new one has, and
    warnings that are new or resolved, as sorted arrays.

    old, new: entity, period, metric_code, value; warnings: entity, warning.  Entities of which one result is missing have
    everything added or removed; repeated warnings count once.
    """
    kinds = result_delta(old, new).groupBy("entity").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed", "unchanged")])

    def lists(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy("entity").agg(F.collect_set(column).alias(name))

    out = kinds
    for part in (lists(old, "period", "op"), lists(new, "period", "np"), lists(old_warnings, "warning", "ow"), lists(new_warnings, "warning", "nw")):
        out = out.hint("merge").join(part.hint("merge"), "entity", "left")
    none = F.array().cast("array<string>")
    only = lambda a, b: F.array_sort(F.array_except(F.coalesce(a, none), F.coalesce(b, none)))
    return out.select("entity", "added", "removed", "changed", "unchanged", only("np", "op").alias("added_periods"), only("nw", "ow").alias("new_warnings"), only("ow", "nw").alias("resolved_warnings"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    key = ["entity", "period", "metric_code"]
    side = lambda df, p: df.select(*key, F.col("value").alias(f"{p}_value"), F.col("quality_flag").alias(f"{p}_flag"))
    return side(a, "a").join(side(b, "b"), key, "full_outer").withColumn("difference", F.col("b_value") - F.col("a_value"))


def unlock_plan(priorities: DataFrame) -> DataFrame:
    rows = priorities.groupBy("entity", "unlocks").agg(F.array_join(F.array_sort(F.collect_list("fact")), ",").alias("facts"), F.sum("score").alias("score"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "unlocks")))


# What each warning looks at.
WARNED_MARGINS = {"ebitda_margin": ("ebitda", "revenue"), "operating_margin": ("operating_profit", "revenue"), "net_margin": ("net_income", "revenue"), "fcf": ("operating_cash_flow", "capex"), "fcf_margin": ("operating_cash_flow", "capex", "revenue")}
WARNED_SNAPSHOTS = {"current_ratio": ("current_assets", "current_liabilities"), "debt_to_equity": ("total_debt", "total_equity")}


def period_compat_warnings(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """metrics (entity, period, metric_code, value, quality_flag) with a warning where inputs of different kinds of period meet.

    The value goes where a snapshot is required; an exact metric with a warning counts as derived.
    """
    codes = sorted({c for names in (*WARNED_MARGINS.values(), *WARNED_SNAPSHOTS.values()) for c in names} | {"net_income"})
    types = facts.groupBy("entity", "period").agg(F.map_from_entries(F.collect_set(F.when(F.col("metric_code").isin(codes) & F.col("period_type").isNotNull(), F.struct("metric_code", "period_type")))).alias("types"))
    rows = metrics.join(types.hint("merge"), ["entity", "period"], "left")
    kinds = lambda names: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.try_element_at("types", F.lit(n)) for n in names]))))
    code, warning = F.col("metric_code"), F.lit(None).cast("string")
    for metric, names in WARNED_MARGINS.items():
        warning = F.when((code == metric) & (F.size(kinds(names)) > 1), F.concat(F.lit(f"mixed period coverage: {metric}: "), F.array_join(kinds(names), ", "))).otherwise(warning)
    for metric, names in WARNED_SNAPSHOTS.items():
        good = (F.array_join(kinds(names), ",") == "balance_sheet_snapshot") | (F.array_join(kinds(names), ",") == "quarter")
        warning = F.when((code == metric) & (F.size(kinds(names)) > 0) & ~good, "balance_sheet_snapshot inputs of one period are required").otherwise(warning)
    income = F.try_element_at("types", F.lit("net_income"))
    warning = F.when(code.isin("roe", "roa") & income.isin("ytd", "annual"), F.concat(F.upper(code), F.lit(" uses "), income, F.lit(" income with snapshots"))).otherwise(warning)
    out = rows.withColumn("warning", warning)
    value = F.when(~(code.isin(*WARNED_SNAPSHOTS) & F.col("warning").isNotNull()), F.col("value"))
    quality = F.when(F.col("warning").isNotNull() & (F.col("quality_flag") == "exact"), "derived").otherwise(F.col("quality_flag"))
    return out.select("entity", "period", "metric_code", value.alias("value"), quality.alias("quality_flag"), "warning")


def metric_lineage(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """entity, period, metric_code, required (names), inputs: map of the facts at hand to their document, flag and period type."""
    names = F.create_map(*[x for code, inputs in AUDIT_INPUTS.items() for x in (F.lit(code), F.array(*map(F.lit, inputs)))])
    cell = F.struct("document_id", "quality_flag", "period_type")
    known = facts.groupBy("entity", "period").agg(F.map_from_entries(F.collect_list(F.struct("metric_code", cell.alias("cell")))).alias("facts"))
    rows = metrics.select("entity", "period", "metric_code", F.coalesce(F.try_element_at(names, F.col("metric_code")), F.array().cast("array<string>")).alias("required"))
    rows = rows.join(known.hint("merge"), ["entity", "period"], "left")
    return rows.select("entity", "period", "metric_code", "required", F.map_filter("facts", lambda k, _: F.array_contains("required", k)).alias("inputs"))


def missing_details(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """entity, period, metric_code, reason, blocking (array) and fix of each metric without a value, by the first cause that fits."""
    names = F.create_map(*[x for code, inputs in AUDIT_INPUTS.items() for x in (F.lit(code), F.array(*map(F.lit, inputs)))])
    known = facts.groupBy("entity", "period").agg(F.collect_set("metric_code").alias("have"), F.map_from_entries(F.collect_set(F.struct("metric_code", "period_type"))).alias("types"))
    rows = metrics.where(F.col("value").isNull() | (F.col("quality_flag") == "missing")).join(known.hint("merge"), ["entity", "period"], "left")
    code = F.col("metric_code")
    needs = F.coalesce(F.try_element_at(names, code), F.array().cast("array<string>"))
    lacks = F.array_sort(F.array_except(needs, F.coalesce("have", F.array().cast("array<string>"))))
    mixed = F.size(F.array_distinct(F.array_compact(F.transform(needs, lambda n: F.try_element_at("types", n))))) > 1
    why = lambda reason, fix, *inputs: F.struct(F.lit(reason).alias("reason"), F.array(*map(F.lit, inputs)).cast("array<string>").alias("blocking"), F.lit(fix).alias("fix"))
    out = (
        F.when(code.isin("ebitda_margin", "net_debt_to_ebitda"), why("missing_ebitda", "wait for an explicit disclosure", "ebitda"))
        .when((code == "ev_to_ebitda") & ~F.coalesce(F.array_contains("have", F.lit("ebitda")), F.lit(False)), why("missing_ebitda", "wait for an explicit disclosure and market inputs", "ebitda", "ev")).when(code == "ev_to_ebitda", why("missing_ev", "add the enterprise value from market data", "ev"))
        .when(code == "pe_ratio", why("missing_market_cap", "add the market capitalisation, or price and shares", "market_cap")).when(code == "dividend_yield", why("missing_dividend", "add dividend and price", "dividends", "price"))
        .when((code == "revenue_growth") & F.coalesce(F.array_contains("have", F.lit("revenue")), F.lit(False)), why("incompatible_period_semantics", "add the comparable period before", "previous_revenue"))
        .when(F.size(lacks) > 0, F.struct(F.lit("missing_input_fact").alias("reason"), lacks.alias("blocking"), F.lit("cover the source rows if there are any").alias("fix")))
        .when(mixed, why("incompatible_period_semantics", "align the inputs' periods")).otherwise(why("not_applicable_to_current_data", "no acceptable calculation from these data"))
    )
    return rows.select("entity", "period", "metric_code", out.alias("d")).select("entity", "period", "metric_code", "d.reason", "d.blocking", "d.fix")
