"""Queries over the shared tables, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import periods as P
from ..operators import facts as A
from ..operators import gaps as H
from ..operators import market as K
from ..operators import metrics as M
from ..sources import fixtures as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FROM, TO = "1996Q1", "1998Q4"
I_FROM, I_TO = 1996 * 4, 1998 * 4 + 3


def query(oracle: str | None = None, *ctes: str):
    """Register a query under its function's name; the oracle's common tables come first."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = ("with " + ",\n".join(ctes) + "\n" if ctes else "") + oracle
        return f

    return keep


FACTS, CANDLES, REGISTRY, SOURCES = S.FACTS_SQL.strip(), S.CANDLES_SQL.strip(), S.REGISTRY_SQL.strip(), S.TWO_SOURCES_SQL.strip()
SAFE = "('exact','derived','high_confidence','manual_verified','reviewed')"
DROPPED = "('fixture','low_confidence_parse','conflicting_sources')"
WIDE = "fw as (select entity, period, any_value(idx) i, " + ", ".join(f"max(case when metric_code = '{c}' then value end) {c}" for c in M.CODES) + " from facts group by entity, period)"


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- sources and periods ----


@query(f"select entity, period, metric_code, value, case when quality_flag in ('exact','derived','low_confidence_parse','fixture') then quality_flag else 'manual_review_required' end quality_flag, currency, unit_multiplier, period_type, confidence from facts where idx between {I_FROM} and {I_TO}", FACTS)
def s1_scan_facts(spark, sf_dir):
    raw = S.facts(spark, sf_dir).select("entity", "period", F.concat(F.lit("  "), F.upper(F.translate("metric_code", "_", " ")), F.lit(" ")).alias("metric_code"), F.col("value").cast("string").alias("value"), F.upper("quality_flag").alias("quality_flag"), F.lit("").alias("currency"), F.lit(None).cast("string").alias("unit_multiplier"), "period_type", F.col("confidence").cast("string").alias("confidence"))
    return A.scan_facts(raw, FROM, TO)


@query("select ticker, date, open, high, low, close, volume, value from candles", CANDLES)
def s2_normalize_candles(spark, sf_dir):
    raw = S.candles(spark, sf_dir).select("ticker", F.col("date").cast("string").alias("begin"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume", "value")])
    return K.normalize_candles(raw).select("ticker", "date", "open", "high", "low", "close", "volume", "value")


@query("select ticker, date, close from candles", CANDLES)
def s4_union_pages(spark, sf_dir):
    rows = S.candles(spark, sf_dir).select("ticker", "date", "close")
    early = rows.where(F.col("date") < "1997-01-01")
    return K.union_pages(early, rows, page_size=1)


@query("select ticker, date, 'x' source, case when month(date) = 1 then close else -1.0 end as close from candles union all select ticker, date, 'y', -1.0 from candles where day(date) < 10", CANDLES)
def s8_upsert_candles(spark, sf_dir):
    rows = S.candles(spark, sf_dir).select("ticker", "date", F.lit("x").alias("source"), "close")
    new = rows.withColumn("close", F.lit(-1.0))
    return K.upsert_candles(rows.where(F.month("date") == 1), new.unionByName(new).unionByName(new.where(F.dayofmonth("date") < 10).withColumn("source", F.lit("y"))))


@query(
    "select entity, document_id, period, metric_code, reporting_standard, case when k % 3 = 0 or k % 4 = 1 then value else value * 2 end as value, case when k % 4 = 1 then 'manual' else 'parser' end provenance,"
    " case when k % 3 = 0 then 'inserted' when k % 4 = 1 then 'kept_foreign' else 'updated' end as action from (select *, entity || '|X' document_id from facts where k % 3 <> 0 union all select *, entity || '|X' from facts where k % 3 = 0)".replace("case when k % 4 = 1 then 'manual' else 'parser' end provenance", "case when k % 3 <> 0 and k % 4 = 1 then 'manual' else 'parser' end provenance"),
    FACTS,
)
def s9_upsert_facts(spark, sf_dir):
    base = S.facts(spark, sf_dir).withColumn("document_id", F.concat("entity", F.lit("|X")))
    old = base.where(F.col("k") % 3 != 0).withColumn("provenance", F.when(F.col("k") % 4 == 1, "manual").otherwise("parser"))
    new = base.withColumn("value", F.when(F.col("k") % 3 == 0, F.col("value")).otherwise(F.col("value") * 2))
    return A.upsert_facts(old, new, "parser")


@query(
    "select period, idx as i, (idx // 4) || 'Q' || (idx % 4 + 1) back, ((idx - 1) // 4) || 'Q' || ((idx - 1) % 4 + 1) previous, (idx // 4 - 1) || 'Q' || (idx % 4 + 1) last_year, (idx // 4 - 1) || 'Q4' last_year_end,"
    f" idx between {I_FROM} and {I_TO} in_range, make_date(idx // 4, (idx % 4) * 3 + 1, 1) first_day, last_day(make_date(idx // 4, (idx % 4) * 3 + 3, 1)) last_day, case when idx % 4 = 3 then 'annual' else 'ytd' end kind, true valid from (select distinct period, idx from facts)",
    FACTS,
)
def p_period_functions(spark, sf_dir):
    p = F.col("period")
    i = P.period_index(p)
    return S.facts(spark, sf_dir).select("period").distinct().select(
        p, i.alias("i"), P.period_from_index(i).alias("back"), P.previous_period(p).alias("previous"), P.same_quarter_last_year(p).alias("last_year"), P.previous_year_end(p).alias("last_year_end"), P.in_range(p, FROM, TO).alias("in_range"),
        P.first_day(p).alias("first_day"), P.last_day(p).alias("last_day"), P.period_type_for(F.lit("income_statement"), p).alias("kind"), P.is_valid_period(p).alias("valid"),
    )


@query(f"select entity, period, metric_code, value from facts where idx between {I_FROM} and {I_TO}", FACTS)
def p3_filter_period_range(spark, sf_dir):
    return S.facts(spark, sf_dir).where(P.in_range(F.col("period"), FROM, TO)).select("entity", "period", "metric_code", "value")


@query("select p, case when regexp_full_match(p, '\\d{4}') then cast(p as integer) * 4 + 3 >= 7985 and cast(p as integer) * 4 <= 7993 else cast(p[1:4] as integer) * 4 + cast(p[6:6] as integer) - 1 between 7985 and 7993 end in_range, case when regexp_full_match(p, '\\d{4}') then p || 'Q4' else p end normal from (select distinct case when idx % 2 = 0 then period else substr(period, 1, 4) end p from facts)", FACTS)
def p4_filter_period_or_year(spark, sf_dir):
    p = F.col("p")
    return S.facts(spark, sf_dir).select(F.when(F.col("idx") % 2 == 0, F.col("period")).otherwise(F.substring("period", 1, 4)).alias("p")).distinct().select(p, P.in_range_or_year(p, "1996Q2", "1998Q2").alias("in_range"), P.normalize_user_period(p).alias("normal"))


@query(f"select entity, (i // 4) || 'Q' || (i % 4 + 1) period from (select distinct entity from facts) cross join (select unnest(range({I_FROM}, {I_TO + 1})) i)", FACTS)
def p5_periods_between(spark, sf_dir):
    entities = S.facts(spark, sf_dir).select("entity").distinct()
    return entities.crossJoin(F.broadcast(A.periods_between(spark, FROM, TO)))  # a list as long as the range


@query("select document_id, (m // 4) || 'Q' || (m % 4 + 1) period from (select document_id, max(idx) m from sources group by document_id)", FACTS, SOURCES)
def p12_resolve_document_periods(spark, sf_dir):
    return A.resolve_document_periods(S.two_sources(spark, sf_dir))


@query("select document_id, period, ((8003 - (dr - 1) * 4) // 4) || 'Q4' new_period from (select distinct document_id, period, dense_rank() over (partition by document_id order by idx desc) dr from sources)", FACTS, SOURCES)
def p13_relabel_periods(spark, sf_dir):
    facts = S.two_sources(spark, sf_dir)
    return A.relabel_periods(facts, facts.select("document_id").distinct().withColumn("period", F.lit("2000Q4"))).select("document_id", "period", "new_period").distinct()


@query(
    "select entity, period, metric_code, value - before as value, 'quarter' period_type, 'derived' quality_flag, least(confidence, cb) confidence from (select *, lag(value) over w before, lag(idx) over w bi, lag(confidence) over w cb from facts where period_type = 'ytd'"
    " window w as (partition by entity, metric_code, idx // 4 order by idx)) where idx - bi = 1",
    FACTS,
)
def p14_ytd_to_quarter(spark, sf_dir):
    return A.ytd_to_quarter(S.facts(spark, sf_dir))


# ---- facts ----


@query("select entity, period, metric_code, value * case when k % 2 = 0 then 1000.0 else 1.0 end economic from facts", FACTS)
def f1_economic_value(spark, sf_dir):
    m = F.when(F.col("k") % 2 == 0, 1000.0).when(F.col("k") % 3 == 0, 0.0)
    return S.facts(spark, sf_dir).select("entity", "period", "metric_code", N.economic_value(F.col("value"), m).alias("economic"))


ELIGIBLE = f"eligible as (select * from facts where (idx between {I_FROM - 1} and {I_TO} or idx = {I_TO - 4}) and quality_flag not in {DROPPED})"


@query("select entity, period, metric_code, value, quality_flag from eligible", FACTS, ELIGIBLE)
def f2_filter_eligible_facts(spark, sf_dir):
    return A.filter_eligible_facts(S.facts(spark, sf_dir), FROM, TO).select("entity", "period", "metric_code", "value", "quality_flag")


@query(f"select entity, period, metric_code, document_id, value from (select *, row_number() over (partition by entity, period, metric_code order by case when k % 4 = 1 and document_id like '%|X' then 1 when quality_flag in {SAFE} then 3 else 2 end desc, document_id) r from sources) where r = 1", FACTS, SOURCES)
def f3_rank_facts(spark, sf_dir):
    method = F.when((F.col("k") % 4 == 1) & F.col("document_id").endswith("|X"), "text_table_fallback")
    return A.rank_facts(S.two_sources(spark, sf_dir).withColumn("extraction_method", method), ["document_id"]).select("entity", "period", "metric_code", "document_id", "value")


@query("select document_id, period, metric_code, confidence, value from (select *, row_number() over (partition by document_id, period, metric_code order by confidence desc, value desc) r from sources) where r = 1", FACTS, SOURCES)
def f4_dedupe_candidates(spark, sf_dir):
    return A.dedupe_candidates(S.two_sources(spark, sf_dir)).select("document_id", "period", "metric_code", "confidence", "value")


PRIORITY = "case source_role when 'financial_statements' then 80 when 'press_release' then 30 else 50 end"


@query(
    "select entity, period, reporting_standard, metric_code, period_type, case when not conflict then fv end as value, case when conflict then 'conflicting_sources' else ff end quality_flag, case when conflict then least(fc, 0.5) else fc end confidence, refs as \"references\", coalesce(sec, '') secondary_references, conflict is_conflict from ("
    " select entity, period, reporting_standard, metric_code, period_type, count(*) filter (p = top) > 1 and max(value) filter (p = top) - min(value) filter (p = top) > 1e-6 conflict, arg_min(value, document_id) filter (p = top) fv, arg_min(quality_flag, document_id) filter (p = top) ff, arg_min(confidence, document_id) filter (p = top) fc,"
    " string_agg(document_id, ',' order by document_id) filter (p = top) refs, string_agg(document_id, ',' order by document_id) filter (p < top) sec from (select *, " + PRIORITY + " p, max(" + PRIORITY + ") over (partition by entity, period, reporting_standard, metric_code, period_type) top from sources) group by all)",
    FACTS, SOURCES,
)
def f5_reconcile_sources(spark, sf_dir):
    return A.reconcile_sources(S.two_sources(spark, sf_dir))


@query(
    "select entity, period, metric_code, period_type, min(value) low, max(value) high, count(*) candidates, string_agg(distinct source_role, ',' order by source_role) source_roles, case when count(distinct source_role) > 1 then 'different_source_roles' else 'different_documents' end likely_reason, case when count(distinct source_role) > 1 then 'prefer_financial_statements' else 'review_documents' end advice from sources group by all having max(value) - min(value) > 1e-6",
    FACTS, SOURCES,
)
def f6_conflict_breakdown(spark, sf_dir):
    return A.conflict_breakdown(S.two_sources(spark, sf_dir))


@query("select entity, period, metric_code, period_type, document_id, value from (select *, row_number() over (partition by entity, period, metric_code, period_type, reporting_standard order by " + PRIORITY + " desc, confidence desc, document_id) r from sources) where r = 1", FACTS, SOURCES)
def f7_primary_existing_fact(spark, sf_dir):
    return A.primary_existing_fact(S.two_sources(spark, sf_dir)).select("entity", "period", "metric_code", "period_type", "document_id", "value")


COMPARED = (
    "c as (select entity, period, metric_code, period_type ct, value cv, source_role cr from sources where document_id like '%|Y'), e as (select entity, period, metric_code, period_type et, value ev, source_role er from sources where document_id like '%|X' and k % 23 <> 0),"
    "compared0 as (select coalesce(c.entity, e.entity) entity, coalesce(c.period, e.period) period, coalesce(c.metric_code, e.metric_code) metric_code, * exclude (entity, period, metric_code) from c full outer join e on c.entity = e.entity and c.period = e.period and c.metric_code = e.metric_code),"
    "compared as (select entity, period, metric_code, ct c_type, cv c_value, cr c_role, et e_type, ev e_value, er e_role, cv is null m1, ev is null m2, coalesce(not abs(cv - ev) <= greatest(1.0, 1e-6 * greatest(abs(cv), abs(ev))), false) v, coalesce(ct <> et, false) t, coalesce(cr <> er, false) r from compared0)"
)
CONFLICTS = "concat_ws(',', case when m1 then 'missing_in_candidates' end, case when m2 then 'missing_in_existing' end, case when v then 'value_conflict' end, case when t then 'period_type_conflict' end, case when r then 'source_role_conflict' end)"


def _compared(spark, sf_dir):
    rows = S.two_sources(spark, sf_dir)
    return A.compare_fact_sets(rows.where(F.col("document_id").endswith("|Y")), rows.where(F.col("document_id").endswith("|X") & (F.col("k") % 23 != 0)))


@query(f"select entity, period, metric_code, c_type, c_value, c_role, e_type, e_value, e_role, {CONFLICTS} conflicts from compared", FACTS, SOURCES, COMPARED)
def f8_compare_fact_sets(spark, sf_dir):
    return _compared(spark, sf_dir).drop("reporting_standard").withColumn("conflicts", F.array_join("conflicts", ","))


@query(
    "select entity, period, metric_code, action, case action when 'block' then 'resolve_conflict' when 'review' then 'manual_review' when 'add' then 'promotion_gate' end required_gate from (select *, case when v or t then 'block' when m2 then 'add' when m1 then 'skip' when r then 'review' else 'corroborate' end as action from compared)",
    FACTS, SOURCES, COMPARED,
)
def f9_persist_plan(spark, sf_dir):
    return A.persist_plan(_compared(spark, sf_dir)).select("entity", "period", "metric_code", "action", "required_gate")


BUCKETS = "buckets as (select entity, case when nation % 4 = 2 or k % 5 = 0 then 'text_table_fallback_semantic_gate' when k % 7 = 0 then 'grid' else 'unknown' end bucket, count(*) candidates from sources where document_id like '%|Y' group by 1, 2)"


def _buckets(spark, sf_dir):
    k = F.col("k")
    rows = S.two_sources(spark, sf_dir).where(F.col("document_id").endswith("|Y"))
    kind = F.when((F.col("nation") % 4 == 2) | (k % 5 == 0), A.FALLBACK_BUCKET)
    return A.trust_buckets(rows.select("entity", kind.alias("fact_source_kind"), F.when(k % 7 == 0, "grid").otherwise("").alias("extraction_method")))


@query("select * from buckets", FACTS, SOURCES, BUCKETS)
def f10_trust_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir)


@query(
    "select *, case eligibility when 'blocked' then 'resolve_conflicts' when 'needs_review' then 'review_fallback_bucket' else 'run_gated_persist' end next_action from (select entity, hard_conflicts, soft_conflicts, candidates, coalesce(f, 0) fallback, case when hard_conflicts > 0 then 'blocked'"
    " when candidates = 0 or soft_conflicts > 0 or 2 * coalesce(f, 0) > coalesce(n, 0) then 'needs_review' else 'eligible' end eligibility from (select entity, count(*) filter (v or t) hard_conflicts, count(*) filter (r) soft_conflicts, count(c_value) candidates from compared group by entity)"
    " left join (select entity, coalesce(sum(candidates) filter (bucket = 'text_table_fallback_semantic_gate'), 0)::bigint f, sum(candidates)::bigint n from buckets group by 1) using (entity))",
    FACTS, SOURCES, COMPARED, BUCKETS,
)
def f10_persist_eligibility(spark, sf_dir):
    return A.persist_eligibility(_compared(spark, sf_dir), _buckets(spark, sf_dir))


@query(
    "select entity, period, coalesce(case when i % 3 = 0 then total_debt end, case when i % 3 = 1 then current_liabilities + total_equity end, case when i % 3 = 2 then current_assets + total_equity end) derived_total_debt,"
    " case when i % 3 = 0 and total_debt is not null then 'explicit_total_debt' when i % 3 = 1 and current_liabilities + total_equity is not null then 'short_including_current + long_net' when i % 3 = 2 and current_assets + total_equity is not null then 'short_excluding_current + long_gross' end derivation from fw",
    FACTS, WIDE,
)
def f11_derive_total_debt(spark, sf_dir):
    kind = P.period_index(F.col("period")) % 3
    wide = M.wide_facts(S.facts(spark, sf_dir)).select(
        "entity", "period", F.when(kind == 0, F.col("total_debt")).alias("total_debt"), F.when(kind == 1, F.col("current_liabilities")).alias("short_term_debt_including_current_portion"), F.when(kind == 1, F.col("total_equity")).alias("long_term_debt_net_of_current_portion"),
        F.when(kind == 2, F.col("current_assets")).alias("total_short_term_debt"), F.when(kind == 2, F.col("total_equity")).alias("gross_long_term_debt"),
    )
    return A.derive_total_debt(wide).select("entity", "period", "derived_total_debt", "derivation")


KEYS_SQL = ", ".join(f"('{c}')" for c in A.KEY_FACTS)


@query(
    f"select g.entity, g.period, g.metric_code, f.value, f.quality_flag, case when f.quality_flag is null then 'missing' when f.quality_flag = 'low_confidence_parse' then 'low_confidence' else 'extracted' end status from (select entity, (i // 4) || 'Q' || (i % 4 + 1) period, code metric_code from (select distinct entity from facts), (select unnest(range({I_FROM}, {I_TO + 1})) i), (values {KEYS_SQL}) v(code)) g"
    " left join facts f on f.entity = g.entity and f.period = g.period and f.metric_code = g.metric_code",
    FACTS,
)
def f18_fact_coverage_grid(spark, sf_dir):
    return A.fact_coverage_grid(S.facts(spark, sf_dir), FROM, TO)


@query(f"select entity, code metric_code from (select distinct entity from facts) e, (values {KEYS_SQL}) v(code) where not exists (select 1 from facts f where f.entity = e.entity and f.metric_code = code)", FACTS)
def f19_missing_expected_facts(spark, sf_dir):
    return A.missing_expected_facts(S.facts(spark, sf_dir))


SUMMARY = (
    "summary as (select entity, count(*) facts, count(*) filter (confidence >= 0.8) high_confidence, count(*) filter (quality_flag = 'low_confidence_parse') low_confidence, count(*) filter (quality_flag = 'derived') derived, count(*) filter (period_type = 'balance_sheet_snapshot') snapshots,"
    " count(*) filter (period_type = 'ytd') ytd, count(*) filter (period_type = 'annual') annual, count(distinct period) periods from facts group by entity)"
)


@query("select * from summary", FACTS, SUMMARY)
def f20_fact_summary(spark, sf_dir):
    return A.fact_summary(S.facts(spark, sf_dir))


@query("select entity, facts, low_confidence, case when facts = 0 then 'FAIL' when low_confidence > 0 or high_confidence < facts then 'PARTIAL' else 'PASS' end status from summary", FACTS, SUMMARY)
def f21_extraction_status(spark, sf_dir):
    return A.extraction_status(A.fact_summary(S.facts(spark, sf_dir)))


@query(
    "select entity, canonical, confident, conflicts, round(ratio, 4) confident_ratio, round(coverage, 4) key_coverage, round(least(canonical / 10, 1.0) * 0.25 + ratio * 0.25 + coverage * 0.25 + 0.15 + case when canonical > 0 then 0.10 else 0.0 end, 4) score, case when ratio < 0.8 then 'low_confidence_ratio' else '' end blockers,"
    " case when ratio < 0.8 then 'fail' when coverage < 1 or canonical < 10 then 'partial' else 'pass' end status from (select *, confident / canonical ratio, found / (periods * 12) coverage from (select entity, count(*) filter (quality_flag <> 'low_confidence_parse') canonical, count(*) filter (quality_flag in ('exact', 'derived') and confidence >= 0.7) confident, cast(0 as bigint) conflicts, count(distinct period) periods,"
    " count(distinct case when quality_flag <> 'low_confidence_parse' then period || metric_code end) found from facts group by entity))",
    FACTS,
)
def f22_parser_quality(spark, sf_dir):
    return A.parser_quality(S.facts(spark, sf_dir))


CHECKS = (
    "checks as (select entity, period, 'current_assets_lte_total_assets' as \"check\", current_assets as \"left\", total_assets as \"right\", current_assets <= total_assets + 0.01 passed from fw where current_assets is not null and total_assets is not null"
    " union all select entity, period, 'total_debt_non_negative', total_debt, 0.0, total_debt >= -0.01 from fw where total_debt is not null union all select entity, period, 'cash_and_equivalents_non_negative', cash_and_equivalents, 0.0, cash_and_equivalents >= -0.01 from fw where cash_and_equivalents is not null)"
)


@query("select * from checks", FACTS, WIDE, CHECKS)
def f23_consistency_checks(spark, sf_dir):
    return A.consistency_checks(S.facts(spark, sf_dir))


@query("select entity, count(*) filter (passed) passed_checks, count(*) filter (not passed) failed_checks, cast(least(1.0, round(count(*) filter (not passed) * 0.05, 4)) as double) penalty from checks group by entity", FACTS, WIDE, CHECKS)
def f23_consistency_penalty(spark, sf_dir):
    return A.consistency_penalty(A.consistency_checks(S.facts(spark, sf_dir)))


@query("select *, high - low <= greatest(0.01, abs(high) * 0.001) passed from (select entity, period, metric_code, count(*) copies, min(value) low, max(value) high from sources group by all having count(*) > 1)", FACTS, SOURCES)
def f23_duplicate_spread(spark, sf_dir):
    return A.duplicate_spread(S.two_sources(spark, sf_dir))


@query(
    "select entity, place, period, metric_code, value, stage from (select *, row_number() over (partition by entity order by stage, period, metric_code, value) place from (select *, case when cat < 2 and row_number() over (partition by entity, cat, period order by metric_code, value) = 1 then cat else 2 end stage from"
    " (select *, case when metric_code in ('revenue','net_income') then 0 when metric_code in ('total_assets','total_equity') then 1 else 2 end cat from facts))) where place <= 20",
    FACTS,
)
def f24_review_pack(spark, sf_dir):
    return A.review_pack(S.facts(spark, sf_dir), {"income": ("revenue", "net_income"), "balance": ("total_assets", "total_equity")}, 20)


GOLDEN = (
    "golden as (select entity, period, metric_code, expected, actual, coalesce(abs(actual - expected) <= greatest(0.01, abs(expected) * 0.01), false) passed, case when actual is null then 'missing_actual' when not abs(actual - expected) <= greatest(0.01, abs(expected) * 0.01) then 'value_outside_tolerance' end reason from"
    " (select x.entity, x.period, x.metric_code, case when x.k % 7 = 0 then x.value * 1.05 else x.value end expected, y.value actual from facts x left join (select * from facts where k % 29 <> 0) y on x.entity = y.entity and x.period = y.period and x.metric_code = y.metric_code))"
)


def _golden(spark, sf_dir):
    base = S.facts(spark, sf_dir)
    return A.verify_golden(base.select("entity", "period", "metric_code", F.when(F.col("k") % 7 == 0, F.col("value") * 1.05).otherwise(F.col("value")).alias("expected")), base.where(F.col("k") % 29 != 0))


@query("select * from golden", FACTS, GOLDEN)
def f25_verify_golden(spark, sf_dir):
    return _golden(spark, sf_dir)


@query("select entity, count(*) checks, count(*) filter (passed) passed_checks, round(avg(case when passed then 1.0 else 0.0 end), 6) accuracy, case when bool_and(passed) then 'PASS' else 'FAIL' end status from golden group by entity", FACTS, GOLDEN)
def f25_golden_accuracy(spark, sf_dir):
    return A.golden_accuracy(_golden(spark, sf_dir))


@query("select entity, period, metric_code, period_type, case when k % 4 <> 0 then value end actual, case when k % 3 <> 0 then value + 1 end expected, case when k % 3 = 0 then 'added' when k % 4 = 0 then 'unchanged' else 'filled' end as action from facts where k % 3 <> 0 or k % 4 <> 0", FACTS)
def f26_sync_golden(spark, sf_dir):
    base = S.facts(spark, sf_dir)
    old = base.where(F.col("k") % 3 != 0).select("entity", "period", "metric_code", "period_type", F.lit(None).cast("double").alias("actual"), (F.col("value") + 1).alias("expected"))
    return A.sync_golden(old, base.where(F.col("k") % 4 != 0).select("entity", "period", "metric_code", "period_type", F.col("value").alias("actual")))


@query("select doc_id, sha256(text) content_hash, first_id, first_id <> doc_id is_duplicate from (select doc_id, text, least(case when text is not null then min(doc_id) over (partition by text) else doc_id end, case when doc_id % 3 <> 0 then min(doc_id) over (partition by lang, case when doc_id % 3 <> 0 then source || doc_id // 40 end) end) first_id from documents)")
def f31_dedupe_documents(spark, sf_dir):
    url = F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.floor(F.col("doc_id") / 40)))
    return A.dedupe_documents(S.table(spark, sf_dir, "documents").withColumns({"period": F.col("lang"), "url": url}))


# ---- metrics ----

HISTORY = (
    "fh as (select f.*, p.revenue prev_revenue, p.total_equity prev_total_equity, p.total_assets prev_total_assets, coalesce((f.total_equity + p.total_equity) / 2, f.total_equity) average_equity, coalesce((f.total_assets + p.total_assets) / 2, f.total_assets) average_assets from (select *,"
    " case when count(*) over w = 4 and count(net_income) over w = 4 then sum(net_income) over w end net_income_ttm, case when count(*) over w = 4 and count(ebitda) over w = 4 then sum(ebitda) over w end ebitda_ttm from fw window w as (partition by entity order by i rows between 3 preceding and current row)) f"
    " left join fw p on p.entity = f.entity and p.i = f.i - 1)"
)


def _engine_sql() -> str:
    parts = []
    for code, (kind, num, den) in M.FORMULAS.items():
        if num is None:
            value, fault = "cast(null as double)", "'market valuation input unavailable'" if code in M.VALUATION else "'formula unavailable'"
        elif den is None:
            value, fault = num, f"case when {num} is null then 'missing input' end"
        else:
            value, fault = f"({num}) / nullif({den}, 0)", f"case when {num} is null or {den} is null then 'missing input' when {den} = 0 then 'denominator_zero' end"
        negative = f"case when {value} is not null and {den} < 0 then 'negative denominator' end" if den else "null"
        current = {"roe": "case when total_equity is not null and prev_total_equity is null then 'average unavailable, current used' end", "roa": "case when total_assets is not null and prev_total_assets is null then 'average unavailable, current used' end"}.get(code, "null")
        parts.append(f"select entity, period, '{code}' metric_code, {value} as value, '{kind}' output_format, case when {value} is null then 'missing' when {current} is not null then 'derived' else 'exact' end quality_flag, concat_ws('; ', {current}, {fault}, {negative}) warnings from fh")
    return "engine as (" + " union all ".join(parts) + ")"


ENGINE = _engine_sql()


def _engine(spark, sf_dir):
    return M.metrics_engine(S.facts(spark, sf_dir))


@query("select entity, period, metric_code, round(value, 6) as value, output_format, quality_flag, warnings from engine", FACTS, WIDE, HISTORY, ENGINE)
def m1_metrics_engine(spark, sf_dir):
    return _engine(spark, sf_dir).withColumn("value", F.round("value", 6)).drop("display_value")


@query(
    "select entity, period, metric_code, case output_format when 'percent' then printf('%.1f%%', round(value * 100, 1) + 0.0) when 'currency' then format('{:,}', cast(round(value, 0) as bigint)) || ' RUB' else printf('%.2fx', round(value, 2) + 0.0) end display_value from engine",
    FACTS, WIDE, HISTORY, ENGINE,
)
def m8_display_value(spark, sf_dir):
    return _engine(spark, sf_dir).select("entity", "period", "metric_code", "display_value")


@query("select f.entity, f.period, round((f.revenue - p.revenue) / nullif(p.revenue, 0), 6) growth from fw f left join fw p on p.entity = f.entity and p.i = f.i - 1", FACTS, WIDE)
def m2_quarter_growth(spark, sf_dir):
    return M.quarter_growth(M.wide_facts(S.facts(spark, sf_dir))).withColumn("growth", F.round("growth", 6))


@query(
    f"select g.entity, (g.i // 4) || 'Q' || (g.i % 4 + 1) period, round((select case when count(*) = 4 and count(x) = 4 then sum(x) end from (select net_income x from fw where fw.entity = g.entity and fw.i <= g.i order by fw.i desc limit 4)), 4) ttm from (select entity, i from (select distinct entity from facts), (select unnest(range({I_FROM}, {I_TO + 40})) i)) g",
    FACTS, WIDE,
)
def m3_ttm_sum(spark, sf_dir):
    last = I_TO + 39
    return M.ttm_sum(M.wide_facts(S.facts(spark, sf_dir)), "net_income", FROM, f"{last // 4}Q{last % 4 + 1}").withColumn("ttm", F.round("ttm", 4))


@query("select f.entity, f.period, coalesce((f.total_equity + p.total_equity) / 2, f.total_equity) average, case when f.total_equity is not null then case when p.total_equity is null then 'derived' else 'exact' end end quality_flag from fw f left join fw p on p.entity = f.entity and p.i = f.i - 1", FACTS, WIDE)
def m4_average_or_current(spark, sf_dir):
    return M.average_or_current(M.wide_facts(S.facts(spark, sf_dir)), "total_equity")


def _strict_sql() -> str:
    """One select a metric, from the eligible facts as cells v (value), t (type), q (flag) of this, the last and last year's quarter."""
    c = lambda n: f"{n}_v"
    out = []

    def add(code, tests, num, den):
        if code in M.BANK_UNSUPPORTED:
            tests = [("bank", "unsupported_by_sector_policy", "'industrial_metric_not_applicable_to_bank'"), *tests]
        tests = [*tests, (f"{den} = 0", "blocked_by_zero_denominator", "'division_by_zero'")]
        status = "case " + " ".join(f"when {t} then '{s}'" for t, s, _ in tests) + " else 'calculated' end"
        reason = "case " + " ".join(f"when {t} then {r}" for t, _, r in tests) + " end"
        out.append(f"select entity, (i // 4) || 'Q' || (i % 4 + 1) period, '{code}' metric_code, case when {status} = 'calculated' then ({num}) / ({den}) end as value, {status} status, {reason} reason from sg")

    for code, base in (("roe", "total_equity"), ("roa", "total_assets")):
        prior = f"(case when net_income_t = 'annual' and i % 4 = 3 and y_{base}_v is not null then y_{base}_v else q_{base}_v end)"
        add(code, [("net_income_v is null", "missing", "'missing_inputs'"), (f"{base}_v is null", "missing", "'missing_inputs'"), (f"{prior} is null", "missing", "'missing_average_base_snapshot'")], c("net_income"), f"(({base}_v + {prior}) / 2)")
    two = lambda code, a, b, more=(): add(code, [(f"{a}_v is null", "missing", "'missing_inputs'"), (f"{b}_v is null", "missing", "'missing_inputs'"), *more], c(a), c(b))
    two("debt_to_equity", "total_debt", "total_equity", [("total_debt_q = 'derived'", "missing", "'explicit_total_debt_missing_no_component_derivation'")])
    two("current_ratio", "current_assets", "current_liabilities")
    fcf = "(operating_cash_flow_v + case when capex_v < 0 then capex_v else -capex_v end)"
    gone = [("operating_cash_flow_v is null or capex_v is null", "missing", "'missing_inputs'")]
    add("fcf", gone, fcf, "1.0")
    add("fcf_margin", [*gone, ("revenue_v is null", "missing", "'missing_inputs'")], fcf, "revenue_v")
    add("ebitda_margin", [("ebitda_v is null", "unsupported_by_policy", "'explicit_ebitda_missing_no_proxy_allowed'"), ("revenue_v is null", "missing", "'missing_inputs'")], "ebitda_v", "revenue_v")
    two("operating_margin", "operating_profit", "revenue")
    two("net_margin", "net_income", "revenue")
    add("revenue_growth", [("revenue_v is null", "missing", "'missing_inputs'"), ("q_revenue_v is null", "missing", "'previous_comparable_revenue_missing'"), ("revenue_t <> q_revenue_t", "blocked_by_period_semantics", "'incomparable_revenue_period_type'")], "revenue_v - q_revenue_v", "q_revenue_v")
    cells = ", ".join(f"max(case when metric_code = '{m}' then value end) {m}_v, max(case when metric_code = '{m}' then period_type end) {m}_t, max(case when metric_code = '{m}' then quality_flag end) {m}_q" for m in M.CODES)
    return (
        f"se as (select entity, idx i, {cells} from eligible group by entity, idx), sg as (select g.entity, g.i, se.* exclude (entity, i), q.revenue_v q_revenue_v, q.revenue_t q_revenue_t, q.total_equity_v q_total_equity_v, q.total_assets_v q_total_assets_v, y.total_equity_v y_total_equity_v, y.total_assets_v y_total_assets_v, coalesce(r.is_bank, false) bank"
        f" from (select entity, i from (select distinct entity from eligible), (select unnest(range({I_FROM}, {I_TO + 1})) i)) g left join se on se.entity = g.entity and se.i = g.i left join se q on q.entity = g.entity and q.i = g.i - 1 left join se y on y.entity = g.entity and y.i = g.i - 4 left join registry r on r.entity = g.entity), strict as (" + " union all ".join(out) + ")"
    )


STRICT = _strict_sql()


def _strict(spark, sf_dir):
    eligible = A.filter_eligible_facts(S.facts(spark, sf_dir), FROM, TO)
    return M.strict_ratios(eligible, FROM, TO, S.registry(spark, sf_dir).where("is_bank"))


@query("select entity, period, metric_code, round(value, 6) as value, status, reason from strict", FACTS, ELIGIBLE, REGISTRY, STRICT)
def m9_strict_ratios(spark, sf_dir):
    return _strict(spark, sf_dir).withColumn("value", F.round("value", 6))


@query(
    "select entity, count(*) filter (status = 'calculated') calculated_count, count(*) filter (status = 'missing') missing_count, count(*) filter (status like 'unsupported%') unsupported_count, count(*) filter (status like 'blocked%') blocked_count, coalesce(string_agg(distinct reason, ',' order by reason) filter (status like 'blocked%'), '') blockers from strict group by entity",
    FACTS, ELIGIBLE, REGISTRY, STRICT,
)
def m16_status_summary(spark, sf_dir):
    return M.status_summary(_strict(spark, sf_dir))


@query(
    "select entity, period, 'equity_to_assets' metric_code, round(total_equity / nullif(total_assets, 0), 6) as value, case when total_equity is null or total_assets is null then 'missing' when total_assets = 0 then 'blocked_by_zero_denominator' else 'calculated' end status from fw union all"
    " select entity, period, 'net_margin_like', round(net_income / nullif(revenue, 0), 6), case when net_income is null or revenue is null then 'missing' when revenue = 0 then 'blocked_by_zero_denominator' else 'calculated' end from fw union all"
    " select entity, period, 'loan_to_deposit', round(current_assets / nullif(current_liabilities, 0), 6), case when current_assets is null or current_liabilities is null then 'missing' when current_liabilities = 0 then 'blocked_by_zero_denominator' else 'calculated' end from fw union all"
    " select entity, period, 'cost_to_income', null, 'missing' from fw union all select entity, period, 'net_interest_margin', null, 'missing' from fw",
    FACTS, WIDE,
)
def m14_bank_ratios(spark, sf_dir):
    names = F.create_map(*map(F.lit, ("revenue", "operating_income", "current_assets", "loans_to_customers", "current_liabilities", "customer_accounts")))
    facts = S.facts(spark, sf_dir).withColumn("metric_code", F.coalesce(F.try_element_at(names, F.col("metric_code")), F.col("metric_code")))
    return M.bank_ratios(facts).withColumn("value", F.round("value", 6))


def _audit_sql() -> str:
    pairs = ", ".join(f"('{c}', '{i}')" for c, names in M.AUDIT_INPUTS.items() for i in names)
    return (
        f"audited as (select entity, period, metric_code, value, case when metric_code in ('pe_ratio','ev_to_ebitda','dividend_yield') then case when value is null then 'missing' else 'invalid' end when value is null or quality_flag = 'missing' then 'missing' when conflict then 'invalid' when low then 'questionable'"
        " when metric_code in ('ebitda_margin','operating_margin','net_margin','fcf','fcf_margin') then case when types = 1 then 'valid' else 'invalid' end when metric_code = 'revenue_growth' and rt in ('ytd','annual') then 'questionable' when metric_code in ('roe','roa') then 'questionable'"
        " when metric_code in ('current_ratio','debt_to_equity') then case when snap then 'valid' else 'invalid' end when metric_code = 'net_debt_to_ebitda' then 'missing' else 'valid' end status, derived from (select e.entity, e.period, e.metric_code, any_value(e.value) as value, any_value(e.quality_flag) quality_flag,"
        " coalesce(bool_or(f.quality_flag = 'conflicting_sources'), false) conflict, coalesce(bool_or(f.quality_flag = 'low_confidence_parse'), false) low, coalesce(bool_or(f.quality_flag = 'derived'), false) derived, count(distinct f.period_type) types, coalesce(bool_and(f.period_type = 'balance_sheet_snapshot'), true) snap, max(case when n.input = 'revenue' then f.period_type end) rt"
        f" from engine e left join (values {pairs}) n(code, input) on n.code = e.metric_code left join facts f on f.entity = e.entity and f.period = e.period and f.metric_code = n.input group by e.entity, e.period, e.metric_code))"
    )


AUDIT = _audit_sql()
AUDITED = (FACTS, WIDE, HISTORY, ENGINE, AUDIT)


def _audited(spark, sf_dir):
    return M.audit_metrics(_engine(spark, sf_dir), S.facts(spark, sf_dir))


@query("select entity, period, metric_code, round(value, 6) as value, status, derived from audited", *AUDITED)
def m17_audit_metrics(spark, sf_dir):
    return _audited(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("select entity, count(*) filter (status = 'valid') metrics_valid_count, count(*) filter (status = 'questionable') metrics_questionable_count, count(*) filter (status = 'invalid') metrics_invalid_count, count(*) filter (status = 'missing') metrics_missing_count from audited group by entity", *AUDITED)
def m19_metric_status_counts(spark, sf_dir):
    return M.metric_status_counts(_audited(spark, sf_dir))


@query(
    "select metric_code, v periods_valid, q periods_questionable, m periods_missing, x periods_invalid, case when metric_code in ('pe_ratio','ev_to_ebitda','dividend_yield') then 'requires_market_data' when metric_code in ('ebitda_margin','net_debt_to_ebitda') then 'requires_explicit_disclosure' when metric_code in ('roe','roa') and q > 0 then 'needs_methodology_decision'"
    " when metric_code = 'revenue_growth' and q > 0 then 'usable_with_warning' when x > 0 then 'needs_methodology_decision' when v > 0 and m = 0 and q = 0 then case when d then 'usable_with_warning' else 'usable' end when v > 0 then 'usable_with_warning' else 'not_available' end decision"
    " from (select metric_code, count(*) filter (status = 'valid') v, count(*) filter (status = 'questionable') q, count(*) filter (status = 'missing') m, count(*) filter (status = 'invalid') x, bool_or(derived) d from audited group by metric_code)",
    *AUDITED,
)
def m20_metric_decisions(spark, sf_dir):
    return M.metric_decisions(_audited(spark, sf_dir))


@query("select entity, period, metric_code, case when value is null then 'missing' when quality_flag = 'derived' then 'derived' else 'calculated' end status from engine where metric_code in (" + ", ".join(f"'{c}'" for c in M.STRICT_CODES) + ")", FACTS, WIDE, HISTORY, ENGINE)
def m25_metric_coverage_grid(spark, sf_dir):
    return M.metric_coverage_grid(_engine(spark, sf_dir))


AUDIT_LIST = "inputs(code, input) as (values " + ", ".join(f"('{c}', '{i}')" for c, names in M.AUDIT_INPUTS.items() for i in names) + ")"
GAPS = (
    "required as (select code, list_sort(list(input)) req from inputs group by code),"
    "have as (select entity, period, list(distinct metric_code) h, coalesce(list(distinct metric_code) filter (k % 7 = 0), []) loose from facts group by 1, 2),"
    "gaps as (select entity, period, metric_code, case when status = 'valid' then 'calculated' else status end status, list_filter(coalesce(req, []), lambda x: list_contains(coalesce(h, []), x)) available,"
    " list_filter(coalesce(req, []), lambda x: not list_contains(coalesce(h, []), x)) missing, coalesce(loose, []) loose from audited left join required on code = metric_code left join have using (entity, period))"
)
MATRIX = (
    "mates as (select sector grp, entity from registry), cells as ("
    "select grp, c.period, c.metric_code, m.entity, coalesce(case g.status when 'calculated' then 'valid' else g.status end, 'missing') status, coalesce(g.missing, []) missing"
    " from (select distinct grp, period, metric_code from gaps join mates using (entity)) c join mates m using (grp) left join gaps g on g.entity = m.entity and g.period = c.period and g.metric_code = c.metric_code),"
    "matrix as (select grp, period, metric_code, count(*) filter (status = 'valid') v, count(*) filter (status = 'missing') gone from cells group by all having count(*) filter (status = 'valid') < count(*))"
)


def _gap_rows(spark, sf_dir):
    return H.metric_input_audit(_audited(spark, sf_dir), S.facts(spark, sf_dir).withColumn("trace", F.when(F.col("k") % 7 != 0, F.concat(F.lit("p"), F.col("k").cast("string")))))


def _matrix(spark, sf_dir):
    return H.gap_matrix(_gap_rows(spark, sf_dir), S.registry(spark, sf_dir).select(F.col("sector").alias("group"), "entity"))


@query(
    "select grp as \"group\", period, metric_code, (select string_agg(entity || '=' || status, ',' order by entity) from cells c where c.grp = m.grp and c.period = m.period and c.metric_code = m.metric_code) statuses,"
    " coalesce((select string_agg(entity || ':' || array_to_string(missing, '+'), ',' order by entity) from cells c where c.grp = m.grp and c.period = m.period and c.metric_code = m.metric_code and status = 'missing'), '') missing_inputs,"
    " case when metric_code in ('pe_ratio', 'ev_to_ebitda', 'dividend_yield') then 'valuation_module' when v > 0 and gone > 0 then 'high' when gone > 0 then 'medium' else 'low' end impact from matrix m",
    *AUDITED, REGISTRY, AUDIT_LIST, GAPS, MATRIX,
)
def m26_gap_matrix(spark, sf_dir):
    """Peer groups are the sectors of the registry."""
    pairs = lambda c, value: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], value(e["value"]))), ",").alias(c)
    shown = _matrix(spark, sf_dir).withColumn("missing_inputs", F.transform_values("missing_inputs", lambda k, v: F.array_join(v, "+")))
    return shown.select("group", "period", "metric_code", pairs("statuses", lambda v: F.concat(F.lit("="), v)), pairs("missing_inputs", lambda v: F.concat(F.lit(":"), v)), "impact")


PRIORITIES = (
    "lacks as (select grp, entity, period, metric_code, unnest(missing) fact from cells semi join matrix using (grp, period, metric_code) where status = 'missing' and metric_code not in ('pe_ratio', 'ev_to_ebitda', 'dividend_yield')),"
    "mated as (select l.*, c.entity mate from lacks l left join cells c on c.grp = l.grp and c.period = l.period and c.metric_code = l.metric_code and c.status = 'valid'),"
    "priorities as (select *, 4 * metrics + 2 * periods + 3 * pairs + case when fact in ('operating_cash_flow', 'capex') then 2 else 5 end score from (select entity, fact, count(distinct metric_code) metrics, count(distinct period) periods, count(distinct mate) pairs,"
    " string_agg(distinct metric_code, ',' order by metric_code) unlocks from mated where fact <> 'ebitda' group by 1, 2))"
)
PRIORITY_PARTS = (*AUDITED, REGISTRY, AUDIT_LIST, GAPS, MATRIX, PRIORITIES)


@query("select entity, fact, metrics, periods, pairs, unlocks, score from priorities", *PRIORITY_PARTS)
def m27_fact_priorities(spark, sf_dir):
    return H.fact_priorities(_matrix(spark, sf_dir))


@query("select *, row_number() over (partition by entity order by score desc, unlocks) place from (select entity, unlocks, string_agg(fact, ',' order by fact) facts, sum(score)::bigint score from priorities group by entity, unlocks)", *PRIORITY_PARTS)
def m28_unlock_plan(spark, sf_dir):
    return M.unlock_plan(H.fact_priorities(_matrix(spark, sf_dir)))


DELTA = "o as (select entity, period, metric_code, value ov from facts where k % 5 <> 0), n as (select entity, period, metric_code, case when k % 7 = 0 then value * 1.5 else value end nv from facts where k % 6 <> 0)"


@query(
    "select entity, period, metric_code, ov old_value, nv new_value, case when ov is null then 'added' when nv is null then 'removed' when ov = nv then 'unchanged' else 'changed' end kind, nv - ov absolute_change, (nv - ov) / nullif(abs(ov), 0) relative_change from o full outer join n using (entity, period, metric_code)",
    FACTS, DELTA,
)
def m30_result_delta(spark, sf_dir):
    base = S.facts(spark, sf_dir)
    return M.result_delta(base.where(F.col("k") % 5 != 0), base.where(F.col("k") % 6 != 0).withColumn("value", F.when(F.col("k") % 7 == 0, F.col("value") * 1.5).otherwise(F.col("value"))))


@query(
    "select entity, added, removed, changed, unchanged, array_to_string(list_sort(list_filter(coalesce(np, []), lambda x: not list_contains(coalesce(op, []), x))), ',') added_periods, array_to_string(list_sort(list_filter(coalesce(nw, []), lambda x: not list_contains(coalesce(ow, []), x))), ',') new_warnings,"
    " array_to_string(list_sort(list_filter(coalesce(ow, []), lambda x: not list_contains(coalesce(nw, []), x))), ',') resolved_warnings from (select entity, count(*) filter (ov is null) added, count(*) filter (nv is null) removed, count(*) filter (ov <> nv) changed, count(*) filter (ov = nv) unchanged"
    " from o full outer join n using (entity, period, metric_code) group by 1) left join (select entity, list(distinct period) op from o where period < '1999Q1' group by 1) using (entity) left join (select entity, list(distinct period) np from n group by 1) using (entity)"
    " left join (select entity, list(distinct quality_flag || ':' || metric_code) ow from facts where k % 5 <> 0 and k % 3 = 0 group by 1) using (entity) left join (select entity, list(distinct quality_flag || ':' || metric_code) nw from facts where k % 6 <> 0 and k % 4 = 0 group by 1) using (entity)",
    FACTS,
    "o as (select entity, period, metric_code, value ov from facts where k % 5 <> 0 and period < '1999Q1'), n as (select entity, period, metric_code, case when k % 7 = 0 then value * 1.5 else value end nv from facts where k % 6 <> 0)",
)
def m30_delta_summary(spark, sf_dir):
    base, k = S.facts(spark, sf_dir), F.col("k")
    new = base.where(k % 6 != 0).withColumn("value", F.when(k % 7 == 0, F.col("value") * 1.5).otherwise(F.col("value")))
    said = lambda test: base.where(test).select("entity", F.concat_ws(":", "quality_flag", "metric_code").alias("warning"))
    found = M.delta_summary(base.where((k % 5 != 0) & (F.col("period") < "1999Q1")), new, said((k % 5 != 0) & (k % 3 == 0)), said((k % 6 != 0) & (k % 4 == 0)))
    return found.select("entity", "added", "removed", "changed", "unchanged", *[F.array_join(c, ",").alias(c) for c in ("added_periods", "new_warnings", "resolved_warnings")])


@query("select entity, period, metric_code, a.value a_value, a.quality_flag a_flag, b.value b_value, b.quality_flag b_flag, b.value - a.value difference from (select * from facts where k % 5 <> 0) a full outer join (select * from facts where k % 6 <> 0) b using (entity, period, metric_code)", FACTS)
def m31_compare_runs(spark, sf_dir):
    base = S.facts(spark, sf_dir)
    return M.compare_runs(base.where(F.col("k") % 5 != 0), base.where(F.col("k") % 6 != 0))


# ---- market ----

IND = (
    "c0 as (select *, close - lag(close) over w delta, close / lag(close) over w - 1 daily_return, row_number() over w n, max(close) over (w rows unbounded preceding) peak from candles where close is not null window w as (partition by ticker order by date)),"
    "c1 as (select *, case when n >= 21 then stddev_samp(daily_return) over w20 * sqrt(252) end volatility_20d, case when n >= 61 then stddev_samp(daily_return) over w60 * sqrt(252) end volatility_60d, case when n >= 20 then avg(close) over w20 end ma_20, case when n >= 50 then avg(close) over w50 end ma_50, case when n >= 200 then avg(close) over w200 end ma_200,"
    " avg(greatest(delta, 0.0)) over w14 gain, avg(greatest(-delta, 0.0)) over w14 loss, min(close) over w20 support_level, max(close) over w20 resistance_level, close / peak - 1 dd from c0 window w14 as (partition by ticker order by date rows 13 preceding), w20 as (partition by ticker order by date rows 19 preceding), w50 as (partition by ticker order by date rows 49 preceding), w60 as (partition by ticker order by date rows 59 preceding), w200 as (partition by ticker order by date rows 199 preceding)),"
    "ind as (select *, case when n >= 15 then case when loss = 0 then 100.0 else 100 - 100 / (1 + gain / loss) end end rsi_14, min(dd) over (partition by ticker order by date rows unbounded preceding) max_drawdown from c1)"
)
NAMES = tuple(K.REQUIREMENTS)


@query("select ticker, date, round(daily_return, 6) daily_return from ind", CANDLES, IND)
def k1_returns(spark, sf_dir):
    return K.indicators(S.candles(spark, sf_dir)).select("ticker", "date", *_r("daily_return"))


@query("select ticker, date, round(volatility_20d, 6) volatility_20d, round(volatility_60d, 6) volatility_60d from ind", CANDLES, IND)
def k2_volatility(spark, sf_dir):
    return K.indicators(S.candles(spark, sf_dir)).select("ticker", "date", *_r("volatility_20d", "volatility_60d"))


@query("select ticker, date, round(ma_20, 6) ma_20, round(ma_50, 6) ma_50, round(ma_200, 6) ma_200 from ind", CANDLES, IND)
def k3_moving_average(spark, sf_dir):
    return K.indicators(S.candles(spark, sf_dir)).select("ticker", "date", *_r("ma_20", "ma_50", "ma_200"))


@query("select ticker, date, round(rsi_14, 6) rsi_14 from ind", CANDLES, IND)
def k4_rsi(spark, sf_dir):
    return K.indicators(S.candles(spark, sf_dir)).select("ticker", "date", *_r("rsi_14"))


@query("select ticker, round(avg(volume), 6) average_daily_volume, round(avg(value), 6) average_daily_turnover from (select *, row_number() over (partition by ticker order by date desc) r from candles) where r <= 20 group by ticker", CANDLES)
def k5_average_volume_turnover(spark, sf_dir):
    return K.average_volume_turnover(S.candles(spark, sf_dir)).select("ticker", *_r("average_daily_volume", "average_daily_turnover"))


@query("select ticker, date, round(max_drawdown, 6) max_drawdown from ind", CANDLES, IND)
def k6_max_drawdown(spark, sf_dir):
    return K.indicators(S.candles(spark, sf_dir)).select("ticker", "date", *_r("max_drawdown"))


@query("select ticker, date, support_level, resistance_level from ind", CANDLES, IND)
def k7_support_resistance(spark, sf_dir):
    return K.indicators(S.candles(spark, sf_dir)).select("ticker", "date", "support_level", "resistance_level")


ALIGN = (
    "align as (select ticker, actual_from, actual_to, covered_days, round(covered_days / 1096, 6) coverage_ratio, inside and covered_days > 0 aligned, case when inside and covered_days > 0 then 'market_cache' else 'market_cache_unaligned' end source from (select ticker, min(date) actual_from, max(date) actual_to, bool_or(date between date '1996-01-01' and date '1998-12-31') inside,"
    " greatest(date_diff('day', greatest(date '1996-01-01', min(date)), least(date '1998-12-31', max(date))) + 1, 0) covered_days from candles group by ticker))"
)
INDAUDIT = "ia as (select ticker, available, code indicator_code, req required, val as value, case when (code = 'max_drawdown' and val > 0) or (code = 'rsi_14' and not val between 0 and 100) then 'questionable' when val is null or available < req then 'missing' when aligned then 'valid' else 'not_applicable_to_requested_period' end status from (" + " union all ".join(f"select c.ticker, c.available, '{n}' code, {r} req, l.{n} val, a.aligned from (select ticker, count(*) available from candles group by ticker) c left join (select * from ind qualify row_number() over (partition by ticker order by date desc) = 1) l on l.ticker = c.ticker left join align a on a.ticker = c.ticker" for n, r in K.REQUIREMENTS.items()) + "))"


@query("select ticker, available, indicator_code, required, round(value, 6) as value, status from ia", CANDLES, IND, ALIGN, INDAUDIT)
def k8_indicator_audit(spark, sf_dir):
    rows = S.candles(spark, sf_dir)
    return K.indicator_audit(rows, K.period_alignment(rows, FROM, TO)).withColumn("value", F.round("value", 6))


@query(
    "select ticker, metric_code, round(value, 6) as value, case when metric_code = 'bid_ask_spread' then 'missing' else 'valid' end status from (select ticker, unnest(['average_daily_volume','average_daily_turnover','median_daily_turnover','trading_days_count','zero_volume_days_count','bid_ask_spread']) metric_code,"
    " unnest([avg(volume), avg(value), median(value), cast(count(*) as double), cast(count(*) filter (coalesce(volume, 0) = 0) as double), null]) as value from candles group by ticker)",
    CANDLES,
)
def k9_liquidity_metrics(spark, sf_dir):
    return K.liquidity_metrics(S.candles(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("select * from align", CANDLES, ALIGN)
def k10_period_alignment(spark, sf_dir):
    return K.period_alignment(S.candles(spark, sf_dir), FROM, TO)


@query(
    "select l.* exclude (b), s.valid, s.missing, s.not_applicable, a.aligned, a.covered_days, case when b % 3 = 0 or not a.aligned or s.missing > 0 or b % 2 = 0 then 'PARTIAL' else 'PASS' end audit_status, concat_ws(',', case when last_date < date '1998-12-31' then 'date_to_not_present_if_non_trading_or_provider_omitted' end, case when b % 3 = 0 then 'source_is_not_the_exchange' end, case when b % 2 = 0 then 'valuation_inputs_missing' end) warnings, case when not a.aligned or s.gaps > 0 then 'PARTIAL' else 'PASS' end technical_status from (select ticker, max(date) last_date, arg_max(close, date) last_close, count(*) candles, substr(ticker, 7)::int b from candles group by ticker) l join (select ticker, count(*) filter (status = 'valid') valid,"
    " count(*) filter (status = 'missing') missing, count(*) filter (status = 'not_applicable_to_requested_period') not_applicable, count(*) filter (indicator_code in ('ma_20','ma_50','rsi_14','support_level','resistance_level') and status <> 'valid') gaps from ia group by ticker) s using (ticker) join align a using (ticker)",
    CANDLES, IND, ALIGN, INDAUDIT,
)
def k11_market_report(spark, sf_dir):
    brand = F.substring("ticker", 7, 9).cast("int")
    candles = S.candles(spark, sf_dir)
    context = candles.select("ticker").distinct().select("ticker", (brand % 3 != 0).alias("official"), (brand % 2 != 0).alias("valuation"))
    return K.market_report(candles, FROM, TO, context)


@query("select ticker, date, open, high, low, close, volume, value from candles where date between date '1996-01-01' and date '1998-12-31'", CANDLES)
def k12_candle_range(spark, sf_dir):
    return K.candle_range(S.candles(spark, sf_dir), FROM, TO)
