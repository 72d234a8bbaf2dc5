"""Queries of candidate facts and outcome roll-ups; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as D
from ..sources import fixtures as S
from .queries import AUDITED, CANDLES, FACTS, FROM, REGISTRY, SOURCES, TO, _audited, query


@query("select ticker id, row_number() over (partition by ticker order by date) - 1 \"row\", date::varchar as date, cast(volume as bigint)::varchar as volume, cast(null as varchar) as error from candles union all select 'none', null, null, null, 'candles block missing'", CANDLES)
def s3_decode_column_block(spark, sf_dir):
    rows = S.candles(spark, sf_dir).select("ticker", F.struct("date", F.array(F.col("date").cast("string"), F.col("volume").cast("long").cast("string")).alias("c")).alias("x"))
    data = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"])
    payload = F.to_json(F.struct(F.struct(F.array(F.lit("DATE"), F.lit("Volume")).alias("columns"), data.alias("data")).alias("candles")))
    blocks = rows.groupBy("ticker").agg(payload.alias("payload")).select(F.col("ticker").alias("id"), "payload").union(spark.sql("select 'none', '{}'"))
    return D.decode_column_block(blocks, "candles").select("id", "row", F.col("cells")["date"].alias("date"), F.col("cells")["volume"].alias("volume"), "error")


@query("select document_id, period, 'customer_accounts' metric_code, r + c as value, least(q, 0.9) confidence from (select document_id, period, max(case when metric_code = 'revenue' then value end) r, max(case when metric_code = 'net_income' then value end) c, max(case when metric_code = 'ebitda' then value end) t, min(confidence) filter (metric_code in ('revenue', 'net_income')) q from sources group by all) where t is null and r is not null and c is not null", FACTS, SOURCES)
def f12_derive_customer_accounts(spark, sf_dir):
    names = F.create_map(*map(F.lit, ("revenue", "retail_customer_accounts", "net_income", "corporate_customer_accounts", "ebitda", "customer_accounts")))
    return D.derive_customer_accounts(S.two_sources(spark, sf_dir).withColumn("metric_code", F.coalesce(F.try_element_at(names, F.col("metric_code")), F.col("metric_code"))))


FUSED = (
    "cand as (select entity, period, metric_code, case when document_id like '%|X' then 'camelot' else 'paddle_ocr' end engine, case when k % 8 = 0 and document_id like '%|Y' then null else value end as value, case when k % 31 = 0 and document_id like '%|Y' then 'cash_flow' else statement_type end fam, case when k % 9 = 0 and document_id like '%|Y' then null else period_type end ep,"
    " case when k % 16 = 1 then case when document_id like '%|Y' then '-' else '+' end end sg, idx % 7 page, case when k % 12 = 5 then 'footnote' else 'statement_line_item' end rk, confidence from sources), fused as (select a.entity, a.period, a.metric_code, case when b.entity is null then 'single_engine' when reason is null then 'merged_engines' else 'conflict_retained_as_evidence' end fusion_status, reason,"
    " case when b.entity is null then 'camelot' else 'camelot,paddle_ocr' end engines, case when b.entity is null or reason is null then coalesce(a.value, b.value) end as value, case when b.entity is null or reason is null then a.metric_code end label_text, case when b.entity is null or reason is null then greatest(a.confidence, b.confidence) end confidence, cast(null as varchar) warning"
    " from (select * from cand where engine = 'camelot') a left join (select * from cand where engine = 'paddle_ocr') b on a.entity = b.entity and a.period = b.period and a.metric_code = b.metric_code cross join lateral (select case when b.entity is null then null when a.fam <> b.fam then 'statement_family_conflict' when a.ep <> b.ep then 'period_conflict' when a.sg <> b.sg then 'sign_conflict'"
    " when a.rk = 'footnote' or a.value <> b.value then 'weak_alignment' end reason))"
)


def _fused(spark, sf_dir):
    y, k = F.col("document_id").endswith("|Y"), F.col("k")
    rows = S.two_sources(spark, sf_dir).select(
        *D.KEY, F.when(y, "paddle_ocr").otherwise("camelot").alias("engine"), F.col("metric_code").alias("label_text"), F.when(~(y & (k % 8 == 0)), F.col("value")).alias("current_value"), F.when(y & (k % 31 == 0), "cash_flow").otherwise(F.col("statement_type")).alias("statement_family"),
        F.when(~(y & (k % 9 == 0)), F.col("period_type")).alias("effective_period"), F.when(k % 16 == 1, F.when(y, "-").otherwise("+")).alias("sign_hint"), (F.col("idx") % 7).alias("page"), F.when(k % 12 == 5, "footnote").otherwise("statement_line_item").alias("row_kind"), "confidence",
    )
    return D.fuse_candidates(rows, {"camelot": 2, "paddle_ocr": 1})


@query("select * from fused", FACTS, SOURCES, FUSED)
def f13_fuse_candidates(spark, sf_dir):
    return _fused(spark, sf_dir)


@query("select engine, count(*) items, count(*) filter (fusion_status = 'merged_engines') merged, count(*) filter (fusion_status = 'single_engine') single, count(*) filter (fusion_status = 'conflict_retained_as_evidence') conflicts, count(*) filter (len(list_filter(string_split(engines, ','), lambda x: not contains(x, 'ocr'))) = 0) ocr_only from (select unnest(string_split(engines, ',')) engine, engines, fusion_status from fused) group by engine", FACTS, SOURCES, FUSED)
def f15_engine_contribution(spark, sf_dir):
    return D.engine_contribution(_fused(spark, sf_dir))


REVIEWED = "reviewed as (select entity, period, metric_code, case when k % 10 <> 0 then value end as value, case when k % 10 = 0 then 'blocked' when k % 4 = 0 then 'needs_manual_check' else 'eligible' end review_status, k from facts)"


def _reviewed(spark, sf_dir):
    k = F.col("k")
    return D.review_candidates(S.facts(spark, sf_dir).select(*D.KEY, F.when(k % 10 != 0, F.col("value")).alias("value"), F.when(k % 4 != 0, "page 3").otherwise("").alias("trace"), "k"))


@query("select entity, count(*) filter (review_status = 'eligible') eligible, count(*) filter (review_status = 'needs_manual_check') needs_manual_check, count(*) filter (review_status = 'blocked') blocked from reviewed group by entity", FACTS, REVIEWED)
def f16_review_candidates(spark, sf_dir):
    return D.review_counts(_reviewed(spark, sf_dir))


@query("select entity, period, metric_code, value, act as \"action\", case when act = 'promoted' then 'reviewed_manual_upload' end quality_flag, case when act = 'promoted' then 0.95::double end confidence from (select *, case when review_status <> 'eligible' then 'blocked' when k % 6 = 1 then 'skipped' else 'promoted' end act from reviewed)", FACTS, REVIEWED)
def f17_promote_reviewed(spark, sf_dir):
    old = S.facts(spark, sf_dir).where(F.col("k") % 6 <= 2).withColumn("provenance", F.when(F.col("k") % 6 == 1, "parser").otherwise("reviewed_manual_upload"))
    return D.promote_reviewed(old.where(F.col("k") % 6 > 0), _reviewed(spark, sf_dir))


@query("select reason, count(*) \"rows\" from (select 'low_confidence' reason from lineitem where l_quantity < 10 union all select 'no_label' from lineitem where l_discount > 0.05 union all select 'ship_mode' from lineitem where l_returnflag = 'R') group by reason")
def f27_rejection_counts(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem")
    return D.rejection_counts(rows.select(F.concat_ws(",", F.when(F.col("l_quantity") < 10, " Low confidence"), F.when(F.col("l_discount") > 0.05, "no-label"), F.when(F.col("l_returnflag") == "R", "SHIP - mode ")).alias("reasons")))


@query("select g.entity, g.family, t.n is not null found, coalesce(t.n, 0) \"tables\", coalesce(t.p, '') periods from (select entity, family from (select distinct entity from facts), (values ('balance_sheet'), ('income_statement'), ('cash_flow')) v(family)) g left join (select entity, statement_type family, count(*) n, string_agg(distinct period, ',' order by period) p from facts group by all) t on t.entity = g.entity and t.family = g.family", FACTS)
def f28_statement_coverage(spark, sf_dir):
    return D.statement_coverage(S.facts(spark, sf_dir))


@query(
    "select *, case status when 'FULL' then 'none' when 'PARTIAL' then 'review_leftovers' when 'EVIDENCE_ONLY' then 'promote_evidence' else 'upload_better_source' end next_action from (select *, case when facts > 0 and rejected + evidence = 0 then 'FULL' when facts > 0 then 'PARTIAL' when evidence > 0 then 'EVIDENCE_ONLY' else 'BLOCKED' end status"
    " from (select document_id || period document_id, count(*) filter (quality_flag in ('exact', 'derived')) facts, count(*) filter (quality_flag = 'low_confidence_parse') rejected, count(*) filter (quality_flag = 'fixture') evidence from sources group by 1))",
    FACTS, SOURCES,
)
def f34_document_final_status(spark, sf_dir):
    flag = F.col("quality_flag")
    counts = S.two_sources(spark, sf_dir).groupBy(F.concat("document_id", "period").alias("document_id")).agg(F.count_if(flag.isin("exact", "derived")).alias("facts"), F.count_if(flag == "low_confidence_parse").alias("rejected"), F.count_if(flag == "fixture").alias("evidence"))
    return D.document_final_status(counts)


@query(
    "select cause, count(*) \"rows\", string_agg(distinct metric_code, ',' order by metric_code) metrics from (select metric_code, case when metric_code in ('pe_ratio','ev_to_ebitda','dividend_yield') then 'requires_market_inputs' when metric_code in ('ebitda_margin','net_debt_to_ebitda') then 'requires_explicit_disclosure' when metric_code in ('roe','roa') then 'blocked_by_period_semantics'"
    " when metric_code in ('net_interest_margin','cost_to_income','loan_to_deposit','equity_to_assets','net_margin_like') then 'unavailable_in_source' else 'fixable_by_parser' end cause from audited where status = 'missing') group by cause",
    *AUDITED,
)
def m19_missing_breakdown(spark, sf_dir):
    return D.missing_breakdown(_audited(spark, sf_dir))


@query("select status, (select count(*) from (select case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment else 'OTHER' end s from customer) where s = status) entities from (values ('BUILDING'), ('MACHINERY'), ('NEVER'), ('OTHER')) v(status)")
def c5_support_scan(spark, sf_dir):
    return D.support_scan(S.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("status")), ("BUILDING", "MACHINERY", "NEVER", "OTHER"))


PACKAGE = (
    "src as (select entity, period, case when k % 11 = 0 then 'annual_report' when k % 17 = 0 then 'other' else source_role end r, k % 4 <> 0 ok from sources where nation % 9 <> 5 and idx % 7 <> 3),"
    f"asked as (select entity, ((i // 4) || 'Q' || (i % 4 + 1)) period from (select distinct entity from registry), range({FROM[:4]} * 4 + {FROM[-1]} - 1, {TO[:4]} * 4 + {TO[-1]}) t(i)),"
    "package as (select entity, period, count(r) sources, coalesce(bool_or(r = 'financial_statements'), false) a, coalesce(bool_or(r = 'financial_supplement'), false) b, coalesce(bool_or(r = 'annual_report'), false) c, coalesce(bool_or(r = 'financial_statements' and ok), false) va,"
    " coalesce(bool_or(r = 'financial_supplement' and ok), false) vb, coalesce(bool_or(r = 'annual_report' and ok), false) vc, count(*) filter (r = 'financial_statements') na, count(*) filter (r = 'financial_supplement') nb, count(*) filter (r = 'annual_report') nc, count(*) filter (r = 'press_release') np"
    " from asked left join src using (entity, period) group by 1, 2)"
)


def _package(spark, sf_dir):
    k = F.col("k")
    role = F.when(k % 11 == 0, "annual_report").when(k % 17 == 0, "other").otherwise(F.col("source_role"))
    sources = S.two_sources(spark, sf_dir).where("nation % 9 <> 5 and idx % 7 <> 3").select("entity", "period", role.alias("source_role"), (k % 4 != 0).alias("verified"))
    return D.source_package(S.registry(spark, sf_dir), sources, FROM, TO)


@query(
    "select entity, period, sources, a has_financial_statements, b has_financial_supplement, c has_annual_report, va verified_financial_statements, vb verified_financial_supplement, vc verified_annual_report, sources > 0 and sources = np press_only,"
    " case when a or b or c then 'ready' when sources > 0 then 'partial' else 'missing' end readiness, na n_financial_statements, nb n_financial_supplement, nc n_annual_report, np n_press_release from package",
    FACTS, SOURCES, REGISTRY, PACKAGE,
)
def c7_source_package(spark, sf_dir):
    """Sources by rule: some quarters and entities have none."""
    return _package(spark, sf_dir)


@query(
    "select entity, missing_periods, press periods_press_only, na n_financial_statements, np n_press_release, case when va + vb + vc >= n then 'READY' when va + vb + vc > 0 then 'PARTIAL' else 'NOT_READY' end status from (select entity, count(*) n, sum(va::int) va, sum(vb::int) vb, sum(vc::int) vc,"
    " count(*) filter (sources > 0 and sources = np) press, sum(na)::bigint na, sum(np)::bigint np, coalesce(string_agg(period, ',' order by period) filter (sources = 0), '') missing_periods from package group by entity)",
    FACTS, SOURCES, REGISTRY, PACKAGE,
)
def c7_package_summary(spark, sf_dir):
    return D.package_summary(_package(spark, sf_dir), verified=True).select("entity", "missing_periods", "periods_press_only", "n_financial_statements", "n_press_release", "status")


BEST = (
    f"best as (select entity, period, url, document_id, confidence, r source_role from (select *, row_number() over (partition by entity, period, url order by confidence desc, document_id) n from (select entity, period, 'u' || (k % 3) url, document_id || metric_code document_id, confidence,"
    f" case when idx % 5 = 0 then 'press_release' else source_role end r from sources where nation % 9 <> 5 and period between '{FROM}' and '{TO}')) where n = 1)"
)


def _best(spark, sf_dir):
    role = F.when(F.col("idx") % 5 == 0, "press_release").otherwise(F.col("source_role"))
    rows = S.two_sources(spark, sf_dir).where("nation % 9 <> 5").select("entity", "period", F.concat(F.lit("u"), F.col("k") % 3).alias("url"), F.concat("document_id", "metric_code").alias("document_id"), "confidence", role.alias("source_role"))
    return D.report_candidates(rows, FROM, TO)


@query("select entity, period, url, document_id, confidence, source_role from best", FACTS, SOURCES, BEST)
def c10_report_candidates(spark, sf_dir):
    return _best(spark, sf_dir)


@query(
    "select entity, coalesce(n, 0) reports, missing_periods, case when n is null then 'NOT_FOUND' when missing_periods = '' then 'READY' else 'PARTIAL' end status from (select entity, coalesce(string_agg(period, ',' order by period) filter (not exists (select 1 from best b where b.entity = asked.entity and b.period = asked.period"
    " and b.source_role = 'financial_statements')), '') missing_periods from asked group by entity) left join (select entity, count(*) n from best group by 1) using (entity)",
    FACTS, SOURCES, REGISTRY, PACKAGE, BEST,
)
def c10_discovery_status(spark, sf_dir):
    return D.discovery_status(S.registry(spark, sf_dir), _best(spark, sf_dir), FROM, TO)


@query("select provider, trust, access, data_type, row_number() over (partition by data_type order by case trust when 'high' then 0 when 'medium' then 1 else 2 end, case access when 'open' then 0 when 'key' then 1 else 2 end, provider) place from (select s_name provider, case s_suppkey % 3 when 0 then 'low' when 1 then 'high' else 'medium' end trust, case s_suppkey % 2 when 0 then 'open' else 'paid' end as access, unnest(['facts', 'n' || (s_nationkey % 4)]) data_type from supplier)")
def c16_rank_providers(spark, sf_dir):
    k = F.col("s_suppkey")
    return D.rank_providers(S.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("provider"), F.when(k % 3 == 0, "low").when(k % 3 == 1, "high").otherwise("medium").alias("trust"), F.when(k % 2 == 0, "open").otherwise("paid").alias("access"), F.array(F.lit("facts"), F.concat(F.lit("n"), F.col("s_nationkey") % 4)).alias("data_types")))
