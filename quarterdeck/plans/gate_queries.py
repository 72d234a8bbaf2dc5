"""Queries of quality gates; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as A
from ..operators import gates as G
from ..sources import fixtures as S
from .queries import AUDITED, CANDLES, CHECKS, FACTS, ORACLES, REGISTRY, SOURCES, _audited, query

PARSER = "parser as (" + ORACLES["f22_parser_quality"].removeprefix("with " + FACTS + "\n") + ")"
PENALTY = "penalty as (select entity, count(*) filter (not passed) failed_checks, cast(least(1.0, round(count(*) filter (not passed) * 0.05, 4)) as double) penalty from checks group by entity)"
CORE = "('" + "','".join(G.CORE) + "')"
QUALITY = (
    f"mq as (select *, round(least(greatest(calculated / eligible - case when invalid > 0 then 0.2 else 0.0 end - case when blockers > 0 then 0.4 else 0.0 end, 0.0), 1.0), 4) score, case when blockers > 0 or invalid > 0 then 'fail' when calculated = 0 then 'missing' when missing_expected > 0 or questionable > 0 then 'partial' else 'pass' end status from (select entity, count(*) filter (metric_code in {CORE}) eligible, count(*) filter (metric_code in {CORE} and status = 'valid') calculated,"
    f" count(*) filter (metric_code in {CORE} and status = 'questionable') questionable, count(*) filter (metric_code in {CORE} and status = 'missing') missing_expected, count(*) filter (status = 'invalid') invalid, count(*) filter (metric_code in ('pe_ratio','ev_to_ebitda','dividend_yield') or (metric_code in ('ebitda_margin','net_debt_to_ebitda') and status = 'missing')) unsupported, count(*) filter (metric_code in ('revenue_growth','roe','roa')) sensitive,"
    " count(*) filter (metric_code in ('pe_ratio','ev_to_ebitda','dividend_yield') and value is not null) blockers from audited group by entity))"
)
ALL = (*AUDITED, CHECKS, PENALTY, PARSER, QUALITY)


def _parts(spark, sf_dir):
    facts = S.facts(spark, sf_dir)
    return G.metric_quality(_audited(spark, sf_dir)), A.parser_quality(facts), A.consistency_penalty(A.consistency_checks(facts))


@query("select * from mq", *AUDITED, QUALITY)
def m22_metric_quality(spark, sf_dir):
    return G.metric_quality(_audited(spark, sf_dir))


@query(
    "select entity, scope, case scope when 'statement_based_financials' then st when 'market_technical_analysis' then case when c then 'AUTO_READY' else 'UNSUPPORTED' end when 'market_valuation' then 'UNAVAILABLE'"
    " when 'peer_comparison' then case when p then 'AUTO_PARTIAL' else 'UNSUPPORTED' end else case when st in ('AUTO_READY', 'AUTO_PARTIAL') then 'AUTO_READY' else 'AUTO_PARTIAL' end end status,"
    " scope = 'llm_summary' or (scope = 'market_technical_analysis' and c) or (scope = 'peer_comparison' and p) or (scope = 'statement_based_financials' and st in ('AUTO_READY', 'AUTO_PARTIAL')) supported, case when scope = 'statement_based_financials' then held else '' end blockers"
    " from (select *, case when held <> '' then case when calculated > 0 then 'LOW_CONFIDENCE' else 'UNSUPPORTED' end when score >= 0.75 and calculated > 0 and blockers = 0 then 'AUTO_READY' when calculated = 0 then 'UNSUPPORTED' else 'AUTO_PARTIAL' end st"
    " from (select mq.entity, calculated, mq.score, mq.blockers, concat_ws(',', case when mq.entity in ('N4', 'N9') then 'source_or_document_blocked' end, case when parser.status in ('parser_blocked', 'fail') then 'parser_blocked' end, case when coalesce(failed_checks, 0) > 0 then 'consistency_checks_failed' end) held,"
    " mq.entity in (select 'N' || substr(ticker, 7) from candles) c, mq.entity in (select entity from compared) p from mq join parser using (entity) left join penalty using (entity))),"
    " (values ('statement_based_financials'), ('market_technical_analysis'), ('market_valuation'), ('peer_comparison'), ('llm_summary')) v(scope)",
    *ALL, CANDLES, REGISTRY,
    "compared as (select distinct a.entity from audited a join registry r using (entity) join audited b on b.period = a.period and b.metric_code = a.metric_code and b.entity <> a.entity join registry s on s.entity = b.entity and s.sector = r.sector where a.status = 'valid' and b.status = 'valid' and a.metric_code = 'fcf_margin')",
)
def m23_readiness_scopes(spark, sf_dir):
    """Brands' candles as those of the entity of the same number; peers are entities of a sector with a valid cash margin in the same quarter."""
    market = S.candle_days(spark, sf_dir).groupBy(F.concat(F.lit("N"), F.substring("ticker", 7, 9)).alias("entity")).agg(F.sum("days").alias("candles"))
    valid = _audited(spark, sf_dir).where("status = 'valid' and metric_code = 'fcf_margin'").select("entity", "period")
    mates = valid.hint("merge").join(S.registry(spark, sf_dir).select("entity", "sector").hint("merge"), "entity")
    shared = mates.groupBy("sector", "period").agg(F.collect_set("entity").alias("all")).where(F.size("all") > 1)
    peers = shared.select(F.explode("all").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("compared_metrics"))
    blocked = S.registry(spark, sf_dir).select("entity", F.col("entity").isin("N4", "N9").alias("documents_blocked"))
    return G.readiness_scopes(*_parts(spark, sf_dir), market=market, peers=peers, sources=blocked)


@query(
    "select entity, round(greatest(0.0, least(1.0, coalesce(s.source_score, 0.0) * 0.25 + parser.score * 0.45 + mq.score * 0.30 - coalesce(penalty, 0.0))), 4) score, case when coalesce(documents, 0) = 0 then 'SOURCE_BLOCKED' when parser.status = 'parser_blocked' then 'PARSER_BLOCKED' when confident_ratio < 0.7 or conflicts > 0 then 'LOW_CONFIDENCE' else 'AUTO_PARTIAL' end status, parser.status parser_status, mq.status metric_status"
    " from parser join mq using (entity) left join penalty using (entity) left join (select entity, cast(count(distinct document_id) as double) / 4 source_score, count(distinct document_id) documents from sources where nation <> 3 group by entity) s using (entity)",
    *ALL, SOURCES,
)
def m24_auto_support(spark, sf_dir):
    metric, parser, checks = _parts(spark, sf_dir)
    source = S.two_sources(spark, sf_dir).where("nation <> 3").groupBy("entity").agg((F.count_distinct("document_id") / 4).alias("source_score"), F.count_distinct("document_id").alias("documents"))
    return G.auto_support(source, parser, metric, checks)


COVER = "cover as (select entity, period, case when k % 3 = 0 then 'press_release' when k % 5 = 0 then 'missing' when k % 2 = 0 then 'financial_statements' else 'annual_report' end \"role\", nation % 4 <> 1 trusted, case when nation % 6 = 5 then 'unknown' else 'pdf' end ft from facts where metric_code = 'revenue' and idx between 7984 and 7987)"


@query(
    "select entity, score, trusted, readiness, coalesce(entity = (select arg_max(entity, (score, trusted, entity)) from c where readiness = 'READY_CANDIDATE'), false) recommended from c",
    FACTS, COVER,
    "c as (select entity, i + case when fy then 2 else 0 end - case when n > 0 and pr = n then 2 else 0 end - case when un > 0 then 3 else 0 end - case when uk > 0 then 2 else 0 end score, tr trusted, case when fy and i > 0 then 'READY_CANDIDATE' when pp > 0 then 'PARTIAL_CANDIDATE' else 'NOT_SUITABLE' end readiness from (select entity, count(distinct period) filter (period <> '1996Q4' and \"role\" = 'financial_statements') i, bool_or(period = '1996Q4' and \"role\" in ('financial_statements', 'annual_report')) fy,"
    " count(*) filter (\"role\" <> 'missing') n, count(*) filter (\"role\" = 'press_release') pr, count(*) filter (\"role\" <> 'missing' and not trusted) un, count(*) filter (\"role\" in ('financial_statements', 'annual_report') and ft = 'unknown') uk, count(*) filter (\"role\" <> 'missing' and trusted) tr, count(*) filter (\"role\" in ('financial_statements', 'annual_report')) pp from cover group by entity))",
)
def e9_peer_source_score(spark, sf_dir):
    k, n = F.col("k"), F.col("nation")
    rows = S.facts(spark, sf_dir).where((F.col("metric_code") == "revenue") & F.col("idx").between(7984, 7987))
    role = F.when(k % 3 == 0, "press_release").when(k % 5 == 0, "missing").when(k % 2 == 0, "financial_statements").otherwise("annual_report")
    return G.peer_source_score(rows.select("entity", "period", role.alias("source_role"), (n % 4 != 1).alias("trusted_domain"), F.when(n % 6 == 5, "unknown").otherwise("pdf").alias("expected_file_type")), ["1996Q1", "1996Q2", "1996Q3", "1996Q4"])
