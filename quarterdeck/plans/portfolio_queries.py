"""Queries of peers, portfolios and texts; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import facts as A
from ..operators import metrics as M
from ..operators import peers as E
from ..operators import portfolio as C
from ..operators.entities import search_entities
from ..sources import fixtures as S
from .queries import AUDITED, ELIGIBLE, ENGINE, FACTS, FROM, HISTORY, REGISTRY, STRICT, TO, WIDE, _audited, _engine, _strict, query

STRICTS = (FACTS, ELIGIBLE, REGISTRY, STRICT)
SUMMARY = "ssum as (select entity, count(*) filter (status = 'calculated') calculated_count, count(*) filter (status = 'missing') missing_count, count(*) filter (status like 'unsupported%') unsupported_count, count(*) filter (status like 'blocked%') blocked_count from strict group by entity)"
PEERS = "peers as (select target, peer, place, selection from (select t.entity target, p.entity peer, row_number() over (partition by t.entity order by case when t.subsector = p.subsector then 0 else 1 end, p.entity) place, 'sector' selection from registry t join registry p on t.sector = p.sector and t.entity <> p.entity where p.is_active) where place <= 5)"


def _peers(spark, sf_dir):
    registry = S.registry(spark, sf_dir)
    return E.select_peers(registry, registry)


@query("select target, peer, place, selection from peers where target not in (select target from x) union all select target, peer, place, 'explicit' from x", REGISTRY, PEERS, "x as (select t.entity target, p.entity peer, row_number() over (partition by t.entity order by p.entity desc, p.entity) place from registry t join registry p on t.sector = p.sector and t.subsector = p.subsector and t.entity <> p.entity where t.is_bank and p.is_active)")
def e1_select_peers(spark, sf_dir):
    from pyspark.sql import Window

    registry = S.registry(spark, sf_dir)
    t = registry.where("is_bank").select(F.col("entity").alias("target"), "sector", "subsector")
    named = t.join(registry.select(F.col("entity").alias("peer"), "sector", "subsector"), ["sector", "subsector"]).where("peer <> target")
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("peer")))).select("target", "peer", "rank")
    return E.select_peers(registry, registry, named)


@query("select r.entity, coalesce(s.calculated_count, 0) calculated_count, case when s.calculated_count is null then 'missing_report' when s.calculated_count < 2 then 'available_but_low_coverage' else 'available' end status from registry r left join ssum s using (entity)", *STRICTS, SUMMARY)
def e2_ratio_availability(spark, sf_dir):
    return E.ratio_availability(S.registry(spark, sf_dir), M.status_summary(_strict(spark, sf_dir)))


TABLE = (
    "ctable as (select m.target, m.entity, m.role, c.code metric_code, s.value, coalesce(s.status, 'metric_missing') status from (select target, peer entity, 'peer' as role from peers union all select distinct target, target, 'target' from peers) m cross join (values "
    + ", ".join(f"('{c}')" for c in (*M.STRICT_CODES, "pe_ratio")) + f") c(code) left join (select * from strict where period = '{TO}') s on s.entity = m.entity and s.metric_code = c.code)"
)


def _table(spark, sf_dir):
    return E.comparison_table(_peers(spark, sf_dir), _strict(spark, sf_dir), TO, (*M.STRICT_CODES, "pe_ratio"))


@query("select target, entity, role, metric_code, round(value, 6) as value, status from ctable", *STRICTS, PEERS, TABLE)
def e3_comparison_table(spark, sf_dir):
    return _table(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("select target, compared_metrics, target_gaps, case when compared_metrics = 0 then 'blocked' when target_gaps > 0 then 'partial' else 'ready' end readiness from (select target, count(*) filter (t and p > 0) compared_metrics, count(*) filter (not t) target_gaps from (select target, metric_code, bool_or(role = 'target' and value is not null) t, count(*) filter (role = 'peer' and value is not null) p from ctable group by all) group by target)", *STRICTS, PEERS, TABLE)
def e4_comparison_readiness(spark, sf_dir):
    return E.comparison_readiness(_table(spark, sf_dir))


@query(f"select target, peer, place, revenue, net_income, case when fw.entity is null then 'missing' else 'exact' end quality_flag from peers left join (select * from fw where period = '{TO}') fw on fw.entity = peer", FACTS, WIDE, REGISTRY, PEERS)
def e5_peer_table(spark, sf_dir):
    return E.peer_table(_peers(spark, sf_dir), M.wide_facts(S.facts(spark, sf_dir)), TO, ("revenue", "net_income"))


SIGNATURES = (
    "sourced as (select *, case when k % 23 <> 0 then 'p' end trace, case when k % 19 = 0 then 'press_release' else 'financial_statements' end src, case when period_type = 'ytd' then (idx % 4 + 1) * 3 end ytd from facts), inputs as (select * from (values "
    + ", ".join(f"('{c}', '{i}')" for c, names in M.AUDIT_INPUTS.items() for i in names)
    + ") n(code, input)),"
    "behind as (select entity, period, code metric_code, count(distinct period_type) types, any_value(period_type) t, count(distinct ytd) ms, max(ytd) m, bool_or(quality_flag in ('low_confidence_parse', 'conflicting_sources', 'fixture')) low, bool_and(trace is not null) traced, bool_and(src <> 'press_release') good_roles"
    " from sourced join inputs on input = metric_code group by 1, 2, 3),"
    "signatures as (select entity, period, metric_code, case when types = 1 then t else 'mixed' end period_type, case when types = 1 and t = 'ytd' and ms = 1 then m || 'M' when types = 1 and t = 'annual' then '12M' when types = 1 then t else 'mixed' end coverage, low, traced, good_roles from behind)"
)


def _signatures(spark, sf_dir):
    inputs = spark.createDataFrame([(c, i) for c, names in M.AUDIT_INPUTS.items() for i in names], "metric_code string, input string")
    k = F.col("k")
    facts = S.facts(spark, sf_dir).withColumns({
        "trace": F.when(k % 23 != 0, "p"), "source_role": F.when(k % 19 == 0, "press_release").otherwise("financial_statements"), "ytd_months": F.when(F.col("period_type") == "ytd", (F.col("idx") % 4 + 1) * 3),
    })
    return E.period_signature(facts, inputs)


@query("select * from signatures", FACTS, SIGNATURES)
def e7_period_signature(spark, sf_dir):
    return _signatures(spark, sf_dir)


PAIRS = (
    "side as (select a.entity, a.period, a.metric_code, a.value, a.status, s.period_type, s.coverage, s.low, s.traced, s.good_roles from audited a left join signatures s using (entity, period, metric_code)),"
    "tside as (select p.target, p.peer, s.* from (select distinct target, peer from peers) p join side s on s.entity = p.target), pside as (select p.target, p.peer, s.* from (select distinct target, peer from peers) p join side s on s.entity = p.peer),"
    "compared as (select target, peer, period, metric_code, t.value t_value, p.value p_value, coalesce(t.status = 'valid', false) t_valid, coalesce(p.status = 'valid', false) p_valid, t.period_type, t.coverage,"
    " case when metric_code in ('pe_ratio', 'ev_to_ebitda', 'dividend_yield') then 'valuation_inputs_missing' when metric_code in ('ebitda_margin', 'net_debt_to_ebitda') then 'ebitda_missing'"
    + "".join(
        f" when {x}.status = 'questionable' then 'questionable_for_{who}' when coalesce({x}.status, '') <> 'valid' then 'missing_for_{who}' when coalesce({x}.low, false) then 'low_quality_inputs_for_{who}'"
        f" when not coalesce({x}.traced, false) then 'traceability_missing_for_{who}' when not coalesce({x}.good_roles, false) then 'unacceptable_source_role_for_{who}'"
        for x, who in (("t", "target"), ("p", "peer"))
    )
    + " when t.period_type is distinct from p.period_type or t.coverage is distinct from p.coverage then 'incompatible_period_coverage' end reason from tside t full outer join pside p using (target, peer, period, metric_code))"
)
COMPARED = (*AUDITED, REGISTRY, PEERS, SIGNATURES, PAIRS)


def _compared(spark, sf_dir):
    return E.pair_compatibility(_audited(spark, sf_dir), _signatures(spark, sf_dir), _peers(spark, sf_dir))


@query(
    "select target, peer, period, metric_code, round(t_value, 6) target_value, round(p_value, 6) peer_value, reason is null comparable, reason, case when reason is null then period_type end period_type, case when reason is null then coverage end coverage, t_valid target_valid, p_valid peer_valid from compared",
    *COMPARED,
)
def e6_pair_compatibility(spark, sf_dir):
    return _compared(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("target_value", "peer_value")})


@query(
    f"select target, peer, comparable, excluded, target_gaps, peer_gaps, full_year, case when comparable > 0 then 'PARTIAL' else 'NOT_READY' end status, case when comparable < 5 then 'not_ready' when not full_year then 'limited' else 'usable_with_warnings' end readiness,"
    " concat_ws(',', case when e then 'ebitda_metrics_unavailable' end, case when pm < 10 then 'narrow_peer_coverage' end, case when comparable = 0 then 'no_compatible_metrics' end, 'partial_comparison', case when not full_year then 'peer_year_end_missing' end, 'valuation_unavailable') warnings, reasons"
    " from (select target, peer, count(*) filter (reason is null) comparable, count(*) filter (reason is not null) excluded, count(*) filter (reason is not null and not t_valid) target_gaps, count(*) filter (reason is not null and not p_valid) peer_gaps, count(*) filter (p_valid) pm,"
    f" coalesce(bool_or(reason = 'ebitda_missing'), false) e, coalesce(string_agg(distinct reason, ',' order by reason), '') reasons, peer in (select entity from facts where period = '{TO}' and k % 4 <> 1) full_year from compared group by 1, 2)",
    *COMPARED,
)
def e8_pair_report(spark, sf_dir):
    documents = S.facts(spark, sf_dir).where("k % 4 <> 1").select("entity", "period").distinct()
    return E.pair_report(_compared(spark, sf_dir), documents, TO)


# ---- portfolio ----


@query("select entity, name, sector, capitalisation, case when substr(entity, 2)::int % 2 = 0 then 'old' else 'new' end origin from registry", REGISTRY)
def s5_load_registry(spark, sf_dir):
    rows = S.registry(spark, sf_dir).select("entity", "name", "sector", "capitalisation")
    old = rows.where(F.substring("entity", 2, 9).cast("int") % 2 == 0).withColumn("origin", F.lit("old"))
    return C.load_registry(old, rows.withColumn("origin", F.lit("new")))


HITS = (
    "qs as (select distinct 'nation_' || (s_nationkey % 7) q from supplier union select distinct c_mktsegment from customer union select 'N1'), names as (select distinct entity, lower(n) n from (select entity, unnest([entity, name, lower(name)]) n from registry where is_active)),"
    "hits as (select q, entity, min(case when n = lower(q) then 0 else 1 end) \"rank\" from names join qs on contains(n, lower(q)) or contains(lower(q), n) group by all), ranked as (select *, row_number() over (partition by q order by \"rank\", entity) place from hits)"
)


def _hits(spark, sf_dir, limit=20):
    q = S.table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation_"), F.col("s_nationkey") % 7).alias("q")).union(S.table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()
    q = q.union(spark.createDataFrame([("N1",)], "q string"))
    return search_entities(S.registry(spark, sf_dir), q, limit)


@query("select q, entity, \"rank\", place from ranked where place <= 20", REGISTRY, HITS)
def t25_search_entities(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("select q, case when count(*) = 1 then min(entity) end entity from ranked where place <= 5 group by q", REGISTRY, HITS)
def t26_resolve_entity(spark, sf_dir):
    return C.resolve_entity(_hits(spark, sf_dir, 5))


@query("select entity, case when contains(t, 'bank') then 'bank_ifrs' when contains(t, 'exchange') or contains(t, 'financial') then 'financial_non_bank_ifrs' else 'industrial_ifrs_general' end issuer_class from (select entity, lower(sector || case when is_bank then ' Bank' else '' end || ' ' || subsector || ' ' || name || case when subsector = 'S1' then ' financial services' else '' end) t from registry)", REGISTRY)
def t27_issuer_class(spark, sf_dir):
    rows = S.registry(spark, sf_dir).withColumn("sector", F.when(F.col("is_bank"), F.concat("sector", F.lit(" Bank"))).otherwise(F.col("sector"))).withColumn("name", F.when(F.col("subsector") == "S1", F.concat("name", F.lit(" financial services"))).otherwise(F.col("name")))
    return C.issuer_class(rows)


@query("select entity, name, capitalisation, row_number() over (order by capitalisation desc, entity) \"rank\" from registry where coalesce(capitalisation, 0) <> 0 order by capitalisation desc, entity limit 10", REGISTRY)
def c8_top_n_by_value(spark, sf_dir):
    return C.top_n_by_value(S.registry(spark, sf_dir), 10)


@query("select entity, periods, case when periods = 12 then 'complete' when periods = 0 then 'missing' else 'partial' end status from (select entity, count(distinct period) filter (idx between 7984 and 7995) periods from facts group by entity)", FACTS)
def c1_documents_status(spark, sf_dir):
    return C.documents_status(S.facts(spark, sf_dir), FROM, TO)


LEVELS = "levels as (select entity, case when calculated_count = 0 then 'no_coverage' when calculated_count < missing_count then 'limited' when blocked_count > 0 then 'partial' else 'full' end \"level\", missing_count > 0 m, blocked_count > 0 b, unsupported_count > 0 u from ssum)"


def _levels(spark, sf_dir):
    return C.coverage_level(M.status_summary(_strict(spark, sf_dir)))


@query("select entity, \"level\", concat_ws(',', case when m then 'missing_facts' end, case when b then 'period_semantics' end, case when u then 'sector_policy' end, 'valuation_inputs') blockers from levels", *STRICTS, SUMMARY, LEVELS)
def c2_coverage_level(spark, sf_dir):
    return _levels(spark, sf_dir).withColumn("blockers", F.array_join("blockers", ","))


@query(
    "select blocker, count(*) entities, string_agg(entity, ',' order by entity) filter (p <= 5) \"sample\", case blocker when 'missing_facts' then 1 when 'period_semantics' then 2 else 99 end priority from (select *, row_number() over (partition by blocker order by entity) p from (select entity, 'missing_facts' blocker from levels where m union all select entity, 'period_semantics' from levels where b union all select entity, 'sector_policy' from levels where u union all select entity, 'valuation_inputs' from levels)) group by blocker",
    *STRICTS, SUMMARY, LEVELS,
)
def c3_blocker_summary(spark, sf_dir):
    return C.blocker_summary(_levels(spark, sf_dir), {"missing_facts": 1, "period_semantics": 2})


@query("select n \"level\", (select count(*) from levels where \"level\" = n) entities from (values ('full'), ('partial'), ('limited'), ('no_coverage')) v(n)", *STRICTS, SUMMARY, LEVELS)
def c4_coverage_counts(spark, sf_dir):
    return C.coverage_counts(_levels(spark, sf_dir))


@query("select entity, period, period result_id, place from (select entity, period, row_number() over (partition by entity order by idx desc) place from (select distinct entity, period, idx from facts)) where place <= 3", FACTS)
def c14_analysis_history(spark, sf_dir):
    results = S.facts(spark, sf_dir).select("entity", "period", F.col("period").alias("result_id"), F.col("idx").alias("created")).distinct()
    return C.analysis_history(results, 3).drop("created")


@query(
    "select entity, string_agg(f, ',' order by f) flags, case when bool_or(f = 'fixture') then 'fixture' when bool_or(f = 'conflicting_sources') then 'conflicting' when bool_or(f = 'low_confidence_parse') then 'low_confidence' when bool_or(f = 'missing') then 'partial' else 'good' end overall from (select distinct entity, quality_flag f from facts union select distinct entity, quality_flag from engine) group by entity",
    FACTS, WIDE, HISTORY, ENGINE,
)
def c15_data_quality(spark, sf_dir):
    return C.data_quality(S.facts(spark, sf_dir), _engine(spark, sf_dir))


@query("select entity, 'ratio' kind, metric_code, period, round(value, 6) as value, case when status = 'calculated' then 'exact' else 'missing' end quality_flag from strict union all select entity, 'fact', metric_code, period, round(value, 6), quality_flag from facts", *STRICTS)
def c19_metric_feed(spark, sf_dir):
    return C.metric_feed(_strict(spark, sf_dir), S.facts(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query()
def c18_assemble_payload(spark, sf_dir):
    facts, metrics = S.facts(spark, sf_dir), _engine(spark, sf_dir)
    return C.assemble_payload(facts, metrics, C.data_quality(facts, metrics))


# ---- texts ----

LINKS = "links as (select page_id, url, pos, m, trim(regexp_replace(regexp_replace(regexp_extract(m, '(?is)>(.*)</a>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) title, regexp_extract(m, '(?is)href=[\"'']([^\"'']+)[\"'']', 1) href from (select page_id, url, unnest(l) m, generate_subscripts(l, 1) - 1 pos from (select page_id, url, regexp_extract_all(html, '(?is)<a[^>]+href=[\"''][^\"'']+[\"''][^>]*>.*?</a>') l from pages)))"


def _links(spark, sf_dir):
    pages = S.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.posexplode(X.html_links(F.col("html"))).alias("pos", "x")).select("page_id", "url", "pos", "x.href", "x.title")


@query("select page_id, pos, href, title from links", LINKS)
def s11_html_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href", "title")


SAID = "said as (select *, case pos % 5 when 0 then 'IFRS Consolidated Financial Statements ' || title || ' 2021 Q' || (page_id % 4 + 1) when 1 then 'Annual  report 2020 ' || title when 2 then 'Press release, nine months 2019 ' || title when 3 then 'Presentation H1 2022 ' || title else title end t from links)"


def _said(spark, sf_dir):
    k = F.col("pos") % 5
    t = F.when(k == 0, F.concat(F.lit("IFRS Consolidated Financial Statements "), "title", F.lit(" 2021 Q"), F.col("page_id") % 4 + 1)).when(k == 1, F.concat(F.lit("Annual  report 2020 "), "title")).when(k == 2, F.concat(F.lit("Press release, nine months 2019 "), "title")).when(k == 3, F.concat(F.lit("Presentation H1 2022 "), "title")).otherwise(F.col("title"))
    return _links(spark, sf_dir).withColumn("t", t)


@query(
    "select page_id, pos, case when contains(v, 'ifrs') and contains(v, 'consolidated financial statements') then 'financial_statements' when contains(v, 'annual report') then 'annual_report' when contains(v, 'press release') then 'press_release' when contains(v, 'presentation') then 'issuer_report' else 'unknown' end \"role\","
    " case when contains(v, 'ifrs') and contains(v, 'consolidated financial statements') then null when contains(v, 'annual report') then 'annual_report_not_validated_as_financial_statements' when contains(v, 'press release') then 'press_release_not_financial_statements' when contains(v, 'presentation') then 'presentation_not_financial_statements' else 'required_financial_statement_markers_absent' end rejection from (select *, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) v from said)",
    LINKS, SAID,
)
def t21_classify_link(spark, sf_dir):
    return _said(spark, sf_dir).select("page_id", "pos", X.link_role(F.col("t"), "IFRS").alias("x")).select("page_id", "pos", "x.role", "x.rejection")


@query(
    "select page_id, pos, case when contains(v, 'ras') or contains(v, 'рсбу') then 'financial_statements' when contains(v, 'presentation') then 'issuer_report' else 'unknown' end \"role\", case when contains(v, 'ras') or contains(v, 'рсбу') then null when contains(v, 'presentation') then 'presentation_not_financial_statements'"
    " else 'required_financial_statement_markers_absent' end rejection from (select *, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) v from said)",
    LINKS, SAID,
)
def t21_classify_link_ras(spark, sf_dir):
    return _said(spark, sf_dir).select("page_id", "pos", X.link_role(F.col("t"), "RAS").alias("x")).select("page_id", "pos", "x.role", "x.rejection")


@query(
    "select page_id, pos, case when regexp_matches(v, '\\b(20\\d{2})\\s*[-_/]?\\s*q([1-4])\\b') then regexp_extract(v, '\\b(20\\d{2})\\s*[-_/]?\\s*q([1-4])\\b', 1) || 'Q' || regexp_extract(v, '\\b(20\\d{2})\\s*[-_/]?\\s*q([1-4])\\b', 2) else nullif(regexp_extract(v, '\\b(20\\d{2})\\b', 1), '') || case when contains(v, '3 months') or contains(v, 'three months') then 'Q1' when contains(v, '6 months') or contains(v, 'six months') or contains(v, 'h1') then 'Q2' when contains(v, '9 months') or contains(v, 'nine months') then 'Q3' when contains(v, '12 months') or contains(v, 'year ended 31 december') or contains(v, 'fy ') or contains(v, 'annual report') then 'Q4' end end period, 'en' lang from (select *, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) v from said)",
    LINKS, SAID,
)
def t22_period_from_link(spark, sf_dir):
    return _said(spark, sf_dir).select("page_id", "pos", X.link_period(F.col("t")).alias("period"), X.language(F.col("t")).alias("lang"))


@query("select page_id, concat_ws(',', case when h not in ('example.org', 'www.example.com') then 'untrusted_domain' end, case when page_id % 3 = 2 then 'unsupported_file_type' end, case when page_id % 3 = 0 and not p like '%.pdf' then 'html_url_marked_pdf' end) warnings from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) h, lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) p from pages)")
def t30_url_checks(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "pdf").when(F.col("page_id") % 3 == 1, "html").otherwise("exe")
    return S.table(spark, sf_dir, "pages").select("page_id", X.url_checks(F.col("url"), ("example.org", "www.example.com"), kind).alias("warnings"))


NORMAL = "normal as (select doc_id, trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), 'ё', 'е'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) t from documents)"
TOPICS = {"article": ("the ", "der ", "une "), "licence": ("license", "mit "), "stop": ("end.",)}


@query("select doc_id, contains(t, 'license') or contains(t, 'the that') found from normal", NORMAL)
def t3_contains_marker(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", X.contains_marker(F.col("text"), ("License!", "the  that", "@", "")).alias("found"))


@query("select doc_id, md5(t) normal from normal", NORMAL)
def t2_matching_text(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.matching_text(F.col("text"))).alias("normal"))


TAGGED = "tagged as (select doc_id, list_filter(['article', 'licence', 'stop'], lambda x: case x when 'article' then contains(t, 'the') or contains(t, 'der') or contains(t, 'une') when 'licence' then contains(t, 'license') or contains(t, 'mit') else contains(t, 'end') end) g from normal)"


def _tagged(spark, sf_dir):
    return C.tag_topics(S.table(spark, sf_dir, "documents"), TOPICS)


@query("select doc_id, array_to_string(g, ',') tags, case when len(g) >= 2 then 'high' when len(g) = 1 then 'medium' else 'low' end relevance from tagged", NORMAL, TAGGED)
def t23_tag_topics(spark, sf_dir):
    return _tagged(spark, sf_dir).withColumn("tags", F.array_join("tags", ","))


@query("select topic, count(*) items from (select unnest(g) topic from tagged) group by topic", NORMAL, TAGGED)
def t24_topic_counts(spark, sf_dir):
    return C.topic_counts(_tagged(spark, sf_dir))


NUMBERS = "ns as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 6 k, cast(cast(l_extendedprice * 100 as bigint) as varchar) c, format('{:,}', cast(floor(l_extendedprice) as bigint)) g from lineitem)"


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case k when 0 then cast(replace(g, ',', '') as double) when 1 then -cast(replace(g, ',', '') as double) when 2 then cast(left(c, length(c) - 2) || '.' || right(c, 2) as double) when 3 then cast(c as double) when 4 then null else -cast(replace(g, ',', '') as double) end as value from ns where length(c) > 2", NUMBERS)
def t4_parse_number(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") % 6).alias("k"), F.expr("cast(cast(round(l_extendedprice * 100) as bigint) as string)").alias("c"), F.format_number(F.floor("l_extendedprice"), 0).alias("g"))
    c, g, k = F.col("c"), F.col("g"), F.col("k")
    raw = F.when(k == 0, F.concat(g, F.lit(" RUB"))).when(k == 1, F.concat(F.lit("("), g, F.lit(")"))).when(k == 2, F.concat(F.expr("left(c, length(c) - 2)"), F.lit(","), F.expr("right(c, 2)"))).when(k == 3, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 4, F.lit("n/a")).otherwise(F.concat(F.lit("−"), g))
    return rows.where(F.length("c") > 2).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.parse_number(raw).alias("value"))


@query("select c_custkey, case c_custkey % 4 when 0 then 1e9 when 1 then 1e6 when 2 then 1e3 else 1.0 end::double factor, case c_custkey % 3 when 0 then 'RUB' when 1 then 'USD' end currency from customer")
def t5_unit_and_currency(spark, sf_dir):
    k, j = F.col("c_custkey") % 4, F.col("c_custkey") % 3
    t = F.concat_ws(" ", "c_name", F.when(k == 0, "in Billions of").when(k == 1, "(млн").when(k == 2, "thousand"), F.when(j == 0, "rubles)").when(j == 1, "USD"))
    return S.table(spark, sf_dir, "customer").select("c_custkey", N.unit_multiplier(t).alias("factor"), N.detect_currency(t).alias("currency"))


@query("select p_partkey, case when t = 'small ring' then 'exact_ring' when contains(t, 'small ring') then 'exact_ring' when contains(t, 'large') then 'large' when contains(t, 'ring') then 'ring' when contains(t, 'economy') then 'economy' when contains(t, 'nut') then 'nut' end metric from (select p_partkey, lower(p_name || ' ' || p_type) t from part)".replace("when contains(t, 'large') then 'large' when contains(t, 'ring') then 'ring' when contains(t, 'economy') then 'economy'", "when contains(t, 'economy') then 'economy' when contains(t, 'large') then 'large' when contains(t, 'ring') then 'ring'"))
def t7_match_metric(spark, sf_dir):
    rules = [("ring", "ring"), ("large", "large"), ("nut", "nut"), ("economy", "economy"), ("small ring", "exact_ring")]
    return S.table(spark, sf_dir, "part").select("p_partkey", X.match_label(F.concat_ws(" ", "p_name", "p_type"), rules).alias("metric"))


@query("select conv_id, turn, case when contains(t, 'RECOMMENDATION: SELL') then 'SELL' when contains(t, '**HOLD**') then 'HOLD' when contains(t, 'BUY') then 'BUY' when contains(t, 'SELL') then 'SELL' when contains(t, 'HOLD') then 'HOLD' else 'N/A' end verdict from (select conv_id, turn, upper(coalesce(text, '') || case turn % 5 when 0 then ' buy? recommendation: sell' when 1 then ' buy **hold**' when 2 then ' hold, sell' when 3 then ' we hold' else '' end) t from conversations)")
def t28_extract_verdict(spark, sf_dir):
    k = F.col("turn") % 5
    more = F.when(k == 0, " buy? recommendation: sell").when(k == 1, " buy **hold**").when(k == 2, " hold, sell").when(k == 3, " we hold").otherwise("")
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.verdict(F.concat(F.coalesce("text", F.lit("")), more)).alias("verdict"))
