"""Queries of what stands behind verdicts: reasons, notes, missing inputs, traces and blockers; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as D
from ..operators import facts as A
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import peers as E
from ..operators import portfolio as C
from ..sources import fixtures as S
from .candidate_queries import REVIEWED, _reviewed
from .gate_queries import ALL, _parts, m23_readiness_scopes
from .portfolio_queries import LEVELS, PEERS, STRICTS, SUMMARY, TABLE, _levels, _peers, _table
from .queries import AUDITED, ELIGIBLE, FACTS, FROM, ORACLES, REGISTRY, SOURCES, STRICT, TO, WIDE, _audited, _engine, _strict, query


def _joined(df, *arrays):
    return df.withColumns({c: F.array_join(c, ",") for c in arrays})


# ---- metrics ----


def _lacking_sql() -> str:
    plain = ("debt_to_equity", "current_ratio", "fcf", "fcf_margin", "operating_margin", "net_margin")
    lists = " ".join(f"when metric_code = '{c}' then concat_ws(',', " + ", ".join(f"case when {n}_v is null then '{n}' end" for n in M.AUDIT_INPUTS[c]) + ")" for c in plain)
    return (
        "select s.entity, s.period, s.metric_code, s.status, case when s.status not in ('missing', 'unsupported_by_policy') then '' when metric_code in ('roe', 'roa') then case when net_income_v is null then 'net_income' when metric_code = 'roe' then 'total_equity' else 'total_assets' end"
        " when metric_code = 'revenue_growth' then case when revenue_v is null then 'revenue' else 'previous_revenue' end when metric_code = 'ebitda_margin' then case when ebitda_v is null then 'ebitda' else 'revenue' end"
        f" else coalesce(nullif(case {lists} end, ''), 'total_debt') end missing_inputs from strict s join sg on sg.entity = s.entity and (sg.i // 4) || 'Q' || (sg.i % 4 + 1) = s.period"
    )


@query(_lacking_sql(), FACTS, ELIGIBLE, REGISTRY, STRICT)
def m9_missing_inputs(spark, sf_dir):
    eligible = A.filter_eligible_facts(S.facts(spark, sf_dir), FROM, TO)
    rows = M.strict_ratios(eligible, FROM, TO, S.registry(spark, sf_dir).where("is_bank"), inputs=True)
    return _joined(rows.select("entity", "period", "metric_code", "status", "missing_inputs"), "missing_inputs")


PAIRS = ", ".join(f"('{c}', '{i}')" for c, names in M.AUDIT_INPUTS.items() for i in names)
FINDINGS = (
    "causes as (select e.entity, e.period, e.metric_code, any_value(e.value) v, any_value(e.quality_flag) q, bool_or(coalesce(f.quality_flag = 'conflicting_sources', false)) conflict, bool_or(coalesce(f.quality_flag = 'low_confidence_parse', false)) low,"
    " bool_or(coalesce(f.quality_flag = 'derived', false)) derived, bool_or(f.entity is not null and f.quality_flag not in ('exact', 'derived')) other, max(case when n.input = 'revenue' then f.period_type end) rt"
    f" from engine e left join (values {PAIRS}) n(code, input) on n.code = e.metric_code left join facts f on f.entity = e.entity and f.period = e.period and f.metric_code = n.input group by 1, 2, 3),"
    "reasons as (select c.entity, c.period, c.metric_code, a.status, case when c.metric_code in ('pe_ratio', 'ev_to_ebitda', 'dividend_yield') then 'valuation_inputs_unavailable' when v is null or q = 'missing' then '' when conflict then 'conflicting_input' when low then 'low_confidence_input'"
    " when a.status = 'invalid' then case when c.metric_code in ('current_ratio', 'debt_to_equity') then 'snapshot_inputs_required' else 'mixed_period_coverage' end when c.metric_code = 'revenue_growth' and a.status = 'questionable' then 'growth_of_cumulative_periods'"
    " when c.metric_code in ('roe', 'roa') then 'income_over_snapshots' when c.metric_code = 'net_debt_to_ebitda' then 'ebitda_unavailable' else '' end warnings,"
    " case when a.status = 'questionable' then case when c.derived then 'derived_input_used' when other then 'unverified_fact_input' when c.metric_code in ('roe', 'roa') then 'ytd_income_with_snapshot_balance_sheet' when c.metric_code = 'revenue_growth' and rt in ('ytd', 'annual') then 'incomplete_period_coverage' else 'methodology_warning' end end questionable_reason"
    " from causes c join audited a on a.entity = c.entity and a.period = c.period and a.metric_code = c.metric_code),"
    "findings as (select *, case when questionable_reason in ('derived_input_used', 'ytd_income_with_snapshot_balance_sheet') then 'requires_manual_policy' when questionable_reason = 'incomplete_period_coverage' then 'period_semantics' when questionable_reason is not null then 'cannot_fix' end fix_type from reasons)"
)


@query("select * from findings", *AUDITED, FINDINGS)
def m17_audit_findings(spark, sf_dir):
    return _joined(M.audit_findings(_engine(spark, sf_dir), S.facts(spark, sf_dir)), "warnings")


@query("select questionable_reason reason, fix_type, count(*) \"rows\", count(distinct entity) entities, string_agg(distinct metric_code, ',' order by metric_code) metrics from findings where status = 'questionable' group by all", *AUDITED, FINDINGS)
def m19_questionable_breakdown(spark, sf_dir):
    return _joined(M.questionable_breakdown(M.audit_findings(_engine(spark, sf_dir), S.facts(spark, sf_dir))), "metrics")


@query(
    "select *, case when decision = 'requires_market_data' then 'needs market value or dividends' when decision = 'requires_explicit_disclosure' then 'no EBITDA is stated in the reports' when metric_code in ('roe', 'roa') and periods_questionable > 0 then 'depends on how income is annualised and balances averaged'"
    " when metric_code = 'revenue_growth' and periods_questionable > 0 then 'growth of cumulative figures, not of single quarters' when periods_invalid > 0 then 'inputs of some quarter don''t cover the same period' when decision = 'usable' then 'every quarter is valid' when decision = 'not_available' then 'no quarter is valid'"
    " when periods_missing = 0 and periods_questionable = 0 then 'an input is derived' else 'some quarters are missing or open to question' end note from (" + ORACLES["m20_metric_decisions"] + ")"
)
def m20_decision_notes(spark, sf_dir):
    return M.decision_notes(M.metric_decisions(_audited(spark, sf_dir)))


@query(
    "select * from (select entity, case when metric_code in ('pe_ratio', 'ev_to_ebitda', 'dividend_yield') or (metric_code in ('ebitda_margin', 'net_debt_to_ebitda') and status = 'missing') then 'unsupported_by_policy' when metric_code in ('revenue_growth', 'roe', 'roa') then 'methodology_sensitive'"
    " when status = 'missing' and metric_code in ('operating_margin', 'net_margin', 'debt_to_equity', 'current_ratio', 'fcf', 'fcf_margin') then 'missing_but_expected' end kind, metric_code, period, status, case when metric_code in ('pe_ratio', 'ev_to_ebitda', 'dividend_yield') then 'market_valuation_required' when metric_code in ('ebitda_margin', 'net_debt_to_ebitda') then 'explicit_disclosure_required'"
    " when metric_code in ('revenue_growth', 'roe', 'roa') then 'methodology_sensitive' else 'core_statement_based' end support_class, case when metric_code in ('pe_ratio', 'ev_to_ebitda', 'dividend_yield') then 'market_or_valuation_inputs_required' when metric_code in ('ebitda_margin', 'net_debt_to_ebitda') then 'explicit_disclosure_required'"
    " when metric_code not in ('revenue_growth', 'roe', 'roa') then 'missing_expected_statement_inputs' end reason, case metric_code "
    + " ".join(f"when '{c}' then '{','.join(M.AUDIT_INPUTS[c])}'" for c in G.CORE) + " else '' end required from audited) where kind is not null",
    *AUDITED,
)
def m22_quality_items(spark, sf_dir):
    return _joined(G.metric_quality_items(_audited(spark, sf_dir)), "required")


SUPPORT_DOCUMENTS = (
    "docs as (select distinct entity, document_id, period, case when nation % 6 = 1 then 'fail' when nation % 6 = 2 or k % 5 <> 0 then 'pass' else 'partial' end st, case when nation % 8 = 4 then 'press_release' else source_role end r, nation from sources where nation % 10 <> 9),"
    "validated as (select entity, case when any_value(nation) % 9 = 8 then 'NOT_READY' else 'READY' end package_status, count(*) documents, count(*) filter (st = 'pass') passed, count(*) filter (st <> 'fail') usable, count(*) filter (r = 'press_release') press, count(*) filter (r = 'financial_statements') proper from docs group by entity)"
)


@query(
    "select entity, case when document_status = 'blocked' then 'SOURCE_BLOCKED' when pstatus = 'parser_blocked' then 'PARSER_BLOCKED' when confident_ratio < 0.7 or conflicts > 0 then 'LOW_CONFIDENCE' else 'AUTO_PARTIAL' end status, document_status, case when key_coverage >= 0.8 then 'sufficient' when canonical > 0 then 'partial' else 'missing' end fact_status,"
    " array_to_string(list_sort(list_distinct(list_filter([case when held then 'source_package_not_ready' end, case when documents = 0 then 'no_documents' end, case when document_status = 'blocked' and documents > 0 then 'no_document_passed' end, case when press > 0 and proper = 0 then 'press_releases_only' end,"
    " case when mblockers > 0 then 'valuation_without_market_inputs' end, case when failed > 0 then 'consistency_checks_failed' end, nullif(pblockers, '')], lambda x: x is not null))), ',') blockers, s1 financial_facts, s1 and calculated > 0 financial_metrics, s2 market_analysis, s3 peer_comparison, s4 llm_payload from ("
    "select *, case when held or documents = 0 or usable = 0 then 'blocked' when passed = documents then 'pass' else 'partial' end document_status from (select parser.entity, parser.status pstatus, parser.blockers pblockers, confident_ratio, key_coverage, conflicts, canonical, calculated, mq.blockers mblockers, coalesce(failed_checks, 0) failed, coalesce(package_status = 'NOT_READY', false) held,"
    " coalesce(documents, 0) documents, coalesce(passed, 0) passed, coalesce(usable, 0) usable, coalesce(press, 0) press, coalesce(proper, 0) proper, coalesce(s1, false) s1, coalesce(s2, false) s2, coalesce(s3, false) s3, coalesce(s4, false) s4 from parser join mq using (entity) left join penalty using (entity) left join validated using (entity)"
    " left join (select entity, bool_or(scope = 'statement_based_financials' and supported) s1, bool_or(scope = 'market_technical_analysis' and supported) s2, bool_or(scope = 'peer_comparison' and supported) s3, bool_or(scope = 'llm_summary' and supported) s4 from scopes group by entity) using (entity)))",
    *ALL, SOURCES, SUPPORT_DOCUMENTS, "scopes as (" + ORACLES["m23_readiness_scopes"] + ")",
)
def m24_support_report(spark, sf_dir):
    """Documents are an entity's source and quarter; some entities have none, only press releases, or a package that isn't ready."""
    metric, parser, checks = _parts(spark, sf_dir)
    nation, k = F.col("nation"), F.col("k")
    state = F.when(nation % 6 == 1, "fail").when((nation % 6 == 2) | (k % 5 != 0), "pass").otherwise("partial")
    role = F.when(nation % 8 == 4, "press_release").otherwise(F.col("source_role"))
    docs = S.two_sources(spark, sf_dir).where(nation % 10 != 9).select("entity", "document_id", "period", state.alias("st"), role.alias("r"), "nation").distinct()
    validated = docs.groupBy("entity").agg(
        F.when(F.max("nation") % 9 == 8, "NOT_READY").otherwise("READY").alias("package_status"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("st") == "pass").alias("passed"), F.count_if(F.col("st") != "fail").alias("usable"),
        F.count_if(F.col("r") == "press_release").alias("press"), F.count_if(F.col("r") == "financial_statements").alias("proper"),
    )
    return _joined(G.support_report(parser, metric, checks, m23_readiness_scopes(spark, sf_dir), validated), "blockers")


# ---- peers ----


@query("select target, entity, role, metric_code, case when metric_code <> 'pe_ratio' then round(value, 6) end as value, case when metric_code = 'pe_ratio' then 'unavailable' else status end status, case when metric_code = 'pe_ratio' then 'valuation_inputs_unavailable' when value is null then status end reason from ctable", *STRICTS, PEERS, TABLE)
def e3_valuation_cells(spark, sf_dir):
    return E.valuation_cells(_table(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "select entity, peers, usable usable_peers, compared compared_metrics, data_status, case when data_status = 'not_ready' or calculated = 0 then 'NOT_READY' when usable >= 2 then 'READY_WITH_LIMITATIONS' else 'PARTIAL' end readiness, concat_ws(',', case when calculated = 0 then 'comparison_table_metrics_unavailable' end, case when low > 0 then 'peer_ratios_low_coverage' end, case when missing <> '' then 'peer_ratios_report_missing' end,"
    " case when peers = 0 then 'peer_selection_not_ready' end, case when report = 'available_but_low_coverage' then 'target_ratios_low_coverage' end, case when report = 'missing_report' then 'target_ratios_report_missing' end, 'valuation_inputs_unavailable') blockers, missing missing_peers"
    " from (select *, case when report = 'missing_report' or peers = 0 then 'not_ready' when usable >= 2 and 2 * usable > peers then 'ready' else 'partial' end data_status from (select r.entity, coalesce(a.report, 'missing_report') report, coalesce(m.peers, 0) peers, coalesce(m.usable, 0) usable, coalesce(m.low, 0) low, coalesce(m.missing, '') missing, coalesce(c.calculated, 0) calculated, coalesce(c.compared, 0) compared"
    " from registry r left join avail a using (entity) left join (select target entity, count(*) peers, count(*) filter (report = 'available') usable, count(*) filter (report = 'available_but_low_coverage') low, coalesce(string_agg(peer, ',' order by peer) filter (report is null or report = 'missing_report'), '') missing from peers left join avail on avail.entity = peer where substr(target, 2)::int % 12 <> 6 group by target) m using (entity)"
    " left join (select target entity, count(*) filter (status = 'calculated' and metric_code <> 'pe_ratio') calculated, count(*) filter (status = 'calculated' and metric_code <> 'pe_ratio' and role = 'peer') compared from ctable group by target) c using (entity)))",
    *STRICTS, SUMMARY, PEERS, TABLE,
    "avail as (select entity, case when calculated_count < 2 then 'available_but_low_coverage' else 'available' end report from ssum where substr(entity, 2)::int % 8 <> 3)",
)
def e4_comparison_status(spark, sf_dir):
    """Every eighth entity has no report, and every twelfth no peers."""
    number = lambda c: F.substring(c, 2, 9).cast("int")
    registry, peers = S.registry(spark, sf_dir), _peers(spark, sf_dir)
    known = E.ratio_availability(registry, M.status_summary(_strict(spark, sf_dir))).where((number("entity") % 8 != 3) & (F.col("status") != "missing_report"))
    rows = E.comparison_status(registry, peers.where(number("target") % 12 != 6), known, _table(spark, sf_dir))
    return _joined(rows, "blockers", "missing_peers")


@query(f"select target, count(*) peer_count, count(fw.entity) available_peer_count, coalesce(string_agg(peer, ',' order by peer) filter (fw.entity is null), '') missing_peers from peers left join (select * from fw where period = '{TO}' and substr(entity, 2)::int % 4 <> 2) fw on fw.entity = peer group by target", FACTS, WIDE, REGISTRY, PEERS)
def e5_peer_counts(spark, sf_dir):
    wide = M.wide_facts(S.facts(spark, sf_dir).where("nation % 4 <> 2"))
    return _joined(E.peer_counts(E.peer_table(_peers(spark, sf_dir), wide, TO, ("revenue", "net_income"))), "missing_peers")


# ---- facts ----


PROMOTED = (
    "acts as (select *, case when review_status <> 'eligible' then 'blocked' when k % 6 = 1 or metric_code = 'capex' then 'skipped' else 'promoted' end act from reviewed),"
    "existing as (select entity, period, metric_code, value * 2 as value, quality_flag, confidence, case when k % 6 = 1 then 'parser' else 'reviewed_manual_upload' end provenance from facts where k % 6 in (1, 2))"
)


def _existing(spark, sf_dir):
    k = F.col("k")
    rows = S.facts(spark, sf_dir).where((k % 6).isin(1, 2))
    return rows.select(*D.KEY, (F.col("value") * 2).alias("value"), "quality_flag", "confidence", F.when(k % 6 == 1, "parser").otherwise("reviewed_manual_upload").alias("provenance"))


def _promoted(spark, sf_dir):
    return D.promote_reviewed(_existing(spark, sf_dir), _reviewed(spark, sf_dir), [c for c in M.CODES if c != "capex"])


@query(
    "select entity, period, metric_code, case when n.act is null then e.value else n.value end as value, case when n.act is null then quality_flag else 'reviewed_manual_upload' end quality_flag, case when n.act is null then confidence else 0.95::double end confidence, case when n.act is null then provenance else 'reviewed_manual_upload' end provenance"
    " from existing e full join (select * from acts where act = 'promoted') n using (entity, period, metric_code)",
    FACTS, REVIEWED, PROMOTED,
)
def f17_promoted_table(spark, sf_dir):
    return D.promoted_table(_existing(spark, sf_dir), _promoted(spark, sf_dir))


@query("select entity, count(*) filter (act = 'promoted') promoted, count(*) filter (act = 'skipped') skipped, count(*) filter (act = 'blocked') blocked from acts group by entity", FACTS, REVIEWED, PROMOTED)
def f17_promotion_counts(spark, sf_dir):
    return D.promotion_counts(_promoted(spark, sf_dir))


@query(
    "select g.*, case when g.status = 'missing' then 'not_extracted' else concat_ws(',', case when f.k % 9 = 4 then 'source_url_missing' end, case when f.k % 7 = 2 then 'source_location_missing' end) end warnings from (" + ORACLES["f18_fact_coverage_grid"] + ") g left join facts f on f.entity = g.entity and f.period = g.period and f.metric_code = g.metric_code",
    FACTS,
)
def f18_coverage_warnings(spark, sf_dir):
    facts, k = S.facts(spark, sf_dir), F.col("k")
    traced = facts.select(*A.KEY, F.when(k % 9 != 4, "u").alias("source_url"), F.when(k % 7 == 2, "").otherwise("page 3").alias("trace"))
    return _joined(A.coverage_warnings(A.fact_coverage_grid(facts, FROM, TO), traced), "warnings")


SOURCED = (
    "sdocs as (select distinct entity, document_id, period, source_role, case k % 3 when 0 then 'new' when 1 then 'downloaded' else 'parsed' end st from sources where nation % 9 <> 7),"
    "dcount as (select entity, count(*) documents, count(*) filter (st <> 'new') downloaded, count(*) filter (st = 'parsed') parsed, count(*) filter (source_role = 'financial_statements') documents_financial_statements, count(*) filter (source_role = 'financial_supplement') documents_financial_supplement, count(*) filter (source_role = 'annual_report') documents_annual_report, count(*) filter (source_role = 'press_release') documents_press_release from sdocs group by entity),"
    "fcount as (select entity, count(*) facts, count(*) filter (source_role = 'financial_statements') facts_financial_statements, count(*) filter (source_role = 'press_release') facts_press_release, count(*) filter (quality_flag in ('exact', 'derived') and confidence >= 0.7) confident, count(*) filter (quality_flag = 'low_confidence_parse' or confidence < 0.7) low_confidence, count(*) filter (quality_flag = 'conflicting_sources') conflicts,"
    " count(*) filter (period_type = 'quarter' and quality_flag = 'derived') derived_quarters, count(*) filter (nation % 4 = 1 and k % 23 = 0) untraced from sources where nation % 11 <> 5 group by entity),"
    "sourced as (select entity, " + ", ".join(f"coalesce({c}, 0) {c}" for c in ("documents", "downloaded", "parsed", *[f"documents_{r}" for r in A.COUNTED_ROLES], "facts", "facts_financial_statements", "facts_press_release", "confident", "low_confidence", "conflicts", "derived_quarters", "untraced")) + " from dcount full join fcount using (entity))"
)


def _source_summary(spark, sf_dir):
    k, nation = F.col("k"), F.col("nation")
    rows = S.two_sources(spark, sf_dir)
    status = F.when(k % 3 == 0, "new").when(k % 3 == 1, "downloaded").otherwise("parsed")
    documents = rows.where(nation % 9 != 7).select("entity", "document_id", "period", "source_role", status.alias("status")).distinct()
    facts = rows.where(nation % 11 != 5).withColumns({"source_url": F.lit("u"), "trace": F.when((nation % 4 == 1) & (k % 23 == 0), "").otherwise("page 3")})
    return A.source_summary(facts, documents)


@query("select * from sourced", FACTS, SOURCES, SOURCED)
def f20_source_summary(spark, sf_dir):
    return _source_summary(spark, sf_dir)


@query(
    "select entity, coalesce(m, 0) missing_key_facts, case when documents = 0 or facts = 0 or confident = 0 or facts_financial_statements = 0 or documents = documents_press_release or untraced > 0 then 'FAIL' when coalesce(m, 0) = 0 and low_confidence = 0 and conflicts = 0 then 'PASS' else 'PARTIAL' end status"
    " from sourced left join (select entity, count(*) filter (status = 'missing') m from (" + ORACLES["f18_fact_coverage_grid"] + ") group by entity) using (entity)",
    FACTS, SOURCES, SOURCED,
)
def f21_extraction_verdict(spark, sf_dir):
    return A.extraction_verdict(_source_summary(spark, sf_dir), A.fact_coverage_grid(S.facts(spark, sf_dir), FROM, TO))


@query(
    "select p.entity, round(score - case when canonical > 0 and not (loc and typ) then 0.10 else 0.0 end, 4) score, case when canonical = 0 then 'parser_blocked' when bl <> '' then 'fail' when status = 'pass' and not ctx then 'partial' else status end status, bl blockers, loc source_location_complete, typ period_type_complete, ctx statement_context_complete, roles forbidden_roles"
    " from (select *, concat_ws(',', case when forb then 'forbidden_source_roles' end, nullif(blockers, ''), case when nation % 7 = 6 then 'no_source_documents' end, case when not typ then 'period_type_missing' end, case when not loc then 'source_location_missing' end) bl, case when forb then 'press_release' else '' end roles from parser join whole using (entity)) p",
    FACTS, "parser as (" + ORACLES["f22_parser_quality"] + ")",
    "whole as (select entity, any_value(nation) nation, count(*) filter (k % 23 = 0 and nation % 2 = 0) = 0 and count(*) > 0 loc, count(*) filter (nation % 10 = 4 and k % 6 = 5) = 0 typ, count(*) filter (nation % 5 = 3 and k % 8 = 1) = 0 ctx, count(*) filter (nation % 3 = 1 and k % 19 = 0) > 0 forb from facts where quality_flag <> 'low_confidence_parse' group by entity)",
)
def f22_traced_quality(spark, sf_dir):
    k, nation = F.col("k"), F.col("nation")
    facts = S.facts(spark, sf_dir)
    seen = facts.withColumns({
        "trace": F.when((k % 23 != 0) | (nation % 2 != 0), "page 3"), "period_type": F.when(~((nation % 10 == 4) & (k % 6 == 5)), F.col("period_type")),
        "statement_type": F.when(~((nation % 5 == 3) & (k % 8 == 1)), F.col("statement_type")), "source_role": F.when((nation % 3 == 1) & (k % 19 == 0), "press_release").otherwise("financial_statements"),
    })
    documents = facts.where("nation % 7 <> 6")
    return _joined(A.traced_parser_quality(A.parser_quality(facts), A.parser_completeness(seen), documents), "blockers", "forbidden_roles")


FAMILIES = (
    "fam as (select *, case when metric_code in ('operating_cash_flow', 'capex') then 'cash_flow' else statement_type end family from facts), tabs as (select * from fam where nation % 4 <> 0 or family = 'balance_sheet'), struct as (select * from fam where not (nation % 3 = 1 and family = 'income_statement')),"
    "cover as (select g.entity, g.family, t.n is not null found, coalesce(t.n, 0) \"tables\", coalesce(t.p, '') periods from (select entity, family from (select distinct entity from tabs), (values ('balance_sheet'), ('income_statement'), ('cash_flow')) v(family)) g left join (select entity, family, count(*) n, string_agg(distinct period, ',' order by period) p from tabs group by all) t on t.entity = g.entity and t.family = g.family)"
)


def _families(spark, sf_dir):
    family = F.when(F.col("metric_code").isin("operating_cash_flow", "capex"), "cash_flow").otherwise(F.col("statement_type"))
    facts = S.facts(spark, sf_dir).withColumn("statement_type", family)
    return D.statement_coverage(facts.where("nation % 4 <> 0 or statement_type = 'balance_sheet'")), facts.where("not (nation % 3 = 1 and statement_type = 'income_statement')")


@query("select c.*, coalesce(n, 0) facts, coalesce(codes, '') key_facts, case when not found then 'missing' when n > 0 then 'complete' else 'detected_without_facts' end status from cover c left join (select entity, family, count(*) n, string_agg(distinct metric_code, ',' order by metric_code) codes from struct group by all) using (entity, family)", FACTS, FAMILIES)
def f28_family_completeness(spark, sf_dir):
    return _joined(D.family_completeness(*_families(spark, sf_dir)), "key_facts")


@query("select entity, bool_and(found) required_found, coalesce(string_agg(family, ',' order by family) filter (not found), '') missing from cover group by entity", FACTS, FAMILIES)
def f28_missing_families(spark, sf_dir):
    return _joined(D.missing_families(_families(spark, sf_dir)[0]), "missing")


@query(
    "select d.document_id, coalesce(b.e, d.period) effective_period, b.c comparative_period, coalesce(b.s, 'upload_default') period_source, coalesce(b.q, 0.1::double) period_confidence from (select distinct document_id || '/' || period document_id, period from sources) d left join"
    " (select document_id || '/' || period document_id, period e, (idx // 4 - 1) || 'Q' || (idx % 4 + 1) c, quality_flag s, confidence - abs(length(metric_code) - 9) / 100.0::double q, row_number() over (partition by document_id, period order by confidence - abs(length(metric_code) - 9) / 100.0::double desc, metric_code) place from sources where k % 4 <> 0 and length(metric_code) % 3 <> 0) b on b.document_id = d.document_id and b.place = 1",
    FACTS, SOURCES,
)
def f28_period_resolution(spark, sf_dir):
    """A source's quarter is a document, each of its facts a table."""
    rows = S.two_sources(spark, sf_dir).withColumn("document_id", F.concat_ws("/", "document_id", "period"))
    tables = rows.select(
        "document_id", F.col("metric_code").alias("table_id"), F.expr("case when k % 4 <> 0 and length(metric_code) % 3 <> 0 then period end").alias("effective_period"), F.expr("concat(idx div 4 - 1, 'Q', idx % 4 + 1)").alias("comparative_period"), F.col("quality_flag").alias("period_source"),
        (F.col("confidence") - F.abs(F.length("metric_code") - 9) / F.lit(100.0)).alias("period_confidence"),
    )
    return D.period_resolution(rows.select("document_id", "period").distinct(), tables)


@query(
    "select blocker, count(distinct entity) entities from (select entity, 'missing_facts' blocker from levels where m union all select entity, 'period_semantics' from levels where b union all select entity, 'sector_policy' from levels where u union all select entity, 'valuation_inputs' from levels) group by blocker order by entities desc, blocker limit 10",
    *STRICTS, SUMMARY, LEVELS,
)
def c5_support_blockers(spark, sf_dir):
    return D.support_blockers(_levels(spark, sf_dir))


# ---- portfolio ----


CACHE = (
    "cdocs as (select entity, period, idx, source_role, case when nation % 5 = 0 or (nation % 5 = 1 and k % 2 = 0) then 'manual_upload' when nation % 5 = 2 and k % 3 = 0 then 'fixture' else 'web' end st, case when nation % 7 = 6 then 'new' when nation % 3 = 0 and k % 10 = 0 then 'failed' else 'parsed' end state from sources),"
    "cached as (select r.entity, case when n is null then 'NOT_CACHED' else case when n = 12 then 'CACHED_VALIDATED' else 'CACHED_PARTIAL' end || case when am then '_MANUAL' when sm then '_WITH_MANUAL' else '' end end documents_status from registry r left join"
    " (select entity, count(distinct idx) n, bool_and(st = 'manual_upload') am, bool_or(st = 'manual_upload') sm from cdocs where state = 'parsed' and source_role = 'financial_statements' and st <> 'fixture' and idx between 7984 and 7995 group by entity) using (entity))"
)


def _cached(spark, sf_dir):
    k, nation = F.col("k"), F.col("nation")
    kind = F.when((nation % 5 == 0) | ((nation % 5 == 1) & (k % 2 == 0)), "manual_upload").when((nation % 5 == 2) & (k % 3 == 0), "fixture").otherwise("web")
    state = F.when(nation % 7 == 6, "new").when((nation % 3 == 0) & (k % 10 == 0), "failed").otherwise("parsed")
    documents = S.two_sources(spark, sf_dir).select("entity", "period", "source_role", kind.alias("source_type"), state.alias("status"))
    return C.cached_documents_status(S.registry(spark, sf_dir), documents, FROM, TO)


@query("select * from cached", FACTS, SOURCES, REGISTRY, CACHE)
def c1_cached_documents(spark, sf_dir):
    return _cached(spark, sf_dir)


SCOPES = "scopes as (" + ORACLES["m23_readiness_scopes"] + ")"
SCOPED = "scoped as (select entity, max(case when scope = 'statement_based_financials' then status end) statement_status, max(case when scope = 'market_technical_analysis' then status end) market_status, max(case when scope = 'market_valuation' then status end) valuation_status from scopes group by entity)"


def _scoped(spark, sf_dir):
    names = {"statement_status": "statement_based_financials", "market_status": "market_technical_analysis", "valuation_status": "market_valuation"}
    return m23_readiness_scopes(spark, sf_dir).groupBy("entity").agg(*[F.max(F.when(F.col("scope") == scope, F.col("status"))).alias(c) for c, scope in names.items()])


@query(
    "select count(*) companies_scanned, count(*) filter (substr(entity, 2)::int % 4 <> 3) source_ready_count, count(*) filter (documents_status = 'CACHED_VALIDATED') cached_documents_ready_count, count(*) filter (statement_status = 'AUTO_READY') statement_scope_auto_ready_count,"
    " count(*) filter (statement_status = 'AUTO_PARTIAL') statement_scope_auto_partial_count, count(*) filter (market_status = 'AUTO_READY') market_technical_ready_count, count(*) filter (valuation_status in ('UNAVAILABLE', 'UNSUPPORTED')) valuation_unavailable_count from cached left join scoped using (entity)",
    *ALL, SOURCES, REGISTRY, CACHE, SCOPES, SCOPED,
)
def c4_ready_counts(spark, sf_dir):
    rows = _cached(spark, sf_dir).hint("merge").join(_scoped(spark, sf_dir).hint("merge"), "entity", "left")
    return C.ready_counts(rows.withColumn("source_status", F.when(F.substring("entity", 2, 9).cast("int") % 4 != 3, "READY").otherwise("PARTIAL")))


@query(
    "select entity, status, score, legacy_score, missing_facts, next_action, coalesce(entity = (select entity from r6 where status <> 'AUTO_READY' order by score, missing_facts desc, entity limit 1), false) weakest from r6",
    *ALL, SCOPES, SCOPED,
    "q6 as (" + ORACLES["m22_quality_items"] + "),"
    "r6 as (select mq.entity, coalesce(statement_status, 'UNSUPPORTED') status, mq.score, legacy_score, coalesce(n, 0) missing_facts, case when substr(mq.entity, 2)::int % 6 = 5 then 'resolve_source_package' when statement_status = 'AUTO_READY' then 'extend_other_scopes' when list_contains(fs, 'current_assets') and list_contains(fs, 'current_liabilities') then 'inspect_balance_sheet'"
    " when list_contains(fs, 'operating_profit') or list_contains(fs, 'net_income') then 'inspect_income_statement' when list_contains(fs, 'operating_cash_flow') or list_contains(fs, 'capex') then 'inspect_cash_flow' else 'review_missing_inputs' end next_action from mq left join scoped using (entity)"
    " left join (select entity, round(count(*) filter (status = 'valid') / count(*), 4) legacy_score from audited group by entity) using (entity) left join (select entity, count(distinct fact || '/' || metric_code) n, list(distinct fact) fs from (select entity, metric_code, unnest(string_split(required, ',')) fact from q6 where kind = 'missing_but_expected') group by entity) using (entity))",
)
def c6_scope_readiness(spark, sf_dir):
    audited = _audited(spark, sf_dir)
    packages = S.registry(spark, sf_dir).select("entity", F.when(F.substring("entity", 2, 9).cast("int") % 6 == 5, "PARTIAL").otherwise("READY").alias("status"))
    statement = _scoped(spark, sf_dir).select("entity", F.col("statement_status").alias("status"))
    return C.scope_readiness(audited, G.metric_quality(audited), statement, G.metric_quality_items(audited), packages)


@query(
    "select *, case when known then 'https://portal.test/company.aspx?id=' || id end company_url, case when known then 'https://portal.test/files.aspx?id=' || id || '&type=4' end files_type_4_url, case when known then 'https://portal.test/files.aspx?id=' || id || '&type=3' end files_type_3_url, case when known then 'https://portal.test/files.aspx?id=' || id || '&type=2' end files_type_2_url,"
    " lower(name) || ',' || entity || ',' || name search_terms, case when known then 'known_company_id' else 'search_only' end link_status from (" + ORACLES["c8_top_n_by_value"] + "), lateral (select 100 + substr(entity, 2)::int id, substr(entity, 2)::int % 3 <> 1 known)"
)
def c8_links(spark, sf_dir):
    number = F.substring("entity", 2, 9).cast("int")
    registry = S.registry(spark, sf_dir)
    ids = registry.select("entity", F.when(number % 3 != 1, (number + 100).cast("string")).alias("company_id"), F.array(F.lower("name"), F.lit(" ")).alias("names"))
    rows = C.with_links(C.top_n_by_value(registry, 10), ids, "https://portal.test").withColumns({"id": number + 100, "known": number % 3 != 1})
    return _joined(rows, "search_terms")
