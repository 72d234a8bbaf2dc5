"""Queries of statement tables and periods; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import statements as R
from ..sources import fixtures as S
from .queries import FACTS, REGISTRY, query

#: Labels of derived statement rows, one an order, and the aliases that name a metric.
LABELS = ("Total assets", "Total current assets", "Revenue", "Segment revenue", "Cash and cash equivalents at the end of the period", "Cash and cash equivalents at beginning of the year", "Net income", "Note 5", "", "Operating activities", "Inventories", "total equity", "Current assets other", "Net income for owners")
RULES = [("total assets", "total_assets"), ("current assets", "current_assets"), ("revenue", "revenue"), ("cash and cash equivalents", "cash_and_equivalents"), ("net income", "net_income"), ("total equity", "total_equity")]
TYPES = ("balance_sheet", "income_statement", "cash_flow", "notes")


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _rows(spark, sf_dir):
    """Statement rows, one an order: labels, headers and gaps by the keys, values of the order's price."""
    spaced = lambda c: F.replace(F.format_number(F.floor(c), 0), F.lit(","), F.lit(" "))
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    period = F.expr("concat(year(o_orderdate), 'Q', quarter(o_orderdate))")
    rows = S.table(spark, sf_dir, "orders").select(
        c.alias("document_id"), o.alias("row_index"), _pick(LABELS, (c + o) % 14).alias("label"), _pick(TYPES, F.floor(o / 8) % 4).alias("statement_type"), period.alias("period"), F.expr("year(o_orderdate)").alias("y"),
        (F.floor(o / 32) % 4).alias("style"), F.when(c % 7 == 0, "n/a").otherwise(spaced("o_totalprice")).alias("a"), F.when(c % 7 == 0, "n/a").otherwise(spaced(F.col("o_totalprice") / 2)).alias("b"),
        F.when(o % 5 == 0, "7").alias("note_ref"), F.when(c % 17 != 0, (o % 90).cast("int")).alias("page_number"), F.lit(1000.0).alias("unit_multiplier"), F.when(c % 2 == 0, "industrial_oil").otherwise("bank").alias("issuer_class"),
        F.when(c % 19 == 0, 0.5).otherwise(0.9).alias("label_confidence"), F.when(c % 23 == 0, 0.6).otherwise(0.9).alias("ownership_confidence"), F.when(c % 29 == 0, 0.5).otherwise(0.85).alias("period_confidence"),
    )
    cell = lambda k, v: F.struct(k.cast("string").alias("key"), v.alias("raw"))
    y, a, b, note = F.col("y"), F.col("a"), F.col("b"), cell(F.lit("note"), F.col("note_ref"))
    december = lambda n: F.concat(F.lit("31 December "), (y - n).cast("string"))
    cells = (
        F.when(F.col("style") == 0, F.array(cell(F.col("period"), a), cell(F.concat((y - 1).cast("string"), F.substring("period", 5, 2)), b)))
        .when(F.col("style") == 1, F.array(cell(december(0), a), cell(december(1), b))).when((F.col("style") == 2) & F.col("note_ref").isNotNull(), F.array(note, cell(F.lit("amount"), a)))
        .when(F.col("style") == 2, F.array(cell(F.lit("amount"), a))).otherwise(F.array(cell(F.lit("x"), a), cell(F.lit("z"), b)))
    )
    return rows.withColumn("cells", cells)


def _metric():
    return X.match_label(F.col("label"), RULES)


def _known(plain):
    return X.match_normal(plain, RULES)


ROWS = (
    "srows as (select o_custkey d, o_orderkey r, (o_custkey + o_orderkey) % 14 l, ['Total assets','Total current assets','Revenue','Segment revenue','Cash and cash equivalents at the end of the period','Cash and cash equivalents at beginning of the year','Net income','Note 5','','Operating activities','Inventories','total equity','Current assets other','Net income for owners'][(o_custkey + o_orderkey) % 14 + 1] label,"
    " ['total_assets','current_assets','revenue','revenue','cash_and_equivalents','cash_and_equivalents','net_income',null,null,null,null,'total_equity','current_assets','net_income'][(o_custkey + o_orderkey) % 14 + 1] metric,"
    " ['balance_sheet','income_statement','cash_flow','notes'][(o_orderkey // 8) % 4 + 1] st, year(o_orderdate) y, quarter(o_orderdate) q, year(o_orderdate) || 'Q' || quarter(o_orderdate) period, (o_orderkey // 32) % 4 s, o_custkey % 7 <> 0 has, o_orderkey % 5 = 0 note,"
    " o_custkey % 2 = 0 oil, floor(o_totalprice) p from orders),"
    "kinds as (select *, has or (s = 2 and note) hv, case when label = '' then case when has or (s = 2 and note) then 'numeric_fragment' else 'unknown' end when l = 7 then 'footnote' when note and not (has or s = 2) then 'note_reference_only' when l in (0, 1, 11) then 'grand_total'"
    " when l = 9 and st = 'cash_flow' and not (has or (s = 2 and note)) then 'section_title' when has or (s = 2 and note) then 'statement_line_item' when l = 12 then 'section_title' else 'unknown' end kind from srows),"
    "gated as (select *, case when metric is null then 'metric_not_mapped' when st = 'balance_sheet' then case when l in (0, 11) and kind <> 'grand_total' then 'subtotal_without_statement_context' end"
    " when st = 'income_statement' then case when oil and l = 3 then 'component_row_not_total_metric' when kind not in ('statement_line_item', 'grand_total') then 'row_kind_not_statement_line_item' end"
    " when st = 'cash_flow' then case when kind <> 'statement_line_item' then 'row_kind_not_statement_line_item' when l = 5 then 'component_row_not_total_metric' end else 'statement_family_ambiguous' end gate,"
    " case when st = 'notes' then 'statement_family_ambiguous' when label = '' or not hv then 'label_ownership_unresolved' when d % 17 = 0 then 'policy_blocked' when d % 19 = 0 or d % 23 = 0 then 'label_ownership_unresolved' when d % 29 = 0 then 'period_header_ambiguous' end promoted,"
    " case when not hv then 'numeric_value_not_detected' when not has then null when s = 3 or (s = 1 and q <> 4 and st <> 'balance_sheet') then 'ambiguous_period_column' end pick,"
    " case when not hv then null when not has then 7.0 when s = 3 or (s = 1 and q <> 4 and st <> 'balance_sheet') then null else p end v from kinds),"
    "parsed as (select *, coalesce(gate, promoted, pick) reason from gated)"
)


@query(
    "select d document_id, r row_index, case when st = 'notes' then 'review_only_note' when s = 0 then 'primary_statement' when s = 1 then 'primary_statement_degraded_but_usable' when s = 2 then 'primary_statement_degraded_unusable' else 'primary_statement_degraded_but_usable' end \"role\" from srows",
    ROWS,
)
def t10_classify_table_role(spark, sf_dir):
    s = F.col("style")
    structure, method = F.when(s == 0, "standard").when(s == 1, "degraded").otherwise("broken"), F.when(s == 3, "text_table_fallback").otherwise("grid")
    return _rows(spark, sf_dir).select("document_id", "row_index", R.table_role(F.col("statement_type"), structure, method).alias("role"))


@query("select d document_id, r row_index, kind, case kind when 'grand_total' then 0.95 when 'statement_line_item' then case when r % 3 = 0 then 0.9 else 0.82 end when 'section_title' then 0.55 when 'numeric_fragment' then 0.35 else 0.4 end::double confidence from kinds", ROWS)
def t11_classify_row_kind(spark, sf_dir):
    has = F.exists("cells", lambda c: F.translate(c["raw"], " ", "").rlike(r"^\d+$"))
    rows = _rows(spark, sf_dir).withColumn("kind", R.row_kind(F.col("label"), has, F.col("note_ref").isNotNull(), F.col("statement_type")))
    return rows.select("document_id", "row_index", "kind", R.row_confidence(F.col("kind"), F.col("row_index") % 3 == 0).alias("confidence"))


@query("select d document_id, r row_index, case when gate is null then metric end metric, gate reason from gated", ROWS)
def t12_gate_statement_row(spark, sf_dir):
    has = F.exists("cells", lambda c: F.translate(c["raw"], " ", "").rlike(r"^\d+$"))
    rows = _rows(spark, sf_dir).withColumn("kind", R.row_kind(F.col("label"), has, F.col("note_ref").isNotNull(), F.col("statement_type"))).withColumn("metric", _metric())
    return rows.select("document_id", "row_index", R.row_gate(F.col("label"), F.col("kind"), F.col("metric"), F.col("statement_type"), F.col("issuer_class")).alias("g")).select("document_id", "row_index", "g.metric", "g.reason")


@query("select d document_id, r row_index, case when pick is null then case when not has then '7' else replace(format('{:,}', p::bigint), ',', ' ') end end as raw, case when pick is null then case when not has then 'note' when s = 0 then period when s = 1 then '31 December ' || y else 'amount' end end as \"key\", pick reason from gated", ROWS)
def t13_select_current_value(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("document_id", "row_index", R.current_value(F.col("cells"), F.col("period"), F.col("statement_type")).alias("v")).select("document_id", "row_index", "v.raw", "v.key", "v.reason")


@query("select d document_id, r row_index, promoted reason from gated", ROWS)
def t14_promote_row(spark, sf_dir):
    has = F.exists("cells", lambda c: F.translate(c["raw"], " ", "").rlike(r"^\d+$"))
    cols = [F.col(c) for c in ("document_id", "page_number", "label_confidence", "ownership_confidence", "period_confidence")]
    return _rows(spark, sf_dir).select("document_id", "row_index", R.promotion_reason(F.col("statement_type"), F.col("label"), has, *cols).alias("reason"))


@query(
    "select d document_id, r row_index, st statement_type, period, kind, case when reason is null then metric end metric_code, case when reason is null then v * 1000 end as value, case when reason is null then 'fact' when gate = 'metric_not_mapped' and hv then 'evidence' else 'rejected' end outcome, reason from parsed",
    ROWS,
)
def t16_parse_statement_rows(spark, sf_dir):
    return R.parse_statement_rows(_rows(spark, sf_dir), _known).drop("raw_value")


@query(
    "select d document_id, facts, rejected, evidence, missing, case when facts > 0 then 'true' when evidence > 0 then 'limited_evidence_only' else 'false' end llm_ready, case when facts > 0 and len(string_split(missing, ',')) * (missing <> '')::int <= greatest(2, facts // 6) then 'strong' when facts > 0 then 'partial' when evidence > 0 then 'weak' else 'blocked' end grade from ("
    " select d, count(*) filter (reason is null) facts, count(*) filter (reason is not null and not (gate is not distinct from 'metric_not_mapped' and hv)) rejected, count(*) filter (gate = 'metric_not_mapped' and hv) evidence,"
    " array_to_string(list_filter(['current_assets', 'net_income', 'revenue', 'total_assets'], lambda x: not coalesce(list_contains(list(metric) filter (reason is null), x), false)), ',') missing from parsed group by d)",
    ROWS,
)
def f30_analysis_readiness(spark, sf_dir):
    return R.analysis_readiness(R.parse_statement_rows(_rows(spark, sf_dir), _known), ["revenue", "net_income", "total_assets", "current_assets"])


@query(
    "select document_id, row_index, raw_value, concat_ws(',', case when length(raw_value) <= 2 then 'raw_value_looks_like_note_reference' end, case when pre then 'raw_value_looks_like_note_prefixed_amount' end, case when low then 'lower_trust_text_fallback_statement_row' end) reasons from ("
    " select d document_id, r row_index, case when r % 6 = 0 and has then '12 ' else '' end || case when not has then '7' else replace(format('{:,}', p::bigint), ',', ' ') end raw_value, r % 6 = 0 and has pre, r % 4 = 1 low from parsed where reason is null and (p >= 1000 or not has)) where length(raw_value) <= 2 or pre or low",
    ROWS,
)
def f32_suspicious_facts(spark, sf_dir):
    facts = R.parse_statement_rows(_rows(spark, sf_dir), _known).where((F.col("outcome") == "fact") & ((F.length("raw_value") >= 5) | (F.col("raw_value") == "7")))
    raw = F.when((F.col("row_index") % 6 == 0) & (F.col("raw_value") != "7"), F.concat(F.lit("12 "), "raw_value")).otherwise(F.col("raw_value"))
    found = R.suspicious_facts(facts.withColumns({"raw_value": raw, "low_trust": F.col("row_index") % 4 == 1}))
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "select d document_id, r row_index, case when takes then trim(label || ' ' || coalesce(nl, '')) else label end label, case when takes then nv else v end \"values\", takes stitched from (select *, coalesce(lag(takes) over w, false) given from (select *, not hv and label <> '' and kind not in ('footnote', 'grand_total') and coalesce(nhv, false) and (nl = '' or nl = 'total equity') takes from ("
    " select d, r, label, kind, hv, case when hv then p::bigint::varchar else '' end v, lead(label) over w nl, lead(case when hv then p::bigint::varchar else '' end) over w nv, lead(hv) over w nhv from (select * exclude (hv, kind), r % 3 <> 0 hv, case when l = 7 then 'footnote' when l in (0, 1, 11) then 'grand_total' else 'item' end kind from srows join (select r rr, has hv, label kind from srows) on r = rr) window w as (partition by d order by r)) window w as (partition by d order by r)) window w as (partition by d order by r)) where not given",
    ROWS,
)
def t17_stitch_rows(spark, sf_dir):
    has = F.col("row_index") % 3 != 0
    label = F.col("label")
    kind = F.when(label == "Note 5", "footnote").when(label.isin("Total assets", "Total current assets", "total equity"), "grand_total").otherwise("item")
    rows = _rows(spark, sf_dir).join(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), "o_totalprice"), "row_index")
    value = F.when(has, F.floor("o_totalprice").cast("string")).otherwise("")
    out = R.stitch_rows(rows.select("document_id", F.lit(0).alias("table_index"), "row_index", "label", kind.alias("kind"), has.alias("has_values"), value.alias("values")))
    return out.drop("table_index")


STEMS = "stems as (select p_partkey k, p_type, list_sort(list_distinct(list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: case when length(w) > 4 and w like '%ies' then left(w, length(w) - 3) || 'y' when length(w) > 4 and w like '%es' then left(w, length(w) - 2) when length(w) > 3 and w like '%s' then left(w, length(w) - 1) else w end), lambda w: w <> '' and w not in ('and','or','the','for','of','to','from','on','other','net','total') and not regexp_full_match(w, '[0-9]+')))) t from part)"


@query(
    "select a.k p_partkey, array_to_string(a.t, ' ') stems, case when a.k % 5 = 0 and b.k % 3 = 0 then left(a.p_type, 5) = left(b.p_type, 5) when len(a.t) = 0 or len(b.t) = 0 then false else a.t = b.t or greatest(len(list_intersect(a.t, b.t)) / len(a.t), len(list_intersect(a.t, b.t)) / len(b.t)) >= 0.75 end matches from stems a join stems b on b.k = a.k + 1",
    STEMS,
)
def t29_label_similarity(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").select(F.col("p_partkey"), F.substring("p_type", 1, 5).alias("kind"), R.label_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    after = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"), F.when((F.col("p_partkey")) % 3 == 0, F.col("kind")).alias("other"))
    mine = F.when(F.col("p_partkey") % 5 == 0, F.col("kind"))
    return rows.join(after, "p_partkey").select("p_partkey", F.array_join("t", " ").alias("stems"), R.labels_match(F.col("t"), F.col("u"), mine, F.col("other")).alias("matches"))


#: Titles put before the documents' texts, by doc_id.
TITLES = (
    "Consolidated Balance Sheet: total assets, current assets at 2021", "Contents", "Notes to the financial statements", "Statement of cash flows", "Statement of profit or loss. Revenue", "We have audited debt", "Бухгалтерский баланс", "Отчёт о финансовых результатах",
    "Total assets and current liabilities 2020", "Segment information", "Statement of changes in equity", "Operating activities, investing activities; financing activities", "Net cash from operating activities", "", "Cash and cash equivalents", "contents: report on review, independent auditor, consolidated balance sheet",
)
PAGES = (
    "titled as (select doc_id, ['Consolidated Balance Sheet: total assets, current assets at 2021','Contents','Notes to the financial statements','Statement of cash flows','Statement of profit or loss. Revenue','We have audited debt','Бухгалтерский баланс','Отчёт о финансовых результатах','Total assets and current liabilities 2020','Segment information','Statement of changes in equity',"
    "'Operating activities, investing activities; financing activities','Net cash from operating activities','','Cash and cash equivalents','contents: report on review, independent auditor, consolidated balance sheet'][doc_id % 16 + 1] || ' ' || coalesce(text, '') x, case when (doc_id // 16) % 2 = 0 then 'IFRS' else 'RAS' end std from documents),"
    "plain as (select *, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) c, trim(regexp_replace(regexp_replace(translate(lower(x), 'ё', 'е'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) t from titled)"
)


def _has(column: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _sum(column: str, *words: str) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::int" for w in words) + ")"


TOC_SQL = "(starts_with(t, 'contents ') or t = 'contents' or (contains(t, 'contents') and " + _sum("t", "report on review", "independent auditor", "consolidated balance sheet", "consolidated statement of comprehensive income", "consolidated statement of cash flows", "notes to the consolidated") + " >= 3))"
AUDIT_SQL = _has("t", "independent auditor", "auditor s report", "report on review", "we have audited", "we have reviewed", "auditor s responsibilities")
NOTES_SQL = _has("t", "notes to consolidated financial statements", "notes to the consolidated financial statements", "notes to the consolidated interim condensed financial", "notes to financial statements", "notes to the financial statements", "примечания к обобщенной консолидированной финансовой отчетности", "примечания к консолидированной финансовой отчетности", "примечания к финансовой отчетности").replace("financial')", "financial information') or contains(t, 'notes to the consolidated interim condensed financial statements')")
CASH_SQL = "case when std = 'RAS' then contains(t, 'отчет о движении денежных средств') or " + _sum("t", "денежные потоки от операционной деятельности", "денежные потоки от инвестиционной деятельности", "денежные потоки от финансовой деятельности", "чистое увеличение денежных средств", "чистое уменьшение денежных средств") + " >= 2 else " + _has("t", "statement of cash flows", "отчет о движении денежных средств") + " or " + _sum("t", "operating activities", "investing activities", "financing activities", "net increase in cash", "net decrease in cash", "cash and cash equivalents at end of period", "cash and cash equivalents at the end of the period") + " >= 3 end"
B_TITLE, I_TITLE = _has("t", "statement of financial position", "balance sheet", "отчет о финансовом положении"), _has("t", "statement of profit or loss", "statement of comprehensive income", "statement of income", "отчет о прибылях и убытках")
B_ROWS = _sum("t", "total assets", "current assets", "non current assets", "total equity", "total equity and liabilities", "current liabilities", "non current liabilities", "итого активов", "обязательства", "собственных средств") + " >= 2"
I_ROWS = _sum("t", "sales", "revenue", "operating profit", "profit for the period", "profit for the year", "profit before profit tax", "total comprehensive income", "прибыль за год", "процентные доходы", "чистые процентные доходы", "комиссионные доходы") + " >= 1"
RAS_SQL = "when std = 'RAS' and contains(t, 'бухгалтерский баланс') then 'balance_sheet' when std = 'RAS' and contains(t, 'отчет о финансовых результатах') then 'income_statement'"


@query(
    "select doc_id, case when contains(c, 'statement of changes in equity') then 'changes_in_equity' when contains(c, 'statement of cash flows') then 'cash_flow' when contains(c, 'net cash from operating activities') then 'cash_flow_note' when " + _has("c", "statement of comprehensive income", "statement of profit or loss") + " then 'profit_or_loss' when " + _has("c", "balance sheet", "statement of financial position") + " then 'financial_position' when " + _has("c", "debt", "borrowings")
    + " then 'debt_note' when contains(c, 'segment information') then 'segment_note' when contains(c, 'cash and cash equivalents') then 'cash_note' when contains(c, 'financial risk factors') then 'financial_risk_note' else 'unknown' end context,"
    f" case when {TOC_SQL} or {AUDIT_SQL} then 'unknown' when {NOTES_SQL} then 'notes' when {CASH_SQL} then 'cash_flow' {RAS_SQL} when {B_TITLE} then 'balance_sheet' when {I_TITLE} then 'income_statement' when {B_ROWS} and regexp_matches(t, '\\b20\\d\\d\\b') then 'balance_sheet' when {I_ROWS} and regexp_matches(t, '\\b20\\d\\d\\b') then 'income_statement' when contains(t, 'statement of changes in equity') then 'changes_in_equity' when contains(t, 'notes') or contains(t, 'note ') then 'notes' else 'unknown' end family,"
    f" case when t = '' or {TOC_SQL} or {NOTES_SQL} or {AUDIT_SQL} then 'unknown' {RAS_SQL} when {B_TITLE} and {B_ROWS} then 'balance_sheet' when {I_TITLE} and {I_ROWS} then 'income_statement' when {CASH_SQL} then 'cash_flow' else 'unknown' end primary_family from plain",
    PAGES,
)
def t9_classify_statement(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", _pick(TITLES, F.col("doc_id") % 16), F.coalesce("text", F.lit(""))).alias("text"), F.when(F.floor(F.col("doc_id") / 16) % 2 == 0, "IFRS").otherwise("RAS").alias("reporting_standard"))
    return R.with_statement_family(docs).select("doc_id", R.statement_context(F.col("text")).alias("context"), "family", "primary_family")


@query(
    "select doc_id document_id, page, arg_max(family, line) family from (select doc_id, line, cast(regexp_extract(t, '(\\d{1,3})\\s*$', 1) as integer) page, case when contains(t, 'balance sheet') then 'balance_sheet' when contains(t, 'statement of income') or contains(t, 'statement of profit or loss') then 'income_statement' when contains(t, 'statement of cash flows') then 'cash_flow' when contains(t, 'statement of changes in equity') then 'changes_in_equity' end family from ("
    " select doc_id, line, trim(regexp_replace(regexp_replace(lower(raw), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) t from (select doc_id, unnest(string_split(x, chr(10))) raw, generate_subscripts(string_split(x, chr(10)), 1) line from (select doc_id, 'CONTENTS' || chr(10) || 'Consolidated balance sheet ... ' || (doc_id % 90) || chr(10) || 'Statement of income ' || (doc_id % 7) || chr(10) || 'Statement of cash flows, page ' || (doc_id % 7) || chr(10) || 'Statement of changes in equity 12' || chr(10) || coalesce(text, '') x from documents where doc_id % 3 <> 0)))"
    " where regexp_matches(t, '\\d\\s*$')) where family is not null group by all"
)
def t31_expected_pages_from_toc(spark, sf_dir):
    k = F.col("doc_id")
    lines = F.concat_ws("\n", F.lit("CONTENTS"), F.concat(F.lit("Consolidated balance sheet ... "), k % 90), F.concat(F.lit("Statement of income "), k % 7), F.concat(F.lit("Statement of cash flows, page "), k % 7), F.lit("Statement of changes in equity 12"), F.coalesce("text", F.lit("")))
    return R.expected_pages(S.table(spark, sf_dir, "documents").select(k.alias("document_id"), lines.alias("text"), F.when(k % 3 == 0, "RAS").otherwise("IFRS").alias("reporting_standard")))


@query("select p_partkey, p_name || case when p_partkey % 3 = 2 and not regexp_matches(p_name, '\\p{L}$') then ' 17' else '' end label from part")
def t33_clean_statement_label(spark, sf_dir):
    k = F.col("p_partkey")
    spaced = F.replace(F.format_number(k * 1000 + 5, 0), F.lit(","), F.lit(" "))
    label = F.when(k % 3 == 0, F.concat_ws(" ", "p_name", spaced, F.lit("(1 234)"))).when(k % 3 == 1, F.concat("p_name", F.lit("  "))).otherwise(F.concat("p_name", F.lit(" 17")))
    return S.table(spark, sf_dir, "part").select("p_partkey", R.clean_label(label).alias("label"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Item of ' || l_returnflag label, case when l_orderkey % 3 < 2 then a end as \"current\", case when l_orderkey % 3 = 0 then '(' || b || ')' end comparative from (select *, format('{:,}', cast(floor(l_extendedprice) as bigint)) a, format('{:,}', cast(floor(l_extendedprice) as bigint) + 1000) b from lineitem)")
def t34_split_inline_values(spark, sf_dir):
    k = F.col("l_orderkey") % 3
    a, b = F.format_number(F.floor("l_extendedprice"), 0), F.format_number(F.floor("l_extendedprice") + 1000, 0)
    line = F.concat_ws("  ", F.concat(F.lit("Item of "), "l_returnflag"), F.when(k < 2, a), F.when(k == 0, F.concat(F.lit("("), b, F.lit(")"))))
    rows = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.inline_values(line).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v.label", "v.current", "v.comparative")


ODATE = "od as (select o_orderkey k, year(o_orderdate) + 10 y, quarter(o_orderdate) q, ['march','june','september','december'][quarter(o_orderdate)] m, case when quarter(o_orderdate) in (1, 4) then 31 else 30 end d from orders)"


@query(
    "select k o_orderkey, case c when 0 then y || 'Q' || q when 1 then y || 'Q4' when 2 then y || 'Q' || q when 3 then y || 'Q2' when 4 then y || 'Q' || q else y || 'Q1' end period, case c when 0 then y - 1 || 'Q' || q when 1 then y - 1 || 'Q4' when 2 then y - 1 || 'Q' || q when 3 then y - 1 || 'Q2' when 4 then y - 1 || 'Q' || q else y - 1 || 'Q1' end comparative,"
    " case c when 0 then case q when 1 then 'quarter' when 4 then 'annual' else 'ytd' end when 1 then 'annual' when 2 then 'balance_sheet_snapshot' when 3 then 'ytd' when 4 then case q when 1 then 'quarter' when 4 then 'annual' else 'ytd' end else 'quarter' end \"type\", case c when 1 then 12 when 3 then 6 when 5 then 3 else q * 3 end \"months\","
    " ['table_headers','document_text','table_headers','table_headers','filename','upload_default'][c + 1] \"source\", ['explicit_date_with_duration','explicit_report_year_phrase','explicit_snapshot_date','year_headers_only','year_token_in_filename','upload_default_report_period'][c + 1] detail, [0.95, 0.9, 0.9, 0.84, 0.55, 0.1][c + 1]::double confidence from (select *, (k // 8) % 6 c from od)",
    ODATE,
)
def p11_detect_period(spark, sf_dir):
    c, q = (F.floor(F.col("o_orderkey") / 8) % 6).cast("int"), F.expr("quarter(o_orderdate)")
    y = F.expr("cast(year(o_orderdate) + 10 as string)")
    before = F.expr("cast(year(o_orderdate) + 9 as string)")
    end = F.concat_ws(" ", F.when(q.isin(1, 4), "31").otherwise("30"), _pick(("March", "June", "September", "December"), q - 1), y)
    months = _pick(("3 months", "six months", "nine months", "year ended"), q - 1)
    headers = F.when(c == 0, F.concat_ws(" ", months, end)).when(c == 2, F.concat_ws(" ", F.lit("at"), end)).when(c == 3, F.concat_ws(" ", F.lit("6 months"), before, y))
    body = F.when(c == 0, F.concat_ws(" ", F.lit("see"), y)).when(c == 1, F.concat_ws(" ", F.lit("report for"), y)).when(c == 3, F.concat_ws(" ", F.lit("figures"), before))
    file = F.when(c == 4, F.concat(F.lit("report q"), q.cast("string"), F.lit(" "), y, F.lit(".pdf"))).when(c == 1, F.concat(F.lit("x "), before))
    preferred = F.when(c.isin(3, 5), F.concat(y, F.lit("Q1")))
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", headers.alias("headers"), body.alias("body"), file.alias("filename"), preferred.alias("preferred"))
    return R.detect_period(rows).drop("headers", "body", "filename", "preferred")


@query("select k o_orderkey, k % 4 in (1, 2) ok from od", ODATE)
def p10_check_extension(spark, sf_dir):
    k, y, q = F.col("o_orderkey") % 4, F.expr("year(o_orderdate) + 10"), F.expr("quarter(o_orderdate)")
    current = F.concat(y, F.lit("Q"), q)
    new = F.when(k == 0, current).when(k == 1, F.concat(y + 1, F.lit("Q"), q)).when(k == 2, F.concat(y + 2, F.lit("Q1"))).otherwise(F.concat(y + 1, F.lit("Q7")))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", R.is_extension(current, new).alias("ok"))


@query(
    "select o_custkey entity, year(o_orderdate) || 'Q' || quarter(o_orderdate) period, 'https://x/' || o_orderkey source_url, case when o_orderkey % 3 = 0 then 'other' else 'report' end document_type, case when o_orderkey % 5 = 0 then case when o_orderkey % 3 = 0 then 'other' else 'report' end else 'annual_report' end source_role, case when o_orderkey % 2 = 0 then 'unknown' else 'pdf' end expected_file_type, case when o_orderkey % 6 = 0 then 0.9 else 0.5 end::double confidence_score"
    " from orders where o_orderkey % 7 <> 0 and o_custkey % 4 <> 0 and year(o_orderdate) between 1994 and 1996 and not (year(o_orderdate) = 1996 and quarter(o_orderdate) > 2)"
)
def s6_scan_manifest(spark, sf_dir):
    o, c, none = F.col("o_orderkey"), F.col("o_custkey"), F.lit(None).cast("string")
    items = S.table(spark, sf_dir, "orders").select(
        c.alias("entity"), F.expr("concat(year(o_orderdate), 'Q', quarter(o_orderdate))").alias("period"), F.when(o % 7 != 0, F.concat(F.lit("https://x/"), o)).when(o % 14 == 0, "").alias("source_url"), F.when(c % 4 == 0, "RAS").otherwise("ifrs").alias("reporting_standard"),
        F.when(o % 3 == 0, none).otherwise("report").alias("document_type"), F.when(o % 5 == 0, none).otherwise("annual_report").alias("source_role"), F.when(o % 2 == 0, none).otherwise("pdf").alias("expected_file_type"), F.when(o % 6 == 0, F.lit(None).cast("double")).otherwise(0.5).alias("confidence_score"),
    )
    return R.scan_manifest(items, None, "1994Q1", "1996Q2", "IFRS")


@query(
    "select d document_id, unnest(['balance_sheet', case when r % 2 = 0 then 'balance_sheet_2' else 'cash_flow' end, case when r % 3 = 0 then 'unknown' when r % 2 <> 0 then 'cash_flow_3' else 'cash_flow' end]) as name, unnest([r, r + 1, r + 2])::bigint \"rows\" from (select o_custkey d, max(o_orderkey) r from orders group by o_custkey)",
)
def s7_scan_statement_tables(spark, sf_dir):
    o = F.col("o_orderkey")
    item = lambda kind, i: F.struct(kind.alias("statement_type"), F.lit(i).alias("table_index"), F.array(F.map_from_arrays(F.array(F.lit("line")), F.array((o + i - 1).cast("string")))).alias("rows"))
    tables = F.array(item(F.lit("balance_sheet"), 1), item(F.when(o % 2 == 0, "balance_sheet").otherwise("cash_flow"), 2), item(F.when(o % 3 == 0, F.lit(None).cast("string")).otherwise("cash_flow"), 3))
    found = R.scan_statement_tables(S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), o.alias("modified"), tables.alias("statement_tables")))
    return found.select("document_id", "name", F.col("rows")[0]["line"].cast("long").alias("rows"))


@query(
    "select entity, coalesce(bool_or(st = 'balance_sheet'), false) balance_sheet, coalesce(bool_or(st = 'income_statement'), false) income_statement, coalesce(bool_or(st = 'cash_flow'), false) cash_flow, count(distinct period) >= 2 and coalesce(bool_or(period like '%Q4'), false) two_periods, count(metric_code) facts, 'customer_accounts,loans_to_customers,net_interest_income,operating_expenses,operating_income,profit_before_tax,total_liabilities' missing_key_facts,"
    " case when coalesce(bool_or(st = 'balance_sheet'), false) and coalesce(bool_or(st = 'income_statement'), false) and coalesce(bool_or(st = 'cash_flow'), false) and count(distinct period) >= 2 and bool_or(period like '%Q4') and count(metric_code) >= 10 then 'high' when bool_or(st = 'balance_sheet') and bool_or(st = 'income_statement') and count(metric_code) >= 6 then 'medium' else 'low' end grade"
    " from (select r.entity, f.period, f.metric_code, case when f.metric_code in ('operating_cash_flow', 'capex') and f.nation % 2 = 0 then 'cash_flow' else f.statement_type end st from registry r left join facts f on f.entity = r.entity where is_bank) group by entity",
    FACTS, REGISTRY,
)
def f29_bank_parser_quality(spark, sf_dir):
    facts = S.facts(spark, sf_dir).withColumn("statement_type", F.when(F.col("metric_code").isin("operating_cash_flow", "capex") & (F.col("nation") % 2 == 0), "cash_flow").otherwise(F.col("statement_type")))
    return R.bank_parser_quality(facts, S.registry(spark, sf_dir).where("is_bank"))


@query(
    "select o_orderkey, reason is null accepted, reason from (select o_orderkey, case when k % 5 = 0 then 'document_validation_partial' when k % 7 = 0 then 'reporting_standard_mismatch' when k % 3 = 0 then case when k % 2 = 0 then 'document_role_not_financial_statements' end when k % 3 = 1 then case when k % 2 = 0 or c % 4 = 0 then 'embedded_financial_statements_not_proven' end else 'unsupported_source_role' end reason from (select o_orderkey, o_orderkey // 8 k, o_custkey c from orders))"
)
def c13_download_acceptance(spark, sf_dir):
    k, c = F.floor(F.col("o_orderkey") / 8), F.col("o_custkey")
    markers = F.map_from_arrays(F.array(*map(F.lit, ("company", "period", "ifrs", "ras", "consolidated", "primary", "notes"))), F.array(F.lit(True), F.lit(True), c % 2 == 0, c % 2 == 1, c % 4 != 0, F.lit(True), F.lit(True)))
    rows = S.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "partial").otherwise("pass").alias("validation_status"), F.lit("IFRS").alias("reporting_standard"), F.when(k % 7 == 0, "RAS").otherwise("ifrs").alias("detected_standard"),
        F.when(k % 3 == 0, "financial_statements").when(k % 3 == 1, "annual_report").otherwise("blog").alias("source_role"), F.when(k % 2 == 0, "press_release").otherwise("financial_statements").alias("detected_role"), markers.alias("markers"),
    )
    return R.download_acceptance(rows).select("o_orderkey", "accepted", "reason")


@query(
    "select doc_id document_id, page, family, case when std <> 'IFRS' or apart then false when family = 'unknown' then k = 2 and line when k = 0 or k = 2 and family = 'cash_flow' then true when k = 1 then false else line or title end needs from (select *, (doc_id // 32) % 3 k, doc_id % 9 page, doc_id % 2 = 0 line,"
    f" {TOC_SQL} or {NOTES_SQL} or {AUDIT_SQL} apart, " + _has("t", "consolidated statement of profit or loss", "statement of comprehensive income", "отчет о прибылях и убытках", "statement of financial position", "balance sheet", "statement of cash flows", "cash flows from operating activities", "statement of changes in equity") + " title,"
    f" case when t = '' or {TOC_SQL} or {NOTES_SQL} or {AUDIT_SQL} then 'unknown' {RAS_SQL} when {B_TITLE} and {B_ROWS} then 'balance_sheet' when {I_TITLE} and {I_ROWS} then 'income_statement' when {CASH_SQL} then 'cash_flow' else 'unknown' end family from (select * exclude (t), trim(t || case when doc_id % 2 = 0 then ' other items 1 234 567' else '' end) t from plain))",
    PAGES,
)
def t36_pages_needing_recovery(spark, sf_dir):
    k = F.floor(F.col("doc_id") / 32) % 3
    text = F.concat(_pick(TITLES, F.col("doc_id") % 16), F.lit(" "), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "\nOther items  1 234  567").otherwise(""))
    docs = S.table(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 9).alias("page"), text.alias("text"), F.when(F.floor(F.col("doc_id") / 16) % 2 == 0, "IFRS").otherwise("RAS").alias("reporting_standard"))
    kinds = F.explode(F.array(*map(F.lit, ("balance_sheet", "income_statement", "cash_flow")))).alias("statement_type")
    tables = docs.where(k > 0).select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 9).alias("page"), (k == 1).alias("strong"), k.alias("k"), kinds)
    return R.pages_needing_recovery(pages, tables.where((F.col("k") == 1) | (F.col("statement_type") != "cash_flow")).drop("k"))


@query("select entity, period, metric_code, 'a' || case when nation % 2 = 0 and metric_code = 'capex' then ',second' else '' end || case when nation % 3 = 0 and metric_code in ('capex', 'revenue', 'net_income', 'total_debt') then ',segment capex' else '' end warnings from facts", FACTS)
def m21_methodology_notes(spark, sf_dir):
    code = F.col("metric_code")
    rows = S.facts(spark, sf_dir).select("entity", "period", "metric_code", F.when(code.isin("net_income", "total_debt"), F.array(F.lit("capex_input"))).otherwise(F.array(F.lit("x"))).alias("inputs"), F.array(F.lit("a")).alias("warnings"))
    nations = S.table(spark, sf_dir, "nation")
    first = nations.where("n_nationkey % 3 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("entity"), F.array(F.lit("capex"), F.lit("revenue")).alias("metrics"), F.lit("capex_input").alias("input"), F.lit("segment capex").alias("note"))
    second = nations.where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("entity"), F.array(F.lit("capex")).alias("metrics"), F.lit("none").alias("input"), F.lit("second").alias("note"))
    out = R.methodology_notes(rows, first.unionByName(second))
    return out.select("entity", "period", "metric_code", F.array_join(F.array_sort("warnings"), ",").alias("warnings"))


CANDS = "cands as (select o_custkey % 200 q, case when o_custkey % 200 % 3 = 0 then o_custkey else o_custkey % 200 end entity, ['registry','exchange','issuer'][o_orderkey % 3 + 1] provider, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 'bad.example' else 'good.example' end host, o_orderkey k, (o_orderkey % 11) / 10.0 confidence from orders)"


@query(
    "select q, entity, provider, case when host is not null then 'https://' || host || '/' || k end url, case when n > 1 then 'ambiguous' else 'trusted_candidate' end trust, place, count(*) over (partition by q) = 1 and n = 1 and confidence >= 0.85 auto_select from (select *, row_number() over (partition by q order by confidence desc, provider desc, coalesce('https://' || host || '/' || k, '') desc, entity) place from (select c.*, n from cands c join (select q, count(distinct entity) n from cands group by q) using (q)) where host is null or host = 'good.example') where place <= 10",
    CANDS,
)
def c11_source_candidates(spark, sf_dir):
    o, q = F.col("o_orderkey"), F.col("o_custkey") % 200
    url = F.when(o % 5 != 0, F.concat(F.when(o % 7 == 0, "https://bad.example/").otherwise("https://good.example/"), o))
    rows = S.table(spark, sf_dir, "orders").select(q.alias("q"), F.when(q % 3 == 0, F.col("o_custkey")).otherwise(q).alias("entity"), _pick(("registry", "exchange", "issuer"), o % 3).alias("provider"), url.alias("url"), ((o % 11) / 10).alias("confidence"))
    return R.source_candidates(rows, ["good.example"])


@query(
    "select c_custkey entity, case when c_custkey % 7 = 0 or n = 0 then 'BLOCKED' when v > 0 then case when fs then 'PASS' else 'PARTIAL' end when d > 0 then 'PARTIAL' else 'BLOCKED' end status, n candidates, d downloads, v valid, c_custkey % 7 <> 0 and n = 0 requires_js_adapter, v = 0 requires_manual_upload"
    " from (select c_custkey, count(o_orderkey) n, coalesce(bool_or(o_orderkey % 3 = 0), false) fs, count(*) filter (o_orderkey % 2 = 0) d, count(*) filter (o_orderkey % 4 = 0) v from customer left join orders on o_custkey = c_custkey and o_orderkey % 5 = 0 group by c_custkey)"
)
def c12_catalog_summary(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    companies = S.table(spark, sf_dir, "customer").select(k.alias("entity"), F.when(k % 7 == 0, "BLOCKED").otherwise("PASS").alias("page_status"))
    reports = S.table(spark, sf_dir, "orders").where(o % 5 == 0).select(F.col("o_custkey").alias("entity"), F.when(o % 3 == 0, "financial_statements").otherwise("press_release").alias("source_role"), (o % 2 == 0).alias("downloaded"), (o % 4 == 0).alias("validated"))
    return R.catalog_summary(companies, reports)
