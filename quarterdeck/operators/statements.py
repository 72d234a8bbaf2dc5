"""Statement tables: families, rows, labels, values and periods, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound, computed, once
from ..functions.numbers import contains_any, parse_number
from ..functions.text import matching_text

# Markers of pages, titles and rows, in the normal form of matching_text.
TOC = ("report on review", "independent auditor", "consolidated balance sheet", "consolidated statement of comprehensive income", "consolidated statement of cash flows", "notes to the consolidated")
NOTES = (
    "notes to consolidated financial statements", "notes to the consolidated financial statements", "notes to the consolidated interim condensed financial information",
    "notes to the consolidated interim condensed financial statements", "notes to financial statements", "notes to the financial statements",
    "примечания к обобщенной консолидированной финансовой отчетности", "примечания к консолидированной финансовой отчетности", "примечания к финансовой отчетности",
)
AUDITOR = ("independent auditor", "auditor s report", "report on review", "we have audited", "we have reviewed", "auditor s responsibilities")
BALANCE_TITLE = ("statement of financial position", "balance sheet", "отчет о финансовом положении")
BALANCE_ROWS = ("total assets", "current assets", "non current assets", "total equity", "total equity and liabilities", "current liabilities", "non current liabilities", "итого активов", "обязательства", "собственных средств")
INCOME_TITLE = ("statement of profit or loss", "statement of comprehensive income", "statement of income", "отчет о прибылях и убытках")
INCOME_ROWS = ("sales", "revenue", "operating profit", "profit for the period", "profit for the year", "profit before profit tax", "total comprehensive income", "прибыль за год", "процентные доходы", "чистые процентные доходы", "комиссионные доходы")
CASH_TITLE = ("statement of cash flows", "отчет о движении денежных средств")
CASH_ROWS = ("operating activities", "investing activities", "financing activities", "net increase in cash", "net decrease in cash", "cash and cash equivalents at end of period", "cash and cash equivalents at the end of the period")
RAS_CASH_ROWS = ("денежные потоки от операционной деятельности", "денежные потоки от инвестиционной деятельности", "денежные потоки от финансовой деятельности", "чистое увеличение денежных средств", "чистое уменьшение денежных средств")
EQUITY_TITLE = ("statement of changes in equity",)
PRIMARY = ("balance_sheet", "income_statement", "cash_flow", "changes_in_equity")
STOPWORDS = ("and", "or", "the", "for", "of", "to", "from", "on", "other", "net", "total", "и", "или", "для", "по", "от", "на", "из", "прочие", "итого", "нетто")
BANK_KEY_FACTS = ("total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "loans_to_customers", "customer_accounts", "net_interest_income", "operating_income", "operating_expenses", "profit_before_tax", "net_income", "operating_cash_flow")
MONTH_ENDS = (("march", 1), ("марта", 1), ("june", 2), ("июня", 2), ("september", 3), ("сентября", 3), ("december", 4), ("декабря", 4))

RANKS = {"table_headers": 4, "document_text": 3, "filename": 2, "upload_default": 1}


def _count(text: Column, markers) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + text.contains(m).cast("int")
    return out


def is_contents_page(t: Column) -> Column:
    return t.startswith("contents ") | (t == "contents") | (t.contains("contents") & (_count(t, TOC) >= 3))


def statement_context(text: Column) -> Column:
    """The statement or note that an IFRS title speaks of; the first of the ordered markers wins."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    out = F.when(t.contains("statement of changes in equity"), "changes_in_equity")
    for markers, name in (
        (("statement of cash flows",), "cash_flow"), (("net cash from operating activities",), "cash_flow_note"), (("statement of comprehensive income", "statement of profit or loss"), "profit_or_loss"),
        (("balance sheet", "statement of financial position"), "financial_position"), (("debt", "borrowings"), "debt_note"), (("segment information",), "segment_note"),
        (("cash and cash equivalents",), "cash_note"), (("financial risk factors",), "financial_risk_note"),
    ):
        out = out.when(contains_any(t, markers), name)
    return out.otherwise("unknown")


def _is_cash_flow(t: Column, ras: Column) -> Column:
    ifrs = contains_any(t, CASH_TITLE) | (_count(t, CASH_ROWS) >= 3)
    return F.when(ras, contains_any(t, CASH_TITLE[1:]) | (_count(t, RAS_CASH_ROWS) >= 2)).otherwise(ifrs)


def with_statement_family(pages: DataFrame, *, text: str = "text", standard: str = "reporting_standard") -> DataFrame:
    """pages with family (of any text) and primary_family (of a page that is a statement itself); IFRS and RAS."""
    t, ras = F.col("normal"), F.upper(standard) == "RAS"
    rows = pages.withColumn("normal", matching_text(F.col(text)))  # named once; the markers below only look it up
    dated = t.rlike(r"\b20\d{2}\b")
    family = F.when(is_contents_page(t) | contains_any(t, AUDITOR), "unknown").when(contains_any(t, NOTES), "notes").when(_is_cash_flow(t, ras), "cash_flow")
    family = family.when(ras & t.contains("бухгалтерский баланс"), "balance_sheet").when(ras & t.contains("отчет о финансовых результатах"), "income_statement")
    family = family.when(contains_any(t, BALANCE_TITLE), "balance_sheet").when(contains_any(t, INCOME_TITLE), "income_statement")
    family = family.when((_count(t, BALANCE_ROWS) >= 2) & dated, "balance_sheet").when((_count(t, INCOME_ROWS) >= 1) & dated, "income_statement")
    family = family.when(contains_any(t, EQUITY_TITLE), "changes_in_equity").when(contains_any(t, ("notes", "note ")), "notes").otherwise("unknown")
    page = F.when((t == "") | is_contents_page(t) | contains_any(t, NOTES) | contains_any(t, AUDITOR), "unknown")
    page = page.when(ras & t.contains("бухгалтерский баланс"), "balance_sheet").when(ras & t.contains("отчет о финансовых результатах"), "income_statement")
    page = page.when(contains_any(t, BALANCE_TITLE) & (_count(t, BALANCE_ROWS) >= 2), "balance_sheet").when(contains_any(t, INCOME_TITLE) & (_count(t, INCOME_ROWS) >= 1), "income_statement")
    page = page.when(_is_cash_flow(t, ras), "cash_flow").otherwise("unknown")
    return rows.withColumns({"family": family, "primary_family": page}).drop("normal")


def table_role(family: Column, structure: Column, method: Column) -> Column:
    return (
        F.when(family == "notes", "review_only_note").when(family == "unknown", "narrative").when(method == "text_table_fallback", "primary_statement_degraded_but_usable")
        .when(structure == "standard", "primary_statement").when(structure == "degraded", "primary_statement_degraded_but_usable").otherwise("primary_statement_degraded_unusable")
    )


def row_kind(label: Column, has_values: Column, has_note: Column, family: Column) -> Column:
    """Kind of a statement row by its label, whether it has values and a note reference, and its statement's family."""
    return bound(matching_text(label), lambda t: _row_kind(t, label, has_values, has_note, family))


def _row_kind(t: Column, label: Column, has_values: Column, has_note: Column, family: Column) -> Column:
    empty = F.coalesce(F.trim(label), F.lit("")) == ""
    activities = contains_any(t, ("операционной деятельности", "инвестиционной деятельности", "финансовой деятельности", "operating activities", "investing activities", "financing activities"))
    return (
        F.when(empty & has_values, "numeric_fragment").when(empty, "unknown").when(contains_any(t, ("примечание", "note")) | F.trim(label).startswith("*"), "footnote").when(has_note & ~has_values, "note_reference_only")
        .when(contains_any(t, ("итого", "total")), F.when(contains_any(t, ("актив", "обяз", "капитал", "equity", "liabilit", "assets")), "grand_total").otherwise("subtotal"))
        .when((family == "cash_flow") & activities, F.when(has_values, "statement_line_item").otherwise("section_title"))
        .when(has_values, "statement_line_item").when(contains_any(t, ("активы", "обязательства", "капитал", "equity", "assets", "liabilities")), "section_title").otherwise("unknown")
    )


def row_confidence(kind: Column, stitched: Column) -> Column:
    out = F.when(kind == "grand_total", 0.95).when(kind == "subtotal", 0.88).when(kind == "statement_line_item", F.when(stitched, 0.9).otherwise(0.82))
    return out.when(kind == "section_title", 0.55).when(kind == "numeric_fragment", 0.35).otherwise(0.4)


def row_gate(label: Column, kind: Column, metric: Column, statement: Column, issuer: Column) -> Column:
    """(metric, reason): which metric a row of a statement may give, or why none."""
    return bound(matching_text(label), lambda t: _row_gate(t, kind, metric, statement, issuer))


def _row_gate(t: Column, kind: Column, metric: Column, statement: Column, issuer: Column) -> Column:
    ok, no = F.struct(metric.alias("metric"), F.lit(None).cast("string").alias("reason")), lambda why: F.struct(F.lit(None).cast("string").alias("metric"), F.lit(why).alias("reason"))
    item, line = kind.isin("subtotal", "grand_total"), kind.isin("statement_line_item", "subtotal", "grand_total")
    parts = metric.isin("current_assets", "current_liabilities", "non_current_assets", "non_current_liabilities")
    named = contains_any(t, ("итого", "total", "current assets", "current liabilities", "оборотные активы", "краткосрочные обязательства", "долгосрочные обязательства"))
    both = metric == "total_equity_and_liabilities"
    balance = F.when(parts, F.when(named, ok).otherwise(no("component_row_not_total_metric"))).when(both & ~item, no("subtotal_without_statement_context"))
    balance = balance.when(both, F.when(contains_any(t, ("equity", "liabilit", "капитал", "обяз")), ok).otherwise(no("label_ownership_unresolved")))
    balance = balance.when(metric.isin("total_assets", "total_equity", "total_liabilities") & ~item, no("subtotal_without_statement_context"))
    balance = balance.when((kind == "grand_total") & ~contains_any(t, ("актив", "asset", "капитал", "equity", "own funds", "собственн", "обяз", "liabilit")), no("component_row_not_total_metric")).otherwise(ok)
    segment = issuer.startswith("industrial") & (metric == "revenue") & contains_any(t, ("segment", "сегмент", "прочие", "other income"))
    income = F.when(segment, no("component_row_not_total_metric")).when(~line, no("row_kind_not_statement_line_item")).otherwise(ok)
    cash = metric == "cash_and_equivalents"
    flow = F.when(~kind.isin("statement_line_item", "subtotal"), no("row_kind_not_statement_line_item")).when(cash & contains_any(t, ("effect of exchange rate", "beginning of the year", "beginning of the period")), no("component_row_not_total_metric"))
    flow = flow.when(cash & ~contains_any(t, ("at the end of the year", "at the end of the period", "at year end", "at period end", "end of year", "end of period")), no("label_ownership_unresolved")).otherwise(ok)
    equity = F.when(~line, no("row_kind_not_statement_line_item")).when((metric == "total_equity") & ~contains_any(t, ("equity", "capital", "капитал")), no("label_ownership_unresolved")).otherwise(ok)
    return F.when(metric.isNull(), no("metric_not_mapped")).when(statement == "balance_sheet", balance).when(statement == "income_statement", income).when(statement == "cash_flow", flow).when(statement == "changes_in_equity", equity).otherwise(no("statement_family_ambiguous"))


def read_cells(cells: Column) -> Column:
    """cells, an array of (key, raw) in the order of the columns, with their numbers."""
    return F.transform(cells, lambda c: F.struct(c["key"].alias("key"), c["raw"].alias("raw"), parse_number(c["raw"]).alias("number")))


def current_value(cells: Column, period: Column, statement: Column) -> Column:
    """(raw, key, number, reason): the cell of the current period.  cells: array of (key, raw) in the order of the columns.

    Numeric cells count, and one or two bare digits (a note reference) only if there is nothing else.  The column named
    as the period, else the one whose header speaks of it, else the only one; several are ambiguous.
    """
    return picked_value(read_cells(cells), period, statement)


def picked_value(cells: Column, period: Column, statement: Column) -> Column:
    """current_value of cells that read_cells has read."""
    year, quarter = F.substring(period, 1, 4), F.substring(period, 6, 1)
    words = {"1": ("march", "марта", "3 months", "three months", "3 мес"), "2": ("june", "июня", "6 months", "six months", "6 мес"), "3": ("september", "сентября", "9 months", "nine months", "9 мес"), "4": ("31 december", "31 декабря", "fy", "year", "год")}

    def speaks(h):
        said = F.lit(False)
        for q, markers in words.items():
            said = said | ((quarter == q) & contains_any(h, markers))
        return h.contains(year) & (said | (h == year) | (statement == "balance_sheet"))

    def read(c):  # a column's cell, its header and whether that is the period
        return bound(matching_text(c["key"]), lambda h: F.struct(c["key"].alias("key"), c["raw"].alias("raw"), c["number"].alias("number"), (F.replace(h, F.lit(" "), F.lit("")) == F.lower(period)).alias("named"), h.alias("header")))

    take = lambda c: F.struct(c["raw"].alias("raw"), c["key"].alias("key"), c["number"].alias("number"), F.lit(None).cast("string").alias("reason"))
    none = lambda why: F.struct(F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("number"), F.lit(why).alias("reason"))
    first = lambda found: take(F.get(found, F.lit(0)))

    def sole(near):
        return F.when(F.size(near) == 1, first(near)).otherwise(none("ambiguous_period_column"))

    def among(cells):  # of two or more: headers that speak of the period matter only if none is the period
        return bound(F.filter(cells, lambda c: c["named"]), lambda named: F.when(F.size(named) == 1, first(named)).when(F.size(named) > 1, none("ambiguous_period_column")).otherwise(bound(F.filter(cells, lambda c: speaks(c["header"])), sole)))

    def chosen(cells):
        return F.when(F.size(cells) == 0, none("numeric_value_not_detected")).when(F.size(cells) == 1, first(cells)).otherwise(bound(F.transform(cells, read), among))

    numeric = F.filter(cells, lambda c: c["number"].isNotNull())
    money = lambda numeric: F.filter(numeric, lambda c: ~F.trim(c["raw"]).rlike(r"^\d{1,2}$"))
    counted = bound(numeric, lambda numeric: bound(money(numeric), lambda money: F.when(F.size(money) > 0, money).otherwise(numeric)))
    return bound(counted, chosen)


def promotion_reason(statement: Column, label: Column, has_values: Column, document: Column, page: Column, label_conf: Column, owner_conf: Column, period_conf: Column) -> Column:
    """Why a row may not become a fact; null if it may."""
    return (
        F.when(~F.coalesce(statement.isin(*PRIMARY[:3]), F.lit(False)), "statement_family_ambiguous").when((F.coalesce(label, F.lit("")) == "") | ~has_values, "label_ownership_unresolved")
        .when(document.isNull() | page.isNull(), "policy_blocked").when((label_conf < 0.55) | (owner_conf < 0.7), "label_ownership_unresolved").when(period_conf < 0.6, "period_header_ambiguous")
    )


def parse_statement_rows(rows: DataFrame, metric: Column | Callable[[Column], Column]) -> DataFrame:
    """rows with kind, metric_code, raw_value, value, outcome (fact, rejected, evidence) and reason, without a shuffle.

    rows: document_id, row_index, statement_type, label, cells, note_ref, period, page_number, unit_multiplier,
    issuer_class, label_confidence, ownership_confidence, period_confidence.  Numbers of rows that no metric claims are
    evidence; rows without numbers and without a metric are rejected.  metric: a column, or what gives it from the
    label's normal form (match_normal), which is cheaper.
    """
    out = once(computed(rows, "numbers", read_cells(F.col("cells"))), "plain", matching_text(F.col("label")))
    out = computed(out, "known", metric if isinstance(metric, Column) else metric(F.col("plain")))
    out = computed(out, "has_values", F.exists("numbers", lambda c: c["number"].isNotNull()))
    out = once(out, "kind", _row_kind(F.col("plain"), F.col("label"), F.col("has_values"), F.col("note_ref").isNotNull(), F.col("statement_type")))
    out = once(out, "gate", _row_gate(F.col("plain"), F.col("kind"), F.col("known"), F.col("statement_type"), F.col("issuer_class")))
    promoted = promotion_reason(F.col("statement_type"), F.col("label"), F.col("has_values"), F.col("document_id"), F.col("page_number"), F.col("label_confidence"), F.col("ownership_confidence"), F.col("period_confidence"))
    out = computed(out.withColumn("promoted", promoted), "picked", picked_value(F.col("numbers"), F.col("period"), F.col("statement_type")))
    reason = F.coalesce("gate.reason", "promoted", "picked.reason")
    value = F.col("picked.number") * F.col("unit_multiplier")
    return once(out, "value", F.when(reason.isNull(), value)).select(
        "document_id", "row_index", "statement_type", "period", "kind", F.when(reason.isNull(), F.col("gate.metric")).alias("metric_code"), F.when(reason.isNull(), F.col("picked.raw")).alias("raw_value"), "value",
        F.when(reason.isNull(), "fact").when((F.col("gate.reason") == "metric_not_mapped") & F.col("has_values"), "evidence").otherwise("rejected").alias("outcome"), reason.alias("reason"),
    )


def stitch_rows(rows: DataFrame) -> DataFrame:
    """Rows of (document_id, table_index) in order of row_index: a row without numbers takes those of the next row where
    that one has no label, or continues the label (a lower-case start); the row that gave them falls out.

    A row that is a header, a footnote or a total takes nothing, nor does one that gave its own away.
    """
    order = Window.partitionBy("document_id", "table_index").orderBy("row_index")
    after = lambda c: F.lead(c).over(order)
    bare = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    mine = ~F.col("has_values") & ~bare(F.col("label")) & ~F.col("kind").isin("header", "footnote", "subtotal", "grand_total")
    follows = bare(F.col("n_label")) | F.col("n_label").rlike(r"^\s*\p{Ll}")
    out = rows.withColumns({"n_label": after("label"), "n_values": after("values"), "n_has": after("has_values")})
    out = out.withColumn("takes", F.coalesce(mine & F.col("n_has") & follows, F.lit(False)))
    out = out.withColumn("given", F.coalesce(F.lag("takes").over(order), F.lit(False))).where(~F.col("given"))
    label = F.when(F.col("takes"), F.trim(F.concat_ws(" ", F.trim("label"), F.trim("n_label")))).otherwise(F.col("label"))
    return out.select("document_id", "table_index", "row_index", label.alias("label"), F.when(F.col("takes"), F.col("n_values")).otherwise(F.col("values")).alias("values"), F.col("takes").alias("stitched"))


def label_tokens(label: Column) -> Column:
    """Sorted distinct stems of a label's words, without stopwords and numbers."""
    def root(w):
        return F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when((F.length(w) > 4) & w.endswith("es"), F.substring(w, F.lit(1), F.length(w) - 2)).when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(matching_text(label), " "), root), lambda w: (w != "") & ~w.isin(*STOPWORDS) & ~w.rlike(r"^\d+$"))))


def labels_match(left: Column, right: Column, left_metric: Column, right_metric: Column) -> Column:
    """Token arrays of label_tokens: equal metrics decide where both are known; else equal sets, or 3 of 4 of either side shared."""
    both = F.size(F.array_intersect(left, right))
    share = F.greatest(both / F.size(left), both / F.size(right))
    return F.when(left_metric.isNotNull() & right_metric.isNotNull(), left_metric == right_metric).when((F.size(left) == 0) | (F.size(right) == 0), False).otherwise((left == right) | (share >= 0.75))


def expected_pages(pages: DataFrame) -> DataFrame:
    """document_id, page, family: the primary statements that the contents pages of IFRS documents name.

    pages: document_id, text, reporting_standard.  The last line of a page number wins.
    """
    t = matching_text(F.col("text"))
    contents = pages.where((F.upper("reporting_standard") == "IFRS") & (is_contents_page(t) | contains_any(t, ("contents", "содержание"))))
    lines = contents.select("document_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("t", matching_text(F.col("raw")))
    page = F.regexp_extract("t", r"(\d{1,3})\s*$", 1)
    apart = contains_any(F.col("t"), NOTES) | contains_any(F.col("t"), AUDITOR)  # such a line names no statement by itself
    family = F.when(~apart & contains_any(F.col("t"), INCOME_TITLE) & ~contains_any(F.col("t"), BALANCE_TITLE), "income_statement").when(contains_any(F.col("t"), BALANCE_TITLE[:2]), "balance_sheet")
    family = family.when(contains_any(F.col("t"), INCOME_TITLE[:2]), "income_statement").when(contains_any(F.col("t"), CASH_TITLE[:1]), "cash_flow").when(~apart & contains_any(F.col("t"), EQUITY_TITLE), "changes_in_equity")
    found = lines.select("document_id", "line", page.alias("page"), family.alias("family")).where((F.col("page") != "") & F.col("family").isNotNull())
    return found.groupBy("document_id", F.col("page").cast("int").alias("page")).agg(F.max_by("family", "line").alias("family"))


def clean_label(label: Column) -> Column:
    """A label without trailing inline values and without a note reference of one to three digits at its end."""
    values = r"(\s+\(?-?\d{1,3}(?:[ ,]\d{3})+(?:[.,]\d+)?\)?)+\s*$"
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(label), values, ""), r"(?<=\p{L})\s+\d{1,3}\s*$", ""))


def inline_values(line: Column) -> Column:
    """(label, current, comparative): a text line's label and its last one or two numbers, thousands in groups of three."""
    number = r"\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?"
    pair = rf"^(.*?\p{{L}}.*?)\s+({number})\s+({number})\s*$"
    one = rf"^(.*?\p{{L}}.*?)\s+({number})\s*$"
    text = F.trim(F.regexp_replace(line, r"\s+", " "))
    part = lambda p, k: F.regexp_extract(text, p, k)
    none = F.lit(None).cast("string")
    build = lambda a, b, c: F.struct(a.alias("label"), b.alias("current"), c.alias("comparative"))
    return F.when(text.rlike(pair), build(part(pair, 1), part(pair, 2), part(pair, 3))).when(text.rlike(one), build(part(one, 1), part(one, 2), none)).otherwise(build(text, none, none))


def _signs(text: Column) -> Column:
    """What a text says of its period: months covered, a named report year, the last day's year and quarter, all years."""
    return bound(F.lower(F.coalesce(text, F.lit(""))), _said)  # whole texts are lowered once


def _said(t: Column) -> Column:
    months = F.when(t.rlike(r"\byear ended\b|\b12 months\b|\b12 месяцев\b"), 12).when(t.rlike(r"\b(nine|9) months\b|\b9 месяцев\b"), 9).when(t.rlike(r"\b(six|6) months\b|\b6 месяцев\b"), 6).when(t.rlike(r"\b(three|3) months\b|\b3 месяца\b"), 3)
    said = F.regexp_extract(t, r"\b(?:for|year)\s+(20\d{2})\b", 1).try_cast("int")
    dated = r"\b(?:31|30)\s+(march|june|september|december|марта|июня|сентября|декабря)\s+(20\d{2})\b"
    quarter = F.create_map(*[F.lit(x) for pair in MONTH_ENDS for x in pair])[F.regexp_extract(t, dated, 1)]
    years = F.transform(F.regexp_extract_all(t, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(months.alias("months"), said.alias("said"), F.regexp_extract(t, dated, 2).try_cast("int").alias("year"), quarter.alias("quarter"), years.alias("years"), F.regexp_extract(t, r"\bq([1-4])\b", 1).try_cast("int").alias("q"))


def _resolution(s: Column, source: str, preferred: Column) -> Column:
    """(confidence, rank, year, quarter, snapshot, months, detail) by the signs of a source, or null."""
    header, last = source == "table_headers", F.coalesce(F.floor(s["months"] / 3).cast("int"), F.lit(4))
    wanted = F.substring(preferred, 1, 4).try_cast("int")
    chosen = F.when(F.array_contains(s["years"], wanted), wanted).otherwise(F.array_max(s["years"]))

    def made(conf, year, quarter, months, detail, snapshot=False):
        return F.struct(F.lit(conf).alias("confidence"), F.lit(RANKS[source]).alias("rank"), year.alias("year"), quarter.alias("quarter"), F.lit(snapshot).alias("snapshot"), months.cast("int").alias("months"), F.lit(detail).alias("detail"))

    if source == "filename":
        q = F.coalesce(s["q"], last)
        dated = F.when(s["year"].isNotNull(), made(0.65, s["year"], s["quarter"], F.coalesce(s["months"], s["quarter"] * 3), "explicit_date_in_filename"))
        return dated.when(F.size(s["years"]) > 0, made(0.55, s["years"][0], q, F.coalesce(s["months"], q * 3), "year_token_in_filename"))
    return (
        F.when(s["said"].isNotNull(), made(0.94 if header else 0.9, s["said"], F.lit(4), F.lit(12), "explicit_report_year_phrase"))
        .when(s["year"].isNotNull() & s["months"].isNotNull(), made(0.95 if header else 0.9, s["year"], s["quarter"], s["months"], "explicit_date_with_duration"))
        .when(s["year"].isNotNull(), made(0.9 if header else 0.85, s["year"], s["quarter"], s["quarter"] * 3, "explicit_snapshot_date", True))
        .when(F.size(s["years"]) > 0, made(0.75 if header else 0.6, chosen, last, F.coalesce(s["months"], last * 3), "year_headers_only"))
    )


def detect_period(rows: DataFrame, *, headers: str = "headers", body: str = "body", filename: str = "filename", preferred: str = "preferred") -> DataFrame:
    """rows with period, comparative, type, months, source, detail and confidence, by headers, body text and file name.

    The best confidence, then the nearer source; headers win over the body where they differ and their year is the
    preferred period's.  Without any evidence a preferred period is taken, at a confidence of 0.1.
    """
    signs = rows.withColumns({"h_": _signs(F.col(headers)), "b_": _signs(F.col(body)), "f_": _signs(F.col(filename))})
    want = F.col(preferred)
    found = signs.withColumns({"h_": _resolution(F.col("h_"), "table_headers", want), "b_": _resolution(F.col("b_"), "document_text", want), "f_": _resolution(F.col("f_"), "filename", want)})
    h, b = F.col("h_"), F.col("b_")
    conflict = ((h["year"] != b["year"]) | (h["quarter"] != b["quarter"])) & (h["year"] == F.substring(want, 1, 4).try_cast("int"))
    held = F.when(F.coalesce(conflict, F.lit(False)), h.withField("confidence", F.greatest(h["confidence"], F.lit(0.84))))
    q = F.substring(want, 6, 1).try_cast("int")
    default = F.when(want.isNotNull(), F.struct(F.lit(0.1).alias("confidence"), F.lit(RANKS["upload_default"]).alias("rank"), F.substring(want, 1, 4).try_cast("int").alias("year"), q.alias("quarter"), F.lit(False).alias("snapshot"), (q * 3).alias("months"), F.lit("upload_default_report_period").alias("detail")))
    out = found.withColumn("p_", F.coalesce(held, F.array_max(F.array_compact(F.array("h_", "b_", "f_"))), default))
    p = F.col("p_")
    name = lambda y: F.concat(y.cast("string"), F.lit("Q"), p["quarter"].cast("string"))
    kind = F.when(p["snapshot"], "balance_sheet_snapshot").when(p["months"] == 12, "annual").when(p["months"] == 3, "quarter").when(p["months"].isNotNull(), "ytd")
    source = F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (v, k)])[p["rank"]]
    return out.select(*rows.columns, name(p["year"]).alias("period"), name(p["year"] - 1).alias("comparative"), kind.alias("type"), p["months"].alias("months"), source.alias("source"), p["detail"].alias("detail"), p["confidence"].alias("confidence"))


def bank_parser_quality(facts: DataFrame, banks: DataFrame) -> DataFrame:
    """A row a bank: the statements found, whether two periods with a year's end are there, missing key facts, grade.

    facts: entity, statement_type, metric_code, period; banks: entity.
    """
    key = F.col("metric_code").isin(*BANK_KEY_FACTS)
    flag = lambda t: F.coalesce(F.bool_or(F.col("statement_type") == t), F.lit(False)).alias(t)
    found = banks.select("entity").distinct().join(facts, "entity", "left").groupBy("entity").agg(
        flag("balance_sheet"), flag("income_statement"), flag("cash_flow"), F.count("metric_code").alias("facts"), F.count_distinct("period").alias("periods"),
        F.coalesce(F.bool_or(F.col("period").endswith("Q4")), F.lit(False)).alias("year_end"), F.collect_set(F.when(key, F.col("metric_code"))).alias("have"),
    )
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, BANK_KEY_FACTS)), "have"))
    two = (F.col("periods") >= 2) & F.col("year_end")
    high = F.col("balance_sheet") & F.col("income_statement") & F.col("cash_flow") & two & ((F.size(missing) <= 4) | (F.col("facts") >= 10))
    grade = F.when(high, "high").when(F.col("balance_sheet") & F.col("income_statement") & (F.col("facts") >= 6), "medium").otherwise("low")
    return found.select("entity", "balance_sheet", "income_statement", "cash_flow", two.alias("two_periods"), "facts", F.array_join(missing, ",").alias("missing_key_facts"), grade.alias("grade"))


def analysis_readiness(outcomes: DataFrame, expected: list[str]) -> DataFrame:
    """A row a document: counts of facts, rejected rows and evidence, missing expected metrics, readiness and grade."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    codes = sorted(set(expected))
    lacks = [(F.count_if(F.col("metric_code") == c) == 0).alias(f"lacks_{k}") for k, c in enumerate(codes)]  # a set of codes would be an object a document, which sorts the rows
    got = outcomes.groupBy("document_id").agg(n("fact").alias("facts"), n("rejected").alias("rejected"), n("evidence").alias("evidence"), *lacks)
    missing = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(f"lacks_{k}"), c) for k, c in enumerate(codes)]))
    ready = F.col("facts") > 0
    grade = F.when(ready & (F.size(missing) <= F.greatest(F.lit(2), F.floor(F.col("facts") / 6))), "strong").when(ready, "partial").when(F.col("evidence") > 0, "weak").otherwise("blocked")
    return got.select("document_id", "facts", "rejected", "evidence", F.array_join(missing, ",").alias("missing"), F.when(ready, "true").when(F.col("evidence") > 0, "limited_evidence_only").otherwise("false").alias("llm_ready"), grade.alias("grade"))


def suspicious_facts(facts: DataFrame) -> DataFrame:
    """document_id, row_index, raw_value, reasons of facts whose raw value looks like a note reference, or like one before
    an amount, or whose row is of low trust."""
    raw = F.trim("raw_value")
    reasons = F.array_compact(F.array(
        F.when(raw.rlike(r"^\d{1,2}$"), "raw_value_looks_like_note_reference"), F.when(raw.rlike(r"^\d{1,2}\s+\d{1,3}(?:[ ,]\d{3})+$"), "raw_value_looks_like_note_prefixed_amount"),
        F.when(F.col("low_trust"), "lower_trust_text_fallback_statement_row"),
    ))
    return facts.select("document_id", "row_index", "raw_value", reasons.alias("reasons")).where(F.size("reasons") > 0)


def scan_manifest(items: DataFrame, entity: str | None, period_from: str, period_to: str, standard: str) -> DataFrame:
    """Manifest items with a link, of a standard, in the range of periods; of one entity or of all."""
    from ..functions.periods import in_range

    out = items.where((F.coalesce(F.col("source_url"), F.lit("")) != "") & (F.upper("reporting_standard") == standard.upper()) & in_range(F.col("period"), period_from, period_to))
    out = out if entity is None else out.where(F.col("entity") == entity)
    return out.select("entity", "period", "source_url", F.coalesce("document_type", F.lit("other")).alias("document_type"), F.coalesce("source_role", "document_type", F.lit("other")).alias("source_role"), F.coalesce("expected_file_type", F.lit("unknown")).alias("expected_file_type"), F.coalesce("confidence_score", F.lit(0.9)).alias("confidence_score"))


def scan_statement_tables(artifacts: DataFrame) -> DataFrame:
    """A row a table of the newest artifact of each document: document_id, name, rows.

    artifacts: document_id, modified, statement_tables (array of struct with statement_type, table_index and rows).  A
    type that came before in the document is named with its table's index; no type is ``unknown``.
    """
    newest = artifacts.groupBy("document_id").agg(F.max_by("statement_tables", "modified").alias("tables"))
    each = newest.select("document_id", F.posexplode("tables").alias("place", "t")).withColumn("kind", F.coalesce("t.statement_type", F.lit("unknown")))
    turn = F.row_number().over(Window.partitionBy("document_id", "kind").orderBy("place"))
    return each.select("document_id", F.when(turn == 1, F.col("kind")).otherwise(F.concat_ws("_", "kind", F.col("t.table_index").cast("string"))).alias("name"), F.col("t.rows").alias("rows"))


def is_extension(current_to: Column, new_to: Column) -> Column:
    """Whether a new end period is valid and later than the current one."""
    from ..functions.periods import period_index

    return F.coalesce(period_index(new_to) > period_index(current_to), F.lit(False))


def download_acceptance(candidates: DataFrame) -> DataFrame:
    """candidates with accepted and reason.

    candidates: validation_status, reporting_standard, detected_standard, source_role, detected_role and markers (map).
    """
    role, statements = F.col("source_role"), F.col("detected_role") == "financial_statements"
    on = lambda m: F.coalesce(F.col("markers")[m], F.lit(False))
    whole = statements & on("company") & on("period") & (on("ifrs") | on("ras")) & on("consolidated") & on("primary") & on("notes")
    reason = (
        F.when(F.col("validation_status") != "pass", F.concat(F.lit("document_validation_"), "validation_status")).when(F.upper("reporting_standard") != F.upper("detected_standard"), "reporting_standard_mismatch")
        .when(role == "financial_statements", F.when(~statements, "document_role_not_financial_statements")).when(role.isin("annual_report", "issuer_report", "press_release"), F.when(~whole, "embedded_financial_statements_not_proven")).otherwise("unsupported_source_role")
    )
    return candidates.withColumns({"accepted": reason.isNull(), "reason": reason})


# Titles that show a statement on a page whose tables are weak.
RECOVERY_TITLES = ("consolidated statement of profit or loss", "statement of comprehensive income", "отчет о прибылях и убытках", "statement of financial position", "balance sheet", "statement of cash flows", "cash flows from operating activities", "statement of changes in equity")


def pages_needing_recovery(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """document_id, page, family, needs: whether an IFRS page's statement must be taken from its text.

    pages: document_id, page, text, reporting_standard; tables: document_id, page, statement_type, strong (has a row
    with a label and values).  A page that is a statement needs it if no table of its family is there, or none is
    strong while a line of two values or a title is; an unclassified one only if a table is weak and such a line exists.
    """
    t, raw = matching_text(F.col("text")), F.col("text")
    number = r"\(?-?\d{1,3}(?:[ ,]\d{3})*(?:[.,]\d+)?\)?"
    line = F.exists(F.split(raw, "\n"), lambda x: x.rlike(rf"^\s*\p{{L}}\S*\s+\p{{L}}.*?\s{{2,}}{number}\s{{2,}}{number}\s*$"))
    shown = with_statement_family(pages).withColumns({"apart": is_contents_page(t) | contains_any(t, NOTES) | contains_any(t, AUDITOR), "line": F.coalesce(line, F.lit(False)), "title": contains_any(t, RECOVERY_TITLES)})
    mine = tables.groupBy("document_id", "page").agg(F.collect_set("statement_type").alias("types"), F.collect_set(F.when(F.col("strong"), F.col("statement_type"))).alias("firm"), F.bool_or(~F.col("strong")).alias("weak"))
    rows = shown.join(mine.hint("merge"), ["document_id", "page"], "left")
    family = F.col("primary_family")
    has = lambda c: F.coalesce(F.array_contains(c, family), F.lit(False))
    needs = F.when((F.upper("reporting_standard") != "IFRS") | F.col("apart"), False).when(family == "unknown", F.coalesce(F.col("weak"), F.lit(False)) & F.col("line"))
    needs = needs.when(~has("types"), True).when(has("firm"), False).otherwise(F.col("line") | F.col("title"))
    return rows.select("document_id", "page", family.alias("family"), needs.alias("needs"))


def methodology_notes(metrics: DataFrame, notes: DataFrame) -> DataFrame:
    """metrics (entity, metric_code, inputs, warnings, ...) with the notes of their entity added once.

    notes: entity, metrics (array), input, note: a note holds for its metrics and for any that uses its input.
    """
    rules = notes.groupBy("entity").agg(F.collect_list(F.struct("metrics", "input", "note")).alias("rules"))
    fits = F.filter(F.coalesce("rules", F.array().cast(rules.schema["rules"].dataType)), lambda r: F.array_contains(r["metrics"], F.col("metric_code")) | F.array_contains(F.col("inputs"), r["input"]))
    return metrics.join(rules.hint("merge"), "entity", "left").withColumn("warnings", F.array_union("warnings", F.transform(fits, lambda r: r["note"]))).drop("rules")


def source_candidates(candidates: DataFrame, domains: list[str], limit: int = 10) -> DataFrame:
    """The best candidates of each query with their trust; whether one may be taken by itself.

    candidates: q, entity, provider, url (may be null), confidence.  A domain off the list is rejected; where a query
    matches several entities, all are ambiguous.  Order: confidence, provider, url, all descending.
    """
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    several = F.size(F.collect_set("entity").over(Window.partitionBy("q"))) > 1
    rows = candidates.withColumn("trust", F.when(F.col("url").isNotNull() & ~F.coalesce(host.isin(*domains), F.lit(False)), "rejected").when(several, "ambiguous").otherwise("trusted_candidate"))
    rows = rows.withColumn("several", several).where(F.col("trust") != "rejected")
    order = Window.partitionBy("q").orderBy(F.desc("confidence"), F.desc("provider"), F.desc(F.coalesce("url", F.lit(""))), "entity")
    kept = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    alone = F.count(F.lit(1)).over(Window.partitionBy("q")) == 1
    return kept.select("q", "entity", "provider", "url", "trust", "place", (alone & ~F.col("several") & (F.col("confidence") >= 0.85)).alias("auto_select"))


def catalog_summary(companies: DataFrame, reports: DataFrame, download: bool = True) -> DataFrame:
    """entity, status (PASS, PARTIAL, BLOCKED) and counts of a catalogue's companies.

    companies: entity, page_status; reports: entity, source_role, downloaded, validated (one row a candidate).
    """
    found = reports.groupBy("entity").agg(F.count(F.lit(1)).alias("candidates"), F.bool_or(F.col("source_role") == "financial_statements").alias("statements"), F.count_if(F.col("downloaded")).alias("downloads"), F.count_if(F.col("validated")).alias("valid"))
    rows = companies.join(found.hint("merge"), "entity", "left").fillna(0, ["candidates", "downloads", "valid"]).fillna(False, ["statements"])
    best = F.when(F.col("statements"), "PASS").otherwise("PARTIAL")
    status = F.when((F.col("page_status") == "BLOCKED") | (F.col("candidates") == 0), "BLOCKED")
    status = status.when(F.col("valid") > 0, best).when(F.col("downloads") > 0, "PARTIAL").otherwise("BLOCKED") if download else status.otherwise(best)
    return rows.select("entity", status.alias("status"), "candidates", "downloads", "valid", ((F.col("page_status") == "PASS") & (F.col("candidates") == 0)).alias("requires_js_adapter"), (F.col("valid") == 0).alias("requires_manual_upload"))
