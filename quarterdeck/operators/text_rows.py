"""Facts from the lines of raw text tables, and rows that hold several statement items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import contains_any, parse_number
from ..functions.periods import period_index
from ..functions.text import group_spaced_numbers, matching_text
from ..functions.binding import bound, once

# By statement, the labels of metrics; an equal label counts more than a longer one that holds it.
LABELS = {
    "income_statement": {
        "revenue": ("revenue", "revenues", "total revenues", "sales", "sales and other operating revenues", "sales and other operating revenues net", "выручка", "продажи"),
        "operating_profit": ("operating profit", "profit from operating activities", "прибыль от операционной деятельности"),
        "net_income": (
            "profit for the period", "profit for the year", "profit loss for the period", "profit attributable to pjsc shareholders", "profit attributable to pjsc lukoil shareholders", "net income", "net profit", "прибыль за год",
            "прибыль за период", "чистая прибыль", "прибыль за отчетный период",
        ),
        "interest_income": ("interest income", "процентные доходы"),
        "interest_expense": ("interest expense", "interest expenses", "процентные расходы"),
        "fee_and_commission_income": ("fee and commission income", "fee commission income", "комиссионные доходы"),
        "fee_and_commission_expense": ("fee and commission expense", "fee and commission expenses", "комиссионные расходы"),
        "net_interest_income": ("net interest income", "net interest income after provision for loan impairment", "чистый процентный доход", "чистые процентные доходы", "чистые процентные доходы после создания резерва"),
        "net_fee_commission_income": ("net fee and commission income", "net fee commission income", "чистый комиссионный доход", "чистые комиссионные доходы"),
        "net_trading_income": ("net trading income", "net gains from trading", "чистые доходы от операций с финансовыми инструментами", "чистые доходы от торговых операций"),
        "operating_income": ("operating income", "total operating income", "операционные доходы", "итого операционные доходы", "операционный доход"),
        "operating_expenses": (
            "operating expenses", "administrative and other operating expenses", "staff costs and administrative expenses", "personnel and administrative expenses", "операционные расходы", "административные и прочие операционные расходы",
            "расходы на содержание персонала и административные расходы",
        ),
        "impairment_charge": ("credit loss allowance", "provision for loan impairment", "impairment losses", "расходы по кредитным убыткам", "резерв под ожидаемые кредитные убытки"),
        "profit_before_tax": ("profit before tax", "profit before income tax", "прибыль до налогообложения"),
    },
    "balance_sheet": {
        "total_assets": ("total assets", "итого активов"),
        "total_liabilities": ("total liabilities", "итого обязательств"),
        "total_equity": ("total equity", "total shareholders equity", "итого собственных средств", "итого капитала"),
        "current_assets": ("total current assets", "current assets"),
        "current_liabilities": ("total current liabilities", "current liabilities"),
        "cash_and_equivalents": ("cash and cash equivalents", "денежные средства и их эквиваленты"),
        "loans_to_customers": ("loans and advances to customers", "loans to customers", "кредиты и авансы клиентам"),
        "retail_customer_accounts": ("amounts due to individuals", "retail customer accounts", "средства физических лиц"),
        "corporate_customer_accounts": ("amounts due to corporate customers", "corporate customer accounts", "средства корпоративных клиентов"),
        "customer_accounts": ("amounts due to customers", "customer accounts", "due to customers", "средства клиентов"),
    },
    "cash_flow": {
        "operating_cash_flow": (
            "net cash provided by operating activities", "net cash generated from operating activities", "net cash from operating activities", "чистые денежные средства полученные от операционной деятельности",
            "денежные средства полученные от операционной деятельности",
        ),
        "capex": ("capital expenditures", "purchase of property plant and equipment", "acquisition of property plant and equipment and intangible assets"),
    },
}
# Cash flow labels that count wherever they stand, with their confidence.
CASH_PARTS = (
    ("operating_cash_flow", 0.9, (
        "net cash provided by operating activities", "net cash generated from operating activities", "net cash from operating activities", "чистый приток денежных средств от операционной деятельности",
        "чистый приток денежных средств по операционной деятельности", "чистые денежные средства полученные от операционной деятельности",
    )),
    ("capex", 0.88, ("capital expenditures", "purchase of property plant and equipment", "acquisition of property plant and equipment and intangible assets", "приобретение основных средств")),
)
# Titles of primary statements, and labels that this gate never takes.
TITLES = {
    "balance_sheet": ("statement of financial position", "balance sheet", "отчет о финансовом положении"),
    "income_statement": ("statement of profit or loss", "statement of comprehensive income", "statement of income", "отчет о прибылях и убытках", "отчет о совокупном доходе"),
    "cash_flow": ("statement of cash flows", "отчет о движении денежных средств"),
}
BLOCKED = ("ebitda", "dividend", "total debt", "borrowings", "loans and borrowings", "interest income", "fee and commission income", "процентные доходы", "комиссионные доходы")
EXACT, PART = 0.94, 0.86
#: A number of a line as it is written.
NUMBER = r"\(?-?\d[\d,]*(?:\.\d+)?\)?"
#: Lines that may make one row together, and lines of a table that may say its periods.
WIDEST, HEADER_LINES = 3, 8


def label_metric(normal: Column, statement: Column) -> Column:
    """(metric, confidence) of a label in the normal form, or null: a cash flow part, an equal label, the longest inside."""
    out = None
    for name, metrics in LABELS.items():
        pairs = [(alias, metric) for metric, aliases in metrics.items() for alias in aliases]
        equal = F.create_map(*[F.lit(x) for pair in dict(pairs).items() for x in pair])[normal]
        inside = F.array_max(F.array_compact(F.array(*[F.when(normal.contains(alias), F.struct(F.lit(len(alias)).alias("n"), F.lit(-k).alias("k"), F.lit(metric).alias("metric"))) for k, (alias, metric) in enumerate(pairs)])))["metric"]
        said = lambda metric, confidence: F.struct(metric.alias("metric"), F.lit(confidence).alias("confidence"))
        test = F.coalesce(bound(equal, lambda x: F.when(x.isNotNull(), said(x, EXACT))), bound(inside, lambda x: F.when(x.isNotNull(), said(x, PART))))
        if name == "cash_flow":
            first, second = CASH_PARTS
            test = F.when(contains_any(normal, first[2]), said(F.lit(first[0]), first[1])).when(contains_any(normal, second[2]), said(F.lit(second[0]), second[1])).otherwise(test)
        out = F.when(statement == name, test) if out is None else out.when(statement == name, test)
    return out


def trailing_numbers(line: Column) -> Column:
    """(label, numbers): a line's numbers at its end, spaced ones put together, and what stands before them."""
    mark = "\x01"
    tail = F.regexp_extract(F.regexp_replace(line, NUMBER, mark), rf"(?:{mark}\s*)+$", 0)
    found = F.regexp_extract_all(line, F.lit(f"({NUMBER})"))

    def cut(tail, found):
        k = F.length(tail) - F.length(F.replace(tail, F.lit(mark), F.lit("")))
        last = F.slice(found, F.size(found) - k + 1, k)
        size = F.length(tail) - k + F.length(F.array_join(last, ""))
        label = F.trim(F.regexp_replace(F.substring(line, F.lit(1), F.length(line) - size), r"\s+", " "))
        numbers = F.filter(group_spaced_numbers(last), lambda x: parse_number(x).isNotNull())
        return F.when(k > 0, F.struct(label.alias("label"), numbers.alias("numbers")))

    # most lines of a text end in no number
    return F.when(line.rlike(r"[\d,)]\s*$"), bound(tail, lambda tail: bound(found, lambda found: cut(tail, found))))


def _year(period: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(period, F.lit("")), r"^(\d{4})", 1).try_cast("int"), F.lit(2021))


def _period_order(header: Column, period: Column, statement: Column) -> Column:
    """Where the header puts the current period beside the one before."""
    p = F.coalesce(period, F.lit(""))
    year = _year(period)
    at = lambda words, y: F.nullif(F.instr(header, F.concat(F.lit(words), y.cast("string"))), F.lit(0))
    month = F.when(p.endswith("Q1"), F.least(at("31 march ", year), at("march ", year))).when(p.endswith("Q2"), F.least(at("30 june ", year), at("june ", year)))
    month = month.when(p.endswith("Q3"), F.least(at("30 september ", year), at("september ", year))).when(p.endswith("Q4") | p.rlike(r"^\d{4}$"), at("31 december ", year))
    now, before = F.least(month, at("", year)), F.least(at("31 december ", year - 1), at("", year - 1))
    third = (statement == "income_statement") & ((p.endswith("Q2") & header.contains("for the six")) | (p.endswith("Q3") & header.contains("for the nine")))
    return F.when(third, "current_ytd_third").when(now.isNull(), F.when(statement == "income_statement", "current_first_inferred").otherwise("unknown")).when(before.isNull(), "single_current").when(now < before, "current_first").otherwise("current_second")


def _selected(numbers: Column, order: Column, bank: Column, now: Column, before: Column) -> Column:
    """Array of (raw, period, column) that a line's numbers give, empty if their periods aren't clear."""
    note = (F.size(numbers) >= 3) & F.regexp_replace(F.get(numbers, F.lit(0)), r"[(), ]", "").rlike(r"^\d{1,2}$")
    values = F.when(note, F.slice(numbers, 2, F.size(numbers))).otherwise(numbers)
    first = order.isin("current_first", "current_first_inferred")

    def made(values):
        n = F.size(values)
        pick = lambda k, period, name: F.struct(F.get(values, F.lit(k)).alias("raw"), period.alias("period"), name.alias("column"))
        text = lambda x: F.lit(x)
        lone = F.when(n == 1, F.array(pick(0, now, text("single_current_period_value")))).when((n == 4) & (order == "current_ytd_third"), F.array(pick(2, now, order)))
        two = F.when((n == 2) & first, F.array(pick(0, now, order))).when((n == 2) & (order == "current_second"), F.array(pick(1, now, order)))
        both = F.when((n == 2) & first, F.array(pick(1, before, text("comparative_second")), pick(0, now, text("current_first")))).when((n == 2) & (order == "current_second"), F.array(pick(0, before, text("comparative_first")), pick(1, now, text("current_second"))))
        return F.coalesce(lone, F.when(bank, both).otherwise(two), F.array().cast("array<struct<raw:string,period:string,column:string>>"))

    return bound(values, made)


def text_line_facts(tables: DataFrame) -> DataFrame:
    """document_id, table_index, line_index, width, outcome (fact, rejected or table_rejected), raw_label, metric_code,
    period, raw_value, value, confidence, column_name, reason, warnings of raw text tables, a row a finding.

    tables: document_id, table_index, statement_type, period, extraction_method, quality_flag, source_location, page_number,
    table_title, headers (array), lines (array), unit, currency, unit_multiplier, is_bank.  A table that isn't raw text of a
    primary statement, can't be traced, is a note or names no statement is refused as a whole, before its lines are
    exploded.  A line, or two or three beside each other where the first has no metric of its own, gives a label and trailing
    numbers; a note reference before two values is left out.  The header and the first lines say which number is current; banks give
    the comparative one too (the fourth quarter of the year before).  Values are multiplied by the table's unit; without a
    unit or currency a line is rejected.  Null arrays count as empty; tables without lines are refused.
    """
    said = F.coalesce("lines", F.array().cast("array<string>"))
    t = tables.withColumn("lines", F.transform(said, lambda x: F.trim(F.coalesce(x, F.lit("")))))
    opening = F.array_join(F.slice("lines", 1, HEADER_LINES), " ")
    title = matching_text(F.col("table_title"))
    heads = F.array_join(F.coalesce("headers", F.array().cast("array<string>")), " ")
    says = {"title": title, "opening": matching_text(F.concat_ws(" ", "table_title", opening)), "header": matching_text(F.concat_ws(" ", heads, opening)), "top": matching_text(F.get("lines", F.lit(0)))}
    t = once(t, "says", F.struct(*[c.alias(k) for k, c in says.items()])).select("*", "says.*")
    shown = F.lit(False)
    for name, words in TITLES.items():
        shown = shown | ((F.col("statement_type") == name) & contains_any(F.col("opening"), words))
    sure = lambda c: F.coalesce(c, F.lit(False))
    traced = sure((F.coalesce("source_location", F.lit("")) != "") & F.col("table_index").isNotNull() & (F.coalesce("page_number", F.lit(0)) != 0))
    refused = (
        F.when(~sure((F.col("extraction_method") == "text_table_fallback") & (F.col("quality_flag") == "raw_text_table")), "not_text_fallback_raw_table").when(~sure(F.col("statement_type").isin(*LABELS)), "unsupported_statement_type_for_text_fallback")
        .when(~traced, "missing_traceability").when(F.col("title").contains("notes to") | F.col("top").startswith("note "), "notes_fallback_not_eligible_for_fact_normalization").when(~sure(shown), "primary_statement_marker_not_detected")
    )
    t = t.withColumn("refused", refused)
    table_key = ("document_id", "table_index")
    t = t.withColumn("order", F.when(F.col("refused").isNull(), _period_order(F.col("header"), F.col("period"), F.col("statement_type"))))
    # one pass: a refused table goes on as a row without a line; a line goes with the few that may make one row with it
    taken = F.col("refused").isNull()
    windows = F.when(taken, F.transform("lines", lambda x, i: F.slice("lines", i + 1, WIDEST)))
    one = t.select(*table_key, "refused", "statement_type", "period", "order", "unit", "currency", "unit_multiplier", "is_bank", F.posexplode_outer(windows).alias("line_index", "group"))
    one = one.withColumn("line", F.get("group", F.lit(0))).where(~taken | (F.coalesce("line", F.lit("")) != ""))
    metric = F.when(F.col("n") != "", label_metric(F.col("n"), F.col("statement_type")))
    one = once(once(once(one, "x", trailing_numbers(F.col("line"))), "n", matching_text(F.col("x.label"))), "m", metric)
    plain = F.col("plain")
    head = contains_any(plain, [w for words in TITLES.values() for w in words] + ["million", "russian rubles"]) | plain.startswith("note")
    closed = ~taken | sure((F.col("x.label") != "") & (F.size("x.numbers") > 0) & F.col("m").isNotNull())
    one = once(once(one, "plain", F.when(~closed, matching_text(F.col("line")))), "open", ~closed & ~sure(head)).drop("plain")
    widths = F.when(F.col("open"), F.array(*[F.lit(k) for k in range(1, WIDEST + 1)])).otherwise(F.array(F.lit(1)))
    group = F.slice("group", F.lit(1), F.col("width"))
    wide = one.select("*", F.explode(widths).alias("width")).where((F.col("width") == 1) | ((F.size(group) == F.col("width")) & ~F.exists(group, lambda x: x == "")))

    def again(rows, name, value):  # of a single line it is known
        out = once(rows.withColumnRenamed(name, "known"), name, F.when(F.col("width") == 1, F.col("known")).otherwise(value))
        return out.drop("known")

    rows = again(wide, "x", trailing_numbers(F.array_join(group, " "))).where(~taken | sure((F.size("x.numbers") > 0) & (F.col("x.label") != "")))
    rows = again(again(rows, "n", matching_text(F.col("x.label"))), "m", metric).drop("group")
    barred = (
        F.when(F.col("n").contains("per share"), "per_share_row_not_statement_fact").when(F.col("n").contains("непрофиль"), "non_core_revenue_not_statement_revenue")
        .when(F.col("n").contains("страхов") & contains_any(F.col("n"), ("выручк", "revenue")), "insurance_revenue_not_total_revenue")
    )
    year = F.when(F.upper("period").rlike(r"^\d{4}$"), F.concat(F.col("period"), F.lit("Q4"))).otherwise(F.upper(F.coalesce("period", F.lit(""))))
    rows = once(rows, "picked", _selected(F.col("x.numbers"), F.col("order"), F.coalesce("is_bank", F.lit(False)), year, F.concat((_year(F.col("period")) - 1).cast("string"), F.lit("Q4"))))
    based = (F.coalesce("unit", F.lit("")) != "") | (F.coalesce("currency", F.lit("")) != "")
    reason = (
        F.when(~taken, F.col("refused")).when(barred.isNotNull(), barred).when(F.col("m").isNull(), F.when(contains_any(F.col("n"), BLOCKED), "unsupported_metric_for_text_fallback").otherwise("")).when(F.size("picked") == 0, "ambiguous_period_column")
        .when(~based, "unit_or_currency_basis_missing")
    )
    rows = once(rows, "reason", reason).where(F.coalesce("reason", F.lit("-")) != "")
    # null picks stand for rejected lines
    rows = rows.select("*", F.explode_outer(F.when(F.col("reason").isNull(), F.col("picked"))).alias("pick"))
    warned = F.concat_ws(",", F.lit("derived_from_raw_text_table_requires_extra_caution"), F.when(F.col("order") == "current_first_inferred", "current_period_column_inferred_from_statement_layout").when(F.col("order") == "unknown", "current_period_header_not_detected"))
    fact = F.col("reason").isNull()
    return rows.select(
        *table_key, "line_index", F.when(taken, F.col("width")).alias("width"), F.when(fact, "fact").when(taken, "rejected").otherwise("table_rejected").alias("outcome"), F.col("x.label").alias("raw_label"), F.when(barred.isNull(), F.col("m.metric")).alias("metric_code"), "pick.period",
        F.col("pick.raw").alias("raw_value"), (parse_number(F.col("pick.raw")) * F.coalesce(F.nullif(F.col("unit_multiplier"), F.lit(0.0)), F.lit(1.0))).alias("value"), F.when(fact, F.col("m.confidence")).alias("confidence"),
        F.col("pick.column").alias("column_name"), "reason", F.when(fact, warned).alias("warnings"),
    )


# The subtotal that the two numbers before a heading of a balance sheet belong to.
BEFORE_HEADING = (("current assets", "Non-current assets"), ("current liabilities", "Non-current liabilities"), ("total assets", "Current assets"), ("total liabilities", "Current liabilities"))


def _parts(text: Column) -> Column:
    """Array of (label, numbers) of a line, cut where words follow a number; a note reference before two values is left out."""
    lines = F.split(F.regexp_replace(text, rf"(?<=^|\s)({NUMBER})\s+(?=[^\d(\-\s]|[(\-](?!\d))", "$1\n"), "\n")

    def read(x):
        numbers = F.regexp_extract_all(F.regexp_extract(x, rf"((?:(?:^|\s){NUMBER})+)$", 1), F.lit(f"({NUMBER})"))
        label = F.trim(F.regexp_replace(x, rf"(?:(?:^|\s){NUMBER})+$", ""))
        noted = (F.size(numbers) == 3) & F.get(numbers, F.lit(0)).rlike(r"^\d{1,2}$")
        return F.struct(label.alias("label"), F.when(noted, F.slice(numbers, 2, 2)).otherwise(numbers).alias("numbers"))

    return F.transform(lines, read)


def split_merged_rows(rows: DataFrame) -> DataFrame:
    """document_id, table_index, row_index, part, line, current, comparative, mode: rows, one for each item that they hold.

    rows: document_id, table_index, row_index, statement_type, line, current, comparative.  A line is cut where words follow a
    number.  Of an income or cash flow row with values in cells of its own, each part but the last brings two numbers and the last
    takes the cells (embedded); without such cells every part brings one or two (merged).  In a balance sheet, two numbers
    before the heading of the next block are the subtotal of the block before, and the rest of the heading takes the cells
    (leading_total).  Every part must be the label of a metric, else the row stays whole (mode null, part 0), as do null and
    empty lines.
    """
    text = F.trim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+", " "))
    t = rows.select("document_id", "table_index", "row_index", "statement_type", "line", "current", "comparative", text.alias("t"))
    t = t.withColumn("own", parse_number(F.col("current")).isNotNull() | parse_number(F.col("comparative")).isNotNull()).withColumn("p", _parts(F.col("t")))
    known = lambda label: label_metric(matching_text(label), F.col("statement_type")).isNotNull()
    n, two = F.size("p"), lambda x: F.size(x["numbers"]) == 2
    last, lead = F.slice("p", -1, 1), F.slice("p", F.lit(1), F.greatest(n - 1, F.lit(0)))
    t = t.withColumn("named", F.forall("p", lambda x: (x["label"] != "") & known(x["label"])))
    flow = F.col("statement_type").isin("income_statement", "cash_flow") & (n > 1) & F.col("named")
    tail = F.size(F.get(last, F.lit(0))["numbers"]) == 0
    embedded = flow & F.col("own") & F.forall(lead, two) & tail
    merged = flow & ~F.col("own") & F.forall("p", lambda x: F.size(x["numbers"]).between(1, 2))
    item = lambda label, a, b: F.struct(label.alias("line"), a.alias("current"), b.alias("comparative"))
    of = lambda x: item(x["label"], F.get(x["numbers"], F.lit(0)), F.get(x["numbers"], F.lit(1)))
    rest = lambda label: item(label, F.col("current"), F.col("comparative"))
    # a balance sheet row: two numbers, a heading, and the first item of its block or, after a total, nothing or two
    # numbers and the next item
    heading, subtotal, after = F.lit(None).cast("string"), F.lit(None).cast("string"), F.get("p", F.lit(1))["label"]
    for alias, name in reversed(BEFORE_HEADING):
        here = F.lower(after).startswith(alias) & F.lower(after).rlike(rf"^{alias}( |$)")
        heading, subtotal = F.when(here, F.substring(after, 1, len(alias))).otherwise(heading), F.when(here, name).otherwise(subtotal)
    first = F.get("p", F.lit(0))
    led = F.coalesce((F.col("statement_type") == "balance_sheet") & F.col("own") & (n > 1) & (first["label"] == "") & two(first) & heading.isNotNull(), F.lit(False))
    t = t.withColumns({"heading": F.when(led, heading), "subtotal": subtotal, "after": F.trim(F.substring(after, F.length(heading) + 1, F.length(after)))})
    total = F.lower("heading").startswith("total")
    top = item(F.col("subtotal"), first["numbers"][0], first["numbers"][1])
    block = F.when(F.col("heading").isNull(), None).when(~total & (n == 2) & (F.size(F.get("p", F.lit(1))["numbers"]) == 0) & (F.col("after") != "") & known(F.col("after")), F.array(top, rest(F.col("after"))))
    block = block.when(total & (F.col("after") == "") & (n == 2) & (F.size(F.get("p", F.lit(1))["numbers"]) == 0), F.array(top, rest(F.col("heading"))))
    follow = F.get("p", F.lit(2))
    block = block.when(total & (F.col("after") == "") & (n == 3) & two(F.get("p", F.lit(1))) & (F.size(follow["numbers"]) == 0) & known(follow["label"]), F.array(top, of(F.get("p", F.lit(1))), rest(follow["label"])))
    items = F.when(embedded, F.concat(F.transform(lead, of), F.transform(last, lambda x: rest(x["label"])))).when(merged, F.transform("p", of)).otherwise(block)
    mode = F.when(embedded, "embedded").when(merged, "merged").when(block.isNotNull(), "leading_total")
    whole = F.array(item(F.col("line"), F.col("current"), F.col("comparative")))
    t = t.select("document_id", "table_index", "row_index", mode.alias("mode"), F.coalesce(items, whole).alias("items"))
    out = t.select("document_id", "table_index", "row_index", "mode", F.posexplode_outer("items").alias("part", "i"))
    return out.select("document_id", "table_index", "row_index", "part", "i.line", "i.current", "i.comparative", "mode")
