"""Validation of report documents by what their texts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.numbers import contains_any
from ..functions.text import matching_text
from .statements import detect_period

# What documents say of their standard, kind and parts, in the normal form of a text.
IFRS = ("ifrs", "international financial reporting standards", "мсфо", "международным стандартам финансовой отчетности", "международные стандарты финансовой отчетности")
CONSOLIDATED = (
    "consolidated financial statements", "consolidated interim condensed financial", "консолидированная финансовая отчетность", "консолидированной финансовой отчетности", "обобщенная консолидированная финансовая отчетность",
    "обобщенной консолидированной финансовой отчетности",
)
ANNUAL = ("annual report", "integrated report", "годовой отчет")
RAS = ("russian accounting standards", "ras", "рсбу", "бухгалтерская отчетность", "бухгалтерская финансовая отчетность")
PRESS = ("press release", "financial results")
PRIMARY = (
    "statement of financial position", "statement of profit or loss", "statement of cash flows", "отчет о финансовом положении", "отчет о прибылях и убытках", "бухгалтерский баланс", "отчет о финансовых результатах",
    "отчет о движении денежных средств",
)
STATEMENTS_RU = ("бухгалтерская отчетность", "бухгалтерский баланс", "отчет о финансовых результатах", "отчет о движении денежных средств")
NOTES = ("notes to", "примечания")
AUDITOR = ("independent auditor", "auditor report", "аудиторское заключение", "независимого аудитора")
STOPWORDS = (
    "ao", "company", "group", "inc", "jsc", "llc", "pjsc", "public", "the", "ао", "зао", "компания", "общество", "ооо", "оао", "пао", "публичное", "акционерное",
)
#: The markers, and the weights of the score.
MARKERS = {"ifrs": IFRS, "consolidated": CONSOLIDATED, "annual_report": ANNUAL, "ras": RAS, "press_release": PRESS, "primary": PRIMARY, "notes": NOTES, "auditor": AUDITOR}


def entity_words(text: Column) -> Column:
    """Runs of letters and digits of English and Russian, in lower case, ё as е; to look for them is several times faster
    than to replace what stands between."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), F.lit("[0-9a-zа-я]+"), F.lit(0))


def entity_text(text: Column) -> Column:
    """The normal form in which names are looked for: the words of a text between single spaces."""
    return F.array_join(entity_words(text), " ")


def name_tokens(normal: Column, stopwords=STOPWORDS) -> Column:
    """Distinct words of three characters or more of a name in the normal form, without those that any company has."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords)))


def enough_tokens(tokens: Column) -> Column:
    """Whether name_tokens alone stand for a name: two or more, or one of five characters or more."""
    return (F.size(tokens) >= 2) | ((F.size(tokens) == 1) & (F.length(F.get(tokens, F.lit(0))) >= 5))


def mentions(text: Column, name: Column) -> Column:
    """A name of three characters or more stands in the text, or all of its two or more tokens are words of it, or its only
    token of five or more is; text and name in the normal form."""
    def among(tokens):  # words stand between single spaces
        words = lambda padded: F.forall(tokens, lambda t: padded.contains(F.concat(F.lit(" "), t, F.lit(" "))))
        return enough_tokens(tokens) & bound(F.concat(F.lit(" "), text, F.lit(" ")), words)

    said = bound(name, lambda n: (n != "") & (((F.length(n) >= 3) & text.contains(n)) | bound(name_tokens(n), among)))
    return F.coalesce(said, F.lit(False))


def document_markers(docs: DataFrame, trusted: tuple[str, ...]) -> DataFrame:
    """docs with markers (map of ten booleans), detected_role, detected_standard, detected_period, score and
    validation_status.

    docs: text, names (array: ticker, names and aliases of its company), source_url, file_name, file_type (expected), content_hash,
    report_period, reporting_standard, source_role.  Whole texts are read, each marker in one pass over the normal
    form.  The score weighs a trusted host 0.15, a text 0.15, a hash 0.10, the expected file type 0.10, the company 0.15, the
    stated standard 0.15, the stated role 0.15 (0.10 for roles other than statements and annual reports) and a period 0.05;
    from 0.75 on a document passes unless a marker that its role needs is missing, from 0.5 on it is partial.  A null or empty
    text shows no marker; a null name counts as none.
    """
    host = F.lower(F.try_parse_url("source_url", F.lit("HOST")))
    sure = lambda c: F.coalesce(c, F.lit(False))
    # bound in a projection of their own, so that the normal forms are made once a text
    needed = ("text", "names", "source_url", "file_name", "file_type", "content_hash", "report_period", "reporting_standard", "source_role")
    rows = docs.select(F.struct(*docs.columns).alias("\x01row"), *needed).withColumn("\x01t", matching_text(F.col("text"))).withColumn("\x01e", F.trim(F.regexp_replace("\x01t", "[^0-9a-zа-я]+", " ")))
    rows = rows.withColumn("\x01headers", F.lit(None).cast("string"))
    periods = detect_period(rows, headers="\x01headers", body="text", filename="file_name", preferred="report_period")
    t = F.col("\x01t")
    company = F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: mentions(F.col("\x01e"), entity_text(n)))
    dated = periods.withColumn("\x01dated", sure((F.col("source") != "upload_default") & F.col("period").isNotNull()))
    said = dated.withColumns({f"\x01{k}": contains_any(t, words) for k, words in MARKERS.items()} | {"\x01company": company, "\x01ru": contains_any(t, STATEMENTS_RU)})
    on = lambda k: F.col(f"\x01{k}")
    role = F.when(on("consolidated") | on("ru"), "financial_statements").when(on("annual_report"), "annual_report").when(on("press_release"), "press_release").otherwise(F.coalesce("source_role", F.lit("other")))
    standard = F.when(on("ifrs"), "IFRS").when(on("ras"), "RAS").otherwise(F.coalesce("reporting_standard", F.lit("UNKNOWN")))
    said = said.withColumns({"detected_role": role, "detected_standard": standard})
    kind, name = F.lower(F.coalesce("file_type", F.lit("unknown"))), F.lower(F.coalesce("file_name", F.lit("")))
    fits = F.when(kind == "pdf", name.endswith(".pdf") | sure(F.col("text").startswith("%PDF"))).when(kind.isin("xlsx", "xls"), name.endswith(".xlsx") | name.endswith(".xls")).otherwise(True)
    weigh = lambda test, w: F.when(sure(test), w).otherwise(0.0)
    same = sure(F.col("detected_role") == F.col("source_role"))
    major = sure(F.col("source_role").isin("financial_statements", "annual_report"))
    parts = [
        weigh(host.isin(*trusted), 0.15), weigh(F.coalesce("text", F.lit("")) != "", 0.15), weigh(F.coalesce("content_hash", F.lit("")) != "", 0.1), weigh(fits, 0.1), weigh(on("company"), 0.15),
        weigh(F.col("detected_standard") == F.col("reporting_standard"), 0.15), F.when(same & major, 0.15).when(same & ~major, 0.1).otherwise(0.0), weigh(on("dated"), 0.05),
    ]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    stated = F.col("source_role")
    needs = (
        F.when(stated == "financial_statements", F.when(F.col("reporting_standard") == "RAS", on("ras") & on("primary")).otherwise(on("ifrs") & on("consolidated")))
        .when(stated == "annual_report", on("annual_report")).when(stated == "press_release", on("press_release")).otherwise(True)
    )
    said = said.withColumn("score", F.round(score, 4))
    status = F.when((F.col("score") >= 0.75) & needs, "pass").when(F.col("score") >= 0.5, "partial").otherwise("fail")
    shown = F.create_map(*[x for k in ("company", *MARKERS) for x in (F.lit(k), on(k))], F.lit("period"), on("dated"))
    return said.select("\x01row.*", shown.alias("markers"), "detected_role", "detected_standard", F.col("period").alias("detected_period"), "score", status.alias("validation_status"))
