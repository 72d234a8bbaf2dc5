"""Merging the table rows of several extraction engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept, swept
from .candidates import conflict_reason
from .grids import once
from .statements import label_tokens, labels_match

#: Ways to match two rows, the surest first.
LABEL, SIMILAR, CONTINUED, BLANK = range(4)
CONTEXT = ("unit", "currency", "comparative_period")


def _tables(rows: DataFrame) -> DataFrame:
    """One row a table: what its rows say of it, the largest of different values."""
    said = ("page_number", "statement_type", "statement_family", "table_role", "period", *CONTEXT)
    return rows.groupBy("document_id", "table_index").agg(*[F.max(c).alias(c) for c in said])


def _known(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))


def match_tables(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate tables (document_id, candidate_index) with table_index, outcome (merge, conflict, add or ignore) and reason.

    A candidate table meets the first table of its page and statement; if it doesn't know its statement, the only table of
    a primary statement on the page.  One that meets none is added if it knows its statement, else ignored.  Tables that
    disagree on family, period or comparative period conflict; unknown values agree with all.
    """
    return _matched(_tables(existing), _tables(candidates))


def _matched(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    e, c = existing, candidates.withColumnRenamed("table_index", "candidate_index")
    e = e.withColumn("statement", _known("statement_type"))
    first = e.groupBy("document_id", "page_number", "statement").agg(F.min("table_index").alias("same"))
    primary = e.where((F.col("statement") != "unknown") & F.coalesce(F.col("table_role").startswith("primary_statement"), F.lit(False)))
    sole = primary.groupBy("document_id", "page_number").agg(F.min("table_index").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    c = c.withColumn("statement", _known("statement_type"))
    met = c.hint("merge").join(first.hint("merge"), ["document_id", "page_number", "statement"], "left").hint("merge").join(sole.hint("merge"), ["document_id", "page_number"], "left")
    at = F.coalesce("same", F.when(F.col("statement") == "unknown", F.col("only")))
    met = met.select("document_id", "candidate_index", "statement", F.col("statement_family").alias("family"), F.col("period").alias("p"), F.col("comparative_period").alias("q"), at.alias("table_index"))
    base = e.select("document_id", "table_index", F.col("statement_family").alias("e_family"), F.col("statement").alias("e_statement"), F.col("period").alias("e_p"), F.col("comparative_period").alias("e_q"))
    both = met.hint("merge").join(base.hint("merge"), ["document_id", "table_index"], "left")
    family = lambda a, b: F.nullif(F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b)), F.lit("unknown"))
    differ = lambda a, b: F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    apart = F.when(differ(family("family", "statement"), family("e_family", "e_statement")), "statement_family_conflict").when(differ(F.col("p"), F.col("e_p")) | differ(F.col("q"), F.col("e_q")), "period_conflict")
    outcome = F.when(F.col("table_index").isNull(), F.when(F.col("statement") == "unknown", "ignore").otherwise("add")).when(apart.isNotNull(), "conflict").otherwise("merge")
    return both.select("document_id", "candidate_index", "table_index", outcome.alias("outcome"), F.when(F.col("table_index").isNotNull(), apart).alias("reason"))


def _dealt(*parts: DataFrame) -> DataFrame:
    """All rows of parts, dealt by document once: windows and groups within a document move them no more, as joins would.

    part: the number of the part, own: the table by itself, which is the existing or the candidate table's.
    """
    numbered = [rows.withColumn("part", F.lit(n)) for n, rows in enumerate(parts)]
    out = numbered[0]
    for rows in numbered[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out.repartition("document_id")


def _said(c: str, part: int) -> Column:
    return F.max(F.when(F.col("part") == part, F.col(c)))


def _chosen_pairs(base: DataFrame, new: DataFrame, met: DataFrame) -> DataFrame:
    """One row a row of base that takes one of new: document_id, table_index, row_index, candidate_index, candidate_row, way.

    met: document_id, candidate_index, table_index.  Rows meet by shared label words, equal metrics, equal labels without a
    word, or places next to each other where one of them is blank or goes on, never table by table.
    """
    table = ["document_id", "table_index"]
    valued = (F.coalesce("current", F.lit("")) != "") | (F.coalesce("comparative", F.lit("")) != "")
    narrow = lambda rows, own, row: rows.select("document_id", F.col(own).alias("own"), F.col(row).alias("row"), F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("l"), valued.alias("valued"), "metric_code", "row_kind")
    old = narrow(base, "table_index", "row_index")
    both_ways = met.select("document_id", "table_index", F.explode(F.array(F.struct(F.lit(True).alias("mine"), F.col("table_index").alias("own")), F.struct(F.lit(False).alias("mine"), F.col("candidate_index").alias("own")))).alias("x"))
    rows = _dealt(old, narrow(new, "candidate_index", "candidate_row"), both_ways.select("document_id", "table_index", "x.*"))
    rows = rows.withColumn("mine", F.coalesce("mine", F.col("part") == 0))
    # rows of tables that take none, or that none takes, meet nothing
    rows = rows.withColumn("table_index", _said("table_index", 2).over(Window.partitionBy("document_id", "mine", "own"))).where("part < 2 and table_index is not null")
    mine = F.col("mine")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*table, "mine").orderBy("own", "row")))
    rows = once(rows, "tokens", label_tokens(F.col("l")))

    blank, at = F.col("l") == "", lambda mark, n=0: F.concat(F.lit(mark), (F.col("place") + n).cast("string"))
    opens = ~F.col("valued") & ~blank & (F.size(F.split("l", " ")) >= 2)
    goes_on = F.col("valued") & F.col("l").rlike(r"^(and|or|of|for|to|in|net|и|или|от|для|по|в|на)\b")
    rows = rows.withColumn("role", F.when(mine, opens).otherwise(goes_on))
    # a row for each thing by which a row meets others
    beside = [F.when(blank == mine, at("blank ")).otherwise(at("full ")), F.when(F.col("role"), at("next ")), F.when(mine & F.col("role"), at("next ", 1))]
    common = [F.when(~blank & (F.size("tokens") == 0), F.concat(F.lit("label "), "l")), F.concat(F.lit("metric "), "metric_code")]
    keys = F.concat(F.array_compact(F.array(*common, *beside)), F.transform("tokens", lambda t: F.concat(F.lit("word "), t)))
    fields = ("row", "l", "tokens", "metric_code", "row_kind", "place", "role")
    seen = rows.select(*table, "mine", "own", *fields, F.explode(keys).alias("k"))
    seen = seen.withColumn("a", F.collect_list(F.when(F.col("mine"), F.struct(*fields))).over(Window.partitionBy(*table, "k")))
    pairs = seen.where(~F.col("mine")).withColumn("a", F.explode("a"))
    kind = F.coalesce((F.col("a.row_kind") == F.col("row_kind")) | (F.col("a.row_kind") == "") | (F.col("row_kind") == ""), F.lit(True))
    one_blank = (F.col("a.l") == "") != (F.col("l") == "")
    way = (
        F.when((F.col("a.l") == F.col("l")) & (F.col("a.l") != ""), LABEL).when(labels_match(F.col("a.tokens"), F.col("tokens"), F.col("a.metric_code"), F.col("metric_code")), SIMILAR)
        .when(F.col("a.role") & F.col("role"), CONTINUED).when(one_blank & (F.col("a.place") == F.col("place")), BLANK)
    )
    pairs = pairs.where(kind).select(*table, F.col("a.row").alias("row_index"), F.col("own").alias("candidate_index"), F.col("row").alias("candidate_row"), way.alias("way")).where(F.col("way").isNotNull())
    first = pairs.groupBy(*table, "candidate_index", "candidate_row").agg(F.min(F.struct("way", "row_index")).alias("x")).select(*table, "candidate_index", "candidate_row", "x.*")
    its = first.groupBy(*table, "row_index").agg(F.min(F.struct("way", "candidate_index", "candidate_row")).alias("x"))
    return its.select(*table, "row_index", "x.*")


def merge_engine_tables(existing: DataFrame, candidates: DataFrame, priority: dict[str, int]) -> DataFrame:
    """document_id, table_index, row_index, origin, label, current, comparative, row_kind, engines, fusion_status, mode,
    reason, warning, unit, currency: the rows of existing with those of candidates merged in.

    Both: document_id, table_index, page_number, statement_type, statement_family, table_role, period, comparative_period, unit,
    currency, engine, row_index, row_kind, metric_code, label, current, comparative, confidence.  Tables meet as match_tables says.
    origin is existing (a row as it was), merged, evidence (a candidate row kept beside: its table or the row conflicts),
    appended (a candidate row that matched none) or added (a row of a candidate table of its own).

    A row takes one candidate row at most and gives itself to one: of its possible rows a candidate chooses the surest match, then
    the first row; of several candidates a row keeps the surest, then the first, and the others are appended.  Rows of
    the same kind match by equal labels, similar ones (labels_match), as a continuation, or with one label empty at the same place.
    Similar and continued rows are merged, the others fused as by fuse_candidates, where the order of two candidates, and so priority,
    doesn't change whether they merge.  Context that a table lacks is filled from its candidates.  Null labels count as
    empty; empty inputs are allowed.  Both inputs are read three times: write out what is costly to derive.
    """
    spark = existing.sparkSession

    def step(df, name):  # whose shuffle files are gone when the next begins
        out = kept(df, f"engine-{name}")
        swept(spark)
        return out

    e, c = step(_tables(existing), "tables"), step(_tables(candidates), "tables")
    tables = step(_matched(e, c), "matches")
    met = tables.where("outcome = 'merge'").select("document_id", "candidate_index", "table_index")
    given = c.withColumnRenamed("table_index", "candidate_index").select("document_id", "candidate_index", *CONTEXT[:2]).hint("merge").join(met.hint("merge"), ["document_id", "candidate_index"])
    given = given.groupBy("document_id", "table_index").agg(*[F.min(F.nullif(F.col(x), F.lit(""))).alias(f"new_{x}") for x in CONTEXT[:2]])
    context = e.select("document_id", "table_index", *CONTEXT[:2]).hint("merge").join(given.hint("merge"), ["document_id", "table_index"], "left")
    context = context.select("document_id", F.col("table_index").alias("at"), F.struct(*[F.coalesce(F.nullif(F.col(x), F.lit("")), F.col(f"new_{x}")).alias(x) for x in CONTEXT[:2]]).alias("context"))
    context = step(context, "context")
    new = candidates.withColumnsRenamed({"table_index": "candidate_index", "row_index": "candidate_row"}).where("document_id is not null and candidate_index is not null")
    chosen = step(_chosen_pairs(existing, new, met), "pairs")

    # every row once, with what is said of its table and of the row it was chosen with
    fields = ("label", "current", "comparative", "row_kind", "engine", "confidence", "statement_family", "statement_type", "period", "page_number")
    old = existing.select("document_id", F.col("table_index").alias("own"), F.col("table_index").alias("at"), F.col("row_index").alias("row"), F.col("row_index").alias("with"), F.struct(*fields).alias("x"))
    new = new.select("document_id", F.col("candidate_index").alias("own"), F.col("candidate_row").alias("row"), F.struct(*fields).alias("x"))
    target = tables.where("outcome <> 'ignore'").select("document_id", F.col("candidate_index").alias("own"), F.coalesce("table_index", "candidate_index").alias("at"), F.struct("outcome", "reason").alias("fate"))
    links = chosen.select("document_id", F.col("candidate_index").alias("own"), F.col("candidate_row").alias("row"), F.col("row_index").alias("with"), "way")
    rows = _dealt(old, new, target, links, context).withColumn("mine", F.col("part").isin(0, 4))
    by_row, by_table = Window.partitionBy("document_id", "mine", "own", "row"), Window.partitionBy("document_id", "mine", "own")
    known = {"way": _said("way", 3).over(by_row), "with": F.when(F.col("part") == 1, _said("with", 3).over(by_row)).otherwise(F.col("with"))}
    rows = rows.withColumns(known).withColumns({"fate": _said("fate", 2).over(by_table), "at": F.when(F.col("part") == 1, _said("at", 2).over(by_table)).otherwise(F.col("at"))})
    rows = rows.where("part in (0, 4) or part = 1 and fate is not null")
    # a row and the candidate rows it takes share a place, other candidate rows have their own
    alone = [F.when(F.col("with").isNull(), F.col(c)) for c in ("part", "own", "row")]
    rows = rows.withColumn("alone", F.struct(*alone))
    b = F.struct("x", F.col("own").alias("candidate_index"), F.col("row").alias("candidate_row"), F.col("fate.outcome").alias("outcome"), F.col("fate.reason").alias("reason"), "way")
    pair = Window.partitionBy("document_id", "at", "with", "alone")
    rows = rows.withColumn("taken", F.collect_list(F.when(F.col("part") == 1, b)).over(pair)).withColumn("context", _said("context", 4).over(Window.partitionBy("document_id", "at")))
    rows = rows.where("part = 0 or part = 1 and `with` is null").withColumn("y", F.explode_outer(F.when(F.col("part") == 0, F.col("taken")).otherwise(F.array(b))))
    both = rows.select(
        "document_id", F.col("at").alias("table_index"), F.col("with").alias("row_index"), F.when(F.col("part") == 0, F.col("x")).alias("a"), F.col("y.x").alias("b"), F.col("y.way").alias("way"),
        F.col("at"), F.col("y.candidate_row").alias("candidate_row_"), F.col("y.outcome").alias("outcome"), F.col("y.reason").alias("table_reason"), "context",
    )

    side = lambda x: F.struct(
        F.nullif(F.trim(F.col(f"{x}.label")), F.lit("")).alias("label_text"), F.nullif(F.col(f"{x}.current"), F.lit("")).alias("current_value"), F.nullif(F.coalesce(F.col(f"{x}.statement_family"), F.col(f"{x}.statement_type")), F.lit("unknown")).alias("statement_family"),
        F.col(f"{x}.period").alias("effective_period"), F.lit(None).cast("string").alias("sign_hint"), F.col(f"{x}.page_number").alias("page"), F.col(f"{x}.row_kind").alias("row_kind"),
    )
    direct = F.col("way").isin(SIMILAR, CONTINUED)
    pair = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = once(both, "odd", F.when(pair & ~direct, conflict_reason(side("a"), side("b"))))
    filled = lambda x: F.coalesce(F.nullif(F.col(f"a.{x}"), F.lit("")), F.col(f"b.{x}"))
    # of two similar labels the longer stays, the first of equals
    longer = F.when(F.length(F.trim("b.label")) > F.length(F.trim("a.label")), F.trim("b.label")).otherwise(F.trim("a.label"))
    label = F.when(F.col("way") == CONTINUED, F.concat_ws(" ", F.trim("a.label"), F.trim("b.label"))).when(F.col("way") == SIMILAR, longer).otherwise(filled("label"))
    engines = F.array_join(F.array_sort(F.array_distinct(F.array("a.engine", "b.engine"))), ",")
    ocr = F.col("a.engine").contains("ocr") & F.col("b.engine").contains("ocr")
    none = F.lit(None).cast("string")

    def row(at, index, origin, values, engines, status, mode, reason, warning):
        shown = {"table_index": at, "row_index": index, "origin": origin, **values, "engines": engines, "fusion_status": status, "mode": mode, "reason": reason, "warning": warning, **{x: F.col(f"context.{x}") for x in CONTEXT[:2]}}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in shown.items()])

    shown = ("label", "current", "comparative", "row_kind")
    as_was = lambda x: {f: F.col(f"{x}.{f}") for f in shown}
    merged = row(
        F.col("table_index"), F.col("row_index"), "merged", {"label": label, **{f: filled(f) for f in shown[1:]}}, engines, "merged_engines",
        F.when(F.col("way") == SIMILAR, "semantic_row_identity_merge").when(F.col("way") == CONTINUED, "continuation_row_merge").otherwise("fused_row"), none, F.when(ocr, "ocr_only_lower_trust"),
    )
    existed = row(F.col("table_index"), F.col("row_index"), "existing", as_was("a"), F.col("a.engine"), "single_engine", none, none, none)
    apart = (F.col("outcome") == "conflict") | F.col("odd").isNotNull()
    beside = row(
        F.col("at"), F.col("candidate_row_"), F.when(F.col("outcome") == "add", "added").when(apart, "evidence").otherwise("appended"), as_was("b"), F.when(F.col("odd").isNotNull(), engines).otherwise(F.col("b.engine")),
        F.when(apart, "conflict_retained_as_evidence").otherwise("single_engine"), none, F.coalesce("odd", "table_reason"), F.when(F.col("outcome") == "conflict", "table_context_conflict_retained_as_evidence"),
    )
    rows = F.when(pair & F.col("odd").isNull(), F.array(merged)).when(pair, F.array(existed, beside)).when(F.col("a").isNotNull(), F.array(existed)).otherwise(F.array(beside))
    return both.select("document_id", F.inline(rows))
