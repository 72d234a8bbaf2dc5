"""Raw table grids to records: header depth, column names and types, labels, notes and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound, once
from ..functions.numbers import contains_any, parse_number
from ..functions.text import contains_marker, matching_text, normal_markers

# What a header says of a date, and of notes.
DATE_MARKERS = ("31 декабря", "30 сентября", "30 июня", "31 марта", "2020", "2021", "2022", "2023", "2024", "2025", "2026", "2027")
NOTE_MARKERS = ("прим", "note")
#: Rows that may be headers.
MOST_HEADERS = 3


def _clean(cell: Column) -> Column:
    plain = F.translate(F.coalesce(cell, F.lit("")), "   –—−", "   ---")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def split_inline(text: Column) -> Column:
    """(label, values) of a clean text that ends in one or two numbers after other words, else null."""
    numeric = lambda words, k: parse_number(F.get(words, F.size(words) - k)).isNotNull()
    count = lambda words: F.when(~numeric(words, 1), 0).when(numeric(words, 2), 2).otherwise(1)

    def cut(words, taken):
        n = F.size(words) - taken
        return F.when((taken > 0) & (n > 0), F.struct(F.array_join(F.slice(words, 1, n), " ").alias("label"), F.slice(words, n + 1, taken).alias("values")))

    return F.when(text.rlike("(?s) .*[0-9]"), bound(F.split(text, " "), lambda words: bound(count(words), lambda taken: cut(words, taken))))


def _cell(raw: Column) -> Column:
    """A cell's text, whether it is a number, and its label and values where it holds both."""
    return bound(_clean(raw), lambda t: F.struct(t.alias("text"), parse_number(t).isNotNull().alias("number"), split_inline(t).alias("inline")))


def _fragment(c: Column) -> Column:
    """What a cell says of its row: its words without values, nothing if it is a number."""
    return F.when(c["inline"].isNotNull(), c["inline"]["label"]).when(c["number"], "").otherwise(c["text"])


def _is_header(row: Column) -> Column:
    says = F.exists(row, lambda c: (c["text"] != "") & (_fragment(c) != ""))
    marked = contains_marker(F.array_join(F.transform(row, lambda c: c["text"]), " "), DATE_MARKERS + NOTE_MARKERS)
    few = F.size(F.filter(row, lambda c: c["number"])) <= 1
    return ~F.exists(row, lambda c: c["inline"].isNotNull()) & ((says & few) | marked)


def _numbered(names: Column) -> Column:
    """Names of which the k-th of equals, from the second on, ends in __k."""
    return F.transform(names, lambda x, i: F.concat(x, F.when(F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x)) > 1, F.concat(F.lit("__"), F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x)).cast("string"))).otherwise("")))


def _record(row: Column) -> Column:
    """(line, note_ref, values, recovered, rebuilt) of a data row; uses the columns names, first, notes and active."""
    at = lambda i: F.get(row, i)
    head = F.filter(F.slice(row, F.lit(1), F.col("first")), lambda c, i: ~F.get(F.col("notes"), i) & (c["text"] != ""))
    values = F.transform("active", lambda i: at(i)["text"])
    known = F.exists("active", lambda i: at(i)["number"])
    noted = F.filter(F.transform(row, lambda c, i: F.when(F.get(F.col("notes"), i), c["text"]).otherwise("")), lambda x: x != "")
    blank = (F.col("first") > 0) & (at(F.lit(0))["text"] == "")

    def made(label, parts, inline):
        own = F.when(~known, F.coalesce(inline, split_inline(label)))
        return bound(own, lambda own: F.struct(
            F.nullif(F.coalesce(own["label"], label), F.lit("")).alias("line"), F.get(noted, F.lit(0)).alias("note_ref"),
            F.transform(values, lambda v, i: F.coalesce(F.get(own["values"], i), v)).alias("values"), own.isNotNull().alias("recovered"), ((label != "") & ((F.size(parts) > 1) | blank)).alias("rebuilt"),
        ))

    first_inline = lambda head: F.get(F.transform(F.filter(head, lambda c: c["inline"].isNotNull()), lambda c: c["inline"]), F.lit(0))
    parts = lambda head: F.filter(F.transform(head, _fragment), lambda x: x != "")
    return bound(head, lambda head: bound(parts(head), lambda parts: made(F.array_join(parts, " "), parts, first_inline(head))))


def normalize_table_grid(tables: DataFrame) -> DataFrame:
    """Records of raw table grids, one row a record: document_id, table_index, row_index, line, note_ref, cells (map of
    value column to text), recovered, header_rows, columns, quality.

    tables: document_id, table_index, rows (array of arrays of cells, of any length).  Rows without any text are left
    out and short rows filled up.  Up to three rows are headers: those that name a date or notes, or have words and at most
    one number, and no cell of words and values together; the first always is one.  A column's name is what its headers
    say, col_i if nothing, and the k-th of equal names ends in __k.  Values start at the first column whose name is a date, else at
    the first that holds a number; the cells before it form the line, note columns the note reference.  A row without
    values takes those that its label ends in.  quality is degraded where names collide or labels are absent or were
    put together.  row_index counts data rows from 0; records without any text are left out, and so are tables without rows.

    All of it is array work on a table's own row: nothing is shuffled.
    """
    t = once(tables.select("document_id", "table_index", F.col("rows").alias("raw")), "rows", F.filter("raw", lambda r: F.exists(r, lambda c: _clean(c) != ""))).where(F.size("rows") > 0)
    t = t.withColumn("width", F.array_max(F.transform("rows", lambda r: F.size(r))))
    grid = F.transform("rows", lambda r: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: _cell(F.get(r, i))))
    t = once(t.select("document_id", "table_index", "width", "rows"), "grid", grid).drop("rows")
    t = once(t, "flags", F.transform(F.slice("grid", 1, MOST_HEADERS), _is_header))
    stop = F.array_position("flags", False).cast("int")  # 0: all are headers
    t = t.withColumn("header_rows", F.greatest(F.when(stop == 0, F.size("flags")).otherwise(stop - 1), F.lit(1)))
    heads = F.slice("grid", F.lit(1), F.col("header_rows"))
    said = lambda i: F.array_distinct(F.filter(F.transform(heads, lambda r: F.get(r, i)["text"]), lambda x: x != ""))
    merged = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.nullif(F.array_join(said(i), " "), F.lit("")), F.concat(F.lit("col_"), i.cast("string"))))
    shown = F.filter(F.transform(F.get("grid", F.lit(0)), lambda c: c["text"]), lambda x: x != "")
    t = t.withColumns({"merged": merged, "shown": shown, "data": F.slice("grid", F.col("header_rows") + 1, F.size("grid"))})
    t = t.withColumn("collide", (F.size(F.array_distinct("merged")) < F.size("merged")) | (F.size(F.array_distinct("shown")) < F.size("shown")))
    t = once(t, "names", _numbered(F.col("merged")))
    t = once(t, "plain", F.transform("names", matching_text))
    dated = F.array_position(F.transform("plain", lambda x: contains_any(x, normal_markers(DATE_MARKERS))), True)
    numeric = F.array_position(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.exists("data", lambda r: F.get(r, i)["number"])), True)
    none = F.when(F.size("data") == 0, 0).otherwise(F.col("width"))
    first = F.when(dated > 0, dated - 1).when(numeric > 0, numeric - 1).otherwise(none).cast("int")
    t = t.withColumns({"first": first, "notes": F.transform("plain", lambda x: contains_any(x, normal_markers(NOTE_MARKERS)))})
    wanted = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: (i >= F.col("first")) & ~F.get(F.col("notes"), i))
    t = once(once(t, "active", wanted), "records", F.transform("data", _record))
    poor = F.col("collide") | F.exists("records", lambda r: r["rebuilt"]) | ~F.exists("records", lambda r: r["line"].isNotNull())
    t = t.withColumn("columns", F.transform("active", lambda i: F.get(F.col("names"), i))).withColumn("quality", F.when(poor, "degraded").otherwise("standard"))
    # the outer form, as the optimizer would copy the whole array work into a filter on its size below an inner one
    rows = t.select("document_id", "table_index", "header_rows", "columns", "quality", F.posexplode_outer("records").alias("row_index", "r"))
    pairs = F.filter(F.arrays_zip(F.col("columns").alias("k"), F.col("r.values").alias("v")), lambda p: p["v"] != "")
    out = rows.select("document_id", "table_index", "row_index", "r.line", "r.note_ref", F.map_from_entries(pairs).alias("cells"), "r.recovered", "header_rows", "columns", "quality")
    return out.where(F.col("line").isNotNull() | F.col("note_ref").isNotNull() | (F.size("cells") > 0))
