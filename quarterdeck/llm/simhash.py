"""SimHash near-dedup: segment popcounts, a grid join under Manhattan distance, exact verification.

A text's fingerprint has bit b set if over half of its shingles' 64-bit hashes have.  Fingerprints are cut into
segments of SEGMENT bits and mapped to the bit counts of their segments.  A changed bit changes one count by one, so the
Manhattan distance of two such vectors is never above the Hamming distance of the fingerprints.

The grid's cells are the vectors.  Of two vectors at distance 2 or less some cell lies at distance 1 or less from both,
so each fingerprint stands in its own cell and in those one step away (45 at most), and near ones share a cell.  A rule on the
two steps names one of the shared cells, so that no pair meets twice.  The join verifies the Hamming distance on the
spot: fingerprints are distinct, none has more than 2,080 within two bits, and so links grow in proportion to them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, release, settled, text_buffers, written
from .graph import connected

SHINGLE, SEED = 3, 42
#: Bits of a segment.  Small segments tell more vectors apart; more of them mean more neighbouring cells.
SEGMENT = 3
SEGMENTS = -(-64 // SEGMENT)
#: Largest distance that one shared cell a pair covers.
DISTANCE = 2
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's shingles of lower-cased words, repeats included; 0 without words.  A text of fewer words is
    one shingle of all of them."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    line = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = len(words) - width + 1
    del words
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, total, _BLOCK):
        a, b = starts[k : min(k + _BLOCK, total)].tolist(), ends[k + width - 1 : min(k + _BLOCK, total) + width - 1].tolist()
        h = np.fromiter((hashed(line[i:j], SEED) for i, j in zip(a, b, strict=True)), "<u8", len(a))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (long), one row a document; null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in pieces(offsets):
                values = np.array([fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(values.view(np.int64))], names=["doc_id", "fingerprint"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(settled(run), schema)


def _vector(f: Column) -> Column:
    """The bit counts of all segments, two bits each."""
    count = lambda k: F.bit_count(F.shiftrightunsigned(f, SEGMENT * k).bitwiseAND(F.lit(2**SEGMENT - 1).cast("long"))).cast("long")
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(count(k), 2 * k) for k in range(SEGMENTS)])


def cells(distinct: DataFrame) -> DataFrame:
    """(f, cell, step) of distinct fingerprints f: their own cell (step 0) and those where the count of segment
    |step| is one more (step > 0) or less (step < 0)."""
    steps = F.explode(F.array(*[F.lit(k) for k in range(-SEGMENTS, SEGMENTS + 1)])).alias("step")
    rows = distinct.select("f", _vector(F.col("f")).alias("v")).select("f", "v", steps)
    # the places of the shifts must be columns, and Spark's functions take whole numbers only
    rows = rows.withColumn("one", F.expr("shiftleft(1L, 2 * (abs(step) - 1))")).withColumn("count", F.expr("shiftrightunsigned(v, 2 * (abs(step) - 1)) & 3L"))
    some = (F.col("step") == 0) | ((F.col("step") > 0) & (F.col("count") < SEGMENT)) | ((F.col("step") < 0) & (F.col("count") > 0))
    moved = F.when(F.col("step") == 0, F.col("v")).when(F.col("step") > 0, F.col("v") + F.col("one")).otherwise(F.col("v") - F.col("one"))
    return rows.where(some).select("f", moved.alias("cell"), F.col("step").cast("byte").alias("step"))


def near_fingerprints(distinct: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints f that differ in 1 to distance (at most 2) bits, once each."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"one cell a pair covers distances up to {DISTANCE}")
    placed = cells(distinct)
    left = placed.select(F.col("f").alias("a"), "cell", F.col("step").alias("s"))
    right = placed.select(F.col("f").alias("b"), "cell", F.col("step").alias("t"))
    s, t = F.col("s").cast("int"), F.col("t").cast("int")
    one_up = lambda up, down: (up > 0) & (down < 0) & (up >= -down)
    # equal vectors meet at step 0; vectors one step apart in the lower cell; of two steps that both lead down, any; of
    # one up and one down, the cell where the segment that goes up isn't the lower
    once = ((s == 0) & (t <= 0)) | ((t == 0) & (s < 0)) | ((s < 0) & (t < 0) & (s != t)) | one_up(s, t) | one_up(t, s)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & once
    joined = left.hint("merge").join(right.hint("merge"), (left["cell"] == right["cell"]) & near)
    return joined.select("a", "b")


def near_components(docs: DataFrame, *, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links, one row a document.

    Documents link if their fingerprints differ in distance or fewer bits; component_id is the least doc_id reachable over
    links, n_links the number of other fingerprints that a document's own links to.  Null, empty and white-space texts share
    fingerprint 0 and link like any other; equal rows are rows of their own; a null doc_id names a component only if it has no
    other.  Long texts are counted a block of shingles at a time.  Other columns of docs are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(fingerprints(docs, shingle=shingle), "simhash-rows")
    firsts = written(rows.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = written(near_fingerprints(firsts.select("f"), distance=distance), "simhash-links")
    labels = connected(links, "simhash")
    ends = links.select(F.col("a").alias("f")).unionByName(links.select(F.col("b").alias("f")))
    degree = ends.groupBy("f").agg(F.count(F.lit(1)).alias("n_links"))
    named = labels.withColumnRenamed("node", "f")
    of = firsts.hint("merge").join(named.hint("merge"), "f", "left").hint("merge").join(degree.hint("merge"), "f", "left")
    of = written(of.select("f", "first", F.coalesce("label", "f").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "simhash-labels")
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    found = written(of.hint("merge").join(least.hint("merge"), "label").select(F.col("f").alias("fingerprint"), "component_id", "n_links"), "simhash-components")
    release(spark, firsts, links, labels, of)
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return rows.hint("merge").join(found.hint("merge"), "fingerprint").select("doc_id", shown, "component_id", "n_links")
