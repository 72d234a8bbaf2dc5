"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A text's set is its 5-word shingles (of lower-cased words without marks) weighted by count times inverse document
frequency, 1 + log((texts + 1) / (texts with the shingle + 1)).  Shingles of less than RARE_SHARE of all texts weigh as
those of that share: what half the corpus repeats counts less, but an edit of a copy doesn't count more than the words
that it left.  Frequencies are counted over all texts in 2**20 hashed buckets, as the hashing trick does, so that the
table's size is fixed; other shingles of its bucket add about (shingles a text) / 2**20 to a shingle's share at any
size of the corpus, far below RARE_SHARE.  Each sample of a text keeps a shingle with probability proportional to its weight, and two
texts agree on a sample with the probability of their weighted Jaccard similarity.

Texts that share a band meet in a bucket.  A bucket of up to GROUP texts compares all signatures in memory and hands
on, for each text, its nearest two and a spanning forest by estimated similarity; a larger one links all to a leader,
the text with the most exact copies.  Links are verified on whole texts, and classes are the connected components of
what holds.

Those links only join most copies cheaply.  After them, all likely pairs of a bucket's texts that are in
different classes are verified: first the best few of each class, which join further classes, and at last every pair
that is left.  A large bucket meets in pairs of parts; texts of its largest class don't meet one another.  A pair is
left out only where its estimate is under LIKELY or where the shingles that no other text has rule out the threshold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slots, mix64, only_slots, pieces, release, settled, slots, text_buffers, written
from .decontamination import normal_words

SHINGLE = 5
BANDS, ROWS = 14, 5
SAMPLES = BANDS * ROWS
SIMILARITY = 0.8
#: Least share of equal samples of a pair to verify: five standard deviations below the threshold.
LIKELY = 0.55
#: Share of texts below which shingles are all equally rare.  Without it, each edit in a group of near copies would weigh
#: several times what the copies share, the more the larger the group is, and copies of 19 equal shingles in 20 would differ.
RARE_SHARE = 1 / 16
GROUP = 400
#: Likely pairs of a class that a unit hands on, by round; the last round hands on all.
ROUNDS = (8, None)
#: Links up to which one task joins them (16 bytes each).
LOCAL_LINKS = 4_000_000
#: Bits of the table of shingles that several texts have.
SLOT_BITS = 27
BUCKETS = 1 << 20
#: Word hashes that a worker keeps.
CACHE_WORDS = 200_000
_BLOCK = 4096
_POOL = 1 << 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word → 64-bit hash, taken when it is looked up; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


class Shingler:
    """Shingle hashes and counts of texts; holds a worker's cache of word hashes."""

    def __init__(self):
        self.cache = WordHashes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = normal_words(text) if text else []
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        x = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        n = max(1, len(x) - SHINGLE + 1)  # a shorter text is one shingle
        h = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(x))):
            h *= _PRIME
            h += x[k : k + n]
        return np.unique(mix64(h), return_counts=True)


_SHINGLER = Shingler()


class Sampler:
    """Consistent weighted samples; gamma and uniform variates come from pools, by bits of a hash of (shingle, sample)."""

    def __init__(self, idf: np.ndarray, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.idf = idf.astype(np.float32)
        self.r = rng.gamma(2.0, 1.0, _POOL).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _POOL)).astype(np.float32)
        self.beta = rng.random(_POOL).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def weights(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.idf[shingles >> np.uint64(44)] * counts.astype(np.float32)

    def samples(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, SAMPLES) uint64; texts are runs of shingles from starts, none empty."""
        log_w = np.log(weights)
        place = np.arange(len(shingles), dtype=np.uint64)
        out = np.empty((len(starts), SAMPLES), np.uint64)
        low = np.uint64(0xFFFF)
        for k in range(SAMPLES):
            m = shingles * self.odd[k]
            r = self.r[m >> np.uint64(48)]
            beta = self.beta[(m >> np.uint64(16)) & low]
            t = np.floor(log_w / r + beta)
            a = self.log_c[(m >> np.uint64(32)) & low] - r * (t - beta) - r
            bits = a.view(np.uint32).astype(np.uint64)  # floats in order of value: flip the sign, or all if negative
            bits = np.where(bits >> np.uint64(31), ~bits & np.uint64(0xFFFFFFFF), bits | np.uint64(1 << 31))
            best = np.minimum.reduceat(bits << np.uint64(32) | place, starts) & np.uint64(0xFFFFFFFF)
            out[:, k] = mix64(shingles[best] + t[best].astype(np.int64).astype(np.uint64) * _PRIME + np.uint64(k))
        return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(texts by shingle bucket, texts): summed in blocks, first within salts, so that no group grows with the tasks."""

    def count(batches):
        table, texts = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(0))
            for i, j in pieces(offsets):
                found = [_SHINGLER(t)[0] for t in batch.column(0).slice(i, j - i).to_pylist()]
                texts += sum(len(h) > 0 for h in found)
                table += np.bincount((np.concatenate(found) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        _SHINGLER.cache.clear()  # workers live on for other stages
        salt = TaskContext.get().partitionId() % 256
        place, data = [], []
        for part in table.reshape(-1, _BLOCK):
            at = np.flatnonzero(part)
            at = at if 2 * len(at) < _BLOCK else np.zeros(0, np.int64)  # few: their places; else the whole block
            place.append(at.astype("<u2").tobytes())
            data.append((part[at] if len(at) or not part.any() else part).astype("<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(data)), pa.int32()), "salt": pa.array([salt] * len(data), pa.int32()), "n": pa.array([texts] + [0] * (len(data) - 1), pa.int64()), "at": pa.array(place, pa.binary()), "data": pa.array(data, pa.binary())})

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(_BLOCK, np.uint64)
        for at, x in zip(pdf["at"], pdf["data"]):
            values = np.frombuffer(x, "<u8")
            total[np.frombuffer(at, "<u2") if len(at) else slice(len(values))] += values
        return pd.DataFrame({"block": [key[0]], "n": [int(pdf["n"].sum())], "at": [b""], "data": [total.astype("<u8").tobytes()]})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(settled(count), "block int, salt int, n long, at binary, data binary")
    salted = parts.groupBy("block", "salt").applyInPandas(lambda key, pdf: add(key, pdf), "block int, n long, at binary, data binary")
    rows = salted.groupBy("block").applyInPandas(add, "block int, n long, at binary, data binary").orderBy("block").collect()  # 8 MB
    return np.concatenate([np.frombuffer(r["data"], "<u8") for r in rows]) if rows else np.zeros(BUCKETS, np.uint64), sum(r["n"] for r in rows)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    seen, n = document_frequencies(docs)
    share = (np.minimum(seen, n) + 1.0) / (n + 1.0)
    return (1 - np.log(np.maximum(share, RARE_SHARE))).astype(np.float32)  # a shingle of every text still counts


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, nd_text: 16 bytes that stand for the text, none for a null."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("nd_text"))


def signed(docs: DataFrame, sampler) -> DataFrame:
    """doc_id, nd_text, nd_bands (array<long>, null without words) and nd_sig (16 bits of each sample) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("nd_text", T.BinaryType()), T.StructField("nd_bands", T.ArrayType(T.LongType())), T.StructField("nd_sig", T.BinaryType())])

    def run(batches):
        sample = sampler.value
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            bands, sigs = [], []
            for i, j in pieces(offsets, 1 << 20):
                found = [_SHINGLER(t) for t in batch.column(1).slice(i, j - i).to_pylist()]
                sizes = np.array([len(h) for h, _ in found])
                full = np.flatnonzero(sizes)
                own: list = [None] * len(found)
                sig: list = [None] * len(found)
                if len(full):
                    h = np.concatenate([found[k][0] for k in full])
                    w = sample.weights(h, np.concatenate([found[k][1] for k in full]))
                    s = sample.samples(h, w, np.cumsum(sizes[full]) - sizes[full])
                    keys = np.zeros((len(full), BANDS), np.uint64)
                    for r in range(ROWS):
                        keys = mix64(keys * _PRIME + s[:, r::ROWS])
                    short = (s >> np.uint64(48)).astype("<u2")
                    for row, k in enumerate(full):
                        own[k], sig[k] = keys[row].astype(np.int64).tolist(), short[row].tobytes()
                bands += own
                sigs += sig
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=schema.names)
        _SHINGLER.cache.clear()

    return _keyed(docs).mapInArrow(settled(run), schema)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes (nd_text, node): only their texts are shuffled, an often repeated one once a task."""

    h = F.xxhash64("nd_text").alias("h")
    likely = only_slots(_keyed(docs).where(F.length("nd_text") > 0).select("nd_text", "text", h), nodes.select(h), once=True)
    once = likely.groupBy("nd_text").agg(F.first("text").alias("text"))
    return once.join(nodes.hint("merge"), "nd_text").select("node", "text")


def _near(ids: np.ndarray, sig: np.ndarray, pairs: set) -> None:
    """Adds a bucket's likely links: each text's nearest two, and a spanning forest by estimated similarity."""
    m = len(ids)
    if m == 2:
        if (sig[0] == sig[1]).mean() >= LIKELY:
            pairs.add((min(ids[0], ids[1]), max(ids[0], ids[1])))
        return
    est = np.zeros((m, m), np.float32)
    for i in range(m):
        est[i] = (sig == sig[i]).mean(axis=1)
    np.fill_diagonal(est, -1)
    links = [(i, int(j)) for i in range(m) for j in np.argsort(-est[i], kind="stable")[:2]]
    best, origin, out = est[0].copy(), np.zeros(m, np.int64), np.ones(m, bool)
    out[0] = False
    for _ in range(m - 1):  # Prim
        j = int(np.argmax(np.where(out, best, -2)))
        links.append((int(origin[j]), j))
        out[j] = False
        closer = est[j] > best
        best[closer], origin[closer] = est[j][closer], j
    for i, j in links:
        if est[i, j] >= LIKELY:
            pairs.add((min(ids[i], ids[j]), max(ids[i], ids[j])))


def _bucket_links(members: DataFrame) -> DataFrame:
    """(a, b) of buckets of bounded size; members: band, v, node, nd_sig."""

    def run(batches):
        held: list = []

        def groups(rows, last):
            pairs: set = set()
            start = 0
            for k in range(1, len(rows) + 1):
                if k == len(rows) or rows[k][:2] != rows[start][:2]:
                    if k == len(rows) and not last:
                        break
                    if k - start > 1:
                        _near(np.array([r[2] for r in rows[start:k]]), np.stack([np.frombuffer(r[3], "<u2") for r in rows[start:k]]), pairs)
                    start = k
            return rows[start:], pairs

        def out(pairs):
            return pa.RecordBatch.from_pydict({"a": pa.array([int(p[0]) for p in pairs], pa.int64()), "b": pa.array([int(p[1]) for p in pairs], pa.int64())})

        for batch in batches:
            held += list(zip(*[c.to_pylist() for c in batch.columns]))
            held, pairs = groups(held, False)
            yield out(pairs)
        yield out(groups(held, True)[1])

    ordered = members.select("band", "v", "node", "nd_sig").repartition("band", "v").sortWithinPartitions("band", "v", "node")
    return ordered.mapInArrow(settled(run), "a long, b long").distinct()


def _apart(ids: np.ndarray, sig: np.ndarray, label: np.ndarray, part: np.ndarray, whole: np.ndarray, common: np.ndarray, bands: np.ndarray, band: int, most: int | None) -> tuple[list, bool]:
    """(likely pairs of different labels, and parts if there are two, the best of each label; whether there are more).

    A pair that shares several bands belongs to the first of them, where its bucket compares it, and to no other.

    whole: weight of each text; common: of its shingles that other texts have too.  No two texts have more in common
    than the less of theirs, which bounds their similarity.
    """
    across = bool((part != part[0]).any())
    left, right, near = [], [], []
    for i in range(len(ids) - 1):
        other = label[i + 1 :] != label[i]
        if across:
            other &= part[i + 1 :] != part[i]
        j = np.flatnonzero(other) + i + 1
        both = np.minimum(common[i], common[j])
        j = j[both >= (SIMILARITY - 1e-6) * (whole[i] + whole[j] - both)]
        est = (sig[j] == sig[i]).mean(axis=1) if len(j) else np.zeros(0)
        j, est = j[est >= LIKELY], est[est >= LIKELY]
        mine = (bands[j] == bands[i]).argmax(axis=1) == band if len(j) else np.zeros(0, bool)
        j, est = j[mine], est[mine]
        left.append(np.full(len(j), i))
        right.append(j)
        near.append(est)
    x, y, est = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right, near))
    take = np.ones(len(x), bool)
    if most is not None and len(x):
        take[:] = False
        for side in (label[x], label[y]):
            order = np.lexsort((y, x, -est, side))
            first = np.flatnonzero(np.concatenate([[True], side[order][1:] != side[order][:-1]]))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            take[order[rank < most]] = True
    pairs = [(min(a, b), max(a, b)) for a, b in zip(ids[x[take]].tolist(), ids[y[take]].tolist())]
    return pairs, not take.all()


def _unsettled(met: DataFrame, sigs: DataFrame, labels: DataFrame, most: int | None) -> DataFrame:
    """(a, b) of the buckets' likely pairs of different labels, the best of each label; (-1, -1) if there are more.

    met: band, v, node.  Parts of the largest label come after the others' and meet those only, so that a group of
    copies that is one class already costs a row a text for each part of the rest.
    """

    def run(batches):
        held: list = []

        def out(rows, last):
            pairs, start = set(), 0
            for k in range(1, len(rows) + 1):
                if k == len(rows) or rows[k][:4] != rows[start][:4]:
                    if k == len(rows) and not last:
                        break
                    unit = rows[start:k]
                    if len(unit) > 1:
                        found, more = _apart(np.array([r[4] for r in unit]), np.stack([np.frombuffer(r[7], "<u2") for r in unit]), *(np.array([r[k] for r in unit]) for k in (5, 6, 8, 9, 10)), unit[0][0], most)
                        pairs.update(found)
                        if more:
                            pairs.add((-1, -1))
                    start = k
            return rows[start:], pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for batch in batches:
            held += list(zip(*[c.to_pylist() for c in batch.columns]))
            held, found = out(held, False)
            yield found
        yield out(held, True)[1]

    here = met.select("band", "v", "node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = here.groupBy("band", "v", "label").agg(F.count(F.lit(1)).alias("c"))
    buckets = sizes.groupBy("band", "v").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    parts = lambda n: F.ceil(n / (GROUP / 2)).cast("int")
    rest, top = F.when(F.col("n") <= GROUP, 1).otherwise(parts(F.col("n") - F.col("top.c"))), F.when(F.col("n") <= GROUP, 0).otherwise(parts(F.col("top.c")))
    buckets = buckets.select("band", "v", F.col("top.label").alias("most"), rest.alias("rest"), top.alias("tops"))
    h = F.xxhash64("node", F.lit(3))
    last = (F.col("label") == F.col("most")) & (F.col("tops") > 0)
    placed = here.join(buckets.hint("merge"), ["band", "v"]).withColumn("p", F.when(last, F.col("rest") + F.pmod(h, "tops")).otherwise(F.pmod(h, "rest")).cast("int"))
    others = F.sequence(F.lit(0), F.when(last, F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1)
    units = placed.join(sigs.hint("merge"), "node").withColumn("q", F.explode(others)).select("band", "v", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node", "label", "p", "nd_sig", "whole", "common", "nd_bands")
    key = ["band", "v", "i", "j"]
    return units.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(settled(run), "a long, b long").distinct()


def _weights(texts: DataFrame, sampler) -> DataFrame:
    """(node, whole, common): the weight of each text, and at least that of its shingles that another text has too."""

    def hashes(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found = [_SHINGLER(t)[0] for t in batch.column(0).slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(found).view(np.int64))})
        _SHINGLER.cache.clear()

    again = texts.select("text").mapInArrow(settled(hashes), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    held = texts.sparkSession.sparkContext.broadcast(slots(again, SLOT_BITS))

    def weigh(batches):
        sample = sampler.value
        for batch in batches:
            out = []
            for t in batch.column(1):
                h, n = _SHINGLER(t.as_py())
                w = sample.weights(h, n).astype(np.float64)
                out.append((float(w.sum()), float(w[in_slots(held.value, h, SLOT_BITS)].sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64())], names=["node", "whole", "common"])
        _SHINGLER.cache.clear()

    return texts.select("node", "text").mapInArrow(settled(weigh), "node long, whole double, common double")


def _verified(links: DataFrame, texts: DataFrame, sampler) -> DataFrame:
    """links (a, b) with their weighted Jaccard similarity on whole texts; texts: node, text."""

    def run(batches):
        sample = sampler.value
        for batch in batches:
            got = []
            for k in range(batch.num_rows):  # one pair's texts at once: the texts may be long
                (hx, cx), (hy, cy) = _SHINGLER(batch.column(2)[k].as_py()), _SHINGLER(batch.column(3)[k].as_py())
                wx, wy = sample.weights(hx, cx), sample.weights(hy, cy)
                _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
                both = float(np.minimum(wx[i], wy[j]).sum(dtype=np.float64))
                got.append(both / (float(wx.sum(dtype=np.float64)) + float(wy.sum(dtype=np.float64)) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["a", "b", "similarity"])
        _SHINGLER.cache.clear()

    ends = links.select(F.xxhash64("a").alias("h")).unionByName(links.select(F.xxhash64("b").alias("h")))
    some = only_slots(texts.select("node", "text", F.xxhash64("node").alias("h")), ends)
    left = some.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = some.select(F.col("node").alias("b"), F.col("text").alias("y"))
    joined = links.hint("merge").join(left.hint("merge"), "a").hint("merge").join(right.hint("merge"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(settled(run), "a long, b long, similarity double")


def _joined_links(batches):
    """(node, label) of all links in the batches, by union of trees."""
    pairs = [np.stack([c.to_numpy() for c in batch.columns], axis=1) for batch in batches]
    ends = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    root = np.arange(len(nodes))
    left, right = at.reshape(-1, 2).T
    while True:  # the least label spreads over links, and jumps to its own label
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes.astype(np.int64)), "label": pa.array(nodes[root].astype(np.int64))})


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the least node of each connected component; nodes without links are not listed.

    Up to LOCAL_LINKS links are joined in one task's memory.  More spread over links and jump to their label's label, so
    that rounds grow with the logarithm of a chain.
    """
    spark = links.sparkSession
    links = written(links.select("a", "b"), f"{name}-pairs")
    if links.count() <= LOCAL_LINKS:
        label = written(links.coalesce(1).mapInArrow(settled(_joined_links), "node long, label long"), f"{name}-labels")
        release(spark, links)
        return label
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    label = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-labels")
    old = label
    while True:
        spread = both.join(label.withColumnsRenamed({"node": "b", "label": "other"}).hint("merge"), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = label.join(spread.withColumnRenamed("a", "node").hint("merge"), "node").select("node", "label", F.least("label", "other").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = written(lower.join(jump.hint("merge"), "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), f"{name}-labels")
        release(spark, old)
        label, old = new.select("node", "label"), new
        if not new.where("moved").head(1):
            release(spark, both, links)
            label.quarterdeck_path = new.quarterdeck_path
            return label


def classes(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, nd_text, nd_row (a number of the row), nd_label (the same for all rows of a class), one row a document.

    Texts without words (null, empty, marks only) are near nothing and are classes of one; equal texts are one class; a
    text of under 5 words is one shingle.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    sampler = spark.sparkContext.broadcast(Sampler(inverse_frequencies(docs)))
    rows = written(signed(docs, sampler).withColumn("nd_row", F.monotonically_increasing_id()), "nd-rows")
    release(spark)
    some = rows.where(F.col("nd_bands").isNotNull())
    nodes = written(some.groupBy("nd_text").agg(F.min("nd_row").alias("node"), F.count(F.lit(1)).alias("copies")), "nd-nodes")
    firsts = written(some.select("nd_row", "nd_bands", "nd_sig").join(nodes.select(F.col("node").alias("nd_row"), "copies").hint("merge"), "nd_row").withColumnRenamed("nd_row", "node"), "nd-firsts")
    release(spark)
    sigs = firsts.select("node", "nd_sig")
    place = firsts.select("node", "copies", F.posexplode("nd_bands").alias("band", "v"))
    order = F.struct((-F.col("copies")).alias("c"), F.xxhash64("node").alias("h"), F.col("node"))  # what others copy leads
    buckets = place.groupBy("band", "v").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where(F.col("n") > 1).select("band", "v", "n", F.col("first.node").alias("leader"))
    met = written(place.join(buckets.hint("merge"), ["band", "v"]), "nd-members")
    texts = written(_texts(docs, nodes.join(met.select("node").distinct().hint("merge"), "node", "left_semi")), "nd-texts")
    release(spark)
    near = _bucket_links(met.where(F.col("n") <= GROUP).join(sigs.hint("merge"), "node"))
    starred = met.where((F.col("n") > GROUP) & (F.col("node") != F.col("leader")))
    star = starred.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    pairs = written(near.unionByName(star).distinct(), "nd-links")
    checked = written(_verified(pairs, texts, sampler), "nd-checked")
    release(spark, pairs)
    tested, held = [checked.select("a", "b")], [checked.where(F.col("similarity") >= similarity).select("a", "b")]
    labels = components(held[0], "nd")
    some_met = met.where(F.col("n") > 2)  # a bucket of two is settled
    weights = None
    for most in ROUNDS if some_met.head(1) else ():
        if weights is None:
            crowd = some_met.select("node").distinct()
            weights = written(_weights(texts.join(crowd.hint("merge"), "node", "left_semi"), sampler), "nd-weights")
            sigs = firsts.select("node", "nd_sig", "nd_bands").join(weights.hint("merge"), "node")
            release(spark)
        pairs = written(_unsettled(some_met, sigs, labels, most), "nd-unsettled")
        release(spark)
        new = written(pairs.where(F.col("a") >= 0).join(reduce(DataFrame.unionByName, tested).hint("merge"), ["a", "b"], "left_anti"), "nd-links")
        more = bool(pairs.where(F.col("a") < 0).head(1))
        if new.head(1):
            checked = written(_verified(new, texts, sampler), "nd-checked")
            release(spark, pairs, new, labels)
            tested.append(checked.select("a", "b"))
            held.append(checked.where(F.col("similarity") >= similarity).select("a", "b"))
            labels = components(reduce(DataFrame.unionByName, held), "nd")
            release(spark)
        else:
            release(spark, pairs, new)
        if not more:
            break
    by_text = nodes.join(labels.hint("merge"), "node", "left").select("nd_text", F.coalesce("label", "node").alias("nd_label"))
    joined = rows.select("doc_id", "nd_text", "nd_row", F.col("nd_bands").isNotNull().alias("words")).join(by_text.hint("merge"), "nd_text", "left")
    out = written(joined.select("doc_id", "nd_text", "nd_row", F.when(F.col("words"), F.col("nd_label")).otherwise(F.col("nd_row")).alias("nd_label")), "nd-classes")
    release(spark, rows, nodes, firsts, met, texts, labels, *([weights] if weights else []))
    return out


def _heads(found: DataFrame) -> DataFrame:
    """nd_label, nd_first: of each class its row of the least doc_id (null last), then text, then number."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nd_text", "nd_row"))
    return found.groupBy("nd_label").agg(first.alias("nd_first"))


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), kept (true for one row of the class), one row a document."""
    found = classes(docs, **options)
    return found.join(_heads(found).hint("merge"), "nd_label").select("doc_id", F.col("nd_first.doc_id").alias("class_id"), (F.col("nd_first.nd_row") == F.col("nd_row")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the least doc_id, with the columns of docs.

    Texts are shuffled once, by id and text together, so that copies of a text are spread over the tasks.
    """
    found = classes(docs, **options)
    ident = lambda text: [F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")).alias("\x01id"), text.alias("\x01text")]
    rest = [f.name for f in docs.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)) and f.name not in ("doc_id", "text")]
    heads = _heads(found).select(F.col("nd_first.doc_id").alias("doc_id"), F.col("nd_first.nd_text").alias("nd_text"))
    heads = written(heads.select(*ident(F.col("nd_text"))).groupBy("\x01id", "\x01text").agg(F.count(F.lit(1)).alias("\x01n")), "nd-heads")
    release(docs.sparkSession, found)
    key = F.coalesce(F.unhex(F.md5(F.col("text").cast("string").cast("binary"))), F.lit(b""))
    mine = docs.select("*", *ident(key)).join(heads.hint("merge"), ["\x01id", "\x01text"])
    turn = F.row_number().over(Window.partitionBy("\x01id", "\x01text").orderBy(F.xxhash64(*rest) if rest else F.lit(0)))
    return mine.withColumn("\x01turn", turn).where(F.col("\x01turn") <= F.col("\x01n")).select(*docs.columns)
