"""Removal of repeated strings by prefix-free parsing.

Rolling-hash triggers cut the corpus into overlapping phrases: of every window of LENGTH bytes, the least hashed
gram of LENGTH / 2 bytes is its trigger, and a phrase is the run of windows that share a trigger.  The trigger depends
on a window's bytes alone, so equal windows have equal triggers at equal places, wherever they stand.  The dictionary
is the set of distinct phrases and the parse their occurrences.

A repeated string of LENGTH bytes is a pair of neighbours in corpus order with a common prefix of LENGTH.  Windows lie
in one phrase each, so two steps give that order to the depth LENGTH: the parse in order of its phrases shows those
that occur twice, which repeat whole; suffix arrays of the dictionary, sorted by prefix doubling to the depth LENGTH,
show the windows that different phrases share.  Phrases of different triggers share none, so a suffix array is built a
block of whole triggers.  A trigger with so many phrases that it may not fit a block (HOT_KINDS) goes another way:
the hashes of its windows, first of their cores, are counted by Spark wherever its phrases are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slots, mix64, release, settled, slots, text_buffers, written

LENGTH = 200
#: Window starts that the kernel takes at once.
CHUNK = 1 << 17
#: Bytes of text over which a task first joins equal phrases.
HELD = 24 << 20
#: Bits of the tables of hashes to look at again, which spare the rows of the others; they never lose one.
SLOT_BITS = 27
#: Different phrases of a trigger up to which they are sorted together, and bytes of the phrases of a suffix array.
HOT_KINDS, BLOCK = 4096, 4 << 20
_MASK = (1 << 64) - 1
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.default_rng(41).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        def series(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS[size] = series(_BASE), series(pow(_BASE, -1, 1 << 64))
    return _POWERS[size]


class Rolling:
    """Hashes of any stretch of some bytes, from prefix sums modulo 2**64."""

    def __init__(self, x: np.ndarray):
        self.up, down = _powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * down[: len(x)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.up[:n]


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Per run of windows: arrays (first window, last window, trigger hash, phrase hash) of absolute places."""
    gram = max(1, length // 2)
    width = length - gram + 1
    for low in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        high = min(int(offsets[-1]), low + CHUNK + length - 1)
        n = high - low - length + 1
        if n <= 0:
            continue
        x = data[low:high]
        rolling = Rolling(x)
        g = mix64(rolling.all(gram))
        v = g & np.uint64(0xFFFFFFFF00000000) | np.arange(len(g), dtype=np.uint64)
        size = 1
        while 2 * size <= width:  # least value of each window, the leftmost of equals
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < width:
            v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
        edge = offsets[(offsets > low) & (offsets < high)] - low
        ok = np.ones(n, bool)
        for e in edge:  # windows don't cross texts
            ok[max(0, e - length + 1) : e] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        trigger = (v[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)]))
        a, b, p = at[first], at[np.append(first[1:], len(at)) - 1], trigger[first]
        shape = ((p - a) << 32 | (b - a)).astype(np.uint64)
        yield a + low, b + low, g[p], mix64(rolling(a, b + length) + mix64(shape))


def _triggers(docs: DataFrame, length: int) -> DataFrame:
    """(h, n): trigger hashes and how often they occur."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            found = [h for _, _, h, _ in phrases(data, offsets, length)]
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    return docs.select("text").mapInArrow(settled(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return in_slots(bits, h, SLOT_BITS)


def _held(batches, length: int, wanted):
    """Runs of about HELD bytes of text: phrases (h, q) that wanted takes, their text's key, place and size, and bytes."""
    parts, size = [], 0

    def flush():
        h, q, start, width = (np.concatenate([p[k] for p in parts]) for k in range(4))
        keys = pa.concat_arrays([p[4] for p in parts])
        order = np.lexsort((np.arange(len(h)), q, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (q[order][1:] != q[order][:-1])
        first = np.flatnonzero(new)
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        piece = lambda i: parts[source[i]][5][(at := parts[source[i]][6][i - begin[source[i]]]) : at + width[i]].tobytes()
        begin = np.cumsum([0] + [len(p[0]) for p in parts])
        return h, q, start, width, keys, order, first, np.diff(np.append(first, len(h))), piece

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for a, b, h, q in phrases(data, offsets, length):
            hit = np.flatnonzero(wanted(h, q))
            a, b, h, q = a[hit], b[hit], h[hit], q[hit]
            doc = np.searchsorted(offsets, a, side="right") - 1
            if len(h):
                parts.append((h, q, a - offsets[doc], b - a + length, batch.column(0).take(pa.array(doc)), data, a))
        size += int(offsets[-1] - offsets[0])
        if size >= HELD and parts:
            yield flush()
            parts, size = [], 0
    if parts:
        yield flush()


def _parse(docs: DataFrame, slots, length: int) -> DataFrame:
    """Occurrences of phrases whose trigger repeats: (h, q, n, key, a, size), one a run of text; and, where n is 0,
    spans (key, a, size) that repeat within the run."""

    def run(batches):
        for h, q, start, width, keys, order, first, n, _ in _held(batches, length, lambda h, q: _in(slots.value, h)):
            one = order[first]
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[one].view(np.int64)), "q": pa.array(q[one].view(np.int64)), "n": pa.array(n), "key": keys.take(pa.array(one)), "a": pa.array(start[one]), "size": pa.array(width[one])})
            many = np.sort(order[np.repeat(n > 1, n)])  # in the order of the text: merge what touches
            if len(many):
                s, e = start[many], start[many] + width[many]
                fresh = np.ones(len(many), bool)
                fresh[1:] = (s[1:] > e[:-1]) | (s[1:] < s[:-1]) | np.array(pa.compute.not_equal(keys.take(pa.array(many[1:])), keys.take(pa.array(many[:-1]))))
                cut = np.flatnonzero(fresh)
                last = np.append(cut[1:], len(many)) - 1
                none = pa.nulls(len(cut), pa.int64())
                yield pa.RecordBatch.from_pydict({"h": none, "q": none, "n": pa.array(np.zeros(len(cut), np.int64)), "key": keys.take(pa.array(many[cut])), "a": pa.array(s[cut]), "size": pa.array(e[last] - s[cut])})

    return docs.select("key", "text").mapInArrow(settled(run), "h long, q long, n long, key binary, a long, size long")


def _dictionary(docs: DataFrame, slots, hot, length: int) -> DataFrame:
    """(h, q, phrase, hot): the bytes of the phrases in slots, once a run of text, and whether their trigger is hot."""

    def run(batches):
        for h, q, _, _, _, order, first, _, piece in _held(batches, length, lambda h, q: _in(slots.value, _pair(h, q))):
            one = order[first]
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[one].view(np.int64)), "q": pa.array(q[one].view(np.int64)), "phrase": pa.array([piece(i) for i in one], pa.binary()), "hot": pa.array(_in(hot.value, h[one]) if hot else np.zeros(len(one), bool))})

    return docs.select("key", "text").mapInArrow(settled(run), "h long, q long, phrase binary, hot boolean")


def _pair(h: np.ndarray, q: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(3) + q)


def shared_windows(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places of runs of windows of phrases that stand elsewhere in the phrases too.

    text: phrases one after the other; ends: where each ends.  A suffix array by prefix doubling, to the depth length:
    a suffix keeps its rank while another has the same prefix, and falls out as soon as none has.
    """
    n = len(text)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # bytes to the phrase's end
    width = min(8, length)
    key = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):  # the order of the prefixes' bytes
        key = key << np.uint64(8) | text[k : n - width + 1 + k]
    at, rank = np.flatnonzero(left[: len(key)] >= width), np.full(n + length, -1, np.int32)
    key = key[at]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        single = new & np.append(new[1:], True)
        ranks = np.cumsum(new, dtype=np.int32) - np.int32(1)
        ranks[single] = -1
        rank[at] = -1
        rank[at[order]] = ranks
        at = at[rank[at] >= 0]
        if width == length:
            break
        step = min(width, length - width)
        fits = (left[at] >= width + step) & (rank[at + step] >= 0)
        longer = at[fits]
        key = rank[longer].astype(np.uint64) << np.uint64(32) | rank[longer + step].astype(np.uint32)
        rank[at[~fits]] = -1
        at, width = longer, width + step
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (left[at[1:]] > left[at[:-1]])
    cut = np.flatnonzero(first)
    return at[cut], at[np.append(cut[1:], len(at)) - 1] if len(cut) else at[cut]


def _sorted_dictionary(phrases_: DataFrame, length: int) -> DataFrame:
    """(h, q, s, e): stretches of dictionary phrases that others share.  phrases_: h, q, phrase, once or more."""

    def run(batches):
        hs, qs, texts, size = [], [], [], 0

        def found(upto):
            first, last = shared_windows(np.frombuffer(b"".join(texts[:upto]), np.uint8), np.cumsum([len(x) for x in texts[:upto]]), length)
            ends = np.cumsum([len(x) for x in texts[:upto]])
            owner = np.searchsorted(ends, first, side="right")
            start = (ends - [len(x) for x in texts[:upto]])[owner]
            return pa.RecordBatch.from_pydict({"h": pa.array(np.array(hs[:upto], np.int64)[owner]), "q": pa.array(np.array(qs[:upto], np.int64)[owner]), "s": pa.array((first - start).astype(np.int32)), "e": pa.array((last - start + length).astype(np.int32))})

        for batch in batches:
            for h, q, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if hs and hs[-1] == h and qs[-1] == q:
                    continue  # the phrase of another run of text
                if size >= BLOCK and hs[-1] != h:
                    yield found(len(hs))
                    hs, qs, texts, size = [], [], [], 0
                hs.append(h)
                qs.append(q)
                texts.append(phrase)
                size += len(phrase)
        if hs:
            yield found(len(hs))

    return phrases_.select("h", "q", "phrase").repartition("h").sortWithinPartitions("h", "q").mapInArrow(settled(run), "h long, q long, s int, e int")


def _hot_suffixes(rows: DataFrame, length: int, cells, windows) -> DataFrame:
    """Of the suffixes of a hot trigger's dictionary phrases (h, q, phrase), by hash, what may be shared.

    Windows go in cells, runs of starts counted from the trigger; all windows of a cell hold its core, so a window can
    be shared only if its core is.  Without cells: (x) the cores' hashes.  With cells, the slots of repeated cores:
    (x) the hashes of the windows in them.  With windows too, the slots of repeated windows: (h, w, q, at) of those.
    """
    gram, cell = max(1, length // 2), max(1, length // 12)

    def run(batches):
        for batch in batches:
            h, q = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            for i in range(0, len(h), 4096):
                j = min(len(h), i + 4096)
                part = offsets[i : j + 1]
                text = data[part[0] : part[-1]]
                rolling = Rolling(text)
                order = mix64(rolling.all(gram)) >> np.uint64(32)
                place = np.array([int(np.argmin(order[s - part[0] : s - part[0] + length - gram + 1])) for s in part[:-1]])  # of the trigger
                each = np.diff(part) - length + 1
                owner = np.repeat(np.arange(j - i), each)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                c = (place[owner] - at) // cell
                base = (part[:-1] - part[0])[owner]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (c[1:] != c[:-1])
                start = (base + place[owner] - c * cell)[new]
                x = mix64(rolling(start, start + length - cell + 1) + mix64(h[i:j][owner[new]] + c[new].astype(np.uint64)))
                if cells is None:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(x.view(np.int64))})
                    continue
                live = _in(cells.value, x)[np.cumsum(new) - 1]
                owner, at, base = owner[live], at[live], base[live]
                w = mix64(rolling(base + at, base + at + length))
                x = mix64(w + mix64(h[i:j][owner]))
                if windows is None:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(x.view(np.int64))})
                    continue
                hit = _in(windows.value, x)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[i:j][owner[hit]].view(np.int64)), "w": pa.array(w[hit].view(np.int64)), "q": pa.array(q[i:j][owner[hit]].view(np.int64)), "at": pa.array(at[hit].astype(np.int32))})

    return rows.select("h", "q", "phrase").mapInArrow(settled(run), "h long" if windows is None else "h long, w long, q long, at int")


def _repeated(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(key, spans): for each text with repeats, by md5, arrays of (s, e) bytes to remove; spans may overlap."""
    spark = docs.sparkSession

    def shared(hashes: DataFrame):
        bits = spark.sparkContext.broadcast(slots(hashes, SLOT_BITS))
        release(spark)
        return bits

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    triggers = shared(_triggers(texts, length).where(F.col("n") > 1))
    parsed = written(_parse(texts, triggers, length), "pfp-parse")
    triggers.unpersist()
    # the parse in order of its phrases: how often each occurs, and where if once
    where = F.struct("key", "a")
    ranked = parsed.where(F.col("n") > 0).groupBy("h", "q").agg(F.sum("n").alias("total"), F.min(where).alias("at"))
    ranked = written(ranked.select("h", "q", "total", "at.key", "at.a"), "pfp-phrases")
    release(spark)
    kinds = ranked.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    differ = written(ranked.join(kinds.hint("merge"), "h").select("h", "q", "total", "key", "a", (F.col("kinds") > HOT_KINDS).alias("hot")), "pfp-differ")
    release(spark)
    often = ranked.where(F.col("total") > 1).select("h", "q")
    span = lambda df: df.select("key", F.col("a").alias("s"), (F.col("a") + F.col("size")).alias("e"))
    again = parsed.where(F.col("n") == 1).join(often.hint("merge"), ["h", "q"], "left_semi")
    whole = written(span(parsed.where(F.col("n") == 0)).unionByName(span(again)), "pfp-whole")
    release(spark, parsed, ranked)
    wanted = shared(differ.select("h", "q").mapInArrow(settled(_pairs), "h long"))
    heat = differ.where("hot").select("h")
    heat = shared(heat) if heat.head(1) else None  # a trigger is hot for all its phrases, so another in its slot loses nothing
    dictionary = _dictionary(texts, wanted, heat, length)
    if heat:
        dictionary = written(dictionary, "pfp-dictionary")
        part = _sorted_dictionary(dictionary.where(~F.col("hot")), length).unionByName(_hot_shared(dictionary.where("hot"), length, shared))
    else:
        part = _sorted_dictionary(dictionary, length)
    single = differ.where(F.col("total") == 1).select("h", "q", "key", "a")
    part = part.join(single.hint("merge"), ["h", "q"]).select("key", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"))
    spans = whole.unionByName(part).groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = written(spans, "pfp-spans")
    wanted.unpersist()
    release(spark, whole, differ, *([dictionary] if heat else []))
    return spans


def _hot_shared(rows: DataFrame, length: int, shared) -> DataFrame:
    """(h, q, s, e) of windows that different phrases of a hot trigger share; rows: h, q, phrase, once or more."""
    phrase = written(rows.groupBy("h", "q").agg(F.min("phrase").alias("phrase")), "pfp-hot")
    cells = shared(_repeated(_hot_suffixes(phrase, length, None, None)))
    windows = shared(_repeated(_hot_suffixes(phrase, length, cells, None)))
    likely = written(_hot_suffixes(phrase, length, cells, windows), "pfp-hot-windows")
    both = likely.groupBy("h", "w").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") > 1).select("h", "w")
    return likely.join(both.hint("merge"), ["h", "w"]).select("h", "q", F.col("at").alias("s"), (F.col("at") + length).alias("e"))


def _pairs(batches):
    for batch in batches:
        h, q = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
        yield pa.RecordBatch.from_pydict({"h": pa.array(_pair(h, q).view(np.int64))})


def _merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked) of every text.

    Each byte of a length-byte string that starts anywhere else too is removed, judged on the whole input.  Null texts
    are empty; shorter texts lose nothing; of repeated rows each loses what it shares; an empty table gives no rows.
    """
    spans = repeated_spans(docs, length=length)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            removed, runs, sums, texts = [], [], [], []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                gone, place, left = _merged(spans), 0, []
                for s, e in gone:
                    left.append(text[place:s])
                    place = e
                kept = b"".join([*left, text[place:]])
                removed.append(len(text) - len(kept))
                runs.append(len(gone))
                sums.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept if with_text else None)
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * with_text, names=names + ["kept"] * with_text)

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.withColumn("key", F.unhex(F.md5("text"))).join(spans.hint("merge"), "key", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(settled(run), schema)
