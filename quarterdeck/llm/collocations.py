"""Phrase mining by vertical partitioning of a word suffix tree.

The suffixes of all pieces of text, cut after DEPTH words, make a suffix tree whose node counts are the frequencies of
phrases.  It is never built whole.  Prefixes split it into subtrees: a first word, or, where more than a share of a
group begins with it, its first two words, or three.  Prefixes are dealt to groups by a hash; as each holds little of a group's
budget, a group's suffixes fit its memory budget.  Each group sorts its suffixes, which are the leaves of its
subtrees, and reads the counts of inner nodes as sums over runs of leaves.

Tasks count equal suffixes before the shuffle.  Only the prefixes that are cut further leave Spark, at most 4 a group
and length; they are counted on their way, and the groups count the nodes below them.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, mix64, release, settled, text_buffers, written

MIN_COUNT, DEPTH, TOP = 10, 3, 2000
#: Suffixes of a group, half of which its prefixes hold on average, and least number of groups.
BUDGET, GROUPS = 1_000_000, 64
#: A longer phrase replaces its parts if it has at least this share (percent) of their occurrences.
SHARE = 50
#: Words that a task counts at once, and different words it numbers at once (21 bits each in a suffix of three).
_WORDS, _BITS = 1 << 21, 21
#: Languages whose word numbers a task holds at once.
_HELD = 64
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_MAP = bytes(10 if b in _BREAKS else 32 if b == 9 else LOWER[b] for b in range(256))
_STRETCH = 1 << 20


def _tokens(text: bytes):
    """Lists of lower-cased words of a text, with a line feed between its pieces; empty tokens are to be skipped."""
    text, at = text.translate(_MAP), 0
    while at < len(text):
        end = min(at + _STRETCH, len(text))
        while end < len(text) and text[end] not in (32, 10):
            end += 1
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


class _Counter:
    """Counts the suffixes (cut to depth words) of texts by language, over runs of about _WORDS words."""

    def __init__(self, depth: int):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        numbers = count()
        self.table = defaultdict(numbers.__next__)
        self.table[b""], self.table[b"\n"]  # numbers 0 and 1
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        parts = self.parts.setdefault(lang, [])
        for tokens in _tokens(text):
            ids = np.fromiter(map(self.table.__getitem__, tokens), np.int32, len(tokens))
            parts.append(ids[ids > 0])
            self.size += len(parts[-1])
        parts.append(np.ones(1, np.int32))

    def full(self) -> bool:
        return self.size >= _WORDS or len(self.parts) >= _HELD

    def counted(self):
        """(language, words, columns of word numbers, counts) of the texts so far; after a piece's end the number is 1."""
        words = np.array(list(self.table), object)
        for lang, parts in self.parts.items():
            x = np.concatenate(parts)
            at = np.flatnonzero(x > 1)
            if not len(at):
                continue
            rows = [x[at]]
            for k in range(1, self.depth):
                nxt = np.append(x, np.ones(k, np.int32))[at + k]
                rows.append(np.where((rows[-1] > 1) & (nxt > 1), nxt, 1))
            columns, n, _ = _summed(rows)
            yield lang, words, columns, n
        self.clear()


def _summed(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of columns of small numbers, in order, with their counts (or the sums of n) and a place of each."""
    if len(columns) <= 3 and max(int(c.max()) for c in columns) < 1 << _BITS:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key << _BITS | c
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort(columns[::-1])
        rows = [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in rows], axis=0)]))
    total = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)
    at = order[first]
    return [c[at] for c in columns], total, at


def _joined(words: np.ndarray, columns: list[np.ndarray]) -> list[bytes]:
    """The phrases of rows of word numbers, all of the same length."""
    text = words[columns[0]]
    for c in columns[1:]:
        text = text + b" " + words[c]
    return text.tolist()


def _counters(docs: DataFrame, depth: int, emitted, schema: str) -> DataFrame:
    """What emitted makes of each run of text: a function of (language, words, columns, counts)."""

    def run(batches):
        counter = _Counter(depth)

        def flush():
            for found in counter.counted():
                yield from emitted(*found)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for k in range(len(langs)):
                counter.add(langs[k], data[offsets[k] : offsets[k + 1]].tobytes())
                if counter.full():
                    yield from flush()
        yield from flush()

    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return named.mapInArrow(settled(run), schema)


_PHRASES = "lang string, phrase string, n long"


def _phrase_rows(docs: DataFrame, depth: int, only: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n) of phrases of depth words, a task's run of text at a time; only: hashes of the words that they
    consist of."""
    wanted = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def emitted(lang, words, columns, n):
        keep = columns[-1] > 1
        if wanted is not None:
            known = np.isin(_hashes(lang, words), wanted.value)
            for c in columns:
                keep = keep & known[c]
        columns, n = [c[keep] for c in columns], n[keep]
        for k in range(0, len(n), 50_000):
            some = pa.array(_joined(words, [c[k : k + 50_000] for c in columns]), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(n[k : k + 50_000], pa.int64())], names=["lang", "phrase", "n"])

    return _counters(docs, depth, emitted, _PHRASES)


def _hashes(lang: str, words) -> np.ndarray:
    head = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in words), np.uint64, len(words))


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a prefix and the word that follows it."""
    return mix64(prefix * np.uint64(3) + word)


def _large(prefixes: DataFrame) -> np.ndarray:
    """Hashes of prefixes (lang, phrase), of which there are few: each holds a share of a group."""
    found = []
    for r in prefixes.select("lang", "phrase").collect():
        h = _hashes(r["lang"], r["phrase"].encode().split(b" "))
        key = h[:1]
        for k in range(1, len(h)):
            key = _extended(key, h[k : k + 1])
        found.append(key)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _grouped(docs: DataFrame, depth: int, large: list[np.ndarray], groups: int) -> DataFrame:
    """(group, lang, words, ids, n, top): the suffixes of a run of text, one row a group that has any.

    The group is that of the suffix's prefix: its first word, and one more while those before are large; top is the
    prefix's length, as shorter nodes are large and were counted before.  words: the distinct words, a line each; ids: three
    columns of their numbers from 1 on (0: no word), n: counts, top: lengths, as arrays of whole numbers.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(large)

    def emitted(lang, words, columns, n):
        h = _hashes(lang, words)
        prefix, top, at = h[columns[0]], np.ones(len(n), np.uint8), np.arange(len(n))
        for k, some in enumerate(wanted.value, 1):
            at = at[np.isin(prefix[at], some)]
            top[at] = k + 1
            at = at[columns[k][at] > 1] if k < depth else at[:0]
            prefix[at] = _extended(prefix[at], h[columns[k][at]])
        group = (prefix % np.uint64(groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        edge = np.flatnonzero(np.diff(group[order], prepend=-1))
        for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
            rows = order[a:b]
            ids = np.stack([c[rows] for c in columns])
            used, number = np.unique(np.append(ids.ravel(), 1), return_inverse=True)  # 1, no word, is the least
            number = number[:-1].astype("<u2" if len(used) < 1 << 16 else "<u4")
            yield pa.RecordBatch.from_pydict({
                "group": pa.array([group[rows[0]]], pa.int32()), "lang": [lang], "words": pa.array([b"\n".join(words[used[1:]])], pa.binary()), "ids": pa.array([number.tobytes()], pa.binary()),
                "n": pa.array([n[rows].astype("<u4").tobytes()], pa.binary()), "top": pa.array([top[rows].tobytes()], pa.binary()),
            })

    return _counters(docs, depth, emitted, "group int, lang string, words binary, ids binary, n binary, top binary")


def _subtrees(depth: int, least: int):
    """Function of a group's leaves (rows of _grouped) that gives its nodes of 2 and more words that occur least times."""

    def run(table: pa.Table) -> pa.Table:
        langs: dict[str, tuple] = {}
        for r in table.to_batches():
            for lang, words, ids, n, top in zip(*(r.column(c).to_pylist() for c in ("lang", "words", "ids", "n", "top")), strict=True):
                numbers, parts = langs.setdefault(lang, (defaultdict(count(2).__next__), []))
                words = words.split(b"\n")
                known = np.concatenate([[1], np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))])
                rows = len(top)
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * depth * rows else "<u4").reshape(depth, rows)
                parts.append((known[ids], np.frombuffer(n, "<u4").astype(np.int64), np.frombuffer(top, np.uint8)))
        out = []
        for lang, (numbers, parts) in langs.items():
            words = np.array([b"", b"", *numbers], object)
            ids, n, top = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
            leaves, total, at = _summed(list(ids), n)
            top = top[at]  # one of a suffix, as its prefix decides
            for k in range(2, depth + 1):
                below = (leaves[k - 1] > 1) & (top <= k)  # leaves below a node of k words, which stand together
                if not below.any():
                    continue
                node = [c[below] for c in leaves[:k]]
                first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in node], axis=0)]))
                sums = np.add.reduceat(total[below], first)
                keep = sums >= least
                text = pa.array(_joined(words, [c[first[keep]] for c in node]), pa.binary()).cast(pa.string()) if keep.any() else pa.array([], pa.string())
                out.append(pa.table({"lang": pa.array([lang] * len(text), pa.string()), "phrase": text, "n": pa.array(sums[keep], pa.int64())}))
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return run


def _cut(words: Column, first: int, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def phrase_counts(docs: DataFrame, *, depth: int = DEPTH, least: int = MIN_COUNT, budget: int = BUDGET, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): n of every word of a language, and of its phrases of 2 to depth words that occur least times
    within pieces; both (lang, phrase, n)."""
    spark = docs.sparkSession
    words = written(_phrase_rows(docs, 1).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrase-words")
    release(spark)
    total = words.agg(F.sum("n")).head()[0] or 0
    groups = max(groups, -(-2 * total // budget))
    limit = max(total // (4 * groups), 1)
    large, counted = [_large(words.where(F.col("n") > limit))], []
    for k in range(2, depth):  # prefixes of k words, all of which are large themselves
        if not len(large[-1]):
            break
        longer = _phrase_rows(docs, k, large[0]).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        counted.append(written(longer.where(F.col("n") > limit), "phrase-prefixes"))
        large.append(_large(counted[-1]))
    leaves = _grouped(docs, depth, large, groups).repartition("group").groupBy("group")
    phrases = leaves.applyInArrow(_subtrees(depth, least), _PHRASES)
    for nodes in counted:
        phrases = phrases.unionByName(nodes.where(F.col("n") >= least))
    phrases = written(phrases, "phrases")
    release(spark, *counted)
    return words, phrases


def collocations(docs: DataFrame, *, depth: int = DEPTH, least: int = MIN_COUNT, top: int = TOP, share: int = SHARE, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each language (null: und) of 2 to depth words.

    a counts the phrase, l and r the parts of its lowest-scoring cut, n all words of the language; score is
    floor(1000000 * a * a / (l * r)) in whole numbers.  Phrases whose words lie in a longer one with share percent or more
    of their occurrences are left out.  Ties go to the larger a, then the least phrase in byte order.  Null and empty texts
    and empty tables have no phrases; repeated rows count each; long texts are taken whole; other columns are ignored.
    """
    words, phrases = phrase_counts(docs, depth=depth, least=least, **options)
    split = phrases.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w"))
    cuts = []
    for size in range(2, depth + 1):
        for k in range(1, size):
            some = split.where(F.col("size") == size)
            cuts.append(some.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), _cut(F.col("w"), 1, k).alias("left"), _cut(F.col("w"), k + 1, size - k).alias("right")))
    cut = cuts[0]
    for more in cuts[1:]:
        cut = cut.unionByName(more)
    parts = words.where(F.col("n") >= least).unionByName(phrases)
    with_left = cut.hint("merge").join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")).hint("merge"), ["lang", "left"])
    both = with_left.hint("merge").join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")).hint("merge"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")  # noqa: E731  products of two: under 10**32
    both = both.withColumn("aa", (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("lr", (wide("l") * wide("r")).cast("decimal(38,0)"))
    lowest = both.select("lang", "phrase", F.struct(F.expr("aa div lr").alias("score"), "k", "a", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))
    inner = None
    for size in range(3, depth + 1):
        for width in range(2, size):
            for k in range(1, size - width + 2):
                rows = split.where(F.col("size") == size).select("lang", _cut(F.col("w"), k, width).alias("phrase"), F.col("n").alias("longer"))
                inner = rows if inner is None else inner.unionByName(rows)
    kept = lowest.select("lang", "phrase", "cut.*")
    if inner is not None:
        most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        kept = kept.hint("merge").join(most.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.hint("merge").join(sums.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
