"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions.  Every context (the last 0 to DEPTH bytes) has a Krichevsky-Trofimov estimate for
each decision, and the tree mixes all depths: a node's weighted probability is half its own estimate's and half the
product of its children's.  Counts come from every training text, and every context that one has is a node: the tree is
mixed where its parts lie (see context_forest), and texts get the values of their codes back by shuffles.

A bounded tree can be asked for instead (min_share): a context then splits off a child only where the child holds a least
share of all training positions; the others of that context share one leaf, so no count is lost, but what lies deeper
is.  It is broadcast: cells of the bytes and decisions that a context has seen, not rows of all 256 bytes.  Scoring runs
it as an automaton: a state is the longest context in the tree, and two table look-ups a byte give the code length and
the next state, for thousands of stretches of text at once; bytes that a state never saw are few and are looked up in its
ancestors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_forest as forest
from .common import LOWER, fold, fresh_path, pieces, release, settled, store_of, text_buffers, written
from .context_forest import END

DEPTH = 6
#: Share of the positions for a node of its own: FIRST_SHARE up to FIRST_POSITIONS, from there on falling with the square
#: root of the positions, down to MIN_SHARE.
FIRST_SHARE, FIRST_POSITIONS, MIN_SHARE = 2.0**-16, 1 << 26, 2.0**-19
#: Words with at least this share of all tokens are looked up in a broadcast table (so it has at most 1 / share
#: entries); counts of all others are joined.
WORD_SHARE = 2.0**-18
END_TOKEN = b"\n"  # no word holds white space
PART_CODES = 1 << 20  # sent to a task that mixes parts of the tree
LANES = 4096
SCORED_BYTES = 1 << 20  # of texts that are scored at once
_ONE = np.uint64(1)
_BIT, _WORD = np.left_shift(_ONE, np.arange(256, dtype=np.uint64) & np.uint64(63)), np.arange(256, dtype=np.int32) >> 6


def stream(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    return forest.stream(data, offsets, depth)


def grams(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, next byte) codes of a stream's positions, and their counts."""
    code = np.zeros(len(text) - depth, np.uint64)
    for k in range(depth + 1):
        code <<= np.uint64(8)
        code |= text[k : len(text) - depth + k]
    edge = np.zeros(len(text) + 1, np.int8)
    edge[starts] += 1
    edge[starts + lengths + 1] -= 1
    code = np.sort(code[np.cumsum(edge[:-1], dtype=np.int8)[depth:] > 0])
    return _runs(code, None)


def least_share(positions: int) -> float:
    return max(MIN_SHARE, FIRST_SHARE * min(1.0, math.sqrt(FIRST_POSITIONS / max(1, positions))))


def _runs(code: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if n is not None and len(first) else np.diff(np.append(first, len(code)))


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(g: gram code or null, w: token or null, n): counts over every text of docs."""

    def run(batches):
        words: dict[bytes, int] = {}
        codes, counts, held = [], [], 0

        def emit():
            code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
            order = np.argsort(code, kind="stable")
            g, n = _runs(code[order], np.concatenate(counts)[order]) if len(code) else (code, code)
            for i in range(0, len(g), 200_000):
                part = g[i : i + 200_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.binary()), pa.array(n[i : i + 200_000].astype(np.int64))], names=["g", "w", "n"])
            keys = list(words)
            for i in range(0, len(keys), 200_000):
                part = keys[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(part, pa.binary()), pa.array([words[k] for k in part], pa.int64())], names=["g", "w", "n"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in pieces(offsets):
                text, starts = stream(data, offsets[i : j + 1], depth)
                g, n = grams(text, starts, np.diff(offsets[i : j + 1]), depth)
                codes.append(g)
                counts.append(n)
                held += len(g)
                text[text == END] = 10  # the ends part words as white space does
                for w in text.tobytes().split():
                    words[w] = words.get(w, 0) + 1
                words[END_TOKEN] = words.get(END_TOKEN, 0) + j - i
                if held > 2_500_000 or len(words) > 300_000:
                    yield from emit()
                    words, codes, counts, held = {}, [], [], 0
        yield from emit()

    partial = docs.select(F.col("text").cast("string")).mapInArrow(settled(run), "g long, w binary, n long")
    return partial.groupBy("g", "w").agg(F.sum("n").alias("n"))


class CellRows:
    """Which columns (0 to 255) the rows of a sparse table have, and where their cells lie: 48 bytes a row."""

    def __init__(self, rows: int, codes: np.ndarray):  # codes: sorted, row << 8 | column
        word = codes >> 6
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        self.bits = np.zeros(rows * 4, np.uint64)
        if len(codes):
            self.bits[word[starts]] = np.bitwise_or.reduceat(_BIT[codes & 255], starts)
        held = np.bincount(word, minlength=rows * 4)
        self.first = (np.cumsum(held) - held).astype(np.int32)

    def find(self, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each cell, whether there is one)."""
        at = (row << 2) + _WORD[column]
        word, bit = self.bits[at], _BIT[column]
        return self.first[at] + np.bitwise_count(word & (bit - _ONE)), (word & bit) != 0


@dataclass
class ContextTree:
    """The tree as an automaton, with cells only for what training has seen.

    A state has a cell for each byte seen after its context, and decisions that saw a byte.  A byte without a cell leads
    where it leads from the parent; a decision that a state never saw has the probability that its nearest ancestor
    which saw it gives to children that didn't (one half if none did).  So a state takes some hundred bytes, not 2 KB.
    """

    depth: int
    up: np.ndarray  # (states) int32: the context less its first byte; the root's is itself
    decisions: CellRows  # by state and decision: 1, then the bits before it
    odds: np.ndarray  # (decisions) float32: natural log odds of a one in the state
    unseen: np.ndarray  # (decisions) float32: the same in children that never saw the decision
    bytes: CellRows | None = None  # by state and byte; the root has all bytes
    next_state: np.ndarray | None = None  # (bytes) int32
    cell_log10: np.ndarray | None = None  # (bytes) float32: of the byte's probability in the state

    def values(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log10 probability of each byte in its state, from the decisions."""
        total = np.zeros(len(state))
        for bit in range(8):
            decision = (1 << bit) | (byte >> (8 - bit))
            index, hit = self.decisions.find(state, decision)
            odds = np.zeros(len(state))
            odds[hit] = self.odds[index[hit]]
            rest = np.flatnonzero(~hit & (state > 0))
            at = self.up[state[rest]]
            while len(rest):
                index, hit = self.decisions.find(at, decision[rest])
                odds[rest[hit]] = self.unseen[index[hit]]
                more = ~hit & (at > 0)
                rest, at = rest[more], self.up[at[more]]
            total -= np.logaddexp(0.0, np.where(byte >> (7 - bit) & 1, -odds, odds))
        return total / math.log(10)

    @property
    def log10(self) -> np.ndarray:
        """(states * 256): of every byte's probability in every state; a whole table, for small trees."""
        code = np.arange(len(self.up) << 8)
        return self.values(code >> 8, code & 255)

    def lines(self, text: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of a stream, given the bytes before it (its first depth bytes: 0)."""
        n = len(text)
        lanes = min(LANES, max(1, n // 64))
        size = -(-n // lanes)
        padded = np.full(lanes * size + self.depth, END, np.uint8)
        padded[self.depth : self.depth + n] = text
        at = np.arange(lanes) * size
        state = np.zeros(lanes, np.int32)
        out = np.empty((size, lanes), np.float32)
        places, codes = [], []
        for t in range(size + self.depth):
            byte = padded[at + t]
            index, hit = self.bytes.find(state, byte)
            following = np.take(self.next_state, index, mode="clip")
            if t >= self.depth:
                np.take(self.cell_log10, index, out=out[t - self.depth], mode="clip")
            if not hit.all():
                rest = np.flatnonzero(~hit)
                seen = byte[rest]
                if t >= self.depth:
                    places.append((t - self.depth) * lanes + rest)
                    codes.append((state[rest].astype(np.int64) << 8) | seen)
                _fallen(self.bytes, self.up, self.next_state, following, rest, self.up[state[rest]], seen)
            state = following
        if places:
            code, which = np.unique(np.concatenate(codes), return_inverse=True)
            out.reshape(-1)[np.concatenate(places)] = self.values(code >> 8, code & 255)[which]
        return out.T.reshape(-1)[:n]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each whole text with its end."""
        out = np.zeros(len(offsets) - 1)
        for i, j in pieces(offsets, SCORED_BYTES):
            text, starts = stream(data, offsets[i : j + 1], self.depth)
            total = np.concatenate([[0.0], np.cumsum(self.lines(text), dtype=np.float64)])
            out[i:j] = total[starts + np.diff(offsets[i : j + 1]) + 1] - total[starts]
        return out


def _fallen(cells: CellRows, up: np.ndarray, next_state: np.ndarray, out: np.ndarray, rest: np.ndarray, at: np.ndarray, byte: np.ndarray) -> None:
    """out[rest]: where bytes lead from states at, or from the nearest ancestors that have a cell for them."""
    while len(rest):
        index, hit = cells.find(at, byte)
        out[rest[hit]] = next_state[index[hit]]
        miss = ~hit
        rest, at, byte = rest[miss], up[at[miss]], byte[miss]


def build_tree(keys: np.ndarray, cell_key: np.ndarray, cell_byte: np.ndarray, cell_n: np.ndarray, depth: int = DEPTH) -> ContextTree:
    """The weighted tree.  keys: sorted node keys (depth << 48 | context); cells: counts of next bytes by node."""
    s = len(keys)
    level, context = keys >> 48, keys & ((1 << 48) - 1)
    cell_node, cell_byte, cell_n = np.searchsorted(keys, cell_key), np.asarray(cell_byte, np.int64), np.asarray(cell_n, np.float64)  # whole numbers are exact
    up = np.where(level > 0, np.searchsorted(keys, ((np.maximum(level, 1) - 1) << 48) | (context & ((np.int64(1) << (8 * (np.maximum(level, 1) - 1))) - 1))), 0)
    child = level > 0
    inner = np.zeros(s, bool)
    inner[up[child]] = True
    table = np.array([math.lgamma(k + 0.5) for k in range(1 << 12)])

    def log_gamma_half(x: np.ndarray) -> np.ndarray:  # of x + 1/2; Stirling's series for large x
        big = np.maximum(x, 1.0) + 0.5
        return np.where(x < 4096, table[np.minimum(x, 4095).astype(np.int64)], (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big))

    def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # Krichevsky-Trofimov, of a zeros and b ones
        big = a + b + 1
        whole = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3)
        whole = np.where(a + b == 0, 0.0, whole)
        return log_gamma_half(a) + log_gamma_half(b) - whole - math.log(math.pi)

    codes, odds, unseen = [], [], []
    for bit, first in ((bit, first) for bit in range(8) for first in range(0, 1 << bit, 8)):  # few decisions at once
        width, some = 1 << (7 - bit), min(8, 1 << bit)
        half = cell_byte // width - 2 * first
        here = np.flatnonzero((half >= 0) & (half < 2 * some))
        saw = np.zeros(s, bool)
        saw[cell_node[here]] = saw[0] = True
        who = np.flatnonzero(saw)  # with each state its ancestors, which saw all that it did
        place = np.cumsum(saw) - 1
        above, split = place[up[who]], inner[who]
        levels = [np.flatnonzero(level[who] == d) for d in range(depth + 1)]
        own = np.bincount(place[cell_node[here]] * 2 * some + half[here], cell_n[here], len(who) * 2 * some).reshape(len(who), some, 2)
        other = own.copy()  # what no child holds
        np.subtract.at(other, above[1:], own[1:])
        np.maximum(other, 0, out=other)
        log_own = log_estimate(own[:, :, 0], own[:, :, 1])
        below = log_estimate(other[:, :, 0], other[:, :, 1])
        weighted = log_own.copy()
        for d in range(depth, -1, -1):
            at = levels[d]
            mix = math.log(0.5) + np.logaddexp(log_own[at], below[at])
            weighted[at] = np.where(split[at, None], mix, log_own[at])
            if d:
                np.add.at(below, above[at], weighted[at])
        stop = np.where(split[:, None], np.exp(math.log(0.5) + log_own - weighted), 1.0)
        one = (own[:, :, 1] + 0.5) / (own.sum(axis=2) + 1)
        one_rest = (other[:, :, 1] + 0.5) / (other.sum(axis=2) + 1)
        mixed, left = np.zeros_like(stop), np.ones_like(stop)
        for d in range(depth + 1):
            at = levels[d]
            if d:
                mixed[at], left[at] = mixed[above[at]], left[above[at]]
            mixed[at] += left[at] * stop[at] * one[at]
            left[at] *= 1 - stop[at]
        row, column = np.nonzero(own.sum(axis=2) > 0)
        codes.append((who[row] << 8) | ((1 << bit) + first + column))
        for out, rest in ((odds, one_rest[row, column]), (unseen, 0.5)):
            p = np.clip(mixed[row, column] + left[row, column] * rest, 1e-12, 1 - 1e-12)
            out.append((np.log(p) - np.log1p(-p)).astype(np.float32))
    code, odds, unseen = np.concatenate(codes), np.concatenate(odds), np.concatenate(unseen)
    if not (np.isfinite(odds).all() and np.isfinite(unseen).all()):
        raise FloatingPointError("a probability of the context tree is not a number")
    order = np.argsort(code)
    tree = ContextTree(depth, up.astype(np.int32), CellRows(s, code[order]), odds[order], unseen[order])
    del codes, code, order
    longer = np.flatnonzero(level > 0)  # a context is where its last byte leads from the context before that
    before = ((level[longer] - 1) << 48) | (context[longer] >> 8)
    place = np.minimum(np.searchsorted(keys, before), s - 1)
    ok = keys[place] == before
    leads, longer = (place[ok] << 8) | (context[longer[ok]] & 255), longer[ok]
    code = np.unique(np.concatenate([np.arange(256), leads, (cell_node << 8) | cell_byte]))
    tree.bytes = CellRows(s, code)
    tree.next_state = np.full(len(code), -1, np.int32)
    tree.next_state[:256] = 0
    tree.next_state[np.searchsorted(code, leads)] = longer
    state_level = level[code >> 8]
    for d in range(1, depth + 1):  # what leads to no longer context leads where it does from the parent
        rest = np.flatnonzero((state_level == d) & (tree.next_state < 0))
        _fallen(tree.bytes, tree.up, tree.next_state, tree.next_state, rest, tree.up[code[rest] >> 8], code[rest] & 255)
    tree.cell_log10 = np.concatenate([tree.values(part >> 8, part & 255).astype(np.float32) for part in np.array_split(code, 1 + len(code) // 200_000)])
    return tree


def train_tree(counts: DataFrame, *, depth: int = DEPTH, min_share: float | None = None) -> ContextTree:
    """Fit from gram counts; only contexts with min_share of the positions come to the driver, a bounded number."""
    g = counts.where(F.col("g").isNotNull())
    total = g.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        return build_tree(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), depth)
    min_share = min_share or least_share(total)
    node = lambda d: F.lit(d << 48) + F.shiftright("g", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1))
    each = g.select(F.explode(F.array(*[node(d) for d in range(depth + 1)])).alias("k"), F.col("g").bitwiseAND(F.lit(255)).alias("b"), "n")
    keep = written(each.groupBy("k").agg(F.sum("n").alias("t")).where((F.col("t") >= min_share * total) | (F.col("k") == 0)).select("k"), "contexts")
    cells = each.join(F.broadcast(keep), "k").groupBy("k", "b").agg(F.sum("n").alias("n")).select("k", F.col("b").cast("short"), "n").toArrow()
    key, byte, n = (cells.column(c).to_numpy() for c in ("k", "b", "n"))
    return build_tree(np.unique(key), key, byte, n, depth)


def lot_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(root, lot, part, codes, n): n codes of a lot below a root, with their counts in training texts; or (w, n): a word of training
    texts and its count; docs: doc_id, text, held_out."""

    def run(batches):
        words: dict[bytes, int] = {}

        def counted():
            keys = list(words)
            for i in range(0, len(keys), 200_000):
                part = keys[i : i + 200_000]
                none = [pa.nulls(len(part), t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(part, pa.binary()), pa.array([words[k] for k in part], pa.int64())], names=names)

        names = ["root", "lot", "part", "codes", "w", "n"]
        for lot, batch in forest.lots(batches, 1, TaskContext.get().partitionId()):
            data, offsets = text_buffers(batch.column(1))
            learnt = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            code, n = forest.distinct(forest.codes(data, offsets, depth), np.repeat(learnt, np.diff(offsets) + 1))
            rows = forest.rows_of(code, depth)
            for k in range(0, len(rows), 5_000):
                some = rows[k : k + 5_000]
                blobs = [forest.packed_codes(code[a:b], n[a:b]) for _, a, b in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r for r, _, _ in some], pa.int32()), pa.array([lot] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(some), pa.binary()), pa.array([b - a for _, a, b in some], pa.int64()),
                ], names=names)
            for k in np.flatnonzero(learnt):
                for w in data[offsets[k] : offsets[k + 1]].tobytes().translate(LOWER).split():
                    words[w] = words.get(w, 0) + 1
            words[END_TOKEN] = words.get(END_TOKEN, 0) + int(learnt.sum())
            if len(words) > 300_000:
                yield from counted()
                words.clear()
        yield from counted()

    return docs.mapInArrow(settled(run), "root int, lot long, part int, codes binary, w binary, n long")


def code_values(spark, sent: DataFrame, depth: int) -> str:
    """The folder of a table by lot of (part, values: log10 probabilities, in their order, of the codes that the lot sent); sent, which it
    deletes: the table of lot_counts."""
    codes = sent.where(F.col("w").isNull())
    size = codes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_CODES)
    path = fresh_path(spark, "lm-roots")
    dealt = codes.select("root", "lot", "part", "codes", F.pmod(F.xxhash64("root"), F.lit(parts)).alias("task"))
    dealt.repartition(parts, "task").sortWithinPartitions("task", "root").write.partitionBy("task").parquet(path)
    release(spark, sent)
    tasks = spark.range(0, parts, 1, parts)

    def held(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for table in own_rows(f"{path}/task={task}", ["root", "lot", "part", "codes"]):
                    yield from forest.roots(table.sort_by("root").to_batches(), depth)

    def up(batches):
        for _, code, n, _ in held(batches):
            key, (a, b, weighted) = forest.Levels(code, n, depth).above()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(weighted)], names=["k", "a", "b", "weighted"])

    top = None
    if depth:  # 65,536 rows at most: of all bytes and decisions
        sums = tasks.mapInArrow(settled(up), "k long, a double, b double, weighted double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("a", "b", "weighted")]).toArrow()
        top = forest.top_levels(*(sums.column(c).to_numpy() for c in ("k", "a", "b", "weighted")), depth)
    above = spark.sparkContext.broadcast(top)

    def down(batches):
        for rows, code, n, place in held(batches):
            value = forest.Levels(code, n, depth).log10(above.value).astype(np.float32)[place]
            ends = np.cumsum([r[3] for r in rows])
            blobs = [forest.packed(value[b - r[3] : b]) for r, b in zip(rows, ends.tolist())]
            for k in range(0, len(rows), 5_000):
                some = rows[k : k + 5_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int32()), pa.array(blobs[k : k + 5_000], pa.binary())], names=["lot", "part", "values"])

    values = fresh_path(spark, "lm-values")
    tasks.mapInArrow(settled(down), "lot long, part int, values binary").repartition(parts, "lot").sortWithinPartitions("lot", "part").write.partitionBy("lot").parquet(values)
    drop(spark, path)
    return values


def own_rows(folder: str, columns: list[str]) -> list[pa.Table]:
    """The rows of a folder of a table that is written by a column, as one table; none if no row has its value."""
    from pyarrow import fs, parquet

    store, path = store_of(folder)
    found = [parquet.read_table(f.path, filesystem=store, columns=columns, partitioning=None) for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    return [pa.concat_tables(found)] if found else []


def drop(spark, uri: str) -> None:
    store, path = store_of(uri)
    store.delete_dir(path)
    release(spark)


def lot_values(path: str, lot: int) -> np.ndarray:
    """The values that code_values gave a lot."""
    tables = own_rows(f"{path}/lot={lot}", ["part", "values"])
    blobs = [x for t in tables for x in t.sort_by("part").column("values").to_pylist()]
    return np.concatenate([forest.unpacked(x, "<f4")[0] for x in blobs]) if blobs else np.zeros(0, np.float32)


def score(docs: DataFrame, *, folds: int = 7, held: int = 2, depth: int = DEPTH, min_share: float | None = None, word_share: float = WORD_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every whole text.

    Null texts are empty (one end token); texts of null ids are in the training fold; repeated rows are scored each;
    an empty table gives no rows.  Without training texts every byte decision has probability one half.  The tree is whole;
    min_share asks for a bounded one.  docs is read twice and must give the same rows in the same partitions.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold("doc_id", folds) == held).alias("held_out"))
    if min_share is None:
        sent = written(lot_counts(docs, depth), "lm-lots")
        counts = written(sent.where(F.col("w").isNotNull()).groupBy("w").agg(F.sum("n").alias("n")), "lm-words")
        release(spark)
        path = code_values(spark, sent, depth)

        def model(lot, data, offsets):
            code = forest.codes(data, offsets, depth)
            return forest.sums(code, lot_values(path, lot), np.cumsum(np.diff(offsets) + 1))
    else:
        counts = written(corpus_counts(docs.where(~F.col("held_out")).select("text"), depth), "lm-counts")
        release(spark)
        tree = spark.sparkContext.broadcast(train_tree(counts, depth=depth, min_share=min_share))
        release(spark)
        model = lambda lot, data, offsets: tree.value.texts(data, offsets)
    words = counts.where(F.col("w").isNotNull()).select("w", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = words.where(F.col("n") >= word_share * n).toArrow()  # at most 1 / word_share
    often = dict(zip(frequent.column("w").to_pylist(), frequent.column("n").to_pylist()))
    often.setdefault(END_TOKEN, 0)
    known = spark.sparkContext.broadcast(often)

    def run(batches):
        get = known.value.get
        for lot, batch in forest.lots(batches, 1, TaskContext.get().partitionId()):
            data, offsets = text_buffers(batch.column(1))
            total = model(lot, data, offsets)
            tokens, base, seen, rare, times = [], [], [], [], []
            ends = get(END_TOKEN)
            for a, b in zip(offsets[:-1], offsets[1:]):
                w = data[a:b].tobytes().translate(LOWER).split()
                c = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
                tokens.append(len(w) + 1)
                base.append(float(np.log10(c + 1.0).sum() + math.log10(ends + 1)))
                seen.append(int((c > 0).sum()) + (ends > 0))
                few: dict[bytes, int] = {}
                for k in np.flatnonzero(c == 0):
                    few[w[k]] = few.get(w[k], 0) + 1
                rare.append(list(few))
                times.append(list(few.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(np.diff(offsets)), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(total), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "n_tokens", "n_bytes", "seen", "base", "score", "rare", "times"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_bytes long, seen long, base double, score double, rare array<binary>, times array<long>"
    scored = written(docs.mapInArrow(settled(run), schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    if min_share is None:
        drop(spark, path)
    few = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("k"))
    # a word that no training text has adds log10(0 + 1) = 0, so an inner join is whole
    found = few.join(words.where(F.col("n") < word_share * n).hint("merge"), "w").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("k").alias("seen_more"))
    out = scored.drop("rare", "times").join(found.hint("shuffle_hash"), "row", "left")
    nothing = F.lit(0).cast("long")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("seen_more", nothing)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), "score",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
