"""Detection of periodic runs of words: tiles scaled to the period, solved alone, stitched by document and period.

A run is a stretch of words that no neighbour extends with its smallest period q kept, at least MIN_POWER periods
and MIN_LENGTH words long.  Octave P holds the periods from P to 2P - 1.  Its tiles lie around boundaries at the
multiples of P and reach BEFORE * P words back and AFTER * P ahead, so that neighbours overlap by more than a period and the tiles of
all octaves together hold the text about (BEFORE + AFTER) * log2(n) times, whatever it repeats.

A tile is solved by Z-values at its boundary b: how far the words from b on, and those before b, equal the words q places on.
A run of period q holds a boundary whose first P words recur at b + q, so only such q are looked at; names of
stretches of P words (doubled from octave to octave) find them, and what they find is measured on the words themselves.  Where
the first P words recur three times or more, they have a period d below P themselves and their places are d apart; then
only the two q that bring the ends of the stretch of period d to one another can go on beyond it.

Each tile gives fragments (document, period, start, end).  Those of a task are joined before they are shuffled by document
and period, where fragments that overlap by a period become one.  Documents of over TILE words are dealt out as rows of
tiles to all tasks; the tiles of others are solved where the text is read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, pieces, release, settled, text_buffers, written

MIN_POWER, MIN_LENGTH = 4, 6
#: Reach of a tile around its boundary, in units of P.
BEFORE, AFTER = 3, 5
#: Words of a tile row; texts of more words are dealt out.
TILE = 1 << 16
#: Cells that a vectorised comparison holds at once.
_CELLS = 1 << 20
#: Bytes of a text whose words are split at once.
_BYTES = 1 << 20
_SPACE = (32, 9, 10, 11, 12, 13)

_FRAGMENTS = "array<struct<q:long,s:long,e:long>>"


def words_of(text: bytes):
    """The words of a text, split a stretch of about _BYTES at a time."""
    at = 0
    while at < len(text):
        end = min(at + _BYTES, len(text))
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield from text[at:end].split()
        at = end


class Pieces:
    """Stretches of word numbers laid one after the other: whole documents or tile rows.

    low, high: where each piece stands in x; first: its first word's number; own, end: the boundaries it is asked for lie
    from word own up to end; octaves: (least, largest) exponent of P.
    """

    def __init__(self, x, low, high, first, own, end, octaves, total):
        self.x, self.low, self.high, self.first = x, low, high, first
        self.own, self.end, self.octaves, self.total = own, end, octaves, total

    def boundaries(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, piece) of all boundaries of octave 2**k: multiples of P before whose two blocks the text doesn't end."""
        p = 1 << k
        last = np.minimum(self.end, self.total - 2 * p + 1)  # room for the block at b and the next
        begin = -(-self.own // p)
        n = np.maximum(-(-last // p) - begin, 0)
        n[(self.octaves[:, 0] > k) | (self.octaves[:, 1] < k) | (self.total < MIN_POWER * p)] = 0
        piece = np.repeat(np.arange(len(n)), n)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (begin[piece] + turn) * p - self.first[piece] + self.low[piece], piece


def _reach(x: np.ndarray, at: np.ndarray, shift: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from at on (step 1; those before at: step -1) equal those shift places on, at most room."""
    out = np.zeros(len(at), np.int64)
    width = int(max(room.max(initial=0), 0)) + 1
    many = max(1, _CELLS // width)
    for k in range(0, len(at), many):
        part = slice(k, k + many)
        go = np.arange(width)
        i = at[part, None] + (go if step > 0 else -1 - go)
        inside = go < room[part, None]
        i = np.where(inside, i, 0)
        same = inside & (x[i] == x[np.where(inside, i + shift[part, None], 0)])
        out[part] = same.argmin(1)
    return out


def _candidates(x, names, b, low, high, p: int):
    """(row of b, q): periods from p to 2p - 1 at which the block of p words from b recurs and may go on."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blocks = sliding_window_view(names, p)
    rows, shifts = [], []
    many = max(1, _CELLS // p)
    for k in range(0, len(b), many):
        at = b[k : k + many]
        full = at + 2 * p <= len(names)
        hit_row, hit = np.nonzero(blocks[np.where(full, at + p, 0)] == names[at, None]) if p <= len(names) else (np.zeros(0, np.int64),) * 2
        keep = full[hit_row]
        rest = np.flatnonzero(~full)
        more = [(r, names[at[r] + p :] == names[at[r]]) for r in rest]
        rows += [hit_row[keep] + k, *[np.full(int(m.sum()), r + k) for r, m in more]]
        shifts += [hit[keep] + p, *[np.flatnonzero(m) + p for _, m in more]]
    row, q = np.concatenate(rows).astype(np.int64), np.concatenate(shifts).astype(np.int64)
    inside = b[row] + q + p <= high[row]  # a name may reach into the next piece
    row, q = row[inside], q[inside]
    order = np.lexsort((q, row))
    row, q = row[order], q[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(np.append(first, len(row)))
    few = np.repeat(n <= 2, n)
    out_row, out_q = [row[few]], [q[few]]
    many_at = first[n > 2]
    if len(many_at):
        r, q1, d = row[many_at], q[many_at], q[many_at + 1] - q[many_at]
        here, there, far = b[r], b[r] + q1, b[r] + q[many_at + n[n > 2] - 1]
        to_end, to_start = high[r], low[r]
        end = here + _reach(x, here, d, to_end - here - d, 1)
        end2 = far + _reach(x, far, d, to_end - far - d, 1)
        start = here - _reach(x, here, d, here - to_start, -1)
        start2 = there - _reach(x, there, d, there - to_start, -1)
        for q0 in (end2 - end, start2 - start):
            ok = (q0 >= p) & (q0 < 2 * p)
            out_row.append(r[ok])
            out_q.append(q0[ok])
    return np.concatenate(out_row), np.concatenate(out_q)


def _primes(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] * (q > 1)


def _has_part(x: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the stretch of period q from s on has a smaller period, which then divides q: another octave's tiles give it."""
    out = np.zeros(len(q), bool)
    for one in np.unique(q).tolist():
        at = np.flatnonzero(q == one)
        for r in _primes(one):
            at = at[~out[at]]
            out[at] = _reach(x, s[at], np.full(len(at), one // r), np.full(len(at), one), 1) == one
    return out


def fragments(work: Pieces) -> np.ndarray:
    """Rows (piece, q, s, e) of periodic stretches of all tiles of the pieces, joined where a piece's overlap by q; s and e
    are word numbers of the document."""
    x, found = work.x, []
    names = mix64(x.astype(np.uint64))
    for k in range(int(work.octaves[:, 1].max(initial=-1)) + 1):
        p = 1 << k
        b, piece = work.boundaries(k)
        low = np.maximum(work.low[piece], b - BEFORE * p)
        high = np.minimum(work.high[piece], b + AFTER * p)
        row, q = _candidates(x, names, b, low, high, p)
        if len(row):
            at = b[row]
            e = at + q + _reach(x, at, q, high[row] - at - q, 1)
            s = at - _reach(x, at, q, at - low[row], -1)
            long = 2 * (e - s) >= 5 * q  # a tile shows at least so much of a run
            long[long] = ~_has_part(x, s[long], q[long])
            move = (work.first - work.low)[piece[row]]
            found.append(np.stack([piece[row], q, s + move, e + move], axis=1)[long])
        if 2 * p <= len(names):
            names = mix64(names[:-p] * np.uint64(3) + names[p:])
    return joined(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def joined(rows: np.ndarray) -> np.ndarray:
    """Rows (piece, q, s, e) with those of a piece and q that overlap by q or more made one."""
    rows = np.unique(rows, axis=0)
    if not len(rows):
        return rows
    new = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
    group = np.concatenate([[0], np.cumsum(new)])
    reach = int(rows[:, 3].max()) + 1
    top = np.maximum.accumulate(rows[:, 3] + group * reach) - group * reach  # largest end so far in the group
    cut = np.concatenate([[True], new | (rows[1:, 2] > top[:-1] - rows[1:, 1])])
    at = np.flatnonzero(cut)
    out = rows[at].copy()
    out[:, 3] = np.maximum.reduceat(rows[:, 3], at)
    return out


def _octaves(n: np.ndarray) -> np.ndarray:
    """The largest exponent k with MIN_POWER * 2**k <= n; -1 for short texts."""
    out = np.full(len(n), -1, np.int64)
    for k in range(62):
        out[n >= MIN_POWER << k] = k
    out[n < MIN_LENGTH] = -1
    return out


def _digest(runs: list[tuple[int, int, int]], words: list[bytes]) -> tuple:
    """The digest columns of a document: runs are (start, length, period) by start, then period."""
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            drop[s + q] += 1
            drop[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    kept = hashlib.sha256(b" ".join(words)).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *shown, listed, kept


_DIGEST = [T.StructField("n_runs", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")], T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]


def _numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, words of each text)."""
    table: defaultdict = defaultdict(count().__next__)
    each = [np.fromiter(map(table.__getitem__, words_of(t)), np.int32) for t in texts]
    return np.concatenate(each) if each else np.zeros(0, np.int32), np.array([len(e) for e in each], np.int64)


def _read(docs: DataFrame, tile: int) -> DataFrame:
    """row, doc_id, n_words, text, fragments, and the digest of a text that surely has no run; text is null for those."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in pieces(offsets):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                x, n = _numbers(texts)
                high = np.cumsum(n)
                top = np.where(n > tile, -1, _octaves(n))
                zero = np.zeros(len(n), np.int64)
                got = fragments(Pieces(x, high - n, high, zero, zero, n, np.stack([zero, top], axis=1), n))
                by: dict[int, list] = defaultdict(list)
                for piece, q, s, e in got.tolist():
                    by[piece].append({"q": q, "s": s, "e": e})
                keep = [k in by or n[k] > tile for k in range(len(texts))]
                done = [(None,) * 7 if keep[k] else _digest([], list(words_of(t))) for k, t in enumerate(texts)]
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array([t if k else None for t, k in zip(texts, keep, strict=True)], pa.binary())]
                columns.append(pa.array([by.get(k) for k in range(len(texts))], pa.list_(pa.struct([(c, pa.int64()) for c in "qse"]))))
                columns += [pa.array([d[c] for d in done], pa.int64() if c < 5 else pa.string()) for c in range(7)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "text", "fragments", *[f.name for f in _DIGEST]])

    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("fragments", T._parse_datatype_string(_FRAGMENTS)), *_DIGEST])
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(settled(run), schema)


def tiles(n: int, tile: int = TILE) -> list[tuple[int, int, int, int]]:
    """(least octave, largest octave, first boundary, end of the boundaries) of the tile rows of n words: octaves whose
    reach is small beside a row share rows of tile words; each larger one has rows that grow with its period."""
    out, top, k = [], int(_octaves(np.array([n]))[0]), 0
    while k <= top:
        last = max(k, min(top, max(0, (tile // (4 * (BEFORE + AFTER))).bit_length() - 1)))
        core = max(tile, 4 * (BEFORE + AFTER) << last)
        out += [(k, last, a, min(a + core, n)) for a in range(0, n, core)]
        k = last + 1
    return out


def _tile_rows(long_docs: DataFrame, tile: int) -> DataFrame:
    """Rows (row, total, least, largest, own, end, first, words) of the tiles of long texts."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, n = _numbers([batch.column(1)[k].as_py()])
                for least, largest, own, end in tiles(int(n[0]), tile):
                    first, stop = max(0, own - (BEFORE << largest)), min(int(n[0]), end + (AFTER << largest))
                    yield pa.RecordBatch.from_pydict({"row": [batch.column(0)[k].as_py()], "total": n, "least": [least], "largest": [largest], "own": [own], "end": [end], "first": [first], "words": [x[first:stop].astype("<i4").tobytes()]})

    return long_docs.select("row", "text").mapInArrow(settled(run), "row long, total long, least long, largest long, own long, end long, first long, words binary")


def _solved(rows: DataFrame) -> DataFrame:
    """(row, q, s, e): the fragments of tile rows, which are dealt out by row and place."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row, total, least, largest, own, end, first, words = (c[k].as_py() for c in batch.columns)
                x = np.frombuffer(words, "<i4")
                one = lambda v: np.array([v], np.int64)
                got = fragments(Pieces(x, one(0), one(len(x)), one(first), one(own), one(end), np.array([[least, largest]]), one(total)))
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(got), row)), **{c: pa.array(got[:, i]) for i, c in enumerate("qse", 1)}})

    return rows.repartition("row", "least", "own").mapInArrow(settled(run), "row long, q long, s long, e long")


def stitched(parts: DataFrame, *, power: int = MIN_POWER, least: int = MIN_LENGTH) -> DataFrame:
    """(row, start, length, period): the runs that fragments (row, q, s, e) of tiles belong to.

    Fragments of a document and period that overlap by a period are one; a stretch counts with its smallest period.
    """
    order = Window.partitionBy("row", "q").orderBy("s", "e")
    top = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = parts.withColumn("new", F.when(top.isNull() | (F.col("s") > top - F.col("q")), 1).otherwise(0))
    runs = cut.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "q", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    size = F.col("e") - F.col("s")
    whole = runs.where((size >= least) & (size >= power * F.col("q")))
    return whole.groupBy("row", "s", "e").agg(F.min("q").alias("period")).select("row", F.col("s").alias("start"), size.alias("length"), "period")


def _digested(texts: DataFrame, doc_id: T.StructField) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                runs = sorted((r["start"], r["length"], r["period"]) for r in batch.column(3)[k].as_py() or [])
                out.append(_digest([(s, n, q) for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))], list(words_of(batch.column(2)[k].as_py()))))
            columns = [pa.array([d[c] for d in out], pa.int64() if c < 5 else pa.string()) for c in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_words", *[f.name for f in _DIGEST]])

    schema = T.StructType([doc_id, T.StructField("n_words", T.LongType()), *_DIGEST])
    return texts.select("doc_id", "n_words", "text", "runs").mapInArrow(settled(run), schema)


def periodic_runs(docs: DataFrame, *, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(texts, runs) of documents.

    texts: row, doc_id, n_words, text, digest columns, a row a document; the digest is null where text isn't, for then the
    document may have runs.  runs: row, start, length, period of every run.  Null and empty texts have no words and no
    runs; repeated rows are rows of their own; ids may be null or repeat, as rows are numbered; a text of any length is
    taken whole.  Other columns of docs are ignored; an empty table gives no rows.
    """
    texts = written(_read(docs, tile), "runs-texts")
    near = texts.where(F.col("fragments").isNotNull()).select("row", F.explode("fragments").alias("f")).select("row", "f.q", "f.s", "f.e")
    far = _solved(_tile_rows(texts.where(F.col("n_words") > tile), tile))
    return texts, stitched(near.unionByName(far))


def run_digests(docs: DataFrame, *, tile: int = TILE) -> DataFrame:
    """doc_id, n_words, n_runs, the run of the greatest length / period (start, length, period, exponent_milli), and the hashes
    runs_sha256 and collapsed_sha256, one row a document; as for periodic_runs otherwise."""
    texts, runs = periodic_runs(docs, tile=tile)
    of = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    open_texts = texts.where(F.col("text").isNotNull()).select("row", "doc_id", "n_words", "text")
    later = _digested(open_texts.hint("merge").join(of.hint("merge"), "row", "left"), docs.schema["doc_id"])
    done = texts.where(F.col("text").isNull()).select("doc_id", "n_words", *[f.name for f in _DIGEST])
    return done.unionByName(later)
