"""The whole context tree, in parts: every context that a text has is a node, and no part of it passes the driver.

A position is a code: the bytes before it, the nearest first, then its own byte.  Codes sorted so have all contexts that
end in the same ROOT bytes together, with everything below them in the tree, so a task that holds such a root has its
subtree whole.  The tree is mixed in two passes over the roots: up, which gives what the few nodes above the roots
need, and down, which gives the probability of every code.

Texts are read in lots.  A lot sends its distinct codes to their roots and gets a value for each back, in the same order.
Contexts that only scored texts have are nodes without counts, which give each decision one half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER, pieces, text_buffers

END = 0xFF  # ends a text and stands before it; it is no byte of UTF-8
ROOT = 2  # bytes of a context that codes are dealt by
LOT_BYTES = 6 << 20  # of texts whose codes are counted, and scored, at once
ROW_CODES = 4096  # in a row that is sent to a root
BLOCK = 1 << 18  # codes that are sorted at once
ROOT_CODES = 400_000  # in roots that are mixed at once, unless one has more
_LOWER = np.frombuffer(LOWER, np.uint8)
_HALF = np.array([math.lgamma(k + 0.5) for k in range(1 << 12)])
_WHOLE = np.array([math.lgamma(k + 1) for k in range(1 << 12)])
_LOG2 = math.log(2)


def stream(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts, each with depth END before and one after; where each text starts)."""
    lengths = np.diff(offsets)
    starts = np.cumsum(lengths) - lengths + np.arange(len(lengths)) * (depth + 1) + depth
    out = np.full(int(lengths.sum()) + len(lengths) * (depth + 1), END, np.uint8)
    for s, a, b in zip(starts, offsets[:-1], offsets[1:]):
        out[s : s + b - a] = _LOWER[data[a:b]]
    return out, starts


def codes(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The code of every byte of the texts and of their ends, in order."""
    text, starts = stream(data, offsets, depth)
    code = np.zeros(len(text) - depth, np.uint64)
    for k in [*range(1, depth + 1), 0]:
        code <<= np.uint64(8)
        code |= text[depth - k : len(text) - k]
    edge = np.zeros(len(text) + 1, np.int8)
    edge[starts] += 1
    edge[starts + np.diff(offsets) + 1] -= 1
    return code[np.cumsum(edge[:-1], dtype=np.int8)[depth:] > 0]


def lots(batches, column: int, partition: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(lot, its rows): the same for the same partition, however often it is read."""
    n, held, size = 0, [], 0

    def whole():
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
            for i, j in pieces(text_buffers(batch.column(column))[1], 2 * LOT_BYTES):
                yield batch.slice(i, j - i)

    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= LOT_BYTES:
            for rows in whole():
                yield (partition << 32) | n, rows
                n += 1
            held, size = [], 0
    for rows in whole() if held else ():
        yield (partition << 32) | n, rows
        n += 1


def packed(*columns: np.ndarray) -> bytes:
    """Numbers of one length, byte by byte, so that what is alike lies together and takes little room."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    n, widths = int.from_bytes(blob[:4], "little"), [np.dtype(t).itemsize for t in types]
    planes, out, at = np.frombuffer(pa.decompress(blob[4:], n * sum(widths), codec="zstd", asbytes=True), np.uint8), [], 0
    for t, width in zip(types, widths):
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(t).reshape(-1))
        at += n * width
    return out


def packed_codes(code: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted codes as the steps between them, and their counts."""
    return packed(np.diff(code, prepend=np.uint64(0)).astype("<u8"), counts.astype("<u4"))


def unpacked_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpacked(blob, "<u8", "<u4")
    return np.cumsum(steps, dtype=np.uint64), counts


def rows_of(code: np.ndarray, depth: int) -> list[tuple[int, int, int]]:
    """(root, first, end) of the rows in which sorted codes are sent: of one root each, ROW_CODES at most."""
    root = (code >> np.uint64(8 * (depth + 1 - min(ROOT, depth)))).astype(np.int64)
    first = np.flatnonzero(np.diff(root, prepend=-1))
    out = []
    for r, a, b in zip(root[first].tolist(), first.tolist(), [*first[1:].tolist(), len(code)]):
        out += [(r, k, min(k + ROW_CODES, b)) for k in range(a, b, ROW_CODES)]
    return out


def distinct(code: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and how many of each are of texts that are learnt from."""
    both = np.sort((code << np.uint64(1)) | learnt.astype(np.uint64))
    known = (both & np.uint64(1)).astype(np.int64)
    both >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    return both[first], np.add.reduceat(known, first) if len(first) else known


def _runs(x: np.ndarray) -> np.ndarray:
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _log_gamma(x: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(x, 4095).astype(np.int64)]
    big = np.flatnonzero(x > 4095)
    if len(big):  # Stirling's series
        y = x[big] + plus
        out[big] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov, of a zeros and b ones."""
    return _log_gamma(a, _HALF, 0.5) + _log_gamma(b, _HALF, 0.5) - _log_gamma(a + b, _WHOLE, 1.0) - math.log(math.pi)


def mixed_with(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted probability, its share of a node's own estimate), in logs but for the share."""
    apart = below - own
    e = np.exp(-np.abs(apart))
    return np.maximum(own, below) + np.log1p(e) - _LOG2, np.where(apart > 0, e, 1.0) / (1 + e)


class Levels:
    """Whole subtrees below roots: cells (context, byte) of every depth, from sorted distinct codes and their counts."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.root = depth, min(ROOT, depth)
        cells, n, self.cells, self.n, self.up = code.astype(np.int64), n.astype(np.float64), [], [], []
        for d in range(depth, self.root - 1, -1):
            self.cells.append(cells)
            self.n.append(n)
            if d > self.root:
                shorter = (cells >> 16 << 8) | (cells & 255)
                order = np.argsort(shorter, kind="stable")
                new = _runs(shorter[order])
                up = np.empty(len(cells), np.int32)
                up[order] = np.cumsum(new) - 1
                self.up.append(up)
                first = np.flatnonzero(new)
                cells, n = shorter[order][first], np.add.reduceat(n[order], first)

    def decisions(self, bit: int):
        """Level by level from the deepest: (first cell, place of each cell, zeros, ones, place in the level above) of the
        decisions after the first bits of a byte."""
        out = []
        for cells, n in zip(self.cells, self.n):
            new = _runs(cells >> (8 - bit))
            first = np.flatnonzero(new)
            total, ones = np.add.reduceat(n, first), np.add.reduceat(n * (cells >> (7 - bit) & 1), first)
            out.append([first, (np.cumsum(new) - 1).astype(np.int32), total - ones, ones, None])
        for k, up in enumerate(self.up):
            out[k][4] = out[k + 1][1][up[out[k][0]]]
        return out

    def mixed(self, bit: int):
        """(decisions, weighted, share of the own estimate) of each level, from the deepest."""
        levels, weighted, stop = self.decisions(bit), [], []
        for k, (_, _, a, b, _) in enumerate(levels):
            own = log_estimate(a, b)
            if k == 0:
                weighted.append(own)
                stop.append(np.ones(len(own)))
            else:
                w, s = mixed_with(own, np.bincount(levels[k - 1][4], weighted[-1], len(own)))
                weighted.append(w)
                stop.append(s)
        return levels, weighted, stop

    def above(self) -> tuple[np.ndarray, np.ndarray]:
        """(context one byte shorter than the roots << 8 | decision, [zeros, ones, weighted of the roots])."""
        keys, values = [], []
        for bit in range(8):
            levels, weighted, _ = self.mixed(bit)
            first, _, a, b, _ = levels[-1]
            key, at = np.unique(self._above(bit, first), return_inverse=True)
            keys.append(key)
            values.append(np.stack([np.bincount(at, x, len(key)) for x in (a, b, weighted[-1])]))
        return np.concatenate(keys), np.concatenate(values, axis=1)

    def _above(self, bit: int, first: np.ndarray) -> np.ndarray:
        cell = self.cells[-1][first]
        return (cell >> 16 << 8) | (1 << bit) | ((cell & 255) >> (8 - bit))

    def log10(self, top: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """log10 probability of each code's byte in its context; top: (mixed, left) of the nodes above the roots."""
        total = np.zeros(len(self.cells[0]))
        for bit in range(8):
            levels, _, stop = self.mixed(bit)
            if top is None:
                mixed, left = np.zeros(len(levels[-1][0])), np.ones(len(levels[-1][0]))
            else:
                at = self._above(bit, levels[-1][0])
                mixed, left = top[0][at], top[1][at]
            for k in range(len(levels) - 1, -1, -1):
                _, _, a, b, _ = levels[k]
                mixed = mixed + left * stop[k] * ((b + 0.5) / (a + b + 1))
                left = left * (1 - stop[k])
                if k:
                    mixed, left = mixed[levels[k - 1][4]], left[levels[k - 1][4]]
            one = np.clip(mixed, 1e-12, 1 - 1e-12)[levels[0][1]]
            total += np.log(np.where(self.cells[0] >> (7 - bit) & 1, one, 1 - one))
        return total / math.log(10)


def top_levels(key: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(mixed, left) of the decisions of all contexts one byte shorter than a root, from sums over the roots."""
    length = min(ROOT, depth) - 1
    if length < 0:
        return None
    size = 256 ** (length + 1)
    levels = [[np.bincount(key, x, size) for x in (a, b, below)]]
    shares = []
    for d in range(length, -1, -1):
        zeros, ones, under = levels[-1]
        weighted, stop = mixed_with(log_estimate(zeros, ones), under)
        shares.append((stop, (ones + 0.5) / (zeros + ones + 1)))
        if d:  # the contexts less their farthest byte
            at = np.arange(len(zeros)) >> 16 << 8 | np.arange(len(zeros)) & 255
            levels.append([np.bincount(at, x, len(zeros) // 256) for x in (zeros, ones, weighted)])
    mixed, left = np.zeros(256), np.ones(256)
    for d, (stop, one) in enumerate(reversed(shares)):
        if d:
            at = np.arange(256 ** (d + 1)) >> 16 << 8 | np.arange(256 ** (d + 1)) & 255
            mixed, left = mixed[at], left[at]
        mixed, left = mixed + left * stop * one, left * (1 - stop)
    return mixed, left


def roots(batches, depth: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, codes, counts, place of each row's codes among them) of whole roots, from rows (root, lot, part, codes) by root."""
    held, size, last = [], 0, None

    def whole():
        both = [unpacked_codes(x[3]) for x in held]
        code, n = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        new = _runs(code[order])
        place = np.empty(len(code), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return [(*x[:3], len(y[0])) for x, y in zip(held, both)], code[order][first], np.add.reduceat(n[order], first), place

    for batch in batches:
        for root, lot, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if root != last and size >= ROOT_CODES:
                yield whole()
                held, size = [], 0
            held.append((root, lot, part, blob))
            size += int.from_bytes(blob[:4], "little")
            last = root
    if held:
        yield whole()


def sums(code: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values of codes up to each end; values: of the sorted distinct codes."""
    blocks = []
    for k in range(0, len(code), BLOCK):  # small enough for a cache
        part = code[k : k + BLOCK]
        order = np.argsort(part)
        part = part[order]
        new = _runs(part)
        blocks.append((k, order.astype(np.int32), np.cumsum(new, dtype=np.int32) - 1, part[new]))
    known = np.sort(np.concatenate([b[3] for b in blocks]))
    known = known[_runs(known)]
    if len(known) != len(values):
        raise ValueError("texts have changed since their contexts were counted")
    each = np.empty(len(code), np.float32)
    for k, order, place, some in blocks:
        each[k : k + len(order)][order] = values[np.searchsorted(known, some)][place]
    return np.diff(np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)[ends - 1]]))
