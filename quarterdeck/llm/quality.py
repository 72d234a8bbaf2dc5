"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, one feature (then one pair) at a time, on the residual of the logistic loss; the
sum of a feature's trees is a lookup table over its bins, a pair's a table over two coarser bins.  A document's
logit is an intercept plus its bins' entries: vectorised additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import label_sample, settled, text_buffers

FEATURES = ("log_words", "mean_word", "symbols", "upper", "digits", "marks", "distinct_words", "top_word", "dup_lines", "dup_line_bytes", "line_words", "repeat_steps", "bars", "bangs", "punct_ends", "high_bytes")
#: Labelled rows that the model is fitted on, at most about this many (a hash of the id picks them).
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6

_CLASS = np.zeros((256, 6), np.float32)  # upper, digit, mark, symbol, bar, bang
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (65 <= _b <= 90, 48 <= _b <= 57, _b < 128 and not _c.isalnum() and _b > 32, _c in "#*$%&|<>", _c == "|", _c == "!")


def features(text: bytes) -> list[float]:
    """The 16 statistics of one whole text; an empty text has zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen, dup, dup_bytes = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_bytes += len(x)
        seen.add(x)
    steps = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(1 for x in lines if x.rstrip()[-1:] in b".!?:")
    bars, high = shares[4], float((np.frombuffer(text, np.uint8) >= 128).mean())
    return [np.log1p(n), (size - n) / n, shares[3], shares[0], shares[1], shares[2], len(counts) / n, max(counts.values()) / n, dup / len(lines), dup_bytes / size, np.log1p(n / len(lines)), steps / n, bars, shares[5], ends / len(lines), high]


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]  # per feature, inner bin edges
    tables: np.ndarray  # (features, bins)
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # (pairs, PAIR_BINS, PAIR_BINS)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        return bins * PAIR_BINS // BINS

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = self.intercept + self.tables[np.arange(b.shape[1]), b].sum(axis=1)
        c = self.coarse(b)
        for k, (i, j) in enumerate(self.pairs):
            out += self.pair_tables[k, c[:, i], c[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf value of each bin: a tree of given depth over ordered bins, from sums of gradient and hessian a bin."""
    if depth == 0 or len(grad) < 2:
        return np.full(len(grad), grad.sum() / (hess.sum() + ridge))
    g, h = np.cumsum(grad), np.cumsum(hess)
    gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
    k = int(np.argmax(gain)) + 1
    return np.concatenate([_tree(grad[:k], hess[:k], depth - 1, ridge), _tree(grad[k:], hess[k:], depth - 1, ridge)])


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, pair_rounds: int = 30, rate: float = 0.15, depth: int = 2, ridge: float = 4.0) -> AdditiveModel:
    """Fit on labelled statistics; without rows of both labels the model is the smoothed label rate."""
    n, d = x.shape
    mean = (y.sum() + 1) / (n + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    model = AdditiveModel(float(np.log(mean / (1 - mean))), edges, np.zeros((d, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if n == 0 or y.min() == y.max():
        return model
    bins = model.bins(x)
    f = np.full(n, model.intercept)

    def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(rounds):  # cyclic: each feature in turn, so that no feature takes another's part
        for j in range(d):
            step = rate * _tree(*sums(bins[:, j], BINS), depth, ridge)
            model.tables[j] += step
            f += step[bins[:, j]]
    coarse = model.coarse(bins)
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            g, h = sums(coarse[:, i] * PAIR_BINS + coarse[:, j], PAIR_BINS**2)
            gains.append(((g**2 / (h + ridge)).sum(), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = (s.reshape(PAIR_BINS, PAIR_BINS) for s in sums(coarse[:, i] * PAIR_BINS + coarse[:, j], PAIR_BINS**2))
            rows = _tree(g.sum(axis=1), h.sum(axis=1), 1, ridge)  # one cut of the first feature, then of the second
            cut = int(np.argmax(rows != rows[0])) or PAIR_BINS // 2
            step = rate * np.stack([_tree(g[:cut].sum(axis=0), h[:cut].sum(axis=0), 1, ridge)] * cut + [_tree(g[cut:].sum(axis=0), h[cut:].sum(axis=0), 1, ridge)] * (PAIR_BINS - cut))
            model.pair_tables[k] += step
            f += step[coarse[:, i], coarse[:, j]]
    return model


def document_features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns + gam (array<float>): the statistics of each whole text."""
    schema = docs.select(*keep).schema.add("gam", T.ArrayType(T.FloatType()))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(keep)))
            rows = [features(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            flat = pa.array(np.array(rows, np.float32).reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(settled(run), schema)


def train(docs: DataFrame, labels_df: DataFrame, *, folds: int = 4, held: int = 2, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fit on labelled documents outside the held fold: a bounded sample that a hash of the id picks."""
    known = label_sample(labels_df, "quality", folds, held, fit_rows)
    found = document_features(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "doc_id", "label")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("gam", "label")).alias("r")).select("r.*").collect()  # at most about fit_rows
    x = np.array([r["gam"] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    order = np.lexsort(np.column_stack([x, [r["label"] for r in rows]]).T) if rows else []
    return fit(x[order], np.array([r["label"] for r in rows], float)[order] if rows else np.zeros(0))


def classify(docs: DataFrame, model: AdditiveModel, *, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """keep columns + score and predicted; null and empty texts are scored as texts without words.

    Repeated rows are scored each; an empty table gives no rows.  names must not clash with keep.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    text_at = columns.index("text")
    fields = docs.select(*keep).schema.names
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            x = np.array([features(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], np.float32).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*fields, *names])

    return docs.select(*columns).mapInArrow(settled(run), schema)
