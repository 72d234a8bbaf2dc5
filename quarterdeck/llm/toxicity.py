"""Toxicity: a logistic classifier with counterfactual regularisation.

Terms (whole words and their first 4, 5 and 6 bytes) are chosen by their counts in labelled texts.  For each labelled
text that names a group, every other name of that kind is put in its place, and the squared change of the logit is
added to the loss.  So a group's name alone can't move a score, and neutral mentions aren't taken for abuse.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import label_sample, settled, text_buffers

#: Names that may stand for each other; the caller can give others.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic", "old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
FIT_ROWS = 20_000
MAX_TERMS = 8192
PREFIXES = (4, 5, 6)
#: ASCII marks part words; A-Z become lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def terms(words: set[bytes]) -> set[bytes]:
    """Distinct words, and prefixes of longer words marked by a trailing star."""
    out = set(words)
    for k in PREFIXES:
        out.update([w[:k] + b"*" for w in words if len(w) > k])
    return out


def counterfactuals(words: set[bytes], other: dict[bytes, list[bytes]]) -> list[set[bytes]]:
    """The words with each identity term in turn replaced by each other one of its kind."""
    return [(words - {t}) | {u} for t in sorted(words & other.keys()) for u in other[t]]


def _change(own: list[int], other: list[int]) -> list[list[int]]:
    """Terms that a counterfactual loses, and those it gains."""
    return [sorted(set(own) - set(other)), sorted(set(other) - set(own))]


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    intercept: float

    def logit(self, text: bytes) -> float:
        words = words_of(text)
        get = self.weights.get
        total = self.intercept + sum(map(get, words & self.weights.keys()))
        for k in PREFIXES:
            total += sum(map(get, {w[:k] + b"*" for w in words if len(w) > k} & self.weights.keys()))
        return total


def fit(rows: list[list[int]], y: np.ndarray, n_terms: int, swaps: list[tuple[list[int], list[int]]], *, ridge: float = 0.3, penalty: float = 1.0, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + ridge + penalty * mean squared logit change over swaps, by Adam.

    rows: term numbers of each text.  swaps: terms that a counterfactual text loses and gains.
    """
    w, b = np.zeros(n_terms), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return w, b
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    at = np.array([k for k, (lost, gained) in enumerate(swaps) for _ in (*lost, *gained)], np.int64)
    term = np.array([c for lost, gained in swaps for c in (*lost, *gained)], np.int64)
    sign = np.array([s for lost, gained in swaps for s in [1.0] * len(lost) + [-1.0] * len(gained)])
    m, v, mb, vb, n = np.zeros(n_terms), np.zeros(n_terms), 0.0, 0.0, len(y)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], n), -30, 30)))
        g, gb = np.bincount(col, (p - y)[row], n_terms) / n + ridge * w / n, float((p - y).mean())
        if len(term):
            change = np.bincount(at, sign * w[term], len(swaps))
            g += np.bincount(term, 2 * penalty / len(swaps) * change[at] * sign, n_terms)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


def train(docs: DataFrame, labels_df: DataFrame, *, folds: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, max_terms: int = MAX_TERMS, min_docs: int = 4, identity=IDENTITY_TERMS, penalty: float = 1.0) -> ToxicityModel:
    """Fit on at most about fit_rows labelled documents outside the held fold; without any, all score the label rate."""
    known = label_sample(labels_df, "toxic", folds, held, fit_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def count(batches):
        tally: dict[bytes, list[int]] = {}
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, y in enumerate(batch.column(2).to_pylist()):
                for t in terms(words_of(data[offsets[i] : offsets[i + 1]].tobytes())):
                    tally.setdefault(t, [0, 0])[1 if y else 0] += 1
        keys = list(tally)
        yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.binary()), "n0": pa.array([tally[k][0] for k in keys], pa.int64()), "n1": pa.array([tally[k][1] for k in keys], pa.int64())})

    size = known.groupBy("label").count().collect()
    n1 = sum(r["count"] for r in size if r["label"])
    n0 = sum(r["count"] for r in size) - n1
    counts = texts.mapInArrow(settled(count), "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lift = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    chosen = counts.where((F.col("n1") >= min_docs) & (lift > 1.5)).withColumn("rank", lift * F.sqrt(F.col("n1").cast("double"))).orderBy(F.desc("rank"), "term").limit(max_terms).collect()
    other = {t.encode(): [u.encode() for u in kind if u != t] for kind in identity for t in kind}
    names = [bytes(r["term"]) for r in chosen]
    names += sorted(terms(set(other)) - set(names))
    place = {t: i for i, t in enumerate(names)}
    numbers = lambda words: sorted(place[t] for t in terms(words) & place.keys())

    def found(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            words = [words_of(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            hits = [numbers(w) for w in words]
            swapped = [[_change(h, numbers(c)) for c in counterfactuals(w, other)] for w, h in zip(words, hits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.list_(pa.int32()))))], names=["doc_id", "label", "hits", "swapped"])

    numbered = T.ArrayType(T.IntegerType())
    schema = T.StructType([texts.schema["doc_id"], texts.schema["label"], T.StructField("hits", numbered), T.StructField("swapped", T.ArrayType(T.ArrayType(numbered)))])
    rows = texts.mapInArrow(settled(found), schema).groupBy("doc_id").agg(F.min(F.struct("label", "hits", "swapped")).alias("r")).orderBy("doc_id").select("r.*").collect()  # at most about fit_rows
    hits, y = [list(r["hits"]) for r in rows], np.array([r["label"] for r in rows], float)
    swaps = [(list(lost), list(gained)) for r in rows for lost, gained in r["swapped"]]
    w, b = fit(hits, y, len(names), swaps, penalty=penalty)
    return ToxicityModel({t: float(w[i]) for t, i in place.items() if w[i] != 0}, b)


def classify(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every whole text; null and empty texts get the intercept's score.

    Repeated rows and null ids are scored each; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            logits = np.array([model.logit(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], float)
            score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(settled(run), schema)
