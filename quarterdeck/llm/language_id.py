"""Language ID: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on short windows of labelled texts; every position of a text is
labelled from the states of both directions, and a document's probability is the mean over its positions.  A long text
is many lanes of one step-by-step pass: a lane labels WINDOW bytes, and each direction first reads the WARM bytes
before it, so that its states are carried over the lanes' bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, pieces, settled, text_buffers

HIDDEN = 8
WINDOW, WARM = 512, 48
#: Labelled documents a language that the network is trained on, about.
FIT_DOCS = 1500
TRAIN_BYTES, BATCH, STEPS, RATE = 64, 256, 260, 0.02


@dataclass
class Direction:
    table: np.ndarray  # (256, 3 hidden): a byte's input to the gates z, r and the candidate n, halved for z and r
    state: np.ndarray  # (hidden, 3 hidden), likewise

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next states; x: bytes, h: (lanes, hidden)."""
        k = h.shape[1]
        a = self.table[x]
        u = h @ self.state
        gates = a[:, : 2 * k]
        gates += u[:, : 2 * k]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5  # sigmoid of the doubled argument
        n = u[:, 2 * k :] * gates[:, k:]
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        h = h - n
        h *= gates[:, :k]
        h += n
        return h


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (2 hidden, languages)
    bias: np.ndarray

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, languages): the mean over positions of the probabilities; rows of empty texts are zero."""
        n, k = len(offsets) - 1, len(self.languages)
        total = np.zeros((n, k))
        for i, j in pieces(offsets, 1 << 20):
            lengths = np.diff(offsets[i : j + 1])
            lanes = -(-lengths // WINDOW)
            owner = np.repeat(np.arange(j - i), lanes)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            first = offsets[i:j][owner] + within * WINDOW
            size = np.minimum(WINDOW, offsets[i + 1 : j + 1][owner] - first)
            order = np.argsort(-size, kind="stable")
            before = np.where(within > 0, WARM, 0)
            after = np.minimum(WARM, offsets[i + 1 : j + 1][owner] - first - size)
            for part in np.array_split(order, max(1, -(-len(order) // 2048))):
                if len(part):
                    sums = self._lanes(data, first[part], size[part], before[part], after[part])
                    np.add.at(total, i + owner[part], sums)
        return total / np.maximum(np.diff(offsets), 1)[:, None]

    def _warm(self, d: Direction, data: np.ndarray, start: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
        """States after n bytes from start on, by lane; lanes with fewer bytes begin later."""
        h = np.zeros((len(n), d.state.shape[0]), np.float32)
        most = int(n.max(initial=0))
        for t in range(most):
            on = np.flatnonzero(n >= most - t)
            h[on] = d.step(data[start[on] + step * (t - most + n[on])], h[on])
        return h

    def _lanes(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Sums of position probabilities; lanes are ordered by falling size."""
        steps, lanes, hidden = int(size[0]), len(size), self.forward.state.shape[0]
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes longer than t
        logits = np.empty((steps, lanes, len(self.languages)), np.float32)
        h = self._warm(self.forward, data, first - before, before, 1)
        for t in range(steps):
            a = active[t]
            h = self.forward.step(data[first[:a] + t], h[:a])
            logits[t, :a] = h @ self.out[:hidden]
        sums = np.zeros((lanes, len(self.languages)), np.float32)
        begin = self._warm(self.backward, data, first + size + after - 1, after, -1)
        h = begin[:0]
        for t in range(steps - 1, -1, -1):
            a = active[t]
            if a > len(h):
                h = np.concatenate([h, begin[len(h) : a]])
            h = self.backward.step(data[first[:a] + t], h)
            p = logits[t, :a]
            p += h @ self.out[hidden:]
            p += self.bias
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            sums[:a] += p / p.sum(axis=1, keepdims=True)
        return sums


def _run(d: Direction, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step of x (steps, lanes), and what backpropagation needs."""
    k, lanes = d.state.shape[0], x.shape[1]
    h, states, kept = np.zeros((lanes, k), np.float32), [], []
    for t in range(len(x)):
        a, u = d.table[x[t]], h @ d.state
        gates = 0.5 * (1 + np.tanh(a[:, : 2 * k] + u[:, : 2 * k]))
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
        kept.append((h, z, r, n, u[:, 2 * k :]))
        h = (1 - z) * n + z * h
        states.append(h)
    return np.stack(states), kept


def _back(d: Direction, x: np.ndarray, kept: list, grad_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the state matrix: backpropagation through time."""
    k = d.state.shape[0]
    g_table, g_state = np.zeros_like(d.table), np.zeros_like(d.state)
    gh, rows = np.zeros_like(grad_states[0]), []
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, un = kept[t]
        gh = gh + grad_states[t]
        gn = gh * (1 - z) * (1 - n * n)
        gz = gh * (h - n) * 2 * z * (1 - z)
        gr = gn * un * 2 * r * (1 - r)
        ga = np.concatenate([gz, gr, gn], axis=1)
        gu = np.concatenate([gz, gr, gn * r], axis=1)
        g_state += h.T @ gu
        gh = gh * z + gu @ d.state.T
        rows.append(ga)
    flat = np.concatenate(rows[::-1])
    index = x.reshape(-1)
    for j in range(3 * k):
        g_table[:, j] = np.bincount(index, flat[:, j], 256)
    return g_table, g_state


def fit(windows: np.ndarray, y: np.ndarray, languages: list[str], *, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> LanguageModel:
    """windows: (n, TRAIN_BYTES) bytes, y: language numbers; Adam on the mean position loss."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    start = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
    params = [start(256, 3 * hidden), start(hidden, 3 * hidden), start(256, 3 * hidden), start(hidden, 3 * hidden), start(2 * hidden, k), np.zeros(k, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1 if len(y) else 1):
        pick = rng.integers(0, len(y), BATCH)
        x, target = windows[pick].T, y[pick]
        f, b = Direction(params[0], params[1]), Direction(params[2], params[3])
        hf, kf = _run(f, x)
        hb, kb = _run(b, x[::-1])
        both = np.concatenate([hf, hb[::-1]], axis=2)
        logits = both @ params[4] + params[5]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), target] -= 1
        p /= BATCH * len(x)
        gboth = p @ params[4].T
        gf = _back(f, x, kf, gboth[:, :, :hidden])
        gb = _back(b, x[::-1], kb, gboth[::-1, :, hidden:])
        grads = [*gf, *gb, np.einsum("tbi,tbj->ij", both, p), p.sum(axis=(0, 1))]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - np.float32(RATE) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
            np.clip(params[i], -6, 6, out=params[i])
    params = [p.astype(np.float32) for p in params]
    return LanguageModel(languages, Direction(params[0], params[1]), Direction(params[2], params[3]), params[4], params[5])


def train(docs: DataFrame, *, folds: int = 3, held: int = 1, fit_docs: int = FIT_DOCS, seed: int = 5) -> LanguageModel:
    """Train on windows of documents outside the held fold: about fit_docs a language, picked by a hash of the id."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold("doc_id", folds) != held))
    share = {r["lang"]: min(1.0, fit_docs / r["count"]) for r in known.groupBy("lang").count().collect()}  # a row a language
    if not share:
        return fit(np.zeros((0, TRAIN_BYTES), np.uint8), np.zeros(0, np.int64), ["und"])
    mark = F.xxhash64("doc_id", "text", F.lit(seed))
    part = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = known.withColumn("mark", mark).where(F.shiftrightunsigned("mark", 11).cast("double") / float(1 << 53) < part[F.col("lang")])

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            out, langs, marks = [], [], []
            for i, (lang, mark) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                text = data[offsets[i] : offsets[i + 1]]
                rng = np.random.default_rng(mark & (2**63 - 1))
                for at in rng.integers(0, max(1, len(text) - TRAIN_BYTES + 1), 3):
                    out.append(np.resize(text[at : at + TRAIN_BYTES], TRAIN_BYTES).tobytes())  # a shorter text repeats
                    langs.append(lang)
                    marks.append(mark)
            yield pa.RecordBatch.from_pydict({"w": pa.array(out, pa.binary()), "lang": pa.array(langs, pa.string()), "mark": pa.array(marks, pa.int64())})

    rows = sample.select("text", "lang", "mark").mapInArrow(settled(cut), "w binary, lang string, mark long").collect()  # about 3 * fit_docs a language, 64 bytes each
    rows.sort(key=lambda r: (r["mark"], bytes(r["w"])))
    languages = sorted(share)
    number = {x: i for i, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(r["w"]) for r in rows), np.uint8).reshape(-1, TRAIN_BYTES)
    return fit(windows, np.array([number[r["lang"]] for r in rows], np.int64), languages, seed=seed)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; null texts and texts without a letter are ``und`` with score 0.

    Ties go to the first language by code point; repeated rows are labelled each; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            p = model.documents(data, offsets)
            has = np.array(batch.column(2).to_pylist(), bool)
            best = p.argmax(axis=1)
            names = [model.languages[k] if ok else "und" for k, ok in zip(best, has)]
            score = np.where(has, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), letters.alias("letters")).mapInArrow(settled(run), schema)
