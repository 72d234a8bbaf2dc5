"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK walk reads a word, writes it, and moves on or stays by a random bit of (step, word): strings at a small edit
distance become strings at a small Hamming distance, as the walks meet again after an edit.  There are REPEATS walks,
and each is sampled SAMPLINGS times: the symbols at SAMPLES places of the walk, one from each stretch of it, are a key.  Windows start at every STRIDE-th word of a text; items are embedded at every offset
below the stride, so one of a passage's windows lines up with one of its item's whatever the passage's place.  A
window's walk serves every window length, since a shorter window's walk is the start of a longer one's.

Everything but the items stays where it is: texts are read once and not shuffled.  Items lie in the shared folder in
blocks of bounded size; a task holds the index of one block at a time and takes the texts in runs of RUN_BYTES.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh_path, pieces, settled, store_of, text_buffers

#: Items and characters of items in a block, which is what a task holds of the benchmark at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
RUN_BYTES = 32 << 20
#: (fewest words of an item, stride); a window has the item's words less stride - 1, at most.
GROUPS = ((24, 8), (8, 4), (1, 1))
REPEATS, SAMPLINGS, SAMPLES, MIN_SIMILARITY = 10, 5, 4, 0.8
#: Windows that walk together.
LANES = 1 << 14
_MARKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str) -> list[bytes]:
    """Lower-cased words; ASCII marks part them."""
    return text.lower().encode("utf-8", "replace").translate(_MARKS).split()


def edit_distance_in(item: str, text: str) -> int:
    """Least edit distance of item to any substring of text (bit-parallel, exact)."""
    if not item or item in text:
        return 0
    n = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, here = full, 0, n
    best = n
    for c in text:
        eq = where.get(c, 0)
        x = eq | minus
        d = ((x & plus) + plus ^ plus) | x
        up, down = minus | ~(d | plus) & full, plus & d
        if up & top:
            here += 1
        if down & top:
            here -= 1
        up, down = up << 1 & full, down << 1 & full  # a match may start anywhere: no cost is carried in
        plus, minus = down | ~(d | up) & full, up & d
        if here < best:
            best = here
    return best


class WindowIndex:
    """Keys of the items' windows in every repetition, and the search for them in texts."""

    def __init__(self, items: list[tuple], *, similarity: float = MIN_SIMILARITY, repeats: int = REPEATS, samples: int = SAMPLES, seed: int = 13):
        self.similarity, self.repeats, self.known = similarity, repeats, {}
        self.ids, self.texts, self.words, self.tried = [], [], [], 0
        for key, text in items:
            words = normal_words(text or "")
            if words:
                self.ids.append(key)
                self.words.append(len(words))
                self.texts.append(b" ".join(words).decode("utf-8", "replace"))
        self.cache: dict[bytes, int] = {}
        self.groups = []
        for g, (least, stride) in enumerate(GROUPS):
            most = GROUPS[g - 1][0] if g else 1 << 30
            mine = [k for k, n in enumerate(self.words) if least <= n < most]
            if mine:
                self.groups.append(self._group(mine, stride, samples, np.random.default_rng([seed, g])))

    def _group(self, mine: list[int], stride: int, samples: int, rng) -> dict:
        size = lambda n: int(2 ** (math.floor(2 * math.log2(max(1, n - stride + 1))) / 2))  # noqa: E731  powers of the root of 2
        sizes = sorted({size(self.words[k]) for k in mine})
        steps = {w: max(samples, int(1.5 * w)) for w in sizes}
        walk = [rng.integers(0, 1 << 31, max(steps.values()), dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(self.repeats)]
        # by walk and step: the (window length, sample) keys that take the symbol in
        places: list[dict[int, list]] = [{} for _ in range(self.repeats)]
        for r in range(self.repeats):
            for w in sizes:
                for s in range(SAMPLINGS):
                    cuts = np.arange(samples + 1) * steps[w] // samples  # a place from each stretch of the walk
                    for j in rng.integers(cuts[:-1], cuts[1:]):
                        places[r].setdefault(int(j), []).append((w, s))
        group = {"stride": stride, "walk": walk, "places": places, "sizes": sizes, "keys": []}
        words = [self.symbols(self.texts[k].encode().split()) for k in mine]
        pad = np.zeros(max(steps.values()) + 1, np.uint32)
        flat = np.concatenate([np.concatenate([w, pad]) for w in words])
        firsts = np.cumsum([0] + [len(w) + len(pad) for w in words[:-1]])
        at = [(first + d, k, d) for first, k, n in zip(firsts, mine, map(len, words)) for d in range(min(stride, n))]
        begin, owner = np.array([a[0] for a in at], np.uint32), np.array([(a[1], a[2]) for a in at])
        sized = np.array([size(self.words[a[1]]) for a in at])
        for r in range(self.repeats):
            got, keys = self._embed(flat, begin, group, r), {}
            for (w, s), key in got.items():
                order = np.flatnonzero(sized == w)
                order = order[np.argsort(key[order], kind="stable")]
                shift = np.uint64(64 - min(20, max(12, (32 * len(order)).bit_length())))
                bits = np.zeros(1 << (64 - int(shift)), bool)
                bits[key[order] >> shift] = True
                keys[w, s] = (key[order], owner[order], bits, shift)
            group["keys"].append(keys)
        return group

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """A number above 0 for each word; the walk may mix up words of one number, the verification doesn't."""
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > 200_000:
            self.cache.clear()
            new = set(words)
        for w in new:
            self.cache[w] = zlib.crc32(w) or 1
        return np.fromiter(map(self.cache.__getitem__, words), np.uint32, len(words))

    def _embed(self, symbols: np.ndarray, starts: np.ndarray, group: dict, r: int) -> dict[tuple[int, int], np.ndarray]:
        """By window length and sample: the key of the walk from each start."""
        places = group["places"][r]
        keys = {(w, s): np.zeros(len(starts), np.uint64) for w in group["sizes"] for s in range(SAMPLINGS)}
        at, walk = starts.astype(np.uint32), group["walk"][r]
        for j in range(1 + max(places)):
            symbol = symbols[at]
            for k in places.get(j, ()):
                key = keys[k]
                key ^= symbol
                key *= _P
            symbol *= walk[j]
            symbol >>= np.uint32(31)
            at += symbol
        return keys

    def search(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text: item number → least edit distance, of items that are similar enough to a passage."""
        words = [normal_words(t) if t else [] for t in texts]
        found: list[dict[int, int]] = [{} for _ in texts]
        counts = np.array([len(w) for w in words], np.int64)
        symbols = self.symbols([w for text in words for w in text])
        for group in self.groups:
            pad = max(len(w) for w in group["walk"]) + 1
            flat = np.zeros(int(counts.sum()) + pad * len(words), np.uint32)
            firsts = np.cumsum(counts + pad) - counts - pad
            flat[np.repeat(firsts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = symbols
            per = -(-counts // group["stride"])
            owner = np.repeat(np.arange(len(words)), per)
            within = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * group["stride"]
            starts = (firsts[owner] + within).astype(np.uint32)
            candidates: set[tuple[int, int, int]] = set()
            for r in range(self.repeats):
                for i in range(0, len(starts), LANES):
                    for k, key in self._embed(flat, starts[i : i + LANES], group, r).items():
                        known, owners, bits, shift = group["keys"][r][k]
                        hit = np.flatnonzero(bits[key >> shift])
                        left, right = np.searchsorted(known, key[hit], "left"), np.searchsorted(known, key[hit], "right")
                        for h, a, b in zip(hit[right > left], left[right > left], right[right > left]):
                            for item, offset in owners[a:b]:
                                candidates.add((int(owner[i + h]), int(item), int(within[i + h]) - int(offset)))
            self._verify(words, sorted(candidates), found)
        return found

    def _verify(self, words: list, candidates: list, found: list[dict[int, int]]) -> None:
        """candidates: (text, item, start), sorted; starts that are near each other are one passage."""
        k = 0
        while k < len(candidates):
            text, item, start = candidates[k]
            n = self.words[item]
            slack = int((1 - self.similarity) * n) + 2
            last = start
            while k < len(candidates) and candidates[k][:2] == (text, item) and candidates[k][2] <= start + slack:
                last = candidates[k][2]
                k += 1
            segment = b" ".join(words[text][max(0, start - slack) : max(0, last) + n + slack]).decode("utf-8", "replace")
            known = self.known.get((item, segment))
            if known is None:
                if len(self.known) > 5_000:
                    self.known.clear()
                known = self.known[item, segment] = edit_distance_in(self.texts[item], segment)
                self.tried += 1
            if known <= (1 - self.similarity) * len(self.texts[item]) + 1e-9 and known < found[text].get(item, 1 << 60):
                found[text][item] = known


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> tuple[str, int]:
    """(folder, blocks): the benchmark in blocks of about BLOCK_ITEMS items and BLOCK_CHARS characters; 0 without items."""
    rows = items.select(F.col(id_column).alias("i"), F.col(text_column).cast("string").alias("t")).where(F.col("t").isNotNull())
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    folder = fresh_path(items.sparkSession, "benchmark")
    if n:
        rows.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(blocks))).repartition("b").write.partitionBy("b").parquet(folder)
    return folder, blocks if n else 0


_LAST: dict = {}


def _index(folder: str, block: int, options: tuple) -> WindowIndex:
    """The index of a block; a worker keeps the last one."""
    import pyarrow.dataset as ds

    if _LAST.get("of") != (folder, block, options):
        _LAST.clear()
        store, path = store_of(f"{folder}/b={block}")
        known = store.get_file_info(path).type.name == "Directory"  # no item may fall in a block
        rows = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["i", "t"]).to_pylist() if known else []
        _LAST.update(of=(folder, block, options), index=WindowIndex(sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (r[1], str(r[0]))), **dict(options)))
    return _LAST["index"]


def _searched(batches, column: int, folder: str, blocks: int, options: dict):
    """(batch, for each of its rows the list of (item id, edit distance, the item's characters)), texts in runs."""
    held, size = [], 0

    def flush():
        hits = [[[] for _ in range(b.num_rows)] for b in held]
        for block in range(blocks):
            index = _index(folder, block, tuple(sorted(options.items())))
            for batch, mine in zip(held, hits):
                _, offsets = text_buffers(batch.column(column))
                for i, j in pieces(offsets, 1 << 20):
                    for k, found in enumerate(index.search(batch.column(column).slice(i, j - i).to_pylist())):
                        mine[i + k] += [(index.ids[item], d, len(index.texts[item])) for item, d in sorted(found.items())]
        yield from zip(held, hits)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if blocks == 1 or size >= RUN_BYTES:
            yield from flush()
            held, size = [], 0
    yield from flush()


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, edit_distance, item_chars, similarity: every pair of a text and an item with a passage of the
    text at a similarity (1 - edit distance / the item's characters, both lower-cased without marks) of 0.8 or more.

    Found with high probability where words are changed, put in or left out (0.9 and more at a similarity of 0.8); a
    passage with a typo in most of its words is seldom found.  Verified exactly.  Null and empty texts and items match
    nothing; repeated rows are searched each; of an item's passages in a text the nearest counts; an empty table on
    either side gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("edit_distance", T.IntegerType()), T.StructField("item_chars", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    folder, blocks = item_blocks(items)
    kind = to_arrow_type(items.schema["item_id"].dataType)

    def run(batches):
        for batch, hits in _searched(batches, 1, folder, blocks, options):
            rows = [(key, *hit) for key, mine in zip(batch.column(0).to_pylist(), hits) for hit in mine]
            columns = [[r[k] for r in rows] for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], kind), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array([1 - d / n for d, n in zip(*columns[2:])], pa.float64())], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(settled(run), schema)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a passage of an item, all columns kept."""
    at, (folder, blocks) = docs.columns.index("text"), item_blocks(items)

    def run(batches):
        for batch, hits in _searched(batches, at, folder, blocks, options):
            yield batch.filter(pa.array([not mine for mine in hits], pa.bool_()))

    return docs.mapInArrow(settled(run), docs.schema)
