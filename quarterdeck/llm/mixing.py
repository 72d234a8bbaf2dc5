"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by a seeded hash and cut into blocks.  A source's target is met by whole
passes over its blocks plus a last pass over its first permuted words.  The (source, pass, block) units are dealt
to output shards: a binary tree halves the shards and, at each node, draws how many of each source's units go left
from the multivariate hypergeometric distribution, so every quota is exact.  Each shard takes the next run of each
source's permuted units, and its rows are shuffled within the shard.  What a document gives is counted over the units
that were dealt.

The driver splits the tree down to at most GROUPS groups of shards, tasks split each group further.  Texts take part in
the last join only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, release, written

#: Documents in a block, on average; a block is the largest group that one task orders.
BLOCK_DOCS = 64
#: Words in an output shard, about.
SHARD_WORDS = 1_000_000
WEIGHTS = (5, 2, 1)
#: Groups of shards, and numbers in the table of groups by source, that the driver splits at most.
GROUPS, GROUP_CELLS = 1024, 2_000_000


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """Share of all sizes by weight; a target stops at limit * size and its excess is reshared by weight."""
    total = share * sum(sizes)
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = limit * sizes[i]
            total -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def splitting_tree(quotas, sizes: list[int], seed) -> np.ndarray:
    """(leaves, sources) exact counts: each node draws its left half's units of every source without replacement.

    sizes: the shards that each leaf stands for; a half gets its shards' part of the units.  seed: a number or several.
    """
    out = np.zeros((len(sizes), len(quotas)), np.int64)
    ends, stack = np.concatenate([[0], np.cumsum(sizes)]).tolist(), [(0, len(sizes), np.asarray(quotas, np.int64), 1)]
    while stack:
        first, last, here, node = stack.pop()
        if last - first == 1:
            out[first] = here
            continue
        middle = (first + last) // 2
        rng = np.random.default_rng([*np.atleast_1d(seed).tolist(), node])
        left, rest = np.zeros_like(here), int(here.sum())
        need = rest * (ends[middle] - ends[first]) // (ends[last] - ends[first])
        for i, n in enumerate(here):  # multivariate hypergeometric as a chain of univariate draws
            rest -= int(n)
            left[i] = _hypergeometric(rng, int(n), rest, need)
            need -= int(left[i])
        stack += [(first, middle, left, 2 * node), (middle, last, here - left, 2 * node + 1)]
    return out


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad >= 10**9:  # numpy's bound; the binomial limit, kept feasible
        return int(min(max(rng.binomial(draws, good / (good + bad)), draws - bad, 0), good, draws))
    return int(rng.hypergeometric(good, bad, draws))


def _ident(df: DataFrame) -> DataFrame:
    """df with mix\x01id and mix\x01text, which tell rows apart for the last join; no null among them."""
    key = F.coalesce(F.unhex(F.md5(F.col("text").cast("string").cast("binary"))), F.lit(b""))
    return df.withColumns({"mix\x01id": F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), "mix\x01text": key})


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, identity, size, order of the permutation (two hashes and the id; all that tells rows apart)."""
    keyed = _ident(docs.select("doc_id", "source", F.col("text").cast("string").alias("text")))
    sized = keyed.withColumn("mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    # the text spreads rows without an id
    return sized.withColumn("mix_h", F.xxhash64(F.lit(seed), "mix\x01id", "text")).withColumn("mix_g", F.xxhash64("text", F.lit(seed))).drop("text")


def mix_plan(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, seed: int = 7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row a document: doc_id, identity, mix_size, mix_source_size, mix_target, mix_taken and mix_draws, an array of
    (shard, order, words), one for each time that the document is taken.

    A null text has size 0; a null source is a source of its own, last; repeated rows count each; an empty table
    gives none.  Each source's taken words are its target rounded down to words: the last document is cut there.
    No document is taken beyond limit times its size (limit is a whole number of passes here).  Documents without
    words, which no target counts, are taken once, with the first unit of their block or in shard 0.
    """
    spark = docs.sparkSession
    slim = written(_sized(docs, seed), "mix-sized")
    by_source = slim.groupBy("source").agg(F.sum("mix_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row a source
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # by code point, null last
    sizes = [r["size"] for r in by_source]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, limit)
    blocks = [max(1, math.ceil(r["n"] / BLOCK_DOCS)) for r in by_source]
    rows = [(i, r["source"], r["size"], float(want[i]), blocks[i], int(want[i]) // r["size"] if r["size"] else 0, int(want[i]) % r["size"] if r["size"] else 0) for i, r in enumerate(by_source)]
    plan = spark.createDataFrame(rows, "mix_s int, mix_src string, mix_source_size long, mix_target double, mix_blocks int, mix_full int, mix_rest long")
    # one row a source: a broadcast by hint, of a collected size
    placed = slim.join(F.broadcast(plan), slim["source"].eqNullSafe(F.col("mix_src"))).drop("mix_src", "source")
    placed = placed.withColumn("mix_b", F.floor((F.shiftrightunsigned("mix_h", 11).cast("double") / float(1 << 53)) * F.col("mix_blocks")).cast("int"))
    per_block = placed.groupBy("mix_s", "mix_b").agg(F.sum("mix_size").alias("mix_words"), F.first("mix_rest").alias("mix_rest"), F.first("mix_full").alias("mix_full"))
    per_block = _running(per_block, "mix_words", "mix_before")
    passes = F.col("mix_full") + F.when(F.col("mix_before") < F.col("mix_rest"), 1).otherwise(0)
    before = written(_running(per_block.withColumn("mix_passes", passes.cast("long")), "mix_passes", "mix_unit"), "mix-blocks")
    dealt = written(_deal(before, seed, shard_words), "mix-units").groupBy("mix_s", "mix_b").agg(F.sort_array(F.collect_list(F.struct("mix_pass", "mix_shard"))).alias("mix_units"))
    known = before.select("mix_s", "mix_b", "mix_before").join(dealt.hint("shuffle_hash"), ["mix_s", "mix_b"], "left")
    in_block = Window.partitionBy("mix_s", "mix_b").orderBy("mix_h", "mix_g", "doc_id")
    ranked = placed.join(known.hint("shuffle_hash"), ["mix_s", "mix_b"])
    cum = F.col("mix_before") + F.sum("mix_size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_size")
    last = F.least(F.col("mix_size"), F.greatest(F.lit(0).cast("long"), F.col("mix_rest") - cum))
    ranked = ranked.withColumn("mix_last", last)
    order = lambda p: F.xxhash64(F.lit(seed), "mix_h", "mix_g", p)
    draw = lambda u: F.struct(u["mix_shard"].alias("shard"), order(u["mix_pass"]).alias("order"), F.when(u["mix_pass"] < F.col("mix_full"), F.col("mix_size")).otherwise(F.col("mix_last")).alias("words"))
    drawn = F.filter(F.transform(F.coalesce("mix_units", F.array().cast("array<struct<mix_pass:int,mix_shard:int>>")), draw), lambda d: d["words"] > 0)
    once = F.array(F.struct(F.coalesce(F.get("mix_units", F.lit(0))["mix_shard"], F.lit(0)).alias("shard"), order(F.lit(0)).alias("order"), F.lit(0).cast("long").alias("words")))
    out = ranked.withColumn("mix_draws", F.when(F.col("mix_size") == 0, once).otherwise(drawn))
    taken = F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select("doc_id", "mix\x01id", "mix\x01text", "mix_size", "mix_source_size", "mix_target", taken.alias("mix_taken"), "mix_draws")


def _running(blocks: DataFrame, column: str, name: str) -> DataFrame:
    """blocks with the sum of a column over the blocks before, by source: in runs of 4096 blocks and over the runs."""
    run = F.floor(F.col("mix_b") / 4096).alias("mix_run")
    runs = blocks.groupBy("mix_s", run).agg(F.sum(column).alias("w")).withColumn("base", F.sum("w").over(Window.partitionBy("mix_s").orderBy("mix_run")) - F.col("w")).drop("w")
    inner = Window.partitionBy("mix_s", "mix_run").orderBy("mix_b")
    here = blocks.select("*", run).withColumn("inner", F.sum(column).over(inner) - F.col(column))
    return here.join(runs.hint("shuffle_hash"), ["mix_s", "mix_run"]).withColumn(name, F.col("inner") + F.col("base")).drop("inner", "base", "mix_run")


def _edges(before: DataFrame, seed: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(mix_s, ends of its groups' units), a row a source; (mix_s, mix_g, u, mix_shard): the first unit of each shard."""
    spark = before.sparkSession
    counts = before.groupBy("mix_s").agg(F.sum("mix_passes").alias("q"), F.sum(F.col("mix_words") * F.col("mix_passes")).alias("w")).orderBy("mix_s").collect()  # a row a source
    sources, quotas = [int(r["mix_s"]) for r in counts], [int(r["q"]) for r in counts]
    shards = max(1, math.ceil(sum(r["w"] for r in counts) / shard_words))
    groups = max(1, min(shards, GROUPS, GROUP_CELLS // max(1, len(sources))))
    bounds = [shards * g // groups for g in range(groups + 1)]
    top = splitting_tree(quotas, np.diff(bounds).tolist(), seed)
    ends = np.cumsum(top, axis=0)
    ends_of = spark.createDataFrame([(s, [int(x) for x in ends[:, i]]) for i, s in enumerate(sources)], "mix_s int, mix_ends array<long>")
    rows = [(g, bounds[g], bounds[g + 1], [int(x) for x in top[g]], [int(x) for x in ends[g] - top[g]]) for g in range(groups)]

    def split(frames):
        for pdf in frames:
            for g, first, last, quota, start in pdf.itertuples(index=False):
                own = splitting_tree(quota, [1] * (last - first), [seed, g])
                at = np.cumsum(own, axis=0) - own + np.asarray(start)
                shard, i = np.nonzero(own)
                yield pdf.__class__({"mix_s": np.asarray(sources, np.int32)[i], "mix_g": np.int32(g), "u": at[shard, i], "mix_shard": (shard + first).astype(np.int32)})

    table = spark.createDataFrame(rows, "g int, first int, last int, quota array<long>, start array<long>").repartition(max(1, min(groups, 64)), "g")
    return ends_of, table.mapInPandas(split, "mix_s int, mix_g int, u long, mix_shard int")


def _deal(before: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """(mix_s, mix_b, mix_pass, mix_shard): every unit of the plan with its output shard.

    A unit's permuted place: blocks hold hash-ordered documents, so a block's number is already a random order.
    """
    ends_of, edges = _edges(before, seed, shard_words)
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_passes") - 1)).alias("p")
    units = before.where(F.col("mix_passes") > 0).select("mix_s", "mix_b", "mix_unit", one).join(F.broadcast(ends_of), "mix_s")  # a row a source
    units = units.withColumn("u", F.col("mix_unit") + F.col("p"))
    units = units.select("mix_s", F.size(F.filter("mix_ends", lambda e: e <= F.col("u"))).alias("mix_g"), "u", F.lit(None).cast("int").alias("mix_shard"), "mix_b", F.col("p").cast("int").alias("mix_pass"))
    both = edges.withColumns({"mix_b": F.lit(None).cast("int"), "mix_pass": F.lit(None).cast("int")}).unionByName(units)
    here = Window.partitionBy("mix_s", "mix_g").orderBy("u", F.col("mix_pass").asc_nulls_first())
    return both.withColumn("mix_shard", F.last("mix_shard", ignorenulls=True).over(here)).where(F.col("mix_pass").isNotNull()).select("mix_s", "mix_b", "mix_pass", "mix_shard")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, and shards, those that the document's draws go to, for every document."""
    plan = mix_plan(docs, **options)
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_draws.shard").alias("shards"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: the columns of docs, a row for each time a document is taken, by shard and shuffled within it.

    The one document of a source in which its target ends is cut after the last word that is taken.
    """
    plan = mix_plan(docs, **options)
    draws = plan.groupBy("mix\x01id", "mix\x01text").agg(F.sort_array(F.collect_list(F.struct("mix_size", "mix_draws"))).alias("mix\x01rows"))
    draws = written(draws, "mix-draws")
    release(docs.sparkSession)
    rest = [f.name for f in docs.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)) and f.name not in ("doc_id", "text")]
    turn = F.row_number().over(Window.partitionBy("mix\x01id", "mix\x01text").orderBy(F.xxhash64(*rest) if rest else F.lit(0)))
    mine = _ident(docs).join(draws.hint("merge"), ["mix\x01id", "mix\x01text"]).withColumn("mix\x01row", F.get("mix\x01rows", turn - 1))
    out = mine.select(*docs.columns, F.col("mix\x01row")["mix_size"].alias("mix\x01size"), F.explode(F.col("mix\x01row")["mix_draws"]).alias("mix\x01draw"))
    words = F.col("mix\x01draw")["words"]
    text = F.when(words >= F.col("mix\x01size"), F.col("text")).otherwise(_first_words("text", words))
    place = [F.col("mix\x01draw")["shard"].alias("mix\x01shard"), F.col("mix\x01draw")["order"].alias("mix\x01order")]
    out = out.withColumn("text", text).select(*docs.columns, *place)
    return out.repartition("mix\x01shard").sortWithinPartitions("mix\x01shard", "mix\x01order").select(*docs.columns)


def _first_words(text: str, n):
    """The text up to its n-th word's end."""
    white = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(text, white), F.lit(1), n.cast("int")), "")
