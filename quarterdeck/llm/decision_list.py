"""Quality rules: a learned decision list as ordered Spark conditional expressions (no Python on the executors).

Sequential covering: a rule grows by the threshold condition with the best information gain on the growing rows,
is cut back on the pruning rows, and its rows leave before the next rule starts.  All counts are DataFrame
aggregates over every labelled document; the driver sees only counts by feature, bin and label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, one_label, written

WHITE = r"[\x20\x09-\x0D]"
FEATURES = ("words", "word_length", "symbols_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share", "line_words", "digit_share")
LEVELS = 24


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, though lambdas inside name it often."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _let(order, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    counted = _let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) < 3, 0).otherwise(counted).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed and the features, of every whole text.

    A null text has no words; its shares are 0.  Repeated rows and null ids each give a row; an empty table none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim("t", F.lit("\t\n\x0b\x0c\r "))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE + "+"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("rep"), F.size(F.array_distinct(w)).alias("dis"))

    line_counts = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    s = docs.select("doc_id", text.alias("t"))
    s = s.select(
        "doc_id", _let(words, of_words).alias("w"), line_counts.alias("l"), F.length("t").alias("chars"),
        F.regexp_count("t", F.lit(WHITE)).alias("white"), F.regexp_count("t", F.lit("[#*$%&|<>]")).alias("sym"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("upper"), F.regexp_count("t", F.lit(r"[!-/:-@\[-`{-~]")).alias("marks"), F.regexp_count("t", F.lit("[0-9]")).alias("digits"),
    )
    n, chars = F.col("w.n"), F.greatest(F.col("chars") - F.col("white"), F.lit(1))
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    values = (n.cast("double"), over(chars, n), over(F.col("sym"), n), over(F.col("l.dup"), F.col("l.n")), over(F.col("w.rep"), n), over(F.col("w.dis"), n), over(F.col("upper"), chars), over(F.col("marks"), chars), over(n, F.col("l.n")), over(F.col("digits"), chars))
    return s.select(
        "doc_id", n.alias("n_words"), (F.col("chars") - F.col("white")).cast("long").alias("word_chars"), F.col("sym").cast("long").alias("n_symbols"),
        F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), ((n < 50) | (100 * F.col("w.rep") > 50 * n)).alias("base_failed"),
        *[v.alias(f"f_{k}") for k, v in zip(FEATURES, values)],
    )


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool  # feature >= cut, or feature < cut
    level: int  # bins at or above / below which it holds
    cut: float

    def column(self) -> Column:
        c = F.col(f"f_{FEATURES[self.feature]}")
        return c >= self.cut if self.above else c < self.cut

    def binned(self) -> Column:
        c = F.col("b")[self.feature]
        return c >= self.level if self.above else c < self.level


@dataclass
class DecisionList:
    """Ordered rules; a text that meets one is rejected, any other is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def keeps(self) -> Column:
        out = None
        for rule in self.rules:
            test = _all([c.column() for c in rule])
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        said = ["IF " + " AND ".join(f"{FEATURES[c.feature]} {'>=' if c.above else '<'} {c.cut:.6g}" for c in r) + " THEN reject" for r in self.rules]
        return "\nELSE ".join([*said, "keep"])


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _level(value: Column, cut: list[float]) -> Column:
    """Number of cuts at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cut]), lambda x: x <= value)) if cut else F.lit(0)


def _gain(p1: int, n1: int, p0: int, n0: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def learn(stats: DataFrame, labels_df: DataFrame, *, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, min_rows: int = 8) -> DecisionList:
    """Learn rules for label 0 from the statistics of every labelled document; without labels the list is empty."""
    known = stats.join(one_label(labels_df, "quality").hint("shuffle_hash"), "doc_id").where(~F.col("base_failed"))
    names = [f"f_{k}" for k in FEATURES]
    known = written(known.select("doc_id", "label", *names), "rule-rows")
    quantiles = [i / LEVELS for i in range(1, LEVELS)]
    # cuts: quantiles of either label, so that a rare kind of bad text has cuts of its own
    found = known.groupBy("label").agg(*[F.percentile_approx(c, quantiles, 2000).alias(c) for c in names]).collect()
    cuts = [sorted({float(x) for r in found for x in (r[c] or [])}) for c in names]
    bins = F.array(*[_level(F.col(c), cut) for c, cut in zip(names, cuts)])
    rows = written(known.select("label", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("prune"), bins.alias("b")), "rule-bins")
    left, out = F.lit(True), DecisionList()
    for _ in range(max_rules):
        rule: list[Condition] = []
        totals = None
        while len(rule) < max_conditions:
            here = rows.where(left & _all([c.binned() for c in rule]) & ~F.col("prune"))
            counts = {(r["pos"], r["col"]): (r["bad"], r["good"]) for r in here.select("label", F.posexplode("b")).groupBy("pos", "col").agg(F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") != 0, 1).otherwise(0)).alias("good")).collect()}
            p0, n0 = (sum(v[k] for (j, _), v in counts.items() if j == 0) for k in (0, 1))
            totals = totals or (p0, n0)
            if p0 < min_rows or n0 == 0:
                break
            best = (0.0, None)
            for j, cut in enumerate(cuts):
                p = n = 0
                for level in range(1, len(cut) + 1):
                    b = counts.get((j, level - 1), (0, 0))
                    p, n = p + b[0], n + b[1]
                    for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                        gain = _gain(p1, n1, p0, n0) if p1 >= min_rows else 0.0
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(j, above, level, cut[level - 1]))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = rows.where(left & F.col("prune"))
        prefix = [_all([c.binned() for c in rule[:k]]) for k in range(1, len(rule) + 1)]
        got = held.agg(*[F.count_if(t & (F.col("label") == y)).alias(f"n{k}_{y}") for k, t in enumerate(prefix) for y in (0, 1)]).first()
        worth = [((got[f"n{k}_0"] - got[f"n{k}_1"]) / max(1, got[f"n{k}_0"] + got[f"n{k}_1"]), got[f"n{k}_0"], -k) for k in range(len(rule))]
        value, bad, k = max(worth)
        if bad == 0 or (value + 1) / 2 < precision:
            break
        out.rules.append(rule[: 1 - k])
        left = left & ~_all([c.binned() for c in out.rules[-1]])
    return out


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The contract's columns, with kept: not base_failed and no rule met."""
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & rules.keeps()).alias("kept"))
