"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def connected(links: DataFrame, name: str = "graph") -> DataFrame:
    """(node, label) for links (a, b) of whole numbers: the least node of each component; nodes without links are not
    listed.

    Each round a node takes the least label of its neighbours and then the label of its label, so that rounds grow with the
    logarithm of the longest path.  Each round is a written table: a lost executor costs no earlier round.  Repeated links
    and links of a node to itself are harmless; an empty table gives no rows.
    """
    spark = links.sparkSession
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(ends.distinct(), f"{name}-links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        spread = both.hint("merge").join(seen.hint("merge"), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = labels.hint("merge").join(spread.withColumnRenamed("a", "node").hint("merge"), "node").select("node", "label", F.least("label", "other").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        joined = lower.hint("merge").join(jump.hint("merge"), "near")
        new = written(joined.select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")), f"{name}-labels")
        settled = not new.where("moved").head(1)
        release(spark, labels)
        if settled:
            release(spark, both)
            out = new.select("node", "label")
            out.quarterdeck_path = new.quarterdeck_path
            return out
        out = new.select("node", "label")
        out.quarterdeck_path = new.quarterdeck_path
        labels = out
