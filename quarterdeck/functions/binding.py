"""Values that are computed once a row, however often an expression names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row.

    The optimizer copies the expression of a plain column into each filter above it, as often as that names it; a
    generator's column it leaves where it is.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """As once, for values with lambdas: a projection below the generator compiles what stands around them, which a
    generator would interpret."""
    return once(rows.withColumn("\x01value", value), name, F.col("\x01value")).drop("\x01value")
