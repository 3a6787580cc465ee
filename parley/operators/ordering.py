"""Exact positions in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000


def running_total(df: DataFrame, group: list[str], ordinal: str, weight, name: str, block: int = BLOCK) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the group with a smaller ``ordinal`` (unique in its group).

    Weights are first summed per block of ordinals. Only the block sums of a group are ordered in one place, and each
    block orders its own rows, at most ``block`` of them, so a group holding most of the rows is still spread out.
    """
    marked = df.withColumn("__block", F.floor(F.col(ordinal) / block)).withColumn("__weight", weight.cast("long"))
    sums = marked.groupBy(*group, "__block").agg(F.sum("__weight").alias("__sum"))
    ahead = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*group, "__block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return (marked.join(starts, [*group, "__block"])
            .withColumn(name, F.col("__start") + F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
            .drop("__block", "__weight", "__start"))
