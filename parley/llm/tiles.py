"""Cut groups into tiles, so that a hot group is compared by many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(df: DataFrame, key: list[str], member: str, size: int) -> DataFrame:
    """Rows with the pair of tiles ``_a <= _b`` they are to be compared in, and their own tile ``_own``.

    A group (equal ``key``) of up to ``size`` rows is one tile. A larger one is dealt by a hash of ``member`` into
    tiles of about ``size`` rows, and each row goes to every pair of tiles that holds its own. Two rows of a group so
    meet in exactly one pair, whatever the size of the group, and no pair holds more than about 2 x ``size`` rows.
    """
    large = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
             .select(*key, F.ceil(F.col("_n") / F.lit(float(size))).cast("long").alias("_tiles")))
    dealt = (df.join(large, key, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1).cast("long")))
             .withColumn("_own", F.pmod(F.xxhash64(F.lit("tile"), F.col(member)), F.col("_tiles")))
             .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))))
    return (dealt.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))
            .drop("_other", "_tiles"))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links i-j, the smallest node each one reaches."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (before == root).all():
            break
    return root
