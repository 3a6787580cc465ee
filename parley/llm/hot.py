"""Joins of all rows with a table of one row a key, where one key may be that of a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each ``key`` of ``rows`` and ``_n``, how many
    rows have it.

    Keys of a thousandth or more of all rows, a thousand at most, are broadcast, and their rows stay where they are; only
    the others are joined by key.
    """
    total = table.agg(F.sum("_n")).first()[0] or 0
    values = [c for c in table.columns if c not in (key, "_n")]
    marked = table.withColumn("_hot", F.col("_n") >= F.lit(total) / HOT)
    hot = marked.where("_hot").select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    rest = marked.where(~F.col("_hot")).select(F.col(key).alias("_rk"), F.struct(*values).alias("_rv"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    done = met.where("_hk IS NOT NULL").select(*rows.columns, *[F.col(f"_hv.{c}").alias(c) for c in values])
    cold = met.where("_hk IS NULL").join(rest, F.col(key) == F.col("_rk")).select(
        *rows.columns, *[F.col(f"_rv.{c}").alias(c) for c in values])
    return done.unionByName(cold)
