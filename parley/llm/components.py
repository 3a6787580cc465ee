"""Connected components by alternating stars; every step is a join or an aggregation, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import new_path, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; root is the smallest node reachable.

    Each round hangs every node's larger neighbours below its smallest one (large star), then the smaller neighbours
    (small star), until nothing moves; the number of rounds grows with the logarithm of the longest chain. Each
    round's links are a written table in the shared folder, so that a lost executor costs one round at most.
    Links with a null end and links of a node with itself are ignored; no links give an empty table.
    """
    spark = links.sparkSession
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    path, last = None, None
    while True:
        if last is None:
            step = edges
        else:
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            step = (large.join(least, "u")
                    .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                    .select("e.u", "e.v").where("u != v").distinct())
        old, path = path, new_path(spark, "links")
        step.write.parquet(path)
        edges = spark.read.schema("u long, v long").parquet(path)
        if old:
            release(spark, [old])
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

