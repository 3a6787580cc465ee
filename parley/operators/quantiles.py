"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
# Up to this many values a group is ranked as a whole.
SMALL = 10_000
# Parts a bracket is cut into, so that its values are ranked by many tasks.
BINS = 1_000
# Parts of a group in the join with its brackets.
SALTS = 32


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join in which null keys meet; the keys of the right side are dropped."""
    same = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"__right_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(right, same).drop(*[f"__right_{k}" for k in keys])


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Per group one column per entry of ``probs``: the quantile with linear interpolation.

    A sketch of bounded size brackets each quantile. Values below a bracket are only counted; values inside are
    counted per distinct value and ranked bin by bin. So neither all values of a group nor all its distinct values
    are ever held in one task, and the result is exact.
    """
    keys = groups or ["__all"]
    base = df if groups else df.withColumn("__all", F.lit(1))
    base = base.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    margin = 10.0 / ACCURACY
    edges = [e for p in probs.values() for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = (base.groupBy(*keys) if groups else base).agg(F.percentile_approx("__v", edges, ACCURACY).alias("__e"),
                                     F.min("__v").alias("__min"), F.max("__v").alias("__max"),
                                     F.count("*").alias("__n"))
    small = F.col("__n") <= SMALL
    spans = F.array(*[F.struct(
        F.lit(i).alias("q"), F.when(small, F.col("__min")).otherwise(F.get("__e", F.lit(2 * i))).alias("lo"),
        F.when(small, F.col("__max")).otherwise(F.get("__e", F.lit(2 * i + 1))).alias("hi"))
        for i in range(len(probs))])
    # One row per quantile and value inside the bracket; all values below it are one counter in bin -1.
    lo, hi, v = F.col("s.lo"), F.col("s.hi"), F.col("__v")
    part = F.least(F.floor(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)) * BINS), F.lit(BINS - 1))
    if groups:
        # Where the sketch is too large to be sent to all tasks, the values of one group still go to many of them.
        salted = base.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int"))
        spread = sketch.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        bracketed = _join_on(salted, spread, [*keys, "__salt"])
    else:
        bracketed = base.crossJoin(F.broadcast(sketch.drop(*keys)))  # one row
    counted = (bracketed.select(*keys, "__v", "__n", F.explode(spans).alias("s")).where(v <= hi)
               .groupBy(*keys, F.col("s.q").alias("q"), "__n", F.when(v >= lo, v).alias("v"),
                        F.when(v >= lo, part).otherwise(-1).alias("bin"))
               .agg(F.count("*").alias("c")))
    bins = counted.groupBy(*keys, "q", "bin").agg(F.sum("c").alias("__in_bin"))
    ahead = Window.partitionBy(*keys, "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("__in_bin").over(ahead), F.lit(0))).drop("__in_bin")
    inside = Window.partitionBy(*keys, "q", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    target = F.element_at(F.array(*[F.lit(p) for p in probs.values()]), F.col("q") + 1) * (F.col("__n") - 1)
    ranked = (_join_on(counted, starts, [*keys, "q", "bin"])
              .withColumns({"upto": F.col("start") + F.sum("c").over(inside), "t": target}))
    low, high = F.floor("t") + 1, F.ceil("t") + 1
    picked = ranked.groupBy(*keys, "q", "t").agg(F.min(F.when(F.col("upto") >= low, F.col("v"))).alias("a"),
                                                 F.min(F.when(F.col("upto") >= high, F.col("v"))).alias("b"))
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("t") - F.floor("t"))
    wide = (picked.withColumn("x", between).groupBy(*keys)
            .agg(*[F.max(F.when(F.col("q") == i, F.col("x"))).alias(name) for i, name in enumerate(probs)]))
    return wide if groups else wide.drop("__all")
