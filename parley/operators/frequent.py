"""The most frequent values of a column, exactly, without shuffling every different value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACKED = 1 << 15  # values that a summary holds, about a megabyte
CANDIDATES = 1000  # values of a group that are recounted, at least four times those asked for
BUCKETS = 1 << 16  # counts of all other values, by hash
MERGED_BY = 256    # tasks that unite the summaries before the last one does
LONGEST = 256      # characters; longer values stay out of the summaries, so that their size is bounded


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def candidates(items: DataFrame, item: str, by: list[str], n: int, tracked: int = TRACKED) -> DataFrame:
    """Up to ``n`` values a group that are likely to be frequent, as ``__k0``, ... and ``__listed``: a summary a task, united
    in two steps. A guess only: nothing relies on its being complete."""
    states = (items.where(F.length(item) <= LONGEST)
              .select(*by, F.col(item).alias("__item"), F.pmod(F.spark_partition_id(), F.lit(MERGED_BY)).alias("__part"))
              .groupBy(*by, "__part").agg(F.expr(f"approx_top_k_accumulate(__item, {tracked})").alias("__state")))
    # Grouped by a constant as well: without any row there is no summary to be united.
    united = states.groupBy(*by, F.lit(0).alias("__all")).agg(F.expr(f"approx_top_k_combine(__state, {tracked})").alias("__state"))
    listed = united.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)],
                           F.explode(F.expr(f"approx_top_k_estimate(__state, {min(n, tracked)})")).alias("__e"))
    return listed.select(*[f"__k{i}" for i in range(len(by))], F.col("__e.item").alias("__listed"))


def recounted(items: DataFrame, item: str, by: list[str], k: int, found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Exact counts of the candidates, and of all other values together by bucket of their hash.

    ``__place`` ranks the candidates of a group, ``__least`` is the count of its k-th candidate (null with fewer). A
    value that is no candidate occurs at most as often as its bucket, so only buckets of ``__least`` or more can hold
    one of the first k. A task sends one row a candidate and bucket, however many different values it meets.
    """
    keys = [F.col(c) for c in by]
    met = items.join(F.broadcast(found), _same([*keys, F.col(item)], _found_columns(by)), "left")
    bucket = F.when(F.col("__listed").isNull(), _bucket(item, buckets))
    counted = met.groupBy(*by, "__listed", bucket.alias("__bucket")).agg(F.count("*").alias("Count"))
    group = Window.partitionBy(*by)
    ranked = counted.withColumn("__place", F.row_number().over(
        group.orderBy(F.col("__listed").isNull(), F.col("Count").desc(), "__listed")))
    last = F.col("__listed").isNotNull() & (F.col("__place") == k)
    return ranked.withColumn("__least", F.max(F.when(last, F.col("Count"))).over(group))


def open_buckets(counts: DataFrame, by: list[str]) -> DataFrame:
    """The buckets that may hold one of the first values, as ``__o0``, ... and ``__open``."""
    return counts.where(F.col("__listed").isNull() & (F.col("Count") >= F.coalesce("__least", F.lit(0)))).select(
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(by)], F.col("__bucket").alias("__open"))


def _bucket(item: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")


def _found_columns(by: list[str]) -> list[Column]:
    return [*[F.col(f"__k{i}") for i in range(len(by))], F.col("__listed")]


def most_frequent(rows: DataFrame, item: str, k: int, by: list[str] | None = None, tracked: int = TRACKED,
                  buckets: int = BUCKETS) -> DataFrame:
    """The ``k`` most frequent strings of ``item`` with ``Count`` and ``place``, in each group of the few-valued columns ``by``.

    Exact; ties go by the value. Nulls are not counted, an empty table gives no rows. ``rows`` is read twice: for
    candidates, and to count them with the buckets of all others. Where a bucket shows that more values could be among the
    first k (flat counts, fewer than k candidates), a third reading counts what lies in such buckets value by value;
    adaptive execution leaves it out where there are none. What is broadcast is bounded by ``CANDIDATES`` and
    ``BUCKETS`` a group.
    """
    by = list(by or [])
    items = rows.where(F.col(item).isNotNull()).select(*by, item)
    found = candidates(items, item, by, max(CANDIDATES, 4 * k), tracked)
    counts = recounted(items, item, by, k, found, buckets)
    first = counts.where(F.col("__listed").isNotNull() & (F.col("__place") <= k)).select(
        *by, F.col("__listed").alias(item), "Count")
    keys = [F.col(c) for c in by]
    marked = items.withColumn("__bucket", _bucket(item, buckets))
    may = open_buckets(counts, by)
    opened = [*[F.col(f"__o{i}") for i in range(len(by))], F.col("__open")]
    rest = (marked.join(F.broadcast(may), _same([*keys, F.col("__bucket")], opened), "left_semi")
            .join(F.broadcast(found), _same([*keys, F.col(item)], _found_columns(by)), "left_anti")
            .groupBy(*by, item).agg(F.count("*").alias("Count")))
    order = [F.col("Count").desc(), F.col(item)]
    both = first.unionByName(rest)
    both = both if by else both.orderBy(*order).limit(k)  # without groups: no ranking of everything in one task
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
