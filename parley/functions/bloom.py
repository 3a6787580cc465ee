"""Bloom filters made by aggregation, of a size that does not grow with the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # one megabyte: of 800,000 values about one other in a hundred passes, of more values more
HASHES = 4


def _places(value: Column, bits: int) -> list[Column]:
    first, step = (F.shiftright(h, 8) for h in (F.xxhash64(value), F.xxhash64(F.lit(1), value)))
    return [F.pmod(first + F.lit(i) * step, F.lit(bits).cast("long")) for i in range(HASHES)]


def bloom_filter(values: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """One row with an ``array<bigint>`` of ``bits`` bits (a multiple of 64). Partial aggregation leaves at most one row
    per 64 bits and task, so the shuffle has a fixed size as well."""
    place = values.where(F.col(col).isNotNull()).select(F.explode(F.array(*_places(F.col(col), bits))).alias("at"))
    cells = (place.groupBy(F.expr("cast(at div 64 as int)").alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")))
    every = values.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("cell"))
    dense = every.join(cells, "cell", "left").select("cell", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "set"))), lambda c: c["set"]).alias("bloom"))


def might_hold(bloom: DataFrame, value: Column, bits: int = BITS) -> Column:
    """False only for values that are surely not in the filter. A scalar subquery: Spark makes the filter once and sends it
    along with the tasks; it cannot stand inside a lambda function."""
    filled = bloom.scalar()
    tests = [F.getbit(F.get(filled, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
             for at in _places(value, bits)]
    return reduce(lambda a, b: a & b, tests)
