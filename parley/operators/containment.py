"""Which strings of one table stand inside strings of another, by an inverted index on rare q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3  # characters of a gram; shorter strings are their own gram


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in shuffles."""
    return F.unhex(F.md5(text))


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters, in time linear in the text (``substring`` would walk to each place anew)."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """All pairs (``short``, ``long``), keys of texts of which the first stands in the second; equal texts are such.

    Both tables have different texts as ``key`` (``text_key``) and ``text``, of any number and length; empty and null texts
    stand in nothing. Each short text is looked up by the one of its grams that fewest long texts hold, and not at all if
    one of its grams is in none; what is found is verified on the texts. A long text costs its different grams; texts
    themselves are only shuffled once, to be verified.
    """
    short = short.where(F.length("text") > 0)
    sizes = F.broadcast(short.agg(F.collect_set(F.least(F.length("text"), F.lit(Q))).alias("sizes")))  # at most Q numbers
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*[F.when(F.array_contains("sizes", n), _grams(F.col("text"), n)).otherwise(none)
                                for n in range(1, Q + 1)]))
    held = long.where(F.length("text") > 0).crossJoin(sizes).select(
        F.col("key").alias("long"), F.explode(F.array_distinct(every)).alias("gram"))
    spread = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("text") < Q, F.array("text")).otherwise(F.array_distinct(_grams(F.col("text"), Q)))
    rarest = (short.select(F.col("key").alias("short"), F.explode(own).alias("gram")).join(spread, "gram", "left")
              .groupBy("short").agg(F.min(F.struct("n", "gram")).alias("least"), F.count_if(F.col("n").isNull()).alias("gone"))
              .where("gone = 0").select("short", F.col("least.gram").alias("gram")))
    pairs = rarest.join(held, "gram").select("short", "long")
    shorts = short.select(F.col("key").alias("short"), F.col("text").alias("__short"))
    longs = long.select(F.col("key").alias("long"), F.col("text").alias("__long"))
    return (pairs.join(shorts, "short").join(longs, "long").where(F.contains(F.col("__long"), F.col("__short")))
            .select("short", "long"))
