"""Word weights learnt from a few seed words, for lexicons made of the texts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.once import once
from parley.functions.text import normalize, word_tokens


def learn_polarity(df: DataFrame, text_col: str, positive: list[str], negative: list[str],
                   min_texts: int = 5) -> DataFrame:
    """One row per word (word, texts, weight) that stands in at least ``min_texts`` texts, in any number of words.

    The weight compares how much oftener than by chance a word shares a text with a positive seed and with a negative
    one: the difference of the two pointwise mutual informations, in bits, brought between -1 and 1 by x / (1 + abs(x)),
    six decimals. A half is added to counts, so a word that never meets a seed is near 0. Each word counts once a text;
    the counts are partial sums, so that a word of every text costs no task more than another. Null and empty texts count
    as texts without words. Without any text there are no rows.
    """
    words = F.col("said")
    marked = (df.select(once(F.array_distinct(word_tokens(normalize(text_col)))).alias("said"))
              .select("said", *[F.arrays_overlap(words, F.array(*[F.lit(s.lower()) for s in seeds]).cast("array<string>"))
                                .cast("int").alias(name) for name, seeds in (("up", positive), ("down", negative))]))
    # The empty word stands in every text: its row holds the totals.
    counts = (marked.select(F.explode(F.array_append("said", F.lit(""))).alias("word"), "up", "down")
              .groupBy("word").agg(F.count("*").alias("texts"), F.sum("up").alias("up"), F.sum("down").alias("down")))
    # Tested on a counted word: a test of the word alone would go down to the scan, and each side would read the texts.
    counted = F.when(F.col("texts") > 0, F.col("word"))
    totals = counts.where(counted == "").select(F.col("up").alias("all_up"), F.col("down").alias("all_down"))
    met = counts.where((counted != "") & (F.col("texts") >= min_texts)).crossJoin(F.broadcast(totals))
    bits = F.log2((F.col("up") + 0.5) / (F.col("all_up") + 1.0)) - F.log2((F.col("down") + 0.5) / (F.col("all_down") + 1.0))
    return met.select("word", "texts", bits.alias("bits")).select(
        "word", "texts", F.round(F.col("bits") / (1 + F.abs("bits")), 6).alias("weight"))
