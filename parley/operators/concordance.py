"""Keyword in context over the classified table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed_values import STOP_WORDS, TOKEN_EDGE
from parley.functions.once import once
from parley.functions.terms import is_word_char, quote
from parley.functions.text import SPACE_CLASS, WORD_CLASS, as_text, words
from parley.operators.frequent import most_frequent
from parley.session import materialize


def keyword_pattern(keyword: str, bounded: bool, case_sensitive: bool = False) -> str:
    body = quote(keyword)
    if bounded:
        word = f"[{WORD_CLASS}]"
        left = rf"(?<!{word})" if is_word_char(keyword[0]) else rf"(?<={word})"
        right = rf"(?!{word})" if is_word_char(keyword[-1]) else rf"(?={word})"
        body = left + body + right
    return body if case_sensitive else "(?iu)" + body


def _contexts(pieces: Column, marks: Column, n: int, left: bool) -> Column:
    """The ``n`` words next to every mark; for the right side both arrays come reversed.

    One pass over the pieces between the marks. What is carried from mark to mark is cut to the last n + 1 words, so
    a text with many marks costs no more than its length.
    """
    edge = rf"[{SPACE_CLASS}]$" if left else rf"^[{SPACE_CLASS}]"
    zero = F.struct(F.lit("").alias("near"), F.array().cast("array<string>").alias("out"))

    def cut(ws, k):
        return F.slice(ws, F.greatest(F.size(ws) - k, F.lit(0)) + 1, F.lit(k)) if left else F.slice(ws, 1, k)

    def step(acc, pair):
        joined = F.concat(acc["near"], pair["piece"]) if left else F.concat(pair["piece"], acc["near"])
        mark = pair["mark"]
        kept = F.array_join(cut(words(joined), n + 1), " ")
        blank = F.when(F.rlike(joined, F.lit(edge)), " ").otherwise("")
        near = F.concat(kept, blank, mark) if left else F.concat(mark, blank, kept)
        context = F.array_join(cut(words(joined), n), " ")
        return F.struct(F.coalesce(near, F.lit("")).alias("near"),
                        F.when(mark.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(context)))
                        .alias("out"))

    return F.aggregate(F.arrays_zip(pieces.alias("piece"), marks.alias("mark")), zero, step, lambda acc: acc["out"])


def _offsets(pieces: Column, marks: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, pair):
        at, mark = acc["at"] + F.length(pair["piece"]), pair["mark"]
        return F.struct((at + F.coalesce(F.length(mark), F.lit(0))).alias("at"),
                        F.when(mark.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(at))).alias("out"))

    return F.aggregate(F.arrays_zip(pieces.alias("piece"), marks.alias("mark")), zero, step, lambda acc: acc["out"])


def _never_empty(marks: Column) -> Column:
    """A match without characters has no keyword to show, and the pieces between the matches would not line up."""
    return F.when(F.exists(marks, lambda m: m == ""),
                  F.raise_error(F.lit("the pattern matches the empty string; it must match some character"))
                  ).otherwise(marks)


def kwic_matches(rows: DataFrame, pattern: str, context: int, keep: list[str], text_col: str = "Original_Text",
                 with_offset: bool = False) -> DataFrame:
    """One row per match: the ``keep`` columns, match_no, Left, KW, Right (and Match_Position).

    A pattern which matches the empty string somewhere is an error.
    """
    text = as_text(text_col)
    found = (rows.select(*keep, text.alias("__text")).where(F.rlike("__text", F.lit(pattern)))
             .withColumn("__marks", once(_never_empty(F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))))
             .withColumn("__pieces", once(F.split("__text", pattern, -1))))
    left = _contexts(F.col("__pieces"), F.col("__marks"), context, True)
    right = F.reverse(_contexts(F.reverse("__pieces"), F.reverse("__marks"), context, False))
    cols = [left.alias("Left"), F.col("__marks").alias("KW"), right.alias("Right")]
    if with_offset:
        cols.append(_offsets(F.col("__pieces"), F.col("__marks")).alias("Match_Position"))
    zipped = found.select(*keep, F.posexplode(F.arrays_zip(*cols)).alias("match_no", "m"))
    return zipped.select(*keep, "match_no", *[F.col(f"m.{c}").alias(c) for c in
                                              ["Left", "KW", "Right"] + (["Match_Position"] if with_offset else [])])


def kwic(out: DataFrame, keyword: str, context: int = 10, category: str | None = None) -> DataFrame:
    """Every match with its neighbours; a phrase is a plain substring, a single word is matched as a word."""
    rows = out if category is None else out.where(F.col("Category") == category)
    pattern = keyword_pattern(keyword, bounded=" " not in keyword.strip())
    return kwic_matches(rows, pattern, context, ["Conversation_ID", "Category", "Subcategory"])


def kwic_options(out: DataFrame, keyword: str, context: int = 10, category: str | None = None,
                 subcategory: str | None = None, case_sensitive: bool = False, regex: bool = False) -> DataFrame:
    """As ``kwic``, always on word boundaries or with a raw regex; adds the deeper levels, full text and offset."""
    rows = out if category is None else out.where(F.col("Category") == category)
    rows = rows if subcategory is None else rows.where(F.col("Subcategory") == subcategory)
    pattern = (keyword if case_sensitive else "(?iu)" + keyword) if regex else keyword_pattern(
        keyword, True, case_sensitive)
    rows = rows.withColumn("Full_Text", as_text("Original_Text"))
    return kwic_matches(rows, pattern, context,
                        ["Conversation_ID", "Category", "Subcategory", "L3", "L4", "Full_Text"], with_offset=True)


def kwic_stats(matches: DataFrame) -> DataFrame:
    """Matches, conversations, categories, mean matches per conversation."""
    per = matches.groupBy("Conversation_ID", "Category").agg(F.count("*").alias("n"))
    total, convs = F.sum("n"), F.count_distinct("Conversation_ID")
    return per.agg(F.coalesce(total, F.lit(0)).alias("matches"), convs.alias("conversations"),
                   F.count_distinct("Category").alias("categories"),
                   F.coalesce(F.bround(F.try_divide(total * 1.0, convs), 1).cast("double"), F.lit(0.0))
                   .alias("avg_per_conversation"))


def kwic_distribution(matches: DataFrame, col: str = "Category") -> DataFrame:
    return matches.groupBy(col).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), col)


def collocations(matches: DataFrame, n: int = 8, min_len: int = 3) -> DataFrame:
    """The ``n`` most frequent neighbours on each side, without stop words; ``min_len`` counts untrimmed letters. ``matches``
    is worked out once, and its neighbours are written to the shared folder, as ``most_frequent`` reads them twice."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in
                      (("left", "Left"), ("right", "Right"))])
    raw = matches.select(F.inline(sides)).select("side", F.explode(words(F.lower("text"))).alias("w"))
    kept = (raw.where(F.length("w") >= min_len).select("side", F.btrim("w", F.lit(TOKEN_EDGE)).alias("word"))
            .where(~F.col("word").isin(STOP_WORDS)))
    return most_frequent(materialize(kept, "neighbours"), "word", n, by=["side"]).withColumnRenamed("Count", "count")
