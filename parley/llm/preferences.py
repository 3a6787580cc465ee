"""Chat preference formatting: one prompt for a pair of conversations, and two masked completions.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def _plain(text: Column) -> Column:
    """Text without control marks: ``<|`` in a text becomes ``< |``."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    """What a model learns to write: the text and the closing mark."""
    return F.concat(_plain(turn["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def trained_spans(turns: Column, role: str = TRAINED) -> Column:
    """Spans ``start, end`` (characters of the rendered turns) of the turns of ``role``; all else is masked."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + F.char_length(_head(t))
        end = start + F.char_length(_body(t))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def _turns(df: DataFrame, key: str, turn: str, role: str, text: str, side: int) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("pair"), F.lit(side).alias("side"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", turn: str = "turn",
                       role: str = "role", text: str = "text", trained: str = TRAINED) -> DataFrame:
    """One row per key: ``n_prompt_turns``, ``prompt``, and for both sides the completion (``chosen``, ``rejected``)
    with the spans that count for the loss (``chosen_spans``, ``rejected_spans``).

    Both inputs hold one row per turn. The longest common prefix of turns (equal role and text) is rendered once as
    the prompt, the rest of each side as its completion. One shuffle brings both sides together; a row holds one
    pair, so a task never holds more than it writes out.

    Null roles and texts count as empty. Turns are taken in order of their number, nulls first, ties by role and
    text; repeated rows are repeated turns. A side without turns has an empty completion; equal conversations have
    two. A null key is a key of its own. Empty tables give an empty table. Other columns do not matter.
    """
    both = _turns(chosen, key, turn, role, text, 0).unionByName(_turns(rejected, key, turn, role, text, 1))
    turns = F.array_sort(F.collect_list(F.struct("side", "turn", "role", "text")))
    rows = both.groupBy("pair").agg(turns.alias("turns"))
    for name, side in (("c", 0), ("r", 1)):
        rows = rows.withColumn(name, F.transform(F.filter("turns", lambda t: t["side"] == side),
                                                 lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    common = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    rows = rows.select("pair", "c", "r", common.alias("n"))
    rest = {s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in "cr"}
    return rows.select(F.col("pair").alias(key), F.col("n").alias("n_prompt_turns"),
                       render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
                       render(rest["c"]).alias("chosen"), trained_spans(rest["c"], trained).alias("chosen_spans"),
                       render(rest["r"]).alias("rejected"), trained_spans(rest["r"], trained).alias("rejected_spans"))


def answers_swapped(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from a table of conversations: chosen is each conversation as it is; rejected is the same with
    its last assistant turn said as in its neighbour (ids 2k and 2k + 1 are neighbours; without one it is empty)."""
    mine = turns.where(F.col("role") == TRAINED).groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("said"))
    other = mine.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("said").alias("answer"))
    swap = mine.select("conv_id", "last").join(other, "conv_id", "left")
    rejected = (turns.join(swap, "conv_id", "left")
                .withColumn("text", F.when((F.col("turn") == F.col("last")) & (F.col("role") == TRAINED),
                                           F.coalesce("answer", F.lit(""))).otherwise(F.col("text")))
                .select("conv_id", "turn", "role", "text"))
    return turns.select("conv_id", "turn", "role", "text"), rejected


def preference_digest(turns: DataFrame) -> DataFrame:
    """Per conversation: turns in the prompt, MD5 of prompt and completions, and their spans as text."""
    done = format_preferences(*answers_swapped(turns), key="conv_id")

    def spans(col):
        return F.array_join(F.transform(col, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")

    return done.select("conv_id", "n_prompt_turns", F.md5("prompt").alias("prompt_md5"),
                       F.md5("chosen").alias("chosen_md5"), spans("chosen_spans").alias("chosen_spans"),
                       F.md5("rejected").alias("rejected_md5"), spans("rejected_spans").alias("rejected_spans"))


_SIDE = """
    {s}p AS (SELECT f.*, n, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
        replace({text}, '<|', '< |') || '<|im_end|>' || chr(10) AS body FROM full_ f JOIN prefix USING (conv_id)),
    {s}s AS (SELECT *, sum(length(head) + length(body)) FILTER (pos > n) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM {s}p),
    {s} AS (SELECT conv_id, coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (pos > n), '') AS said,
        coalesce(string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY pos)
            FILTER (pos > n AND role = 'assistant'), '') AS spans,
        coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (pos <= n), '') AS prompt FROM {s}s GROUP BY conv_id)"""

PREFERENCES_SQL = """
WITH mine AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS said FROM conversations
        WHERE role = 'assistant' GROUP BY conv_id),
    full_ AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS pos,
        CASE WHEN c.turn = m.last AND c.role = 'assistant' THEN coalesce(o.said, '') ELSE c.text END AS other
        FROM conversations c LEFT JOIN mine m USING (conv_id) LEFT JOIN mine o ON o.conv_id = xor(c.conv_id, 1)),
    prefix AS (SELECT conv_id, CAST(coalesce(min(pos) FILTER (text <> other) - 1, count(*)) AS INT) AS n FROM full_ GROUP BY conv_id),
""" + _SIDE.format(s="x", text="text").lstrip() + "," + _SIDE.format(s="y", text="other") + """
SELECT x.conv_id, n AS n_prompt_turns, md5(x.prompt) AS prompt_md5, md5(x.said) AS chosen_md5, x.spans AS chosen_spans,
    md5(y.said) AS rejected_md5, y.spans AS rejected_spans FROM x JOIN y USING (conv_id) JOIN prefix USING (conv_id)"""
