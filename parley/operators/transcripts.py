"""Turns of a conversation to labelled transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_transcripts(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
                      labels: dict[str, str], style: str = "lines") -> DataFrame:
    """One labelled transcript per conversation: columns ``conv_col``, transcript.

    Roles without a label are left out. A transcript is one text cell, so a task holds no more than the cell which it
    writes; conversations are independent of each other. Styles: ``lines`` (label per line), ``simple``
    (segments split by ``|``), ``stamped`` and ``bracket`` (with times counted from the turn number).
    """
    said = turns.where(F.col(role_col).isin(*labels))
    label = None
    for role, name in labels.items():
        test = F.col(role_col) == role
        label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
    minute = F.lpad((F.floor(F.col(turn_col) / 60) % 60).cast("string"), 2, "0")
    second = F.lpad((F.col(turn_col) % 60).cast("string"), 2, "0")
    body = F.coalesce(F.col(text_col), F.lit(""))
    if style == "stamped":
        line = F.concat(F.lit("2025-06-30 09:"), minute, F.lit(":"), second, F.lit(" +0000 "), label, F.lit(": "), body)
    elif style == "bracket":
        line = F.concat(F.lit("[09:"), minute, F.lit(":"), second, F.lit(" "), F.upper(label), F.lit("]: "), body)
    else:
        line = F.concat(label, F.lit(": "), body)
    joiner = {"lines": "\n", "simple": " | ", "stamped": " | ", "bracket": " "}[style]
    return (said.groupBy(conv_col)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), line.alias("line")))).alias("ls"))
            .select(conv_col, F.array_join(F.transform("ls", lambda s: s["line"]), joiner)
                    .alias("transcript")))
