"""Column functions on text: words, tokens, transcripts, speakers.

All of them are built-in expressions evaluated row by row, so they add no shuffle to a plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.fixed_values import (
    AGENT_LABELS,
    CONSUMER_FORMATS,
    CONSUMER_SIMPLE,
    CONSUMER_SIMPLE_FALLBACK,
    CUSTOMER_LABELS,
    STOP_WORDS,
    TOKEN_EDGE,
)

# Character classes spelled out, because "\w", "\s" and "\b" differ between regex dialects.
WORD_CLASS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"

SPEAKERS = {"agent": AGENT_LABELS, "customer": CUSTOMER_LABELS}


def as_text(col) -> Column:
    """Any column as a string, null as the empty string."""
    return F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit(""))


def normalize(col) -> Column:
    return F.lower(as_text(col))


def strip(col: Column) -> Column:
    """Remove white space (any Unicode kind) at both ends."""
    return F.regexp_replace(col, rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def words(col: Column) -> Column:
    """White-space separated words; no empty entries."""
    return F.regexp_extract_all(col, F.lit(rf"[^{SPACE_CLASS}]+"), F.lit(0))


def squeeze(col: Column) -> Column:
    """Words joined by single blanks."""
    return F.array_join(words(col), " ")


def word_tokens(col: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(col, F.lit(rf"[{WORD_CLASS}]+"), F.lit(0))


def tokens(col: Column) -> Column:
    """Lower-cased words without punctuation at their ends."""
    return F.transform(words(F.lower(col)), lambda w: F.btrim(w, F.lit(TOKEN_EDGE)))


def content_tokens(col: Column, min_raw_length: int = 3) -> Column:
    """Tokens which are no stop words; words shorter than ``min_raw_length`` before trimming are left out."""
    raw = F.filter(words(F.lower(col)), lambda w: F.length(w) >= min_raw_length) if min_raw_length else words(F.lower(col))
    return F.filter(F.transform(raw, lambda w: F.btrim(w, F.lit(TOKEN_EDGE))), lambda t: ~t.isin(STOP_WORDS))


def ngrams(tokens_col: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by blanks."""
    if n == 1:
        return tokens_col
    starts = F.when(F.size(tokens_col) >= n, F.sequence(F.lit(1), F.size(tokens_col) - (n - 1)))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")),
                       lambda i: F.array_join(F.slice(tokens_col, i, F.lit(n)), " "))


def _joined_segments(matches: Column, clean) -> Column:
    return F.array_join(F.filter(F.transform(matches, clean), lambda s: s != ""), " ")


def consumer_text(col: Column, style: str = "simple") -> Column:
    """What the consumer says in a labelled transcript.

    ``simple``: segments opened by ``Consumer:``; ``multi``: the first of four transcript formats that matches.
    """
    if style == "simple":
        primary = F.regexp_extract_all(F.concat(col, F.lit(" ")), F.lit(CONSUMER_SIMPLE), F.lit(1))
        fallback = F.regexp_extract_all(F.concat(col, F.lit("|")), F.lit(CONSUMER_SIMPLE_FALLBACK), F.lit(1))
        return F.when(F.size(primary) > 0, _joined_segments(primary, strip)).otherwise(
            _joined_segments(fallback, strip))
    found = [F.regexp_extract_all(col, F.lit(p), F.lit(1)) for p in CONSUMER_FORMATS]
    chain = F.lit("")
    for matches in reversed(found):
        chain = F.when(F.size(matches) > 0, _joined_segments(matches, squeeze)).otherwise(chain)
    return chain


_LINE_SPACE = r"[\t\x0b\f\x1c-\x20\x85\p{Z}]*"


def _label(names: list[str]) -> str:
    return rf"(?:{'|'.join(names)}){_LINE_SPACE}[:\-|]"


ANY_LABEL = rf"(?imd)^(?:{'|'.join(AGENT_LABELS + CUSTOMER_LABELS)})[\s\p{{Z}}]*[:\-|]"


def has_speaker_label(col: Column) -> Column:
    return F.rlike(col, F.lit(ANY_LABEL))


def speaker_text(col: Column, who: str) -> Column:
    """Lines said by one kind of speaker, joined by blanks.

    The text is cut in front of every labelled line, so a piece is a labelled line with the unlabelled lines which
    continue it; pieces of the wanted speaker are kept and lose their label.
    """
    lines = F.regexp_replace(col, r"\r\n?", "\n")
    pieces = F.split(lines, rf"(?imd)(?=^{_LINE_SPACE}{_label(AGENT_LABELS + CUSTOMER_LABELS)})")
    own = rf"(?i)^[{SPACE_CLASS}]*{_label(SPEAKERS[who])}"
    mine = F.filter(pieces, lambda p: F.rlike(p, F.lit(own)))
    said = F.transform(mine, lambda p: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(p, own, ""), r"\n$", ""),
        rf"(?md)^{_LINE_SPACE}|{_LINE_SPACE}$", ""))
    return F.translate(F.array_join(said, " "), "\n", " ")
