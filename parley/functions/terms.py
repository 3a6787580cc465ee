"""Bounded, case-insensitive term matching on lower-cased text.

A term matches where a regex would find it between word boundaries; ``*`` stands for any run of word characters. The
matcher tries a term's pattern only in texts which hold all its whole words.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import SPACE_CLASS, WORD_CLASS

_WORD = f"[{WORD_CLASS}]"


def is_word_char(ch: str) -> bool:
    category = unicodedata.category(ch)
    return category[0] in "LM" or category in ("Nd", "Nl", "Pc")


def clean_term(term: str) -> str:
    return term.strip().lower()


def quote(literal: str) -> str:
    """Escape regex metacharacters one by one; valid in every dialect used here."""
    return re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", literal)


def term_body(term: str) -> str:
    """The term as a regex, without its boundaries."""
    return f"{_WORD}*".join(quote(part) for part in clean_term(term).split("*"))


def term_pattern(term: str) -> str:
    """The term as a regex with word boundaries at both ends.

    A literal stands in front and its left boundary is checked behind it, by length: searching for a literal is much
    faster than testing a boundary at every letter.
    """
    t = clean_term(term)
    first, last, body = t[0], t[-1], term_body(t)
    right = rf"(?!{_WORD})" if last == "*" or is_word_char(last) else rf"(?={_WORD})"
    if first == "*":
        return rf"(?<!{_WORD})" + body + right
    head = quote(t.split("*")[0])
    left = rf"(?<!{_WORD}{head})" if is_word_char(first) else rf"(?<={_WORD}{head})"
    return head + left + body[len(head):] + right


def term_words(term: str) -> list[str]:
    """Whole words every matching text must contain (words touching a wildcard are left out)."""
    t = clean_term(term)
    spans = [(m.start(), m.end()) for m in re.finditer(r"\w+", t)]
    return [t[a:b] for a, b in spans if not (a > 0 and t[a - 1] == "*") and not (b < len(t) and t[b] == "*")]


def is_plain_word(term: str) -> bool:
    t = clean_term(term)
    return bool(t) and all(is_word_char(ch) for ch in t)


def term_found(term: str, lowered: Column, known: Column) -> Column:
    """Whether ``term`` occurs in ``lowered``; ``known`` holds those rule words which the text contains."""
    t = clean_term(term)
    if is_plain_word(t):
        return F.array_contains(known, t)
    found = None
    for w in dict.fromkeys(term_words(t)):
        test = F.array_contains(known, w)
        found = test if found is None else found & test
    if "*" in t:
        for part in t.split("*"):
            if part:
                test = F.contains(lowered, F.lit(part))
                found = test if found is None else found & test
    confirm = F.rlike(lowered, F.lit(term_pattern(t)))
    return confirm if found is None else found & confirm


def near_pattern(a: str, b: str, gap: int) -> str:
    """``a`` and ``b``, in either order, with at most ``gap`` words between them."""
    not_word = f"[^{WORD_CLASS}]"
    between = f"{not_word}+(?:{_WORD}+{not_word}+){{0,{gap}}}"
    pa, pb = term_pattern(a), term_pattern(b)
    return f"{pa}{between}{pb}|{pb}{between}{pa}"


def pattern_word_positions(pattern: Column, lowered: Column) -> Column:
    """For every occurrence of a term's pattern, the number of white-space words that start before it.

    One pass over the pieces between the occurrences; it carries the number of words so far and whether the text so
    far ends inside a word.
    """
    pairs = F.arrays_zip(F.split(lowered, pattern, -1).alias("piece"),
                         F.regexp_extract_all(lowered, pattern, F.lit(0)).alias("mark"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("at"))

    def advance(n, is_open, text):
        count = F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0)))
        glued = is_open & (text != "") & ~F.rlike(text, F.lit(f"^[{SPACE_CLASS}]"))
        ends_open = F.when(text == "", is_open).otherwise(~F.rlike(text, F.lit(f"[{SPACE_CLASS}]$")))
        return n + count - glued.cast("int"), ends_open

    def step(acc, pair):
        n, is_open = advance(acc["n"], acc["open"], pair["piece"])
        n2, open2 = advance(n, is_open, F.coalesce(pair["mark"], F.lit("")))
        at = F.when(pair["mark"].isNotNull(), F.concat(acc["at"], F.array(n))).otherwise(acc["at"])
        return F.struct(n2.alias("n"), open2.alias("open"), at.alias("at"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["at"])


def within_distance(left: Column, right: Column, n: int | Column, least: int = 0) -> Column:
    """Whether some entry of ``left`` and some entry of ``right`` are at most ``n`` and at least ``least`` (0 or 1) apart.

    In the merged order the closest such pair stands side by side, so neighbours are all there is to compare.
    """
    def tag(side):
        return lambda p: F.struct(p.alias("p"), F.lit(side).alias("side"))

    merged = F.array_sort(F.concat(F.transform(left, tag(0)), F.transform(right, tag(1))))
    zero = F.struct(F.lit(0).alias("p"), F.lit(-1).alias("side"), F.lit(False).alias("near"))

    def step(acc, x):
        close = (acc["side"] >= 0) & (acc["side"] != x["side"]) & (x["p"] - acc["p"] <= n) & (x["p"] - acc["p"] >= least)
        return F.struct(x["p"].alias("p"), x["side"].alias("side"), (acc["near"] | close).alias("near"))

    return F.aggregate(merged, zero, step, lambda acc: acc["near"])
