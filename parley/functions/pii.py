"""Personal-data detection and redaction as built-in column expressions.

Each detector finds its matches in the text left by the previous one; every valid match is replaced wherever it
occurs literally, and every valid match adds one to the count. A cheap test in front of each detector keeps texts
which cannot match away from the expensive pattern; it never changes the result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import fixed_values as fv
from parley.functions.bloom import BITS, bloom_filter, might_hold
from parley.functions.once import constant, once
from parley.functions.replaced import words_replaced
from parley.functions.text import WORD_CLASS
from parley.session import materialize

MODES = ("hash", "mask", "token", "remove")


def luhn_ok(col: Column) -> Column:
    """Check digit test for numbers of 13 to 19 digits."""
    digits = F.reverse(F.regexp_replace(col, "[^0-9]", ""))
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))
    return F.when((n >= 13) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def ssn_ok(col: Column) -> Column:
    return ~F.rlike(col, F.lit(r"^(000|666|9)|-00-|-0000$"))


def dob_ok(col: Column) -> Column:
    """The year is not in the future; the pattern already starts at 1900."""
    return F.substring(col, -4, 4).cast("int") <= F.year(F.current_date())


def ip_ok(col: Column) -> Column:
    return F.forall(F.split(col, r"\."), lambda part: part.cast("int") <= 255)


Gate = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Detector:
    """A pattern, the check its matches must pass, and a cheap necessary test (text, text holds a digit)."""

    kind: str
    pattern: str
    gate: Gate
    group: int = 0
    valid: Callable[[Column], Column] | None = None
    only_up_to: str | None = None
    longest_first: bool = False

    def matches(self, text: Column, has_digit: Column) -> Column:
        """Valid matches in order of occurrence, repeats included."""
        searched = F.regexp_extract(text, self.only_up_to, 0) if self.only_up_to else text
        found = F.regexp_extract_all(searched, F.lit(self.pattern), F.lit(self.group))
        if self.valid is not None:
            found = F.filter(found, self.valid)
        if self.longest_first:
            found = longest_first(found)
        return F.when(self.gate(text, has_digit), found).otherwise(F.array().cast("array<string>"))


def longest_first(values: Column) -> Column:
    sized = F.transform(values, lambda m: F.struct(F.length(m).alias("l"), m.alias("v")))
    return F.transform(F.reverse(F.array_sort(sized)), lambda m: m["v"])


def _with_digit(pattern: str) -> Gate:
    return lambda text, has_digit: has_digit & F.rlike(text, F.lit(pattern))


def _holds_any(needles: list[str]) -> Gate:
    def held(lowered):
        test = F.contains(lowered, F.lit(needles[0]))
        for needle in needles[1:]:
            test = test | F.contains(lowered, F.lit(needle))
        return test
    # In an array, so that the text is lowered once and not again for each needle.
    return lambda text, _: F.exists(F.array(F.lower(text)), held)


def _address_gate(text: Column, has_digit: Column) -> Column:
    street = F.lit(rf"(?i)(?:{fv.ADDRESS_SUFFIXES})\b")
    return has_digit & F.rlike(text, F.lit(r"\d\s+[A-Za-z0-9\s,.-]")) & F.rlike(text, street)


_EMAIL = Detector("EMAIL", fv.EMAIL, lambda text, _: F.contains(text, F.lit("@")))
_PHONES = [Detector("PHONE", p, _with_digit(r"\d{3}[-.]?\d{4}")) for p in fv.PHONES]
_CARD = Detector("CARD", fv.CARD, _with_digit(r"\d{13}"), valid=luhn_ok)
_CARDS = [Detector("CARD", p, _with_digit(r"\d{13}"), valid=luhn_ok) for p in fv.CARD_BRANDS]
_SSN = Detector("SSN", fv.SSN, _with_digit(r"\d-\d{2}-\d"), valid=ssn_ok)
_DOB = Detector("DOB", fv.DOB, _with_digit(r"\d[/-]\d{2}[/-]\d{4}"))
_DOB_CHECKED = Detector("DOB", fv.DOB, _with_digit(r"\d[/-]\d{2}[/-]\d{4}"), valid=dob_ok)
_MRN = Detector("MRN", fv.MRN, _holds_any(["mrn", "medical record"]), group=1)
_IP = Detector("IP", fv.IP, _with_digit(r"\d\.\d{1,3}\.\d"), valid=ip_ok)
# An address ends with a street word, so nothing behind the last street word can matter.
_ADDRESS = Detector("ADDRESS", fv.ADDRESS, _address_gate, only_up_to=rf"(?is)^.*(?:{fv.ADDRESS_SUFFIXES})\b")
# Longer names first, so that "covid-19" is not read as "covid".
_CONDITION = Detector("CONDITION", "(?i)" + "|".join(sorted(fv.CONDITIONS, key=lambda c: -len(c))),
                      _holds_any(fv.CONDITIONS), longest_first=True)

PROFILES: dict[str, list[Detector]] = {
    "validated": [_EMAIL, *_PHONES, _CARD, _SSN, _DOB, _MRN, _IP, _ADDRESS],
    "full": [_EMAIL, *_CARDS, _SSN, *_PHONES, _DOB_CHECKED, _MRN, _IP, _ADDRESS, _CONDITION],
    "fast": [_EMAIL, *_PHONES],
}
SINGLE: dict[str, list[Detector]] = {
    "EMAIL": [_EMAIL], "PHONE": _PHONES, "CARD": [_CARD], "SSN": [_SSN], "DOB": [_DOB], "DOB_CHECKED": [_DOB_CHECKED],
    "MRN": [_MRN], "IP": [_IP], "ADDRESS": [_ADDRESS], "CONDITION": [_CONDITION],
}


def token_for(kind: str, value: Column, mode: str) -> Column:
    """What stands in for a value; an unknown mode means ``hash``."""
    if mode == "mask":
        return F.lit(f"[{kind}:{'*' * 10}]")
    if mode == "token":
        return F.lit(f"[{kind}]")
    if mode == "remove":
        return F.lit("")
    return F.concat(F.lit(f"[{kind}:"), F.left(F.sha2(value, 256), F.lit(8)), F.lit("]"))


def replace_all(text: Column, values: Column, kind: str, mode: str) -> Column:
    """Replace the values one after the other, each at all of its places."""
    return F.when(F.size(values) == 0, text).otherwise(
        F.aggregate(values, text, lambda acc, m: F.replace(acc, m, token_for(kind, m, mode))))


def with_redaction(df, text_col: str, detectors: list[Detector] | str = "validated", mode: str = "hash",
                   redacted_col: str = "redacted_text", found_col: str = "pii_found"):
    """Add the redacted text and one count per detector (an array aligned with ``detectors``).

    The steps are separate projections, as each detector reads what the previous one left.
    """
    chain = PROFILES[detectors] if isinstance(detectors, str) else detectors
    out = df.withColumn(redacted_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # Replacement tokens stand in brackets, so they never make up a number which was not there before.
    out = out.withColumn("__digit", F.rlike(redacted_col, F.lit("[0-9]")))
    counts = []
    for i, detector in enumerate(chain):
        hits, count = f"__hits_{i}", f"__n_{i}"
        out = out.withColumn(hits, once(detector.matches(F.col(redacted_col), F.col("__digit"))))
        out = out.withColumns({
            redacted_col: once(replace_all(F.col(redacted_col), F.col(hits), detector.kind, mode)),
            count: F.size(hits),
        }).drop(hits)
        counts.append(count)
    return out.withColumn(found_col, F.array(*counts)).drop("__digit", *counts)


def pii_columns(df, text_col: str, profile: str = "validated", mode: str = "hash"):
    """Add ``redacted_text``, ``pii_counts`` (type to count, zeros left out), ``total_items``, ``pii_detected``."""
    chain = PROFILES[profile]
    out = with_redaction(df, text_col, chain, mode)
    kinds = list(dict.fromkeys(d.kind for d in chain))
    per_kind = []
    for kind in kinds:
        parts = [F.get(F.col("pii_found"), F.lit(i)) for i, d in enumerate(chain) if d.kind == kind]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        per_kind.append(total)
    pairs = F.map_from_arrays(F.array(*[F.lit(fv.PII_COUNTERS[k]) for k in kinds]), F.array(*per_kind))
    return (out.withColumn("pii_counts", F.map_filter(pairs, lambda _, n: n > 0))
            .withColumn("total_items", once(F.aggregate("pii_found", F.lit(0), lambda a, n: a + n)))
            .withColumn("pii_detected", F.col("total_items") > 0)
            .drop("pii_found"))


def with_hardened_redaction(df, text_col: str, mode: str = "hash", redacted_col: str = "redacted_text"):
    """Add the text after pattern-only redaction in a fixed order, without validation."""
    tags = {kind: f"[{kind}]" if mode == "token" else f"[{kind}:REDACTED]" for kind, _ in fv.HARDENED}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    for kind, pattern in fv.HARDENED:
        if kind != "ADDR":
            text = F.regexp_replace(text, pattern, tags[kind])
    address = dict(fv.HARDENED)["ADDR"]
    street = address[address.rindex("(?:"):]
    # Only the text up to the last street word can hold an address.
    done = F.col("__done")
    head = F.regexp_extract(done, rf"(?s)^.*{street}", 0)
    return (df.withColumn("__done", once(text))
            .withColumn("__head", F.when(F.rlike(done, F.lit(street)), head).otherwise(F.lit("")))
            .withColumn(redacted_col, F.concat(F.regexp_replace("__head", address, tags["ADDR"]),
                                               F.substring(done, F.length("__head") + 1, F.length(done))))
            .drop("__done", "__head"))


MOST_LISTED = 10_000  # names in a constant of the plan; longer lists stay on Spark
SALTS = 16
HOT_SHARE = 10_000


def with_names_redacted(df, id_col: str, text_col: str, names, name_col: str, mode: str = "hash",
                        most_listed: int = MOST_LISTED):
    """Redact the words which a table of names holds; adds ``redacted_text`` and ``names_found``.

    Up to ``most_listed`` names become a constant of the plan, a table by a hash of the name, in which every text looks
    up its own words: no shuffle and no join. More names, in any number, are never collected: ``names_in_texts`` finds
    them. Each row is decided by its text alone, so ``id_col`` may repeat or be null. Texts that are null stay null.
    """
    text = F.col(text_col)
    listed = names.select(F.col(name_col).cast("string").alias("n")).where("n <> ''").distinct()
    few = [r.n for r in listed.take(most_listed + 1)]
    if len(few) <= most_listed:
        rows = df.withColumn("names_found", once(F.sort_array(F.filter(_said(text), _in_constant(few)))))
    else:
        rows = df.withColumn("__text_key", _text_key(text))
        hot = F.broadcast(_of_many_rows(rows.where(text.isNotNull()).groupBy("__text_key").agg(F.count("*").alias("n")))
                          .select("__text_key", F.lit(True).alias("__hot")))
        # The salt is made of the other columns, so that copies of one text do not meet in one task.
        others = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != text_col and f.dataType.typeName() != "map"]
        salt = F.pmod(F.xxhash64(F.lit(0), *others), F.lit(SALTS)).cast("int")
        rows = (rows.join(hot, "__text_key", "left")
                .withColumn("__salt", F.when(F.col("__hot") | text.isNull(), salt).otherwise(F.lit(0))).drop("__hot"))
        salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        found = (names_in_texts(df.select(text.alias("t")), "t", listed, "n").join(hot, "__text_key", "left")
                 .withColumn("__salt", F.explode(salts)).drop("__hot"))
        rows = (rows.join(found, ["__text_key", "__salt"], "left").drop("__text_key", "__salt")
                .withColumn("names_found", F.coalesce("names_found", F.array().cast("array<string>"))))
    return rows.withColumn("redacted_text", words_replaced(text, F.col("names_found"), "NAME", mode))


def _of_many_rows(counts):
    """Rows of ``counts`` whose ``n`` is more than one in ``HOT_SHARE`` of all: fewer than ``HOT_SHARE``."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.col("n") * HOT_SHARE > F.col("total"))


def _said(text: Column) -> Column:
    """The different words of a text; cutting at what lies between them is faster than finding them."""
    return F.coalesce(F.array_distinct(F.array_remove(F.split(text, f"[^{WORD_CLASS}]+", -1), "")), F.array().cast("array<string>"))


def _in_constant(listed: list[str]):
    buckets = [[] for _ in range(2 * len(listed) + 1)]
    for name in sorted(listed):
        buckets[zlib.crc32(name.encode()) % len(buckets)].append(name)
    table = constant(buckets, "array<array<string>>")
    return lambda w: F.array_contains(F.get(table, F.pmod(F.crc32(w), F.lit(len(buckets))).cast("int")), w)


def _text_key(text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)))


def names_in_texts(texts, text_col: str, names, name_col: str, bits: int = BITS):
    """One row per different text with a listed name: ``__text_key`` (128 bits of hash), ``names_found`` (sorted).

    Words that pass a Bloom filter of the names are the only ones that leave their task, one a text and word. The words
    that pass are counted; those of more than one row in ``HOT_SHARE`` are so few that their names are broadcast, the
    others meet the names by an equi-join.
    """
    text, word = F.col(text_col), F.col("word")
    bloom = bloom_filter(names, name_col, bits)
    # Key and words are made before the words become rows, and so once a text; behind ``explode`` a filter would copy them.
    said = (texts.where(text.isNotNull()).select(_text_key(text).alias("__text_key"), _said(text).alias("__said"))
            .select("__text_key", F.explode_outer("__said").alias("word")).where(word.isNotNull()))
    passed = materialize(said.where(might_hold(bloom, word, bits)).distinct(), "names")
    counts = passed.groupBy("word").agg(F.count("*").alias("n"))
    hot = _of_many_rows(counts).select("word")
    listed = names.select(F.col(name_col).alias("word"))
    hot_names = F.broadcast(listed.join(F.broadcast(hot), "word", "left_semi").distinct())
    few = passed.join(F.broadcast(hot), "word", "left_anti").join(listed.distinct().hint("merge"), "word", "left_semi")
    many = passed.join(hot_names, "word", "left_semi")
    return (many.unionByName(few).groupBy("__text_key")
            .agg(F.sort_array(F.collect_list("word")).alias("names_found")))

