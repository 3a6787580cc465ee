"""Names that are too many for a constant of the plan, and the filter in front of them."""

import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.functions.bloom import bloom_filter, might_hold
from parley.functions.pii import longest_first, names_in_texts, token_for, with_names_redacted
from parley.functions.replaced import _replaced, words_replaced


def test_filter_holds_all_its_values_and_few_others(spark):
    values = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("v"))
    bloom = bloom_filter(values, "v", 1 << 18)
    assert len(bloom.first().bloom) == (1 << 18) // 64
    assert values.where(might_hold(bloom, F.col("v"), 1 << 18)).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("v"))
    assert others.where(might_hold(bloom, F.col("v"), 1 << 18)).count() < 1_000


def test_empty_filter_holds_nothing(spark):
    none = spark.createDataFrame([], "v string")
    assert spark.range(5).where(might_hold(bloom_filter(none, "v", 64), F.col("id").cast("string"), 64)).count() == 0


def by_hand(rows, names):
    out = []
    for i, t, extra in rows:
        found = sorted({w for w in re.findall(r"\w+", t or "") if w in names})
        new = t
        for n in sorted(found, key=lambda n: (-len(n), n)):
            new = new.replace(n, "[NAME]")
        out.append((i, extra, found, new))
    return sorted(out, key=repr)


def joined(spark, rows, names, most_listed):
    df = spark.createDataFrame(rows, "id int, t string, names_of string")
    listed = spark.createDataFrame([(n,) for n in names], "n string")
    out = with_names_redacted(df, "id", "t", listed, "n", "token", most_listed=most_listed)
    assert out.columns == ["id", "t", "names_of", "names_found", "redacted_text"]
    return sorted([(r.id, r.names_of, r.names_found, r.redacted_text) for r in out.collect()], key=repr)


ROWS = [(1, "Ann met Bob", "a"), (1, "Ann met Bob", "a"), (None, "Bob, Bob and Cleo", None), (2, None, "b"), (3, "", "c"),
        (None, "nobody here", "d"), (4, "Annabel is not Ann", "e")] + [(100 + i, "Ann said so", "hot") for i in range(200)]


def test_joined_equals_constant_and_loop(spark):
    names = ["Ann", "Bob", "Cleo", "Bob", "", None, "Zed"]
    want = by_hand(ROWS, {"Ann", "Bob", "Cleo", "Zed"})
    assert joined(spark, ROWS, names, 0) == want
    assert joined(spark, ROWS, names, 100) == want


def test_no_names_and_no_rows(spark):
    assert joined(spark, ROWS, [], -1) == by_hand(ROWS, set())
    assert joined(spark, [], ["Ann"], 0) == []


def test_more_names_than_a_constant_takes(spark):
    names = spark.range(300_000).select(F.concat(F.lit("name"), "id").alias("n"))
    df = spark.range(1_000).select("id", F.concat(F.lit("from name"), F.col("id") * 400, F.lit(" to other")).alias("t"))
    out = with_names_redacted(df, "id", "t", names, "n", "token")
    assert out.where(F.size("names_found") == 1).count() == 750
    assert out.where(F.col("redacted_text") == "from [NAME] to other").count() == 750


def test_a_saturated_filter_still_gives_exact_names(spark):
    names = spark.range(2_000).select(F.concat(F.lit("n"), "id").alias("n"))
    texts = spark.createDataFrame([("n5 x y n1999 z",), ("q r",)], "t string")
    assert [r.names_found for r in names_in_texts(texts, "t", names, "n", 64).collect()] == [["n1999", "n5"]]


def test_long_texts_with_many_names_take_time_by_their_length():
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in range(1_000, 1_500)]  # 10,000 names, 600,000 characters
    text = " ".join(words * 10)
    start = time.process_time()
    (got,), = [part.to_pylist() for part in _replaced(pa.array([text.encode()]), pa.array([[w.encode() for w in words]]), "NAME", "token")]
    assert got.decode() == " ".join(["[NAME]"] * 100_000)
    assert time.process_time() - start < 5  # 10,000 passes over the text take some 10 s


@pytest.mark.parametrize("mode", ["hash", "mask", "token", "remove"])
def test_names_inside_words_and_inside_tokens(spark, mode):
    """As one name after the other replaced by Spark: in longer words, across each other, in tokens, where a gap has closed."""
    hexes = [f"{i:02x}" for i in range(256)]
    text = ("NAME AM M anan ana an na nana xanay abXYcd XY abcd é éa aé été日本 本 " + " ".join(hexes) + "\U00020000b b __ a_b")
    rows = [(1, text, ["NAME", "AM", "M", "anan", "ana", "an", "na", "XY", "abcd", "é", "éa", "本", "b", "a_b", *hexes]),
            (2, text, ["M", "é"]), (3, None, ["an"]), (4, "an", []), (5, "an", None), (6, "", ["an"])]
    df = spark.createDataFrame(rows, "id int, t string, w array<string>")
    one_by_one = F.aggregate(longest_first(F.array_sort("w")), F.col("t"), lambda acc, m: F.replace(acc, m, token_for("NAME", m, mode)))
    got = df.select("id", words_replaced(F.col("t"), F.col("w"), "NAME", mode).alias("got"),
                    F.coalesce(one_by_one, "t").alias("want")).collect()
    assert len(got) == 6 and all(r.got == r.want for r in got)
