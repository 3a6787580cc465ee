"""Exact top lists from summaries, a recount and its proof."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import frequent
from parley.operators.frequent import candidates, most_frequent, open_buckets, recounted


def by_hand(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda p: (-p[1], p[0]))[:k]


def skewed(spark, rows=60_000):
    """Some words hold a large share of all rows; half of the rows are words that occur once."""
    at = F.col("id")
    word = (F.when(at % 3 == 0, F.lit("hot")).when(at % 6 < 3, F.concat(F.lit("w"), F.floor(F.sqrt(at % 900)).cast("string")))
            .otherwise(F.concat(F.lit("rare"), at.cast("string"))))
    return spark.range(0, rows, 1, 6).select(word.alias("word"))


CASES = {
    "ties": ["b", "a", "c", "a", "b", "c", "d"],
    "fewer than k": ["x", None, "x", ""],
    "flat": [f"v{i}" for i in range(3000)],
    "nearly flat": [f"v{i % 700}" for i in range(5000)],
    "long": ["y" * 5000] * 9 + ["z" * 300] * 8 + ["s"] * 3 + ["y" * 4999] * 9,
    "nulls only": [None, None],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_values_against_a_loop(spark, case):
    rows = spark.createDataFrame([(v,) for v in CASES[case]], "word string").repartition(3)
    for tracked, buckets in ((frequent.TRACKED, frequent.BUCKETS), (16, 8)):
        got = most_frequent(rows, "word", 5, tracked=tracked, buckets=buckets).collect()
        assert [(r.word, r.Count) for r in sorted(got, key=lambda r: r.place)] == by_hand(CASES[case], 5)


def test_groups_null_groups_and_further_columns(spark):
    rows = skewed(spark).withColumn("side", F.when(F.length("word") % 3 == 0, "a").when(F.length("word") % 3 == 1, "b"))
    rows = rows.withColumn("count", F.lit(1)).withColumn("place", F.lit("p"))
    values = [(r.side, r.word) for r in rows.collect()]
    for tracked, buckets in ((frequent.TRACKED, frequent.BUCKETS), (32, 16)):
        got = most_frequent(rows, "word", 7, by=["side"], tracked=tracked, buckets=buckets).collect()
        for side in ("a", "b", None):
            mine = sorted((r for r in got if r.side == side), key=lambda r: r.place)
            assert [(r.word, r.Count) for r in mine] == by_hand([w for s, w in values if s == side], 7)


def test_candidates_are_proven_and_few_rows_are_shuffled(spark):
    rows = skewed(spark)
    found = candidates(rows, "word", [], 100)
    counts = recounted(rows, "word", [], 10, found)
    assert open_buckets(counts, []).count() == 0  # nothing else can be among the first ten
    assert found.count() <= 100
    small = recounted(rows, "word", [], 10, found, buckets=64)
    assert small.count() <= 64 + 100  # however many different words there are (20,000 here)
    assert small.agg(F.sum("Count")).first()[0] == 60_000


def test_no_third_reading_when_proven(spark):
    top = most_frequent(skewed(spark), "word", 10)
    top.collect()
    final = top._jdf.queryExecution().executedPlan().toString()
    final = final[final.index("Final Plan"):final.index("Initial Plan")] if "Initial Plan" in final else final
    assert final.count("Range (0, 60000") == 2


def test_wrong_candidates_do_no_harm(spark):
    rows = skewed(spark)
    wrong = spark.createDataFrame([("w1",), ("nowhere",)], "__listed string")
    counts = recounted(rows, "word", [], 2, wrong)
    assert open_buckets(counts, []).count() > 10_000  # fewer than two candidates occur: all buckets stay open


def test_rows_are_worked_out_once(spark):
    """Words and neighbours are read twice, three times where counts are flat, but what makes the texts runs once."""
    from parley.operators.concordance import collocations
    from parley.operators.reports import top_ngrams

    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 3000, numPartitions=4).selectExpr("concat('word', id % 700) AS t").mapInArrow(make, "t string")
    want = [(f"word{k}", 5) for k in sorted(range(200), key=str)[:5]]
    assert [(r.ngram, r.Count) for r in top_ngrams(rows, 1, 5, "t").collect()] == want and made.value == 3000
    got = collocations(rows.selectExpr("t AS Left", "t AS Right"), 5, 0).where("side = 'left'").orderBy("place").collect()
    assert [(r.word, r["count"]) for r in got] == want and made.value == 6000
    none = rows.where("t = ''")
    assert top_ngrams(none, 1, 5, "t").count() == 0
    assert collocations(none.selectExpr("t AS Left", "t AS Right"), 5).count() == 0
