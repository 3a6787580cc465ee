"""Profiles by hashed values and by sketches that unite."""

from pyspark.sql import functions as F

from parley.operators.profiling import column_profile, infer_column_roles, merged_profile, profile_sketches

SCHEMA = "id bigint, t string, x double, tags array<string>, m map<string,int>"
ROWS = [(1, "aa", 0.0, ["a"], {"k": 1}), (2, "aa", -0.0, ["a"], {"k": 1}), (3, None, 1.5, ["a", "b"], None),
        (None, "", float("nan"), None, {"k": 2}), (5, "ccc", float("nan"), [], {"k": 2})]


def test_profile_by_hand(spark):
    got = {r.column: r for r in column_profile(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {c: (r.rows, r.non_null, r.missing, r.distinct) for c, r in got.items()} == {
        "id": (5, 4, 1, 4), "t": (5, 4, 1, 3), "x": (5, 5, 0, 3), "tags": (5, 4, 1, 3), "m": (5, 4, 1, 2)}
    assert (got["t"].avg_len, got["t"].min_len, got["t"].max_len, got["id"].avg_len) == (7 / 4, 0, 3, None)


def test_profile_of_nothing(spark):
    for exact in (True, False):
        rows = column_profile(spark.createDataFrame([], SCHEMA), exact).collect()
        assert sorted((r.column, r.rows, r.non_null, r.non_null_pct, r.distinct, r.missing) for r in rows) == [
            (c, 0, 0, None, 0, 0) for c in ("id", "m", "t", "tags", "x")]


def test_columns_named_like_the_profile(spark):
    df = spark.createDataFrame([(1, "a", 2)], "at int, h1 string, n int")
    assert {r.column: r.distinct for r in column_profile(df).collect()} == {"at": 1, "h1": 1, "n": 1}
    assert {r.column: r.distinct for r in column_profile(df, exact=False).collect()} == {"at": 1, "h1": 1, "n": 1}


def test_sketches_unite(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 700).cast("string").alias("t"))
    old, new = df.where("id < 30000"), df.where("id >= 20000")
    got = {r.column: r for r in merged_profile(profile_sketches(old).unionByName(profile_sketches(new))).collect()}
    assert (got["id"].rows, got["t"].non_null, got["t"].min_len, got["t"].max_len) == (50_000, 50_000, 1, 3)
    assert abs(got["id"].distinct - 40_000) < 2_000 and abs(got["t"].distinct - 700) < 35


def test_exact_profile_shuffles_hashes_only(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for made in (column_profile(df), infer_column_roles(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert shuffled and all("text" not in line for line in shuffled) and "Expand" not in plan
    assert "Expand" not in column_profile(df, exact=False)._jdf.queryExecution().executedPlan().toString()
