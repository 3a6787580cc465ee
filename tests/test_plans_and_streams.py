"""How often reports read their input, long lists of names and companies, and streams over several arrivals."""

import re

import pytest
from pyspark.sql import functions as F

from parley.functions.pii import with_names_redacted
from parley.operators import reports as R
from parley.operators.scorers import detect_industry
from parley.plans.runs import classify_run
from parley.streaming.classify_stream import category_trend_stream, stream_classify, trend_table

RULES = [{"rule_id": "A", "conditions": "alpha", "l1": "First"}]


@pytest.fixture(scope="module")
def classified(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reports") / "rows")
    rows = [(k, c, s, d) for k, (c, s, d) in enumerate(
        [("A", "x", "2024-01-01"), ("A", "y", "2024-01-05"), ("B", "x", "2024-01-09"), ("Uncategorized", "NA", "2024-01-03"),
         (None, None, None)] * 50)]
    spark.createDataFrame(rows, "Conversation_ID int, Category string, Subcategory string, day string").write.parquet(path)
    return spark.read.parquet(path)


def run_and_count_scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in plan
    return len(re.findall(r"FileScan parquet", plan)), plan


def test_reports_read_their_input_once(spark, classified):
    assert run_and_count_scans(R.analytics_sql(classified))[0] == 1
    paths = classified.withColumns({"L3": F.lit("NA"), "L4": F.lit("NA"), "match_score": F.lit(50)})
    for df in (R.level_table(classified, "Category"), R.level_table(classified, "Subcategory", "Category"),
               R.level_table_of_parent(classified, "Subcategory", ["Category"]), R.path_distribution(paths, 2),
               R.top5(classified), R.sunburst_counts(paths), R.narrative_facts(paths),
               R.category_trend(classified, "day", "Category", "day"),
               R.top_movers(classified, "day", "Category", "2024-01-04")):
        scans, plan = run_and_count_scans(df)
        assert scans == 1, plan


def test_reports_of_an_empty_table(spark, classified):
    none = classified.limit(0)
    assert {r.name: r.n for r in R.analytics_sql(none).collect()} == {
        "total_records": 0, "unique_l1_categories": 0, "unique_l2_categories": 0}
    assert R.level_table(none, "Category").collect() == []
    assert R.top_movers(none, "day", "Category", "2024-01-04").collect() == []


def test_movers_on_both_sides(spark, classified):
    rows = R.top_movers(classified, "day", "Category", "2024-01-04", n=1).collect()
    assert [(r.Side, r.Category, r.Change) for r in rows] == [("gain", "B", 50), ("loss", "A", 0)]


def test_long_list_of_names(spark):
    texts = [(1, "Ann met Zoë and name77 twice: name77"), (1, "nobody"), (None, "Ann"), (3, None), (4, "")]
    names = spark.range(120_000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("n")).union(
        spark.createDataFrame([("Ann",), ("Zoë",), (None,), ("",), ("Ann",)], "n string"))
    got = with_names_redacted(spark.createDataFrame(texts, "id int, t string"), "id", "t", names, "n", "token").collect()
    assert sorted((str(r.t), r.names_found, r.redacted_text) for r in got) == sorted([
        ("Ann met Zoë and name77 twice: name77", ["Ann", "Zoë", "name77"], "[NAME] met [NAME] and [NAME] twice: [NAME]"),
        ("nobody", [], "nobody"), ("Ann", ["Ann"], "[NAME]"), ("None", [], None), ("", [], "")])


def test_long_map_of_companies(spark):
    many = spark.range(110_000).select(F.lit(5).alias("industry_no"), F.lit("Many").alias("industry"), F.col("id").alias(
        "company_no"), F.concat(F.lit("Firm "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" Ltd")).alias("company"))
    first = spark.createDataFrame([(1, "Bank", 0, "Acme"), (0, "Food", 7, "Acme Foods"), (2, "None", 0, " "), (2, "None", 1, None)],
                                  "industry_no int, industry string, company_no long, company string")
    cases = [("ACME", "Food"), ("the acme shop", "Bank"), ("firm 000042 ltd", "Many"), ("000042", "Many"), ("unheard of", None),
             ("  ", None), (None, None), ("x firm 109999 ltd x", "Many"), ("ACME", "Food")]
    rows = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(cases)], "id int, name string")
    got = {r.id: r.industry for r in detect_industry(rows, "name", first.unionByName(many)).collect()}
    assert got == {k: i for k, (_, i) in enumerate(cases)}


def arrivals(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        yield spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), str(folder)


def test_trend_over_arrivals_in_any_order(spark, tmp_path):
    schema = "ts timestamp_ntz, Category string"
    from datetime import datetime as d

    batches = [[(d(2024, 5, 9, 1), "A"), (d(2024, 5, 9, 2), "A")], [(d(2024, 1, 1), "A"), (d(2024, 5, 9), "B")],
               [(d(2024, 3, 1), "NA"), (None, "A")]]
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    for stream, folder in arrivals(spark, tmp_path, batches, schema):
        category_trend_stream(stream, "ts", "Category", "1 day", sink, check).awaitTermination()
    got = sorted(tuple(r) for r in trend_table(spark, sink, "Category").collect())
    assert got == [(d(2024, 1, 1), "A", 1), (d(2024, 5, 9), "A", 2), (d(2024, 5, 9), "B", 1)]


def test_classified_arrivals_equal_one_run(spark, tmp_path):
    schema = "id int, text string"
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    batches = [[(1, "alpha beta"), (2, "gamma")], [(2, "alpha"), (None, None)]]
    for stream, folder in arrivals(spark, tmp_path, batches, schema):
        stream_classify(stream, RULES, "id", "text", sink, check).awaitTermination()
    once = classify_run(spark.read.schema(schema).parquet(folder), RULES, "id", "text")
    got = spark.read.parquet(sink)
    assert got.count() == 4
    cols = [c for c in got.columns if c in once.columns and not c.startswith("pii_counts")]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, once.select(cols).collect()))
