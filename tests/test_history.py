"""The run log: written twice it is read once, half-written not at all."""

from pyspark.sql import functions as F

from parley.operators.history import append, history, recorded


def table(spark, rows):
    return spark.createDataFrame(rows, "rid string, ts long, tot long")


def test_written_twice_read_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    append(table(spark, [("1", 10, 5), ("2", 20, 7)]), path)
    append(table(spark, [("2", 20, 7)]), path)
    append(table(spark, [("03", 30, 1), ("a/b", 40, 2)]), path)
    assert [tuple(r) for r in history(spark, path).collect()] == [("a/b", 40, 2), ("03", 30, 1), ("2", 20, 7), ("1", 10, 5)]
    append(table(spark, [("2", 21, 8), ("2", 22, 9)]), path)
    assert sorted(tuple(r) for r in recorded(spark, path).where("rid = '2'").collect()) == [("2", 21, 8), ("2", 22, 9)]


def test_half_written_run_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/log"
    append(table(spark, [("1", 10, 5), ("03", 5, 1)]), path)
    # What a writer that ended before its mark leaves behind.
    table(spark, [("2", 20, 7), ("x", 1, 1)]).withColumn("run", F.col("rid")).write.mode("append").partitionBy("run").parquet(path)
    assert sorted(r.rid for r in recorded(spark, path).collect()) == ["03", "1"]
    append(table(spark, [("2", 20, 8), (None, 30, 9)]), path)
    assert sorted((r.rid or "", r.tot) for r in recorded(spark, path).collect()) == [("", 9), ("03", 1), ("1", 5), ("2", 8)]
