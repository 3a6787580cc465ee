"""CSV cells with line breaks, cut anywhere between tasks, against Spark's reader of whole files and Python's csv."""

import csv
import random

import pytest

from parley.sources.quoted_csv import has_open_lines, inferred_types, quoted_lines, records
from parley.sources.tables import read_csv_unique_names, read_table, write_table

SCHEMA = "id long, t string, x double"


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(n, seed):
    r = random.Random(seed)
    bits = ["\n", "\r\n", '"', '""', ",", "a", "word ", "\n\n", "é", "x" * 90, "\\", "\n" * 30]
    return [(k, "".join(r.choice(bits) for _ in range(r.randrange(1, 12))), k / 2) for k in range(n)]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_split_anywhere(spark, tmp_path, small_parts, ends):
    rows = cells(300, 1)
    for name, some in (("a", rows[:200]), ("b", rows[200:]), ("c", [])):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=ends, quoting=csv.QUOTE_ALL)
            out.writerows([("id", "t", "x"), *some])
    path = f"{tmp_path}/*.csv"
    assert quoted_lines(spark, path).rdd.getNumPartitions() > 10 and has_open_lines(spark, path)
    got = sorted(tuple(r) for r in read_table(spark, path, schema=SCHEMA).collect())
    assert got == rows
    whole = spark.read.schema(SCHEMA).csv(path, header=True, multiLine=True, quote='"', escape='"')
    # Where lines end with both characters, Spark's reader takes them for one inside of cells too.
    assert sorted((r.id, r.t, r.x) for r in whole.collect()) == [(i, t if ends == "\n" else t.replace("\r\n", "\n"), x) for i, t, x in got]
    typed = read_table(spark, path)
    assert typed.dtypes == [("id", "int"), ("t", "string"), ("x", "double")] and sorted(tuple(r) for r in typed.collect()) == rows


def test_one_cell_over_many_blocks(spark, tmp_path, small_parts):
    rows = [(1, "begin\n" + "line\n" * 2000 + '"end"', 0.5), (2, "plain", 1.0), (3, "\n", 1.5)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("id", "t", "x"), *rows])
    assert sorted(tuple(r) for r in read_table(spark, f"{tmp_path}/a.csv", schema=SCHEMA).collect()) == rows
    assert [r.number for r in records(spark, f"{tmp_path}/a.csv").orderBy("number").collect()] == [1, 2, 3, 4]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([*cells(50, 2), (None, None, None), (60, "", None)], SCHEMA)
    path = write_table(df, "csv", f"{tmp_path}/t.csv")
    got = read_table(spark, path, schema=df.schema)
    # Without quotes around it a null is an empty cell, as Spark writes and reads it.
    whole = spark.read.schema(df.schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 52
    plan = got._jdf.queryExecution().toString()
    assert "multiLine" not in plan.split("FileScan")[-1]


def test_repeated_names_and_plain_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,id\n1,"x\ny",2\n')
    df = read_csv_unique_names(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "int"), ("t", "string"), ("id_1", "int")] and df.first().t == "x\ny"
    typed = read_csv_unique_names(spark, str(tmp_path / "a.csv"), schema="a long, b string, c double")
    assert typed.columns == ["id", "t", "id_1"] and typed.first().id_1 == 2.0
    (tmp_path / "b.csv").write_text('id,t\n1,"x ""q"""\n')
    assert not has_open_lines(spark, str(tmp_path / "b.csv"))
    assert read_table(spark, str(tmp_path / "b.csv")).first().t == 'x "q"'
    (tmp_path / "c.csv").write_text('id,t\n1,"never closed\n2,b\n')
    assert read_table(spark, str(tmp_path / "c.csv"), schema="id int, t string").count() == 1


def test_inferred_types(spark):
    df = spark.createDataFrame([("1", "3000000000", "1.5", "true", "2024-01-01 10:00:00", "x", None), (None, "1", "2", "false", "2024-01-02", "1", None)],
                               "a string, b string, c string, d string, e string, f string, g string")
    assert inferred_types(df) == ["int", "bigint", "double", "boolean", "timestamp", "string", "string"]
    assert inferred_types(df.limit(0)) == ["string"] * 7
