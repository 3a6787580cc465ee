"""Run history: tables of run summaries and rule hits, each run written once and read when complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.fixed_values import UNCATEGORIZED
from parley.session import materialize


def run_summary(out: DataFrame, rid, ts, secs, rules: int, pii, by: list[str] | None = None) -> DataFrame:
    """One row per run: totals, coverage, distinct values, speed. ``by`` separates several runs in one table.

    rid, ts, secs and pii are columns; inside a group they are constant or aggregates.
    """
    n, unc = F.count("*"), F.count_if(F.col("Category") == UNCATEGORIZED)
    return out.groupBy(*(by or [])).agg(
        rid.alias("rid"), ts.alias("ts"), n.alias("tot"), (n - unc).alias("cat"), unc.alias("unc"),
        F.coalesce(F.try_divide((n - unc) * 100.0, n), F.lit(0.0)).alias("pct"),
        F.count_distinct("Category").alias("ul1"), F.count_distinct("Subcategory").alias("ul2"),
        secs.alias("secs"), F.when(secs > 0, n / secs).otherwise(0.0).alias("rps"), F.lit(rules).alias("rn"),
        pii.alias("pii")).select("rid", "ts", "tot", "cat", "unc", "pct", "ul1", "ul2", "secs", "rps", "rn", "pii")


def rule_hits_summary(out: DataFrame, rid, by: list[str] | None = None) -> DataFrame:
    """Hits by rule and category."""
    return (out.where(F.col("matched_rule") != "").groupBy(*(by or []), "matched_rule", "Category")
            .agg(rid.alias("rid"), F.count("*").alias("hits"))
            .select("rid", F.col("matched_rule").alias("rule_id"), "hits", F.col("Category").alias("l1")))


def append(table: DataFrame, path: str) -> str:
    """Add the runs of ``table`` (column ``rid``) to the log at ``path``. A run that is written again, by a retry or a second
    call, takes the place of what the log has of it.

    Each run is a partition, and only partitions that are written are overwritten. When all rows are there, the runs are
    marked complete in ``path-complete``, likewise by partition; ``recorded`` reads marked runs only.
    """
    table = materialize(table, "runs")  # both tables come from the same rows, worked out once
    run = F.coalesce(F.col("rid").cast("string"), F.lit("none"))
    runs = table.select(run.alias("run")).distinct().withColumn("complete", F.lit(True))
    for rows, to in ((table.withColumn("run", run), path), (runs, f"{path}-complete")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(to)
    return path


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The complete runs of a log; a run whose writing has not come to its end is not seen."""
    # Names of runs stay words, so that 03 is not 3.
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != "run"]
    rows = spark.read.schema(T.StructType([*fields, T.StructField("run", T.StringType())])).parquet(path)
    done = spark.read.schema("complete boolean, run string").parquet(f"{path}-complete").select("run")
    return rows.join(done, "run", "left_semi").drop("run")


def history(spark: SparkSession, path: str) -> DataFrame:
    """All complete runs, newest first."""
    return recorded(spark, path).orderBy(F.col("ts").desc())


def drift(runs: DataFrame) -> DataFrame:
    """Change of coverage and speed between the last two runs; no row with fewer than two."""
    last_two = runs.orderBy(F.col("ts").desc()).limit(2)
    w = Window.orderBy("ts")
    before = last_two.select("ts", (F.col("pct") - F.lag("pct").over(w)).alias("d_pct"),
                             (F.col("rps") - F.lag("rps").over(w)).alias("d_spd"))
    return before.where("d_pct is not null").select("d_pct", "d_spd")


def rule_performance(hits: DataFrame) -> DataFrame:
    """Hits by rule and category over all runs."""
    return hits.groupBy("rule_id", "l1").agg(F.sum("hits").alias("hits"))


def never_fired(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Rules without any hit."""
    return rules.join(hits, "rule_id", "left_anti")
