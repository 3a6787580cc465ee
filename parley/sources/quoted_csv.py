"""CSV whose cells may hold line breaks, read by many tasks.

A line feed ends a record only if an even number of quotes lies before it in its file. Lines are read as text, split
between tasks anywhere; quotes are counted a line, added up a block of the file, and the blocks' running sums tell each
block in which state it begins. Inside a block, running sums over its own lines do the rest. Only records that reach over
the border of two blocks are put together by a second, small grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
OPTIONS = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true"}


def quoted_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files: ``file``, ``block`` (where the task's part of the file begins), ``value`` and ``odd``, 1 for an
    odd number of quotes. Lines end at line feeds; a carriage return in front of one stays."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(QUOTE), F.lit("")))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        "value", (quotes % 2).alias("odd"))


def has_open_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether any line ends inside a quoted cell. Without one, every line is a record."""
    return not quoted_lines(spark, path).where("odd = 1").isEmpty()


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``number`` (from 1 in each file) and ``record``, the text of each record without its last line break.

    The lines are shuffled once, by file and block, so that a task orders at most what one task has read. A file may so
    be of any size; a record has to fit in memory. A quote that is never closed makes one record of the rest of its file.
    Empty lines outside of quotes are records without text.
    """
    # A task reads its blocks in order, so rising row numbers are the order of the lines of a block.
    lines = quoted_lines(spark, path).withColumn("row", F.monotonically_increasing_id())
    inside = Window.partitionBy("file", "block").orderBy("row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("state", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    # A line begins a record if its block begins in the state that makes the quotes before it even.
    lines = lines.withColumn("n0", F.sum(1 - F.col("state")).over(inside)).withColumn("n1", F.sum("state").over(inside))
    blocks = (lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
              .withColumn("begin", F.coalesce(F.sum("odd").over(Window.partitionBy("file").orderBy("block")
                                                                .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
              .withColumn("own", F.when(F.col("begin") == 0, F.col("n0")).otherwise(F.col("n1")))
              .withColumn("ahead", F.coalesce(F.sum("own").over(Window.partitionBy("file").orderBy("block")
                                                                 .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("file", "block", "begin", "ahead", F.col("own").alias("last")))
    # The number of a record in its block; 0 is the end of a record that an earlier block began.
    parts = (lines.join(blocks, ["file", "block"])
             .withColumn("k", F.when(F.col("begin") == 0, F.col("n0")).otherwise(F.col("n1")))
             .groupBy("file", "block", "k", "ahead", "last")
             .agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("x"))
             .select("file", "block", (F.col("ahead") + F.col("k")).alias("number"),
                     ((F.col("k") > 0) & (F.col("k") < F.col("last"))).alias("whole"),
                     F.array_join(F.transform("x", lambda v: v["value"]), "\n").alias("record")))
    border = (parts.where("NOT whole").groupBy("file", "number")
              .agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("x"))
              .select("file", "number", F.array_join(F.transform("x", lambda v: v["record"]), "\n").alias("record")))
    done = parts.where("whole").select("file", "number", "record").unionByName(border)
    return done.withColumn("record", F.regexp_replace("record", "\r$", ""))


def header_of(spark: SparkSession, path: str | list[str]) -> list[str | None]:
    """The cells of the first record of the first file; a line break in a name is no matter."""
    first = spark.read.csv(path, header=False, **OPTIONS).first()
    return list(first) if first is not None else []


# In the order in which they are tried.
_TYPES = ["int", "bigint", "double", "timestamp", "boolean"]


def _as_type(col: Column, kind: str) -> Column:
    return col.try_cast(kind)


def inferred_types(table: DataFrame) -> list[str]:
    """For each column, the first of int, bigint, double, timestamp and boolean that all its values have, else string;
    one aggregate over the whole table."""
    if not table.columns:
        return []
    tests = [F.bool_and(F.col(f"`{c}`").isNull() | _as_type(F.col(f"`{c}`"), kind).isNotNull()).alias(f"{k}_{kind}")
             for k, c in enumerate(table.columns) for kind in _TYPES]
    filled = [F.count(f"`{c}`").alias(f"{k}_n") for k, c in enumerate(table.columns)]
    r = table.agg(*tests, *filled).first()
    return [next((kind for kind in _TYPES if r[f"{k}_n"] and r[f"{k}_{kind}"]), "string") for k in range(len(table.columns))]


def read_quoted_csv(spark: SparkSession, path: str | list[str], names: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The table of CSV files with a header each. With a ``schema`` its columns are taken by place; without one, types
    are looked for in all rows."""
    made = schema if schema is not None else T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    rows = records(spark, path).where((F.col("number") > 1) & (F.trim("record") != ""))
    ddl = ", ".join(f"`c{k}` {f.dataType.simpleString()}" for k, f in enumerate(made.fields))
    table = (rows.select(F.from_csv("record", ddl, OPTIONS).alias("r"))
             .select(*[F.col(f"r.c{k}") for k in range(len(made.fields))]))
    if schema is not None:
        return table.toDF(*schema.names)
    kinds = inferred_types(table)
    return table.select(*[F.col(f"c{k}").cast(kind) for k, kind in enumerate(kinds)]).toDF(*names)
