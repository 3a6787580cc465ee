"""Reading and writing tables by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import types as T

from parley.operators.shaping import unique_names
from parley.sources.quoted_csv import has_open_lines, header_of, read_quoted_csv

FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "ndjson": "json", "jsonl": "json"}


def extension(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rstrip("/").rsplit("/", 1)[-1] else ""


def read_table(spark: SparkSession, path: str, schema=None, multiline: bool | None = None) -> DataFrame:
    """Read CSV, Parquet or JSON, chosen by the extension of the path; any other extension is refused.

    A ``.json`` file is one array document unless ``multiline`` is False; ``.ndjson`` and ``.jsonl`` files hold one
    document per line and can be split between tasks. CSV can be split too: whether cells hold line breaks is found out
    by counting quotes, and if so records are put together from lines (``sources/quoted_csv.py``). ``multiline`` False
    says that no cell does, and saves the count; True leaves it to Spark's reader, which takes one task a file. With a
    ``schema`` the data is not scanned for types first.
    """
    ext = extension(path)
    if ext not in FORMATS:
        raise ValueError(f"unsupported format: {ext or path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if ext == "csv":
        if multiline is None and has_open_lines(spark, path):
            return read_quoted_csv(spark, path, unique_names(_header(spark, path)), _struct(schema))
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=bool(multiline), quote='"', escape='"')
    if ext == "parquet":
        return reader.parquet(path)
    return reader.json(path, multiLine=(ext == "json") if multiline is None else multiline)


def _struct(schema) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _header(spark: SparkSession, path: str) -> list[str]:
    return [c if c is not None else f"_c{i}" for i, c in enumerate(header_of(spark, path))]


def read_csv_unique_names(spark: SparkSession, path: str, schema=None, multiline: bool | None = None) -> DataFrame:
    """CSV whose header may repeat a name; the header is read as data, so no name is changed by the reader.

    ``schema`` gives the types in order (its names do not count); ``multiline`` as in ``read_table``.
    """
    names, made = unique_names(_header(spark, path)), _struct(schema)
    if multiline is None and has_open_lines(spark, path):
        return read_quoted_csv(spark, path, names, made).toDF(*names)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.csv(path, header=True, inferSchema=schema is None, multiLine=bool(multiline), quote='"',
                      escape='"').toDF(*names)


def write_table(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists") -> str:
    """Write CSV (all fields quoted), snappy Parquet or newline-delimited JSON; returns the path."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
    elif fmt == "parquet":
        writer.parquet(path, compression="snappy")
    elif fmt == "json":
        writer.json(path, ignoreNullFields=False)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return path


def land(df: DataFrame, path: str) -> DataFrame:
    """Write text input once as Parquet and go on from there; worth it for anything read more than once."""
    write_table(df, "parquet", path)
    return df.sparkSession.read.parquet(path)
