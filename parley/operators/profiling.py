"""Checks and profiles of an input table, each one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.fixed_values import COMPANY_HINTS, ID_HINTS

_TEXT = (T.StringType,)
_NUMERIC = (T.NumericType,)
SKETCH = 12  # binary logarithm of the buckets of a sketch


def validate_input(df: DataFrame, required: list[str], text_col: str, max_rows: int = 50_000,
                   min_avg_chars: float = 10) -> DataFrame:
    """One row per check: check, ok, value; one aggregate over the whole table."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        return df.sparkSession.createDataFrame([("columns_present", False, float(len(missing)))],
                                               "check string, ok boolean, value double")
    totals = df.agg(F.count("*").alias("n"), F.count_if(F.col(text_col).isNull()).alias("nulls"),
                    F.avg(F.length(F.col(text_col).cast("string"))).alias("chars"))
    n, nulls = F.col("n"), F.col("nulls")
    checks = [
        ("columns_present", F.lit(True), F.lit(0.0)),
        ("not_empty", n > 0, n),
        ("row_limit", n <= max_rows, n),
        ("not_all_null", nulls < n, nulls),
        ("mostly_filled", nulls <= n * 0.5, nulls),
        ("long_enough", F.coalesce(F.col("chars") >= min_avg_chars, F.lit(False)),
         F.coalesce(F.col("chars"), F.lit(0.0))),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("check"), ok.alias("ok"), v.cast("double").alias("value"))
                     for name, ok, v in checks])
    return totals.select(F.inline(rows))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: type, non-null rows and share, distinct and missing values, text lengths; a row for every column, of
    an empty table too.

    ``exact``: each value becomes 128 bits of hash, and equal ones are counted before and after one shuffle; the values
    themselves, whole texts among them, stay where they are. Otherwise the distinct values are estimated by sketches
    (about 2 %) in one aggregate without a shuffle of values; see ``profile_sketches``.
    """
    if not exact:
        return merged_profile(profile_sketches(df))
    values = []
    for i, f in enumerate(df.schema.fields):
        c = _hashable(f)
        hashes = [F.when(c.isNotNull(), h) for h in (F.xxhash64(c), F.xxhash64(F.lit(1), c))]
        length = F.length(c) if isinstance(f.dataType, _TEXT) else F.lit(None).cast("int")
        values.append(F.struct(F.lit(i).alias("at"), hashes[0].alias("h1"), hashes[1].alias("h2"), length.alias("len")))
    n, held = F.col("n"), F.col("h1").isNotNull()
    facts = (df.select(F.inline(F.array(*values))).groupBy("at", "h1", "h2")
             .agg(F.count("*").alias("n"), F.max("len").alias("len")).groupBy("at")
             .agg(F.sum(n).alias("rows"), F.sum(F.when(held, n)).alias("filled"), F.count_if(held).alias("distinct"),
                  F.sum(n * F.col("len")).alias("chars"), F.min("len").alias("min_len"), F.max("len").alias("max_len")))
    return _profile_rows(_columns(df).join(facts, "at", "left"))


def _hashable(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return F.to_json(c) if isinstance(f.dataType, T.MapType) else c


def _columns(df: DataFrame) -> DataFrame:
    """One row per column: its place, name and kind."""
    rows = [F.struct(F.lit(i).alias("at"), F.lit(f.name).alias("column"), F.lit(_kind(f.dataType)).alias("type"))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _profile_rows(facts: DataFrame) -> DataFrame:
    rows, filled = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("rows", "filled"))
    return facts.select(
        "column", "type", filled.alias("non_null"), F.try_divide(filled * 100.0, rows).alias("non_null_pct"),
        F.coalesce("distinct", F.lit(0).cast("bigint")).alias("distinct"), (rows - filled).alias("missing"),
        F.try_divide("chars", "filled").alias("avg_len"), "min_len", "max_len", rows.alias("rows"))


def profile_sketches(df: DataFrame) -> DataFrame:
    """What a profile is made of, to be stored next to the files it describes: a row per column with counts, lengths and
    a HyperLogLog sketch of the values. One aggregate, every task gives one row."""
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = _hashable(f)
        aggs += [F.count(c).alias(f"filled_{i}"),
                 F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), SKETCH).alias(f"sketch_{i}")]
        if isinstance(f.dataType, _TEXT):
            aggs += [F.sum(F.length(c)).alias(f"chars_{i}"), F.min(F.length(c)).alias(f"min_{i}"),
                     F.max(F.length(c)).alias(f"max_{i}")]
    rows = []
    for i, f in enumerate(df.schema.fields):
        text = isinstance(f.dataType, _TEXT)
        rows.append(F.struct(
            F.lit(i).alias("at"), F.lit(f.name).alias("column"), F.lit(_kind(f.dataType)).alias("type"),
            F.col("n").alias("rows"), F.col(f"filled_{i}").alias("filled"),
            (F.col(f"chars_{i}") if text else F.lit(None).cast("bigint")).alias("chars"),
            (F.col(f"min_{i}") if text else F.lit(None).cast("int")).alias("min_len"),
            (F.col(f"max_{i}") if text else F.lit(None).cast("int")).alias("max_len"),
            F.col(f"sketch_{i}").alias("sketch")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all tables whose stored sketches are given, old and new ones together; nothing is read again.
    Columns are matched by name and type."""
    facts = sketches.groupBy("column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.sum("chars").alias("chars"),
        F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return _profile_rows(facts)


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "number" if isinstance(t, T.NumericType) else "other"


def infer_column_roles(df: DataFrame, min_avg: float = 30, exact: bool = True) -> DataFrame:
    """Which columns look like an id, a text, a company, read from the profile of the whole table."""
    low = F.lower("column")
    named_id, named_company = (F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, h))
                               for hints in (ID_HINTS, COMPANY_HINTS))
    is_id = named_id | F.coalesce(F.try_divide("distinct", "rows") > 0.8, F.lit(False))
    is_text = (F.col("type") == "text") & F.coalesce(F.col("avg_len") > min_avg, F.lit(False))
    return (column_profile(df, exact).withColumns({"id_like": is_id, "text_like": is_text})
            .select("column", "id_like", "text_like", (named_company & ~F.col("id_like") & ~F.col("text_like"))
                    .alias("company_like")))


def infer_measure_columns(df: DataFrame, min_share: float = 0.3) -> DataFrame:
    """Which columns can be measured: numbers and dates by type or by parsing; a text column is a date if all its
    values are. One aggregate over the whole table."""
    facts = [F.count("*").alias("n")]
    texts = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, _TEXT)]
    for i, c in texts:
        v = F.col(f"`{c}`")
        is_date = F.bool_and(F.when(v.isNotNull(), v.try_cast("timestamp").isNotNull()))
        facts += [F.count(v.try_cast("double")).alias(f"p_{i}"), F.coalesce(is_date, F.lit(False)).alias(f"t_{i}")]
    rows = []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, _TEXT):
            numeric = F.coalesce(F.col(f"p_{i}") > F.col("n") * min_share, F.lit(False))
            date = F.col(f"t_{i}") & ~numeric
        else:
            numeric, date = F.lit(isinstance(f.dataType, _NUMERIC)), F.lit(_kind(f.dataType) == "date")
        rows.append(F.struct(F.lit(f.name).alias("column"), numeric.alias("numeric"), date.alias("date")))
    return df.agg(*facts).select(F.inline(F.array(*rows)))
