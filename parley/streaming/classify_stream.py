"""The same work on files which keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.fixed_values import NOT_AVAILABLE, UNCATEGORIZED
from parley.functions.pii import pii_columns
from parley.operators.matching import classify
from parley.operators.shaping import passthrough_result


def stream_classify(source: DataFrame, rules, id_col: str, text_col: str, sink: str, checkpoint: str,
                    mode: str | None = "hash") -> StreamingQuery:
    """Classify all files that have arrived and append the results as Parquet; run again for the next files.

    A projection per micro-batch, without state. The checkpoint makes a restart after a lost driver or executor go on
    where it stopped.
    """
    rows = pii_columns(source, text_col, mode=mode) if mode else source
    text = "redacted_text" if mode else text_col
    out = passthrough_result(classify(rows, rules, text), id_col, text_col)
    return (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def category_trend_stream(source: DataFrame, ts_col: str, level: str, window: str, sink: str,
                          checkpoint: str) -> StreamingQuery:
    """Count all files that have arrived per window and value; run again for the next files, read with ``trend_table``.

    Each micro-batch writes its own counts, a few rows, to a folder of its own, and writes it anew if it is run again.
    So every window is there as soon as its rows are, no row is too late, and the order of files does not matter; no
    state is kept.
    """
    def count(rows: DataFrame, batch: int) -> None:
        (rows.where(~F.col(level).isin(NOT_AVAILABLE, UNCATEGORIZED))
         .groupBy(F.window(F.col(ts_col).cast("timestamp"), window).alias("w"), level).agg(F.count("*").alias("Count"))
         .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), level, "Count")
         .write.mode("overwrite").parquet(f"{sink}/batch={batch}"))

    return (source.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def trend_table(spark: SparkSession, sink: str, level: str) -> DataFrame:
    """Counts per window and value of all batches so far."""
    return spark.read.parquet(sink).groupBy("window_start", level).agg(F.sum("Count").alias("Count"))
