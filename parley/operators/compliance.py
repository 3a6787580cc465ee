"""Reports on detected personal data; input has pii_counts, total_items and pii_detected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.fixed_values import COMPLIANCE_STANDARDS


def pii_type_distribution(df: DataFrame) -> DataFrame:
    return (df.select(F.explode("pii_counts").alias("pii_type", "n"))
            .groupBy("pii_type").agg(F.sum("n").alias("items")))


def compliance_summary(df: DataFrame) -> DataFrame:
    """One row: records, with and without personal data, detection rate, items, audit entries, standards."""
    n, hit = F.count("*"), F.count_if("pii_detected")
    return df.agg(n.alias("records"), hit.alias("with_pii"), (n - hit).alias("clean"),
                  F.coalesce(F.try_divide(hit * 100.0, n), F.lit(0.0)).alias("detection_rate"),
                  F.coalesce(F.sum("total_items"), F.lit(0)).alias("items"), hit.alias("audit_entries"),
                  F.lit(", ".join(COMPLIANCE_STANDARDS)).alias("standards"))


def audit_log(df: DataFrame, id_col: str, with_time: bool = True) -> DataFrame:
    """One row per record with personal data."""
    cols = [F.col(id_col).alias("conversation_id"), "pii_counts", "total_items"]
    if with_time:
        cols.insert(0, F.current_timestamp().alias("logged_at"))
    return df.where("pii_detected").select(*cols)
