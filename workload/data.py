"""Inputs of the registered queries: the given tables, and tables Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.matching import classify
from parley.operators.shaping import passthrough_result
from parley.operators.transcripts import build_transcripts
from workload.seed import SEED_RULES

LABELS = {"user": "Customer", "assistant": "Agent"}
CONSUMER = {"user": "Consumer", "assistant": "Agent"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FEW_SPLITS = 8  # scans with fewer splits are under a gigabyte; whatever the cluster, a larger one is never shuffled


def docs(spark, sf) -> DataFrame:
    """The documents; a small table, often one Parquet row group, is dealt out to all cores."""
    rows = table(spark, sf, "documents")
    return rows.repartition(spark.sparkContext.defaultParallelism) if rows.rdd.getNumPartitions() < FEW_SPLITS else rows


def results(spark, sf, rules=None, with_sentiment: bool = False) -> DataFrame:
    """The classified documents."""
    out = classify(docs(spark, sf), rules or SEED_RULES, "text", with_sentiment=with_sentiment)
    return passthrough_result(out, "doc_id", "text")


def transcripts(spark, sf, labels=None, style: str = "lines") -> DataFrame:
    """One labelled transcript per conversation; line breaks inside a turn become blanks."""
    turns = table(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", r"[\r\n]+", " "))
    return build_transcripts(turns, "conv_id", "turn", "role", "text", labels or LABELS, style)


def order_results(spark, sf) -> DataFrame:
    """Orders as a result table: region, nation, segment and priority as levels, some of them missing."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    l1 = F.when(F.col("r_name") == "AFRICA", "Uncategorized").otherwise(F.col("r_name"))
    l2 = F.when((F.col("r_name") == "AFRICA") | (F.col("n_nationkey") >= 20), "NA").otherwise(F.col("n_name"))
    l3 = F.when((l2 == "NA") | (F.col("c_acctbal") < 0), "NA").otherwise(F.col("c_mktsegment"))
    l4 = F.when((l3 == "NA") | (F.col("o_orderstatus") == "P"), "NA").otherwise(F.col("o_orderpriority"))
    return j.select(F.col("o_orderkey").alias("Conversation_ID"), l1.alias("Category"), l2.alias("Subcategory"),
                    l3.alias("L3"), l4.alias("L4"), F.col("o_orderdate").alias("order_date"),
                    F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
                    F.col("o_totalprice").cast("string").alias("price_text"))


# The same table for the check.
ORDER_RESULTS = """res AS MATERIALIZED (SELECT o_orderkey AS "Conversation_ID", l1 AS "Category", l2 AS "Subcategory", l3 AS "L3",
    CASE WHEN l3 = 'NA' OR o_orderstatus = 'P' THEN 'NA' ELSE o_orderpriority END AS "L4",
    o_orderdate AS order_date, o_totalprice AS price, c_acctbal AS balance FROM
    (SELECT *, CASE WHEN l2 = 'NA' OR c_acctbal < 0 THEN 'NA' ELSE c_mktsegment END AS l3 FROM
    (SELECT *, CASE WHEN r_name = 'AFRICA' THEN 'Uncategorized' ELSE r_name END AS l1,
        CASE WHEN r_name = 'AFRICA' OR n_nationkey >= 20 THEN 'NA' ELSE n_name END AS l2
     FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey)))"""
