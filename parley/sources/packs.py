"""Domain packs (rules and keyword groups per industry) and the company map as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.fixed_values import NOT_AVAILABLE, UNCATEGORIZED

_S = T.StringType()
PACK_SCHEMA = T.StructType([
    T.StructField("conditions", T.ArrayType(_S)),
    T.StructField("set", T.StructType([T.StructField(n, _S) for n in
                                       ("category", "subcategory", "level_3", "level_4", "sentiment")])),
    T.StructField("domain", _S),
    T.StructField("_corrupt_record", _S),
])


def _read(spark: SparkSession, path, multiline: bool) -> DataFrame:
    df = spark.read.schema(PACK_SCHEMA).json(path, multiLine=multiline, mode="PERMISSIVE",
                                             columnNameOfCorruptRecord="_corrupt_record")
    pattern = r"/(?:industry=)?([^/]+)/(?:kind=)?(rules|keywords)\.json(?:/|$)"
    file = F.url_decode(F.col("_metadata.file_path"))
    empty = F.col("conditions").isNull() & F.col("set").isNull()
    return df.select("*", (F.col("_corrupt_record").isNotNull() | empty).alias("unreadable"),
                     F.regexp_extract(file, pattern, 1).alias("industry"),
                     F.regexp_extract(file, pattern, 2).alias("kind"),
                     F.col("_metadata.file_path").alias("file"),
                     F.monotonically_increasing_id().alias("group_no"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(industry, kind) of every pack file, also of those without entries; contents are not read.

    A file without a single byte counts as absent.
    """
    pattern = r"/(?:industry=)?([^/]+)/(?:kind=)?(rules|keywords)\.json(?:/|$)"
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.select(F.regexp_extract("path", pattern, 1).alias("industry"),
                        F.regexp_extract("path", pattern, 2).alias("kind")).where("kind <> '' and not startswith(industry, '.')")


def _groups(df: DataFrame) -> DataFrame:
    s = F.col("set")
    return df.where(~F.col("unreadable")).select(
        "industry", "kind", "group_no", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"),
        F.coalesce(s["category"], F.lit(UNCATEGORIZED)).alias("l1"),
        F.coalesce(s["subcategory"], F.lit(NOT_AVAILABLE)).alias("l2"),
        F.coalesce(s["level_3"], F.lit(NOT_AVAILABLE)).alias("l3"),
        F.coalesce(s["level_4"], F.lit(NOT_AVAILABLE)).alias("l4"), s["sentiment"].alias("sentiment"))


def load_packs(spark: SparkSession, folder: str, multiline: bool = True) -> DataFrame:
    """All packs below ``folder``: ``<industry>/rules.json`` and ``<industry>/keywords.json``.

    An industry counts only if it has both files and both are valid; a file may be an empty list. ``group_no`` keeps the order inside a file.
    With ``multiline=False`` the files hold one document per line.
    """
    raw = _read(spark, f"{folder}/*/*.json", multiline)
    usable = (_files(spark, f"{folder}/*/*.json").groupBy("industry")
              .agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2").select("industry"))
    broken = raw.where("kind <> '' and unreadable").select("industry").distinct()
    return _groups(raw).join(usable, "industry", "left_semi").join(broken, "industry", "left_anti")


def load_packs_merged(spark: SparkSession, rules_path: str, keywords_path: str, multiline: bool = True) -> DataFrame:
    """One rules file and one keywords file for all industries; entries without a domain belong to ``Other``."""
    both = [(_read(spark, p, multiline).withColumn("kind", F.lit(k))) for p, k in
            ((rules_path, "rules"), (keywords_path, "keywords"))]
    merged = both[0].unionByName(both[1]).withColumn("industry", F.coalesce("domain", F.lit("Other")))
    return _groups(merged)


def pack_inventory(spark: SparkSession, folder: str, expected: DataFrame, multiline: bool = True) -> DataFrame:
    """Per expected industry and every found one: number of rules and keyword groups, and a status.

    valid: both files present and readable; invalid: a file is broken; missing: a file or the folder is absent.
    """
    raw = _read(spark, f"{folder}/*/*.json", multiline).where("kind <> '' and not startswith(industry, '.')")
    good = ~F.col("unreadable")
    counts = raw.groupBy("industry").agg(
        F.count_if(good & (F.col("kind") == "rules")).alias("rules"),
        F.count_if(good & (F.col("kind") == "keywords")).alias("keywords"),
        F.count_if(~good).alias("bad"))
    files = _files(spark, f"{folder}/*/*.json").groupBy("industry").agg(F.count_distinct("kind").alias("kinds"))
    counts = files.join(counts, "industry", "left")
    status = (F.when(F.col("bad") > 0, "invalid").when(F.col("kinds") == 2, "valid").otherwise("missing"))
    return (expected.select("industry", F.lit(True).alias("expected")).distinct().join(counts, "industry", "full")
            .select("industry", F.coalesce("expected", F.lit(False)).alias("expected"),
                    F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("keywords", F.lit(0)).alias("keywords"),
                    status.alias("status")))


COMPANY_MAP_SCHEMA = "struct<version:string,description:string,industries:map<string,array<string>>>"


def company_rows(docs: DataFrame, json_col: str = "value") -> DataFrame:
    """Company map documents to rows: industry, company and their positions in the document."""
    m = docs.select(F.from_json(json_col, COMPANY_MAP_SCHEMA).alias("m"))
    industries = m.select(F.posexplode(F.map_entries("m.industries")).alias("industry_no", "e"))
    return industries.select("industry_no", F.col("e.key").alias("industry"),
                             F.posexplode("e.value").alias("company_no", "company"))


def load_company_map(spark: SparkSession, path: str) -> DataFrame:
    return company_rows(spark.read.text(path, wholetext=True))


def register_company(companies: DataFrame, new: DataFrame) -> DataFrame:
    """Add (industry, company) rows which are not there yet; blank companies are ignored."""
    fresh = (new.select("industry", F.trim("company").alias("company")).where("company <> ''").distinct()
             .join(companies, ["industry", "company"], "left_anti"))
    return companies.select("industry", "company").unionByName(fresh)
