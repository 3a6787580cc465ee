"""From documents to training pieces, in five stages. Each stage's rows are written and read again by the next.

Every stage but the last returns the columns it was given, whatever their names; an empty table stays empty. Null
texts stay null and are treated as empty ones; rows without an id are judged like others but can be taken away by the
classifier only, as the other stages name what goes by its id. Repeated rows share one fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.contamination import contained_items
from parley.llm.dictionary_quality import quality_scores, remainder
from parley.llm.line_spread import dedup_lines
from parley.llm.near_duplicates import similar_groups
from parley.llm.piece_dropout import segmentation_digest
from parley.session import materialize


def _spare(docs: DataFrame, name: str) -> str:
    """``name``, behind as many underscores as no column of ``docs`` begins with."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, good = _spare(docs, "_score"), _spare(docs, "_good")
    scored = quality_scores(docs, labels, remainder(F.col("_id"), 4) != 2, score_col=score, predicted_col=good)
    return scored.where(F.col(good) == 1).drop(score, good)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; ``n_chars`` follows the text where lines are gone."""
    removed = _spare(docs, "_removed")
    done = dedup_lines(docs, removed_col=removed)
    changed = F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.withColumn("n_chars", F.coalesce(changed, F.col("n_chars"))).drop(removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8
    or more); rows without an id stay."""
    groups = similar_groups(docs.select("doc_id", "text"))
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    found = contained_items(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document with merge dropout: their number, a hash, and that decoding gives the text back."""
    return segmentation_digest(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", segment)]

# Compression sizes and hashes of pieces cannot be computed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
