"""End-to-end runs: read, redact, classify, shape - each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.pii import pii_columns
from parley.functions.text import consumer_text
from parley.operators.language_model import LanguageModel, with_language_by_model
from parley.operators.matching import classify
from parley.operators.scorers import (
    apply_overrides,
    classify_keyword_first,
    classify_subtopics,
    classify_topics,
    detect_industry,
    long_enough,
    proximity_themes,
    sentiment_bands,
    sentiment_hybrid,
    with_language,
    with_tokens,
)
from parley.operators.shaping import passthrough_result


def classify_run(df: DataFrame, rules, id_col: str, text_col: str, mode: str | None = "hash",
                 profile: str = "validated") -> DataFrame:
    """Redact, classify the redacted text, keep all input columns; ``mode=None`` leaves the text as it is."""
    if mode is None:
        return passthrough_result(classify(df, rules, text_col), id_col, text_col)
    redacted = pii_columns(df, text_col, profile, mode)
    return passthrough_result(classify(redacted, rules, "redacted_text"), id_col, text_col)


FULL_COLUMNS = [
    "Conversation_ID", "Industry", "Original_Text", "Redacted_Text", "Translated_Text", "L1_Category",
    "L2_Subcategory", "L3_Tertiary", "L4_Quaternary", "Category_Confidence", "Category_Path", "Matched_Rule",
    "Primary_Proximity", "Proximity_Group", "Theme_Count", "Sentiment", "Sentiment_Score", "PII_Detected",
    "PII_Items_Redacted", "PII_Types",
]
SHORT_COLUMNS = ["Conversation_ID", "Original_Text", "L1_Category", "L2_Subcategory", "L3_Tertiary",
                 "L4_Quaternary", "Primary_Proximity", "Proximity_Group", "Sentiment", "Sentiment_Score"]


def full_run(df: DataFrame, packs, polarity: dict[str, float], id_col: str, text_col: str, mode: str = "hash",
             profile: str = "full", industry: str | None = None, company_col: str | None = None,
             companies: DataFrame | None = None, language: LanguageModel | str | None = None) -> DataFrame:
    """Redact, classify keyword first, themes, sentiment: the twenty-column record.

    With ``company_col`` and ``companies`` (see ``detect_industry``) each row has the industry of its own company; where
    none is listed, ``industry`` or ``Unknown`` stands. With ``language``, a trigram model or ``"words"`` for frequent
    function words, the language of the redacted text is a further column, ``Language``. There is no machine
    translation, so the translated text is the redacted text.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"),
                     (F.col(company_col) if company_col else F.lit(None)).cast("string").alias("__company"))
    names = rows.select("__company")
    rows = pii_columns(rows, "__text", profile, mode)
    rows = classify_keyword_first(rows, packs, "redacted_text")
    rows = proximity_themes(rows, "redacted_text")
    rows = with_tokens(rows, "redacted_text", "__words")
    rows = sentiment_bands(rows, "redacted_text", polarity, "__words")
    further = []
    if language is not None:
        rows = (with_language(rows, "redacted_text", out="Language", tokens_col="__words") if language == "words"
                else with_language_by_model(rows, "redacted_text", language, "Language"))
        further = ["Language"]
    rows = rows.drop("__words")
    if company_col and companies is not None:
        # The names come from the table itself, so that redaction and classification run once.
        rows = detect_industry(rows, "__company", companies, "__own_industry", names)
    else:
        rows = rows.withColumn("__own_industry", F.lit(None).cast("string"))
    return rows.select(
        F.col("__id").cast("string").alias("Conversation_ID"),
        F.coalesce("__own_industry", F.lit(industry or "Unknown")).alias("Industry"), F.col("__text").alias("Original_Text"), F.col("redacted_text").alias("Redacted_Text"),
        F.col("redacted_text").alias("Translated_Text"), F.col("l1").alias("L1_Category"),
        F.col("l2").alias("L2_Subcategory"), F.col("l3").alias("L3_Tertiary"), F.col("l4").alias("L4_Quaternary"),
        F.col("confidence").alias("Category_Confidence"), F.col("match_path").alias("Category_Path"),
        F.col("matched_rule").alias("Matched_Rule"), F.col("primary_proximity").alias("Primary_Proximity"),
        F.col("proximity_group").alias("Proximity_Group"), F.col("theme_count").alias("Theme_Count"),
        F.col("sentiment").alias("Sentiment"), F.col("sentiment_score").alias("Sentiment_Score"),
        F.col("pii_detected").alias("PII_Detected"), F.col("total_items").alias("PII_Items_Redacted"),
        F.to_json("pii_counts").alias("PII_Types"), *further)


def topics_run(df: DataFrame, id_col: str, transcript_col: str, polarity: dict[str, float],
               valence: dict[str, float], style: str = "v1") -> DataFrame:
    """Consumer text, language gate, topic, subtopic, sentiment, overrides; blank results behind the gate."""
    rows = df.select(id_col, transcript_col).withColumn(
        "Consumer_Text", consumer_text(F.col(transcript_col), "simple" if style == "v1" else "multi"))
    rows = with_language(rows, "Consumer_Text")
    rows = classify_subtopics(classify_topics(rows, "Consumer_Text", style), "Consumer_Text", style)
    rows = sentiment_hybrid(rows, "Consumer_Text", polarity, valence)
    rows = apply_overrides(rows, "Consumer_Text")
    ok = long_enough("Consumer_Text", "language")
    return rows.select(F.col(id_col).alias("Conversation_Id"), "Consumer_Text", F.lit("").alias("Translated_Text"),
                       F.when(ok, F.col("topic")).otherwise("").alias("Category"),
                       F.when(ok, F.col("subtopic")).otherwise("").alias("Subcategory"),
                       F.when(ok, F.col("sentiment")).otherwise("").alias("Sentiment"))
