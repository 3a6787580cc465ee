"""Registered queries of this subpackage and, where SQL can express them, the SQL they are checked against."""

from __future__ import annotations

import corpus_pipeline
from parley.llm.contamination import CONTAINED_SQL, contained_items
from parley.llm.dictionary_quality import quality_digest
from parley.llm.divergence import DIVERGENCE_SQL, rules_digest
from parley.llm.fill_in_middle import MIDDLE_SQL, middle_digest
from parley.llm.lattice import embedding_links
from parley.llm.line_spread import LINES_SQL, line_digest
from parley.llm.piece_dropout import segmentation_digest
from parley.llm.preferences import PREFERENCES_SQL, preference_digest
from parley.llm.simhash import simhash_groups
from parley.llm.spelling_variants import VARIANTS_SQL, spelling_variants
from parley.llm.token_counts import token_counts
from parley.llm.toxicity import toxicity_digest
from parley.llm.url_rules import judge_urls


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_preferences(spark, sf):
    return preference_digest(table(spark, sf, "conversations"))


def op2_token_counts(spark, sf):
    return token_counts(table(spark, sf, "documents"))


def op3_simhash(spark, sf):
    return simhash_groups(table(spark, sf, "documents"))


def op4_line_spread(spark, sf):
    return line_digest(table(spark, sf, "documents"))


def op5_lattice(spark, sf):
    return embedding_links(table(spark, sf, "embeddings"))


def op6_url_rules(spark, sf):
    return judge_urls(table(spark, sf, "pages"))


def op7_toxicity(spark, sf):
    return toxicity_digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_contamination(spark, sf):
    return contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_dictionary_quality(spark, sf):
    return quality_digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_piece_dropout(spark, sf):
    return segmentation_digest(table(spark, sf, "documents"))


def op11_fill_in_middle(spark, sf):
    return middle_digest(table(spark, sf, "documents"))


def op12_spelling_variants(spark, sf):
    return spelling_variants(table(spark, sf, "documents"))


def op13_divergence(spark, sf):
    return rules_digest(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_preferences, op2_token_counts, op3_simhash, op4_line_spread, op5_lattice, op6_url_rules, op7_toxicity,
    op8_contamination, op9_dictionary_quality, op10_piece_dropout,
    op11_fill_in_middle, op12_spelling_variants, op13_divergence)} | {"pipeline": corpus_pipeline.run}
# None of the others can be written in SQL; tests/llm holds them against brute force.
ORACLE = {"op1_preferences": PREFERENCES_SQL, "op4_line_spread": LINES_SQL, "op8_contamination": CONTAINED_SQL,
          "op11_fill_in_middle": MIDDLE_SQL, "op12_spelling_variants": VARIANTS_SQL, "op13_divergence": DIVERGENCE_SQL}
