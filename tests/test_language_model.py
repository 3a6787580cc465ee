"""The trigram model against a loop, odd texts, and held-out documents."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parley.operators.language_model import BUCKETS, LanguageModel, fit_language, with_language_by_model
from parley.operators.scorers import with_language

TRAIN = [("en", "the cat and the dog"), ("en", "that is the end"), ("fr", "le chat et la bête"), ("fr", "c'est la fin"),
         (None, "nothing learnt here"), ("en", None), ("fr", "")]
TEXTS = ["the dog", "la fin de la bête", "THE", "ê", "", None, "12 34 !", "zzz qqq", "a", "the la", "a\U0001d7d8b la", "le chat " * 40_000]


def grams(text):
    x = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
    return [(ord(x[i]) * 961 + ord(x[i + 1]) * 31 + ord(x[i + 2])) % BUCKETS for i in range(len(x) - 2)]


def test_against_a_loop(spark):
    model = fit_language(spark.createDataFrame(TRAIN, "lang string, t string"), "t", "lang")
    assert model.languages == ["en", "fr"]
    counts = {lang: Counter(g for la, t in TRAIN if la == lang for g in grams(t)) for lang in model.languages}

    def weight(lang, g):
        return math.floor(1000 * math.log((counts[lang][g] + 1) / (sum(counts[lang].values()) + BUCKETS)) + 0.5)

    want = []
    for t in TEXTS:
        g = grams(t)
        sums = [(-sum(weight(lang, x) for x in g), lang) for lang in model.languages]
        want.append(min(sums)[1] if len(g) >= 3 else "unknown")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    assert [r.language for r in with_language_by_model(df, "t", model).orderBy("i").collect()] == want


def test_no_languages_and_no_rows(spark):
    none = spark.createDataFrame([], "lang string, t string")
    model = fit_language(none, "t", "lang")
    assert model.languages == []
    assert with_language_by_model(spark.createDataFrame([("abc",)], "t string"), "t", model).first().language == "unknown"
    one = LanguageModel(["en"], np.zeros((BUCKETS, 1), np.int64))
    assert with_language_by_model(none, "t", one).collect() == []


def test_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = fit_language(df.where(~held), "text", "lang")
    out = with_language(with_language_by_model(df.where(held), "text", model), "text", out="by_words")
    r = out.agg(F.avg((F.col("language") == F.col("lang")).cast("double")).alias("model"),
                F.avg((F.col("by_words") == F.col("lang")).cast("double")).alias("words")).first()
    print("held-out accuracy", r)
    assert r.model >= 0.97 and r.model > r.words
    plan = with_language_by_model(df, "text", model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
