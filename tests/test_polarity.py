"""Learnt word weights against a loop, and their use as a lexicon."""

import math
import re

from parley.operators.polarity import learn_polarity
from parley.operators.scorers import read_lexicon, sentiment_bands

TEXTS = ["good bright day", "Good bright sun", "bad grey day", "bad, grey rain rain", "plain day", None, "", "good bright bright", "42"]


def by_hand(texts, up, down, least):
    said = [set(re.findall(r"\w+", (t or "").lower())) for t in texts]
    ups, downs = [s for s in said if s & set(up)], [s for s in said if s & set(down)]
    out = {}
    for w in set().union(*said):
        n = sum(w in s for s in said)
        if n >= least:
            x = (math.log2((sum(w in s for s in ups) + 0.5) / (len(ups) + 1))
                 - math.log2((sum(w in s for s in downs) + 0.5) / (len(downs) + 1)))
            out[w] = (n, round(x / (1 + abs(x)), 6))
    return out


def learnt(spark, texts, *args):
    df = spark.createDataFrame([(t, 1) for t in texts], "word string, up int")  # names used inside
    return {r.word: (r.texts, r.weight) for r in learn_polarity(df, "word", *args).collect()}


def test_by_hand(spark):
    for least in (1, 2):
        assert learnt(spark, TEXTS, ["Good"], ["bad"], least) == by_hand(TEXTS, ["good"], ["bad"], least)


def test_odd_input(spark):
    assert learnt(spark, [], ["good"], ["bad"], 1) == {}
    assert learnt(spark, [None, ""], ["good"], ["bad"], 1) == {}
    assert learnt(spark, ["a b"], [], [], 1) == by_hand(["a b"], [], [], 1)


def test_learnt_words_decide_sentiment(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    lexicon = read_lexicon(learn_polarity(df, "t", ["good"], ["bad"], 2))
    new = spark.createDataFrame([(1, "a bright bright morning"), (2, "so grey"), (3, "nothing known")], "i int, t string")
    scores = {r.i: r.sentiment_score for r in sentiment_bands(new, "t", lexicon).collect()}
    assert scores[1] > 0.5 and scores[2] < -0.5 and scores[3] == 0


def test_texts_are_read_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = learn_polarity(df, "text", ["the"], ["der"])
    made.collect()
    assert "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString()
