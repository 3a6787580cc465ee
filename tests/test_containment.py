"""Containment of strings by rare grams, and the industry of company names."""

import random

from pyspark.sql import functions as F

from parley.operators.containment import contained, text_key
from parley.operators.scorers import detect_industry


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text string").withColumn("key", text_key(F.col("text")))


def pairs(spark, short, long):
    a, b = texts(spark, short), texts(spark, long)
    got = (contained(a, b).join(a.select(F.col("key").alias("short"), F.col("text").alias("s")), "short")
           .join(b.select(F.col("key").alias("long"), F.col("text").alias("l")), "long"))
    return sorted((r.s, r.l) for r in got.collect())


def by_hand(short, long):
    return sorted((a, b) for a in short for b in long if a and b and a in b)


def test_all_pairs_against_a_loop(spark):
    lot = random.Random(5)
    word = lambda n: "".join(lot.choice("abcé \n😀") for _ in range(n))
    short = sorted({word(lot.randint(1, 6)) for _ in range(150)}) + ["", None]
    long = sorted({word(lot.randint(1, 40)) for _ in range(150)}) + ["", None]
    want = by_hand([s for s in short if s], [t for t in long if t])
    assert len(want) > 300
    assert pairs(spark, short, long) == want
    assert pairs(spark, ["abc"], []) == [] and pairs(spark, [], ["abc"]) == []
    assert pairs(spark, ["abcd", "xyz"], ["xabcdx", "abc", "yz"]) == [("abcd", "xabcdx")]


def test_very_long_names(spark):
    filler = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(100_000))
    long = ["acme " + filler, filler + " acme", filler[:99_999], "acme"]
    assert pairs(spark, ["acme", filler, "zz top"], long) == by_hand(["acme", filler, "zz top"], long)


def test_industry_against_a_loop(spark):
    lot = random.Random(8)
    name = lambda n: " ".join(lot.choice(["acme", "bolt", "co", "x", "Ltd", "né", "ox", "Sun", "moon", "red", "blue", "ab"]) for _ in range(n))
    companies = [(lot.randint(0, 9), None, k, name(2 + k % 2)) for k in range(60)] + [(1, None, 99, " "), (2, None, 98, None)]
    companies = [(i, f"I{i}", k, c) for i, _, k, c in companies]
    rows = [(k, lot.choice([" ", ""]) + name(lot.randint(1, 4))) for k in range(200)] + [(200, None), (201, "  "), (202, "unheard")]
    rows += [(300 + k, "The BOLT moon shop") for k in range(400)]  # one name of more than a third, some of them repeated rows
    rows += [(300, "The BOLT moon shop")] * 3

    def industry(n):
        n = (n or "").lower().strip(" ")
        met = [(i, k, ind) for i, ind, k, c in companies if c and c.strip(" ") and n and (c.lower() in n or n in c.lower())]
        return min(met)[2] if met else None

    df = spark.createDataFrame(rows, "id int, company string").withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    df = df.withColumn("text", F.lit("t")).withColumn("key", F.lit("k"))
    listed = spark.createDataFrame(companies, "industry_no int, industry string, company_no int, company string")
    got = detect_industry(df, "company", listed)
    assert got.columns == df.columns + ["industry"]
    want = sorted((k, str(industry(n))) for k, n in rows)
    assert len({i for _, i in want}) > 3
    assert sorted((r.id, str(r.industry)) for r in got.collect()) == want
    assert detect_industry(df.limit(0), "company", listed).count() == 0
    assert detect_industry(df, "company", listed.limit(0)).where("industry is not null").count() == 0
