"""Conditions of packs found in one pass, against plain loops, for few and for thousands of them."""

import random
import re
import time

from pyspark.sql import functions as F

from parley.functions.substrings import occurrences
from parley.operators.scorers import classify_keyword_first


def group(no, kind, conditions):
    return {"kind": kind, "group_no": no, "conditions": conditions, "l1": f"G{no}", "l2": "NA", "l3": "NA", "l4": "NA"}


def test_occurrences(spark):
    literals = ["ab", "b", "abab", "日本", "x y"]
    texts = ["", None, "ababab", "日本ab😀b", "x y x  y", "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", occurrences(F.col("t"), literals).alias("all"),
                                                                                  occurrences(F.col("t"), literals, first=True).alias("one"))
    for r in rows.collect():
        t = texts[r.id] or ""
        want = {(c, m.start()) for c, x in enumerate(literals) for m in re.finditer(f"(?={re.escape(x)})", t)}
        assert {(p.c, p.at) for p in r.all} == want and len(r.all) == len(want)
        assert {(p.c, p.at) for p in r.one} == {(c, t.find(x)) for c, x in enumerate(literals) if x in t}
    assert rows.where("id = 2").count() == 1
    assert spark.range(1).select(occurrences(F.lit("abc"), []).alias("x")).first().x == []


def test_keyword_first_by_hand(spark):
    r = random.Random(6)
    groups = [group(k, r.choice(["keywords", "rules", "rules"]), ["".join(r.choice("abc") for _ in range(r.randrange(2, 5))) for _ in range(6)])
              for k in range(12)]
    groups.append(group(12, "rules", ["", "caB"]))
    texts = [(k, "".join(r.choice("abcd ") for _ in range(r.randrange(0, 30)))) for k in range(150)] + [(150, None)]
    ordered = sorted(groups, key=lambda g: (g["kind"] != "keywords", g["group_no"]))
    for x in classify_keyword_first(spark.createDataFrame(texts, "id int, t string"), groups, "t").collect():
        t = (x.t or "").lower()
        first = next((g for g in ordered if g["kind"] == "keywords" and any(c.lower() in t for c in g["conditions"] if c)), None)
        counts = [(len(re.findall("|".join(c.lower() for c in g["conditions"] if c), t)), -k, g)
                  for k, g in enumerate(ordered) if g["kind"] == "rules"]
        n, _, g = max(counts, key=lambda c: c[:2])
        want = first["l1"] if first else g["l1"] if n else "Uncategorized"
        assert x.l1 == want and x.matched_rule == ("keyword_match" if first else f"rule_match_{n}_conditions" if n else None)


def test_thousands_of_conditions_cost_little(spark):
    r = random.Random(7)
    words = sorted({"".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(20_500)})[:20_000]
    texts = spark.createDataFrame([(k, " ".join(r.choice(words) if r.random() < 0.02 else f"w{r.randrange(900)}" for _ in range(300)))
                                   for k in range(2000)], "id int, t string").repartition(4).cache()
    texts.count()

    def seconds(n, score):
        groups = [group(k, "rules", words[k: n: max(1, n // 10)]) for k in range(max(1, n // 10))]
        best = None
        for _ in range(3):
            start = time.perf_counter()
            score(texts, groups, "t").write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        return best

    few, many = seconds(20, classify_keyword_first), seconds(20_000, classify_keyword_first)
    assert many < 3 * few + 1, (few, many)


def test_places_held_at_once():
    """A worker holds the places of a few texts, not those of its whole batch."""
    import tracemalloc

    import pyarrow as pa

    from parley.functions.substrings import found_in
    batch = pa.array(["ab" * 400] * 10_000)
    tracemalloc.start()
    n = sum(len(x.values) for x in found_in([batch], ("a", "b", "ab"), False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 * 1200 and peak < 20_000_000, peak
