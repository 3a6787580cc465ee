"""Fill-in-the-middle, spelling variants and distribution divergence against plain loops, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import divergence
from parley.llm.divergence import CLASSES, DIVERGENCE_SQL, distances, divergence_rules
from parley.llm.fill_in_middle import UNITS, WaveletMatrix, fill_in_middle, middle_digest, restore
from parley.llm.spelling_variants import spelling_variants, words_of

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "\n", "a", "a\n", "\n\n", "one\ntwo\nthree", "é日😀\n\nx\r\n", "has <P> in it", "<S\n<<M\nP>", "w " * 40_000,
         "<", "a<\nS>b\n<", "\n".join(f"line {k}" for k in range(3000))]


def documents(spark, n=80):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]


# Fill-in-the-middle

def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 8, n).astype(np.uint8)
        m = WaveletMatrix(x)
        at = np.arange(n + 1)
        for c in range(8):
            assert m.rank(c, at).tolist() == [int((x[:k] == c).sum()) for k in at]
        hits = np.flatnonzero((x == 1) | (x == 5)) + 1
        k = np.arange(1, len(hits) + 1)
        assert m.place((1, 5), k, np.zeros(len(k), np.int64), np.full(len(k), n)).tolist() == hits.tolist()


def middle_by_hand(key, text, pattern="[^\n]*\n|[^\n]+"):
    t = text or ""
    s = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(s[8 * k: 8 * k + 8], 16) for k in range(4)]
    u = re.findall(pattern, t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")):
        return (len(u), "plain", None, None, t)
    if h[3] % 100 < 50:
        return (len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("block", [1, 500, 4_000_000])
def test_middle_by_hand(spark, block):
    rows = documents(spark) + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fill_in_middle(df, block_bytes=block).collect()}
    for key, t in rows:
        r = got[key]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_hand(key, t) and r.text == t
    for r in middle_digest(df).collect():
        t = dict(rows)[r.doc_id] or ""
        assert r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(middle_by_hand(r.doc_id, t)[4].encode()).hexdigest()


@pytest.mark.parametrize("unit, pattern", [("word", r"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+"), ("sentence", "[^\n.!?]*[\n.!?]|[^\n.!?]+"),
                                           ("clause", "[^\n.!?,:;]*[\n.!?,:;]|[^\n.!?,:;]+")])
def test_other_units(spark, unit, pattern):
    rows = documents(spark, 30) + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    done = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit)
    for r in done.withColumn("back", restore(F.col("output"), F.col("form"))).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_hand(r.doc_id, r.text, pattern)
        assert r.back == (r.text or "")
    assert set(UNITS) == {"line", "word", "sentence", "clause"}


def test_middle_odd_tables(spark):
    schema = "doc_id long, text string, n int, Form string, `c0` string, `a.b` string, _ string"
    df = spark.createDataFrame([(None, "x\ny", 1, "f", "p", "q", "r")] * 2 + [(5, None, None, None, None, None, None)], schema)
    rows = fill_in_middle(df).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[0]["a.b"] == "q" and rows[0]["c0"] == "p" and rows[0]["n"] == 2
    assert fill_in_middle(df.limit(0)).collect() == []
    assert {r.form for r in fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert fill_in_middle(df, keep=["doc_id"]).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


# Spelling variants

def variants_by_hand(rows, slip=97):
    total = Counter()
    for key, t in rows:
        total.update(words_of(key, t, slip))
    times = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    letters, near, form = set("".join(times)), {}, {}
    for w, n in times.items():
        around = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + a + w[k:] for k in range(len(w) + 1) for a in letters}
        around |= {w[:k] + a + w[k + 1:] for k in range(len(w)) for a in letters}
        near[w] = [x for x in around - {w} if x in times]
        best = min(near[w], key=lambda x: (-times[x], x), default=None)
        if best and times[best] >= 2 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), times.get(form.get(w))) for w, n in times.items())


def test_words_of():
    assert words_of(1, None) == words_of(1, "") == {}
    assert words_of(1, "ABC Ärger ÄRGER abc x-y", 0) == {"abc": 2, "Ärger": 2, "x": 1, "y": 1}
    import zlib
    run = next(w for w in (f"{'abcdefgh'[k % 8] * 3}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(676))
               if zlib.crc32(f"7:{w}".encode()) % 97 == 0)
    at = zlib.crc32(f"7:{run}".encode()) % len(run)
    assert words_of(7, f"{run} {run}") == {run[:at] + run[at + 1:]: 2}


def test_variants_by_hand(spark):
    rows = documents(spark, 200)
    r = random.Random(4)
    stem = ["kitten", "balloon", "aaaaaa", "straße", "naïveté", "missississippi"]
    for key in range(1000, 1150):
        w = r.choice(stem)
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1:]])
        rows.append((key, f"{w} {w} {w}" if r.random() < 0.5 else w))
    rows += [(k, "y" * 3000 + "z " + "y" * 3000) for k in (2000, 2001, 2002)] + [(None, "kitten"), (3000, None), (3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in spelling_variants(df).collect())
    assert got == variants_by_hand(rows)
    assert any(g[1] for g in got) and any(g[1] and g[2] != g[1] for g in got)


def test_variants_one_group(spark):
    """Every letter at one place: all words meet at one pair of nodes; chains of forms lead to one root."""
    rows, k = [], 0
    for i, a in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"):
        rows += [(k + j, f"sh{a}rt") for j in range(3 * (i + 1))]
        k += 1000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in spelling_variants(df, slip=0).collect()) == variants_by_hand(rows, 0)


def test_variants_odd_tables(spark):
    schema = "doc_id long, text string, word string, k long, n long, form string"
    df = spark.createDataFrame([(1, "hello hello hello", "a", 1, 1, "b")] * 2, schema)
    assert [tuple(r) for r in spelling_variants(df, slip=0).collect()] == [("hello", None, "hello", 6, 0, None)]
    assert spelling_variants(df.limit(0)).collect() == [] and spelling_variants(df, least_times=99).collect() == []


# Distribution divergence

def base_by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    runs = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
    held = {k + j for k in range(len(w) - 2) if runs[tuple(w[k: k + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(held))


def test_base_counts(spark):
    r, texts = random.Random(1), list(TEXTS) + ["a b c", "a b c d", "a a a", "a a a a", "x y z x y z", " lead, trail "]
    for n in (4, 10, 50, 300, 2000):
        for v in (2, 5, 30, 200):
            words = [f"w{r.randrange(v)}" for _ in range(n)]
            texts.append(r.choice([" ", "\n", "\t "]).join(words) + r.choice(["", "\n", "#|", " x\x85"]))
    rows = list(enumerate(texts)) + documents(spark)
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    got = sorted(tuple(x)[:7] for x in divergence_rules(df).collect())
    want = sorted((k, *base_by_hand(t), base_by_hand(t)[0] < 50 or 2 * base_by_hand(t)[4] > base_by_hand(t)[0]) for k, t in rows)
    assert got == want


def test_distances(spark):
    """Both distances by their definition, entropy of the mean less mean of the entropies."""
    def entropy(p):
        p = np.asarray(p, float)
        return -(p[p > 0] * np.log2(p[p > 0])).sum()

    def far(p, q):
        return np.sqrt(max(0, entropy((np.array(p) + np.array(q)) / 2) - (entropy(p) + entropy(q)) / 2))

    chars, c = [40, 9, 0, 3, 2, 0, 1, 0], [0.7, 0.15, 0.05, 0.02, 0.03, 0.01, 0.01, 0.03]
    assert len(chars) == len(CLASSES) + 1
    counts, w = {0: 4, 2: 1}, [0.1, 0.2, 0.05, 0.0]
    row = spark.createDataFrame([(20, chars, [(k, n) for k, n in counts.items()], (c, w, sum(w)))],
                                "n_words long, _chars array<long>, _common array<struct<i:int,n:int>>,"
                                "r struct<c:array<double>,w:array<double>,all:double>")
    a, b = row.select(*distances(F.col("r"))).first()
    p = [counts.get(k, 0) / 20 for k in range(4)]
    assert a == pytest.approx(far(np.array(chars) / sum(chars), c)) and b == pytest.approx(far(p + [1 - sum(p)], w + [1 - sum(w)]))


def test_divergence_keeps_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = divergence_rules(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.6
    # A group of copies of junk, as large as all other texts, does not change what is judged clean.
    junk = docs.where("doc_id = (SELECT 0)").select(F.lit("en").alias("lang"), F.lit("%%% ### $$$ " * 60).alias("text"))
    many = spark.range(1000).crossJoin(junk).select((F.col("id") + 10_000).alias("doc_id"), "text", "lang")
    both = divergence_rules(docs.select("doc_id", "text", "lang").union(many))
    assert both.where("doc_id >= 10000 AND kept").count() == 0


def test_divergence_odd_tables(spark):
    schema = "doc_id long, text string, lang string, n_words int, _chars string, `_keep0` int"
    df = spark.createDataFrame([(None, "w " * 60, None, 1, "", 1)] * 2 + [(1, None, "en", None, None, None)], schema)
    rows = divergence_rules(df).collect()
    assert len(rows) == 3 and [r.n_words for r in rows if r.doc_id is None] == [60, 60]
    assert [(r.n_words, r.base_failed, r.kept) for r in rows if r.doc_id == 1] == [(0, True, False)]
    assert divergence_rules(df.limit(0)).collect() == [] and divergence_rules(df, lang_col=None).count() == 3


@pytest.mark.parametrize("dense", [divergence.DENSE, 0])
def test_divergence_any_number_of_languages(spark, monkeypatch, dense):
    """No language is left out: more than a hundred, the rarest too, and one whose words are all long."""
    monkeypatch.setattr(divergence, "DENSE", dense)
    r, rows = random.Random(5), []
    for k in range(102):
        for n in range(40 if k < 100 else 20):
            word = "longerthanall" if k == 101 else f"l{k}w"
            rows.append((len(rows), " ".join(f"{word}{j % 40}" for j in r.sample(range(60 + n), 60 + n)), f"lang{k}"))
    rows += [(len(rows) + n, " ".join(f"none{n}x{j}" for j in range(90)), "few") for n in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: (x.base_failed, x.kept) for x in divergence_rules(df).collect()}
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang"), map(list, zip(*rows))))))
    res = con.execute(DIVERGENCE_SQL)
    at = [c[0] for c in res.description]
    assert got == {x[0]: (x[at.index("base_failed")], x[at.index("kept")]) for x in res.fetchall()}
    kept = Counter(lang for k, _, lang in rows if got[k][1])
    assert (kept["lang0"], kept["lang100"], kept["lang101"]) == (40, 20, 20)
