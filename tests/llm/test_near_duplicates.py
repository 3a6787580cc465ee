"""The pipeline's near-duplicates against brute force by Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from parley.llm import near_duplicates
from parley.llm.contamination import shingles, words_of
from parley.llm.hot import looked_up
from parley.llm.near_duplicates import bands, candidate_links

SCHEMA = "doc_id long, text string"


def kept_by_hand(docs):
    sets = {i: set(shingles(words_of(t))) for i, t in docs}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and (not sets[a] and not sets[b] or
                                                 len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(i for i in root if root[i] == i)


def test_near_duplicates_by_jaccard(spark):
    r = random.Random(3)
    docs = []
    for n in (8, 9, 12, 30, 60, 120, 400):  # words; edits from few enough to too many
        for _ in range(6):
            text = [f"w{r.randrange(5000)}" for _ in range(n)]
            docs.append(" ".join(text))
            for edits in (0, 1, n // 60, n // 45, n // 40, n // 20):
                other = list(text)
                for at in r.sample(range(n), edits):
                    other[at] = f"v{r.randrange(5000)}"
                docs.append(" ".join(other))
            docs += [" ".join(text[: n - n // 10]), " ".join(text[n // 5:]), " ".join(text + ["x", "y"])]
    docs += ["", None, "  ", "one", "One ", "w " * 3000]
    r.shuffle(docs)
    rows = list(enumerate(docs))
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(x.doc_id for x in got) == kept_by_hand(rows)


def test_many_near_copies(spark):
    """More near copies than one tile of texts holds, joined to each other by chains only."""
    text, rows = [f"w{k}" for k in range(100)], []
    for i in range(200):
        text[i % 100] = f"v{i}"  # one word after the other is replaced
        rows.append((i, " ".join(text)))
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [x.doc_id for x in got] == kept_by_hand(rows) == [0]


def test_bands_find_sets_of_the_similarity():
    """Of pairs of sets with a Jaccard similarity of 0.8, nearly all share a band; of unlike ones nearly none."""
    rng = np.random.default_rng(5)
    hits = {0.8: 0, 0.1: 0}
    for s in hits:
        for _ in range(1500):
            n = int(rng.integers(10, 200))
            both = max(1, round(2 * n * s / (1 + s)))
            x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            hits[s] += bool(set(bands(x[:n])) & set(bands(x[n - both:])))
    assert hits[0.8] >= 0.99 * 1500 and hits[0.1] <= 0.02 * 1500


@pytest.mark.parametrize("tile", [3, 4096])
def test_a_band_in_many_tiles(spark, tile):
    """More keys in a band than a tile holds: the same keys are connected as by comparing all with all."""
    r = random.Random(8)
    rows = [(k, *[r.getrandbits(6) if k % 5 else 0 for _ in range(3)], [7, k % 4]) for k in range(60)]
    df = spark.createDataFrame(rows, "_key long, _f0 long, _f1 long, _f2 long, _bands array<long>")
    links = [(x.a, x.b) for x in candidate_links(df, 5, tile).collect()]
    far = {(a[0], b[0]): sum((x ^ y).bit_count() for x, y in zip(a[1:4], b[1:4])) for a in rows for b in rows}

    def joined(pairs):
        root = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert joined(links) == joined([p for p, d in far.items() if d <= 5])


def test_looked_up(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id")
    table = rows.groupBy("k").count().withColumnRenamed("count", "_n").selectExpr("k", "_n", "k * 2 AS v")
    got = looked_up(rows, table, "k").collect()
    assert len(got) == 5000 and all(x.v == 2 * x.k for x in got)
    assert looked_up(rows.limit(0), table.limit(0), "k").collect() == [] and near_duplicates.BANDS == 16


def test_candidates_by_simhash():
    """Candidates come from the fingerprints: with bands as short and as long as tables ask for, nearly all pairs with a
    Jaccard similarity of 0.8 agree in one, and chance meetings stay few."""
    rng = np.random.default_rng(9)
    pairs = []
    for _ in range(600):
        n = int(rng.integers(10, 200))
        both = int(np.ceil(2 * n * 0.8 / 1.8 - 1e-9))
        x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        pairs.append([near_duplicates.long_fingerprint(h) for h in (x[:n], x[n - both:])])
    left, right = ([np.array(lane, np.int64) for lane in zip(*side)] for side in zip(*pairs))
    for n in (300, 50_000, 1_000_000, 20_000_000):
        bits = near_duplicates.bits_for(n)
        one, other = (near_duplicates.fingerprint_bands(side, bits) for side in (left, right))
        assert (one == other).any(1).sum() >= 0.995 * len(pairs)
        assert n / 2**bits <= near_duplicates.BUCKET or n == 300
        assert (one[:-1] == other[1:]).mean() < 3 / 2**bits  # other texts


def test_tiles_of_distant_population_counts(monkeypatch):
    """Tile pairs whose population counts lie apart are not compared; what is near is found as by a loop."""
    rng = np.random.default_rng(4)
    lanes = [rng.integers(0, 2**63, 900).astype(np.uint64) for _ in range(3)]
    for v in lanes:
        v[:300] = np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        v[300:600] = ~v[:300]
    want = {(i, j) for i in range(900) for j in range(900) if sum(int(v[i] ^ v[j]).bit_count() for v in lanes) <= 6}
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda v: counted.append(v.size) or count(v))
    i, j = near_duplicates._near(lanes, lanes, 6, block=64)
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) >= 900 and len(i) == len(want)
    assert sum(counted) < 0.75 * 3 * 900**2
