"""Merge dropout is dealt anew for every occurrence of a word."""

import pytest
from test_llm import agenda, table

from parley.llm.piece_dropout import Merger, default_model, encode


@pytest.mark.parametrize("dropout", [0.0, 0.05, 0.3])
def test_every_occurrence_by_definition(spark, dropout):
    texts = [r.text[:400] for r in table(spark, "documents").limit(25).collect()]
    texts += ["x" * 130 + " tail", "日本 ﬁ \n▁é", " a  b ", "", "the information " * 40]
    merger = Merger(default_model(), dropout, 17)
    ids, at = merger.encode(texts, list(range(len(texts))))
    # 2**64 - 1 variants: the key of document and place itself
    assert [ids[at[k]: at[k + 1]].tolist() for k in range(len(texts))] == [agenda(merger, t, k, 2**64 - 1) for k, t in enumerate(texts)]


def test_a_frequent_word_varies():
    merger = Merger(default_model(), 0.1, 17)
    ids, at = merger.encode(["information"] * 4000, list(range(4000)))
    ways = [tuple(ids[at[k]: at[k + 1]]) for k in range(4000)]
    assert len(set(ways)) > 20
    whole, _ = Merger(default_model(), 0.0, 17).encode(["information"], [0])
    same = merger.undropped(*_chunk(" information"), *_places(4000))
    assert all(w == tuple(whole) for w, s in zip(ways, same) if s) and 0.05 < same.mean() < 0.6


def _chunk(text):
    import numpy as np

    from parley.llm.spans import code_points
    return code_points(text), np.array([0, len(text)])


def _places(n):
    """The first chunk of n documents with the ids from 0 on."""
    import numpy as np
    import xxhash

    from parley.llm.spans import scramble
    seeds = np.array([xxhash.xxh64_intdigest(str(k).encode(), 17) for k in range(n)], np.uint64)
    return np.zeros(n, np.int64), scramble(seeds)


def test_a_frequent_word_varies_in_a_table(spark):
    rows = encode(spark.range(3000).selectExpr("id AS doc_id", "'information' AS text").coalesce(1)).collect()
    assert len({tuple(r.piece_ids) for r in rows}) > 20
