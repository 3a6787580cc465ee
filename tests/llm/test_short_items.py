"""Test items of few words are found wherever they stand in a long document."""

import random

from parley.llm.contamination import contained_items, shingles, words_of


def test_short_items_in_long_documents(spark):
    r = random.Random(5)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(5 + k % 8))) for k in range(600)]  # 1 to 8 shingles
    items += [(600 + k, f"a b c d e f{k} g h") for k in range(40)]  # shingles that many items share
    docs = []
    for k, (_, text) in enumerate(items):
        words = [f"w{r.randrange(3000)}" for _ in range(400)]
        at = 400 if k % 3 == 0 else r.randrange(400)
        own = text.split()
        if k % 4 == 1:
            own[-1] = "other"  # one shingle less
        docs.append((k, " ".join(words[:at] + own + words[at:])))
    docs.append((1000, " ".join(t for _, t in items)))
    got = {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sets = [(i, set(shingles(words_of(t)))) for i, t in items]
    want = set()
    for d, t in docs:
        own = set(shingles(words_of(t)))
        want |= {(d, i, len(q & own), len(q)) for i, q in sets if len(q & own) >= 0.8 * len(q) - 1e-9}
    assert got == want and len(got) > 1000
