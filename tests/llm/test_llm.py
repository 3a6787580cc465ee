"""Operators of parley.llm against brute force, round trips and held-out labels, and their edge cases."""

import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from test_near_duplicates import kept_by_hand

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, norm
from parley.llm import queries as Q
from parley.llm.contamination import contained_items, shingles, words_of
from parley.llm.dictionary_quality import SAMPLE, quality_scores, remainder, training_texts
from parley.llm.dictionary_quality import fit as fit_quality
from parley.llm.lattice import embedding_links, minimal_vectors, nearest_e8
from parley.llm.line_spread import dedup_lines
from parley.llm.piece_dropout import Merger, decode, default_model, encode
from parley.llm.preferences import format_preferences
from parley.llm.simhash import simhash_groups
from parley.llm.spans import scramble
from parley.llm.token_counts import token_counts
from parley.llm.toxicity import toxicity_scores
from parley.llm.url_rules import judge_urls, match, mine

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, _id long, _text string, score double"
EDGE = [(1, None, None, 7, "x", 0.5), (2, "", "a", None, None, None), (None, "one two three four five six seven", "b", 1, "", 1.0),
        (3, " \t\n ", "a", 1, "", 1.0), (3, " \t\n ", "a", 1, "", 1.0), (4, "w " * 60_000, "c", 1, "", 1.0),
        (5, "é日😀 <|endoftext|> ▁ it's", "d", 1, "", 1.0)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_preferences_edges(spark):
    schema = "pair_id long, turn int, role string, text string, side int"
    a = spark.createDataFrame([(1, 0, "user", "hi", 9), (1, 1, "assistant", "a", 9), (None, 0, None, None, 9),
                               (2, 0, "user", "<|im_end|>", 9)], schema)
    b = spark.createDataFrame([(1, 0, "user", "hi", 9), (1, 1, "assistant", "bb", 9), (None, 0, None, None, 9)], schema)
    rows = {r.pair_id: r for r in format_preferences(a, b).collect()}
    assert rows[1].n_prompt_turns == 1 and rows[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    s = rows[1].chosen_spans[0]
    assert rows[1].chosen[s.start: s.end] == "a<|im_end|>\n" and rows[1].rejected.count("bb") == 1
    assert rows[None].n_prompt_turns == 1 and rows[None].chosen == ""
    assert rows[2].n_prompt_turns == 0 and rows[2].rejected == "" and "< |im_end|>" in rows[2].chosen
    assert format_preferences(a.limit(0), b.limit(0)).collect() == []


def test_token_counts(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, "documents").select("doc_id", "text").union(edge.select("doc_id", "text"))
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids))
                  for r in docs.collect())
    assert sorted((str(r[0]), r[1], r[2]) for r in token_counts(docs, block_chars=100_000).collect()) == want
    assert token_counts(edge.limit(0)).collect() == []


def fingerprint_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i: i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, near):
    parent = {i: i for i in ids}
    for _ in ids:
        moved = False
        for a, b in near:
            low = min(parent[a], parent[b])
            moved |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
        if not moved:
            return parent
    return parent


def test_simhash(spark, edge):
    docs = table(spark, "documents").select("doc_id", "text")
    prints = {r.doc_id: fingerprint_by_hand(r.text) for r in docs.collect()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots(sorted(prints), near)
    got = simhash_groups(docs).collect()
    assert len(got) == len(prints)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)
    rows = simhash_groups(edge).collect()
    assert len(rows) == len(EDGE) and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert simhash_groups(edge.limit(0)).collect() == []


def test_lines_edges(spark, edge):
    line = "this line stands on every site"
    docs = spark.createDataFrame([(k, f"own text number {k} here\n{line}", f"s{k % 6}", "x") for k in range(12)]
                                 + [(None, line, "s0", "x"), (20, None, None, "x"), (21, "", "s1", "x")],
                                 "doc_id long, text string, source string, n_removed string")
    rows = dedup_lines(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 15 and line in by[0].text and by[5].text == "own text number 5 here" and by[5].n_removed == 1
    assert by[None].text == "" and by[20].text is None and by[21].text == "" and by[20].n_removed == 0
    assert len(dedup_lines(edge).collect()) == len(EDGE) and dedup_lines(edge.limit(0)).collect() == []


def test_lattice(spark):
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    p, steps = nearest_e8(x), minimal_vectors()
    assert len(steps) == 240
    assert all(((a - b) ** 2).sum() <= ((a - b - steps) ** 2).sum(1).min() + 1e-9 for a, b in zip(x, p))
    df = table(spark, "embeddings")
    rows = df.collect()
    e = np.array([r.embedding for r in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    near = e @ e.T >= 0.9
    ids = [r.vec_id for r in rows]
    want = roots(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j])
    got = {r.vec_id: r for r in embedding_links(df).collect()}
    assert all(got[i].n_links == near[k].sum() - 1 and got[i].component_id == want[i] and got[i].kept == (want[i] == i)
               for k, i in enumerate(ids))
    odd = spark.createDataFrame([(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0),
                                 (6, [1.0, 0.0], 0), (6, [2.0, 0.0], 0), (None, [3.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0)],
                                "vec_id long, embedding array<double>, node int")
    out = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_links(odd, tile=2).collect()), key=repr)
    assert out == sorted([(0, 2, 6, False), (6, 2, 6, True), (6, 2, 6, True)]
                         + [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 8)], key=repr)
    assert embedding_links(odd.limit(0)).collect() == []


def test_url_rules(spark):
    urls = [(1, "http://a.NET/x", "block", "net/"), (2, "https://m.example.net/en/1", "allow", "example.net/en/"),
            (3, "http://example.com/de/5?q=1", "block", "example.com/de/"), (4, "http://x.org/fr/", "allow", "org/fr/"),
            (5, None, "allow", None), (6, "no scheme", "allow", None), (6, "http://notnet/", "allow", None),
            (7, "http://x.net", "allow", None)]
    pages = spark.createDataFrame([(i, u, "t") for i, u, _, _ in urls], "page_id long, url string, tokens string")
    got = sorted((r.page_id, r.rule or "") for r in judge_urls(pages).collect())
    assert got == sorted((i, r or "") for i, _, _, r in urls)
    assert judge_urls(pages.limit(0)).collect() == []
    data = [(["a", "b"], "block")] * 6 + [(["a"], "allow")] * 4 + [(["b", "c"], "block")] * 2
    rules = mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), 0.1, 0.8)
    assert {tuple(r.tokens): (r.verdict, round(r.confidence, 3)) for r in rules.collect()} == {("b",): ("block", 1.0), ("c",): ("block", 1.0)}
    sets = spark.createDataFrame([(["b", "z"],), (["z"],)], "tokens array<string>")
    assert [(r.tokens, r.verdict) for r in match(sets, rules).collect()] == [(["b", "z"], "block")]


def test_contained(spark, edge):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (4, "w w"), (None, "w")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained_items(edge, items).collect()}
    d = [(r[0], set(shingles(words_of(r[1])))) for r in EDGE]
    i = [(k, set(shingles(words_of(t)))) for k, t in ((1, "one two three four five six"), (4, "w w"), (None, "w"))]
    assert got == {(a, b) for a, s in d for b, q in i if len(q & s) >= 0.8 * len(q)}
    assert contained_items(edge.limit(0), items).collect() == [] and contained_items(edge, items.limit(0)).collect() == []


@pytest.mark.parametrize("score, label, n, r", [(toxicity_scores, "toxic", 5, 0), (quality_scores, "quality", 4, 2)])
def test_classifiers(spark, edge, score, label, n, r):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, labels, remainder(F.col("_id"), n) != r).join(labels, "doc_id").collect()
    held = [x for x in out if zlib.crc32(str(x.doc_id).encode()) % n == r]
    bad, good = [x.score for x in held if x[label] == 0], [x.score for x in held if x[label] == 1]
    assert np.mean([a < b for a in bad for b in good]) > 0.9
    rows = score(edge, labels.limit(0), F.lit(True)).collect()
    assert len(rows) == len(EDGE) and {x.score for x in rows} == {0.5}
    assert score(edge.limit(0), labels, F.lit(True)).collect() == []


def test_pieces(spark, edge):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [r.text for r in table(spark, "documents").limit(60).collect()] + ["", "  a  b\n\tc ", "x" * 300, "日本 ﬁ １２"]
    plain = Merger(default_model(), 0.0)
    ids, at = plain.encode(texts, list(range(len(texts))), 1)
    assert all(ids[at[k]: at[k + 1]].tolist() == sp.encode(t) for k, t in enumerate(texts))
    done = decode(encode(edge, dropout=0.3)).collect()
    assert len(done) == len(EDGE) and all(r.decoded == (r.text or "") for r in done)
    again = Merger(default_model(), 0.3, 5)
    one, _ = again.encode(texts, [0] * len(texts), 4)
    other, _ = Merger(default_model(), 0.3, 6).encode(texts, [0] * len(texts), 4)
    assert one.tolist() == again.encode(texts, [0] * len(texts), 4)[0].tolist() != other.tolist()
    assert encode(edge.limit(0)).collect() == []


ODD_ROWS = [(1, None, None, None, None, 1, 0, "x"), (None, "one two three four five six", "en", "s1", 27, 2, 0, "y"),
            (2, "", "en", None, 0, 3, 0, None), (3, "w " * 40_000, "en", "s2", 80_000, None, None, "z"),
            (4, "the same text\nin two rows", "de", "s3", 25, 4, 0, "z"),
            (4, "the same text\nin two rows", "de", "s3", 25, 4, 0, "z"),
            (5, "é日😀 ▁ <|endoftext|>\r\n\x00x", "fr", "s4", None, 5, 0, "")]
ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, _id long, _good int, `_removed.x y` string")


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    given = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF)
        assert rows.columns == docs.columns, name
        # Stages take whole rows away, or lines from texts; here no line stands on enough sites.
        assert all(r in given for r in rows.collect()), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(map(str, corpus_pipeline.lines(spark, docs, SF).collect())) == sorted(map(str, given))
    near = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "3", "4", "4", "5", "None"]  # 2 is as empty as 1
    last = corpus_pipeline.segment(spark, docs, SF).collect()
    assert len(last) == len(ODD_ROWS) and all(r.lossless for r in last)


def agenda(merger, text, key, variants):
    """Pieces of one text by the definition: per chunk, take the best candidate that is still there, leftmost first."""
    if not text:
        return []
    text = " " + text
    cut = [k for k in range(len(text)) if k == 0 or (text[k] == " " and text[k - 1] != " ")
           or merger.alone[ord(text[k])] or merger.alone[ord(text[k - 1])]]
    seed, out = xxhash.xxh64_intdigest(str(key).encode(), merger.seed), []
    for place, (a, b) in enumerate(zip(cut, cut[1:] + [len(text)])):
        mixed = scramble(np.array([place], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        variant = int(mixed[0] % np.uint64(variants))
        parts = [(k, k + 1, int(merger.symbol[ord(text[a + k])])) for k in range(b - a)]
        gone = {}
        while True:
            best = None
            for k in range(len(parts) - 1):
                (s, m, x), (_, e, y) = parts[k], parts[k + 1]
                made = merger.table.get((x << 20) | y, -1) if x >= 0 and y >= 0 else -1
                if made < 0:
                    continue
                if (s, m, e, made) not in gone:
                    gone[s, m, e, made] = merger.dropped(*(np.array([v]) for v in (variant, s, m, e, made)))[0]
                if not gone[s, m, e, made] and (best is None or merger.score[made] > best[0]):
                    best = (merger.score[made], k, (s, e, made))
            if best is None:
                break
            parts[best[1]: best[1] + 2] = [best[2]]
        for s, e, x in parts:
            out += [x] if x >= 0 else [merger.bytes[c] for c in text[a + s: a + e].encode()]
    return out


def test_dropout_by_definition(spark):
    texts = [r.text[:400] for r in table(spark, "documents").limit(25).collect()] + ["x" * 130 + " tail", "日本 ﬁ \n▁é", " a  b "]
    merger = Merger(default_model(), 0.3, 17)
    ids, at = merger.encode(texts, list(range(len(texts))), 4)
    assert [ids[at[k]: at[k + 1]].tolist() for k in range(len(texts))] == [agenda(merger, t, k, 4) for k, t in enumerate(texts)]


def lines_by_hand(docs):
    """``(doc_id, text)`` without lines of 16 characters or more that five sources or more hold."""
    sites, first = {}, {}
    for i, t, source in docs:
        for line in {x.strip(" \t\r\x0b\x0c") for x in t.split("\n")}:
            if len(line) >= 16:
                sites.setdefault(line, set()).add(source)
                first[line] = min(first.get(line, i), i)
    return [(i, "\n".join(x for x in t.split("\n") if len(sites.get(x.strip(" \t\r\x0b\x0c"), ())) < 5
                          or first[x.strip(" \t\r\x0b\x0c")] == i)) for i, t, _ in docs]


def test_pipeline_by_hand(spark):
    """All five stages against loops over all rows; only the fitted classifier and the piece merger are shared."""
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, "documents").collect()]
    model = fit_quality(*training_texts(table(spark, "documents"), table(spark, "labels"), "quality",
                                        remainder(F.col("_id"), 4) != 2, SAMPLE))
    good = [d for d in docs if model.scores([d[1].encode()])[0] >= 0.7]
    assert 0 < len(good) < len(docs)
    left = lines_by_hand(good)
    assert left != [d[:2] for d in good]
    ids = set(kept_by_hand(left))  # Jaccard similarity of five-word shingles
    kept = [(i, t) for i, t in left if i in ids]
    assert len(kept) < len(left)
    items = [set(shingles(words_of(r.text))) for r in table(spark, "benchmark").collect()]
    clean = [(i, t) for i, t in kept if not any(q and len(q & set(shingles(words_of(t)))) >= 0.8 * len(q) for q in items)]
    assert len(clean) < len(kept)
    merger = Merger(default_model(), 0.1, 17)
    want = {}
    for i, t in clean:
        ids, _ = merger.encode([t], [i])  # each occurrence of a word by its own key
        assert merger.decode(ids.tolist()) == t
        want[i] = len(ids)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == len(want) and {r.doc_id: r.n_pieces for r in rows} == want and all(r.lossless for r in rows)


def test_quality_pieces():
    """Pieces cover whole texts, or are spread over all parts of them."""
    from parley.llm.dictionary_quality import PIECE, pieces
    texts = [bytes([k]) * (PIECE * 40 + k) for k in range(1, 6)]
    assert b"".join(pieces(texts, 10**9)) == b"".join(texts)
    some = pieces(texts, 40 * PIECE)
    assert len(some) == 40 and {p[0] for p in some} == {1, 2, 3, 4, 5}
    ends = pieces([b"".join(bytes([k]) * PIECE for k in range(200))], 20 * PIECE)
    assert len(ends) == 20 and ends[0][0] < 60 and ends[-1][0] > 140
