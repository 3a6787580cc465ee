"""Near-duplicates by Jaccard similarity of word shingles: found by long SimHash fingerprints, verified on the shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.hot import looked_up
from parley.llm.simhash import shingle_digests
from parley.llm.spans import scramble
from parley.llm.tiles import local_roots, tiled
from parley.session import materialize

WORDS = 5
SIMILARITY = 0.8
LANES = 3  # 64-bit words of a fingerprint
RADIUS = 56
BANDS = 16        # bands at least
BAND_BITS = 20    # bits of a band at most
MISSED = 0.0001   # of pairs of which 0.175 of the bits differ; at a similarity of 0.8 it is 0.15 on the average
BUCKET = 2_048    # fingerprints that agree in a band by chance, at most
TILE = 4_096
TEXTS = 64
_U = np.uint64


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text; none of a text without words."""
    return np.unique(shingle_digests(text, words))


def set_key(h: np.ndarray) -> int:
    """Equal sets have equal keys; signed as Spark's long."""
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), 7)], _U).view(np.int64)[0])


def long_fingerprint(h: np.ndarray) -> list[int]:
    """SimHash of ``LANES`` x 64 bits of a set of hashes, each shingle counted once."""
    out = []
    for lane in range(LANES):
        x, ones = scramble(h + _U(0x9E3779B97F4A7C15 * (lane + 1) % 2**64)), np.zeros(64, np.int64)
        for at in range(0, len(x), 65536):
            ones += np.unpackbits(x[at: at + 65536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0]))
    return out


def bits_for(n: int) -> int:
    """Bits of a band for ``n`` fingerprints, so that about ``BUCKET`` of them agree in one by chance."""
    return min(BAND_BITS, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))))


def band_places(bits: int) -> np.ndarray:
    """The bits of a fingerprint that each band looks at, a row a band: blocks of permuted fingerprints.

    A bit of two sets of a similarity of 0.8 differs with a probability of 0.151 (the angle between them), so a band of b
    bits is shared with one of 0.849 ** b; there are as many bands as leave ``MISSED`` of the pairs without any.
    """
    n = max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-(0.825**bits))))
    rng, each = np.random.Generator(np.random.PCG64(9)), 64 * LANES // bits
    blocks = [rng.permutation(64 * LANES)[: each * bits].reshape(each, bits) for _ in range(-(-n // each))]
    return np.concatenate(blocks)[:n]


def fingerprint_bands(lanes: list[np.ndarray], bits: int) -> np.ndarray:
    """Band keys, a row a fingerprint: number of the band, then what the fingerprint has in its places."""
    places = band_places(bits)
    ones = np.unpackbits(np.stack(lanes, 1).astype("<i8").view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((len(ones), len(places)), np.int64) + (np.arange(len(places)) << bits)
    for k in range(bits):
        out += ones[:, places[:, k]].astype(np.int64) << k
    return out


def bands(h: np.ndarray, bits: int = BAND_BITS) -> list[int]:
    """Keys that sets of shingle hashes share if their SimHash fingerprints agree in all bits of a band."""
    if not len(h):
        return []
    return fingerprint_bands([np.array([x], np.int64) for x in long_fingerprint(h)], bits)[0].tolist()


def _prints(words: int):
    """Key and fingerprint of each row's shingle set."""
    def run(batches):
        for batch in batches:
            keys, lanes = [], [[] for _ in range(LANES)]
            for text in batch.column(2).to_pylist():
                h = shingle_set(text, words)
                keys.append(set_key(h))
                for lane, x in zip(lanes, long_fingerprint(h)):
                    lane.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in lanes)],
                names=["_id", "_hash", "_key", *(f"_f{k}" for k in range(LANES))])

    return run


def _banded(bits: int, rows: int = 1024):
    """Each fingerprint once a band."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, rows).columns]
                found = fingerprint_bands(part[1:], bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, found.shape[1])) for c in part] + [pa.array(found.ravel())],
                                                 names=["_key", *(f"_f{k}" for k in range(LANES)), "_band"])

    return run


def _near(x: list[np.ndarray], y: list[np.ndarray], radius: int, block: int = 256):
    """Index pairs whose fingerprints differ in at most ``radius`` bits.

    Both sides are sorted by population count and cut into tiles. The counts of two fingerprints differ by no more than
    their bits do, so tile pairs whose ranges of counts lie more than ``radius`` apart are skipped.
    """
    def cut(lanes):
        count = sum(np.bitwise_count(v).astype(np.int64) for v in lanes)
        order = np.argsort(count, kind="stable")
        return order, [v[order] for v in lanes], count[order]

    own, x, low = cut(x)
    other, y, high = cut(y)
    found = []
    for p in range(0, len(own), block):
        least, most = low[p], low[min(p + block, len(own)) - 1]
        for q in range(0, len(other), 4 * block):
            if high[q] - most > radius or least - high[min(q + 4 * block, len(other)) - 1] > radius:
                continue
            far = np.zeros((len(x[0][p: p + block]), len(y[0][q: q + 4 * block])), np.uint8)
            for a, b in zip(x, y):
                far += np.bitwise_count(a[p: p + block, None] ^ b[None, q: q + 4 * block])
            i, j = np.nonzero(far <= radius)
            if len(i):
                found.append((own[i + p], other[j + q]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _candidates(radius: int):
    """Links that join the same keys as all near pairs of two tiles do."""
    def run(batches):
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                x, y = ([c[k].values.field(f).to_numpy(zero_copy_only=False) for f in range(LANES + 1)]
                        for c in (batch.column(0), batch.column(1)))
                if not len(y[0]):  # one tile, with itself
                    y = x
                i, j = _near([v.view(_U) for v in x[1:]], [v.view(_U) for v in y[1:]], radius)
                keys, place = np.unique(np.concatenate((x[0], y[0])), return_inverse=True)
                root = local_roots(len(keys), place[i], place[j + len(x[0])])
                own = np.flatnonzero(root != np.arange(len(keys)))
                out_a.append(keys[own])
                out_b.append(keys[root[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_a, out_b)], names=["a", "b"])

    return run


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """The Jaccard similarity of two sorted sets is at least ``similarity``."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (small + large - both) - 1e-9


def _verified(words: int, similarity: float):
    """Of the texts of two tiles, links that join the same keys as all pairs of the wanted similarity do."""
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                rows = batch.column(0)[k].values
                keys, own = rows.field("k").to_pylist(), rows.field("own").to_pylist()
                sets = [shingle_set(t, words) for t in rows.field("t").to_pylist()]
                root, one = list(range(len(keys))), len(set(own)) < 2
                for i in range(len(keys)):
                    for j in range(i):
                        if root[i] != root[j] and (one or own[i] != own[j]) and alike(sets[i], sets[j], similarity):
                            old, new = root[i], root[j]
                            root = [new if r == old else r for r in root]
                            out_a.append(keys[i])
                            out_b.append(keys[j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def candidate_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` that connect the keys which pairs of one of their ``_bands`` within ``radius`` bits connect."""
    lanes = [f"_f{k}" for k in range(LANES)]
    classes = prints.groupBy("_key").agg(*(F.first(c).alias(c) for c in [*lanes, "_bands"]))
    return band_links(classes.select("_key", *lanes, F.explode("_bands").alias("_band")), radius, tile)


def band_links(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The same of one row a key and ``_band``.

    Only texts of the same band are compared, so the work grows with the texts and with how many of them are really
    alike; a band that very many texts share is cut into tiles (see ``tiled``), all of which are compared.
    """
    x = F.struct("_key", *[f"_f{k}" for k in range(LANES)])
    pairs = (tiled(rows, ["_band"], "_key", tile).groupBy("_band", "_a", "_b")
             .agg(F.collect_list(F.when(F.col("_own") == F.col("_a"), x)).alias("x"),
                  F.collect_list(F.when(F.col("_own") != F.col("_a"), x)).alias("y"))
             .where((F.size("x") + F.size("y")) > 1).where((F.col("_a") == F.col("_b")) | (F.size("x") * F.size("y") > 0)))
    return pairs.select("x", "y").mapInArrow(_candidates(radius), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id and ``component_id``, the smallest id reachable over pairs of texts whose sets of word
    shingles have a Jaccard similarity of ``similarity`` or more.

    Texts of equal sets are one class. Classes whose SimHash fingerprints (192 bits of five-word shingles) agree in one of
    the bands (``band_places``) and differ in at most 56 bits are candidates, and only pairs with the similarity, on all
    their shingles, are linked. Two sets of a similarity of exactly 0.8 share a band with a probability of 0.9998 or more;
    their fingerprints differ in 24 to 29 bits with a deviation of 5. Bands get longer, and more, with the number of
    classes, so that chance meetings do not grow with it. Shingles and sets are compared by 64-bit hashes.

    Texts without words are one class; a text of fewer words than a shingle is one shingle. Repeated rows give repeated
    rows; a null id stays null and takes part in its component, whose id is the smallest that is not null.
    """
    id_type = docs.schema[id_col].dataType
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    lanes = [f"_f{k}" for k in range(LANES)]
    schema = f"_id {id_type.simpleString()}, _hash long, _key long, " + ", ".join(f"{c} long" for c in lanes)
    prints = materialize(rows.mapInArrow(_prints(words), schema), "long-fingerprints")
    classes = materialize(prints.groupBy("_key").agg(*(F.first(c).alias(c) for c in lanes)), "fingerprint-classes")
    banded = classes.mapInArrow(_banded(bits_for(classes.count())), "_key long, " + ", ".join(f"{c} long" for c in lanes) + ", _band long")
    near = materialize(components(band_links(banded)).withColumnRenamed("node", "_key").withColumnRenamed("root", "_near"), "near-keys")
    # One text of each class that has a candidate; equal texts are found by their hash, not by their shingles.
    one = prints.join(near, "_key").groupBy("_key", "_near").agg(F.min("_hash").alias("_hash"))
    texts = (rows.select("_hash", "_text").join(one, "_hash").groupBy("_near", "_key").agg(F.first("_text").alias("_text")))
    texts = materialize(texts, "near-texts")
    pairs = (tiled(texts, ["_near"], "_key", TEXTS).groupBy("_near", "_a", "_b")
             .agg(F.collect_list(F.struct(F.col("_key").alias("k"), F.col("_own").alias("own"), F.col("_text").alias("t")))
                  .alias("x")).where(F.size("x") > 1))
    links = pairs.select("x").mapInArrow(_verified(words, similarity), "a long, b long")
    roots = components(links).withColumnRenamed("node", "_key")
    # From here to the last step one row is a class; only then does each class go to all of its rows.
    keys = prints.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    classed = keys.join(roots, "_key", "left").select("_key", "_first", "_n", F.coalesce("root", "_key").alias("_class"))
    first = classed.groupBy("_class").agg(F.min("_first").alias("component_id"))
    table = materialize(classed.join(first, "_class").select("_key", "component_id", "_n"), "near-classes")
    return looked_up(prints.select("_id", "_key"), table, "_key").select(F.col("_id").alias(id_col), "component_id")
