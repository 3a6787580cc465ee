"""SimHash near-duplicates: fingerprints, and their exact comparison tile by tile with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.tiles import local_roots, tiled
from parley.session import materialize

BITS = 64
TILE = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_digests(text: str | None, words: int) -> np.ndarray:
    """The XXH64 values (seed 42) of the shingles of a text; none of a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at space and \t to \r only
    if not w:
        return np.zeros(0, "<u8")
    line = b" ".join(w)
    if len(w) <= words:
        spans = [(0, len(line))]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], 42) for s, e in spans], dtype="<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The majority, bit by bit, of the XXH64 values (seed 42) of the shingles; signed as Spark's long."""
    h = shingle_digests(text, words)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at: at + 65536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint_column(text: str, words: int = 3) -> Column:
    """The fingerprint of a text column, as a long."""
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return F.pandas_udf(of, "long")(F.col(text).cast("string"))


def compare(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = 256):
    """Index pairs (i, j) that differ in at most ``radius`` bits, of one set (``right`` None) or between two.

    Both sides are sorted by population count and cut into tiles. The counts of two values differ by no more than
    their bits do, so tile pairs whose ranges of counts lie more than ``radius`` apart are skipped.
    """
    def cut(x):
        count = np.bitwise_count(x)
        order = np.argsort(count, kind="stable")
        return order, x[order], count[order].astype(np.int64)

    one = right is None
    lo, lx, lc = cut(left)
    ro, rx, rc = (lo, lx, lc) if one else cut(right)
    found = []
    for p in range(0, len(lx), tile):
        for q in range(p if one else 0, len(rx), tile):
            if rc[q] - lc[min(p + tile, len(lx)) - 1] > radius or lc[p] - rc[min(q + tile, len(rx)) - 1] > radius:
                continue
            near = np.bitwise_count(lx[p: p + tile, None] ^ rx[None, q: q + tile]) <= radius
            i, j = np.nonzero(np.triu(near, 1) if one and p == q else near)
            if len(i):
                found.append((lo[i + p], ro[j + q]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _stars(radius: int):
    """For each pair of tiles, links that join the same fingerprints as all links of the pair do: one for each
    fingerprint that has any."""
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            firsts, seconds = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                x = firsts[k].values.to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
                y = seconds[k].values.to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
                if len(y):
                    i, j = compare(x, y, radius)
                    j = j + len(x)
                    x = np.concatenate((x, y))
                else:
                    i, j = compare(x, None, radius)
                if len(i):
                    root = local_roots(len(x), i, j)
                    own = np.nonzero(root != np.arange(len(x)))[0]
                    out_a.append(x[own])
                    out_b.append(x[root[own]])
            empty = [np.zeros(0, "<u8")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v or empty).view("<i8")) for v in (out_a, out_b)],
                                             names=["a", "b"])

    return run


def fingerprint_links(prints: DataFrame, col: str = "fingerprint", radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` that connect exactly the distinct fingerprints which pairs within ``radius`` bits connect.

    Comparing every tile with every tile would be a cross join. Fingerprints within ``radius`` bits agree in at least
    one of ``radius + 1`` words of the 64 bits, so only tiles of the same word are compared, still all of them: no
    link is lost. Words that very many fingerprints share are cut into tiles (see ``tiled``).
    """
    n = radius + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    words = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.shiftleft(F.col("_fp"), BITS - cuts[k + 1]),
                                                                BITS - cuts[k + 1] + cuts[k]).alias("w"))
             for k in range(n)]
    distinct = prints.select(F.col(col).alias("_fp")).where(F.col("_fp").isNotNull()).distinct()
    rows = distinct.select("_fp", F.explode(F.array(*words)).alias("_word")).select("_fp", "_word.k", "_word.w")
    pairs = (tiled(rows, ["k", "w"], "_fp", tile).groupBy("k", "w", "_a", "_b")
             .agg(F.collect_list(F.when(F.col("_own") == F.col("_a"), F.col("_fp"))).alias("x"),
                  F.collect_list(F.when(F.col("_own") != F.col("_a"), F.col("_fp"))).alias("y"))
             .where((F.size("x") + F.size("y")) > 1).where((F.col("_a") == F.col("_b")) | (F.size("x") * F.size("y") > 0)))
    return pairs.select("x", "y").mapInArrow(_stars(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                   radius: int = 3) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable.

    Null and empty texts, and texts of white space only, have fingerprint zero and are linked like any other. A text
    with fewer words than a shingle is one shingle. Repeated rows give repeated rows; a null id stays null and takes
    part in its component, whose id is the smallest that is not null. An empty table gives an empty table. Columns
    of the input other than the two named are not looked at.
    """
    id_type = docs.schema[id_col].dataType
    prints = materialize(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                         .select("_id", fingerprint_column("_text", words).alias("_fp")), "fingerprints")
    roots = components(fingerprint_links(prints, "_fp", radius))
    classed = (prints.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left")
               .select("_id", "_fp", F.coalesce("root", "_fp").alias("_class")))
    first = classed.groupBy("_class").agg(F.min("_id").alias("_first"))
    return (classed.join(first, "_class")
            .select(F.col("_id").cast(id_type).alias(id_col),
                    F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                    F.col("_first").alias("component_id")))
