"""Near-duplicate vectors: E8 lattice hashing of random projections, verified by cosine."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.spans import scramble
from parley.llm.tiles import local_roots, tiled
from parley.session import materialize

TABLES = 8
PROBES = 2
SCALE = 1.5
TILE = 1024
SEED = 8
_U = np.uint64


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of D8, or of D8 moved by one half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to the neighbours of a lattice point."""
    whole = [v for v in product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
    halves = [v for v in product((-0.5, 0.5), repeat=8) if sum(c < 0 for c in v) % 2 == 0]
    return np.array(whole + halves)


@lru_cache(maxsize=16)
def projections(dim: int, tables: int, scale: float, seed: int):
    r = np.random.default_rng([seed, dim])
    return r.standard_normal((tables, dim, 8)) / scale, r.random((tables, 8)) * 4


def cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Keys (n, tables, 1 + probes) of unit vectors: in each table the own lattice cell, then the nearest others."""
    matrix, shift = projections(x.shape[1], tables, scale, seed)
    out = np.empty((len(x), tables, 1 + probes), _U)
    steps = minimal_vectors()
    for t in range(tables):
        p = x @ matrix[t] + shift[t]
        own = nearest_e8(p)
        reach = (p - own) @ steps.T
        best = np.argsort(-reach, axis=1, kind="stable")[:, :probes]
        points = np.concatenate((own[:, None, :], own[:, None, :] + steps[best]), 1)
        code = np.rint(points * 2).astype(np.int64).astype(_U)
        key = np.full(code.shape[:2], t + 1 + (x.shape[1] << 8), _U)
        for k in range(8):
            key = scramble(key * _U(0x9E3779B97F4A7C15) + code[:, :, k])
        out[:, t] = key
    return out


def _matrix(column, width: int) -> np.ndarray:
    """Rows of unit vectors of ``width`` double components, from their bytes."""
    x = np.frombuffer(b"".join(column), "<f8").reshape(-1, width)
    return x


def _keys(tables: int, probes: int, scale: float, seed: int):
    def run(batches):
        for batch in batches:
            node, raw = batch.column(0), batch.column(1).to_pylist()
            size = np.array([len(v) // 8 for v in raw], np.int64)
            parts = []
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                key = cells(_matrix([raw[i] for i in at], int(width)), tables, probes, scale, seed)
                own = np.zeros(key.shape, bool)
                own[:, :, 0] = True
                key, own = key.reshape(len(at), -1), own.reshape(len(at), -1)
                row = np.repeat(at, key.shape[1])
                parts.append((row, key.reshape(-1).view(np.int64), own.reshape(-1)))
            if parts:
                row, key, own = (np.concatenate(p) for p in zip(*parts))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([node.take(at), batch.column(1).take(at), pa.array(key), pa.array(own)],
                                                 names=["node", "vector", "key", "home"])

    return run


def _pairs(threshold: float, count: bool):
    """Compare the vectors of a pair of tiles; links as stars, or the number of links of each vector."""
    def run(batches):
        for batch in batches:
            out = ([], [])
            nodes, vectors, left, extra = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                node = nodes[k].values.to_numpy()
                raw = vectors[k].as_py()
                a = left[k].values.to_numpy(zero_copy_only=False)
                more = extra[k].values.to_numpy(zero_copy_only=False)
                width = len(raw[0]) // 8
                x = _matrix(raw, width)
                i, j = (np.arange(len(x)),) * 2 if a.all() else (np.flatnonzero(a), np.flatnonzero(~a))
                one = a.all()
                links = np.zeros(len(x), np.int64)
                rows, cols = [], []
                for at in range(0, len(i), 512):
                    near = x[i[at: at + 512]] @ x[j].T >= threshold
                    if count:
                        links[i[at: at + 512]] += near @ more[j]
                        if not one:
                            links[j] += more[i[at: at + 512]] @ near
                    else:
                        near &= more[i[at: at + 512], None] | more[None, j]  # one of them at home in the cell
                        p, q = np.nonzero(near)
                        rows.append(i[p + at])
                        cols.append(j[q])
                if count:
                    out[0].append(node)
                    out[1].append(links)
                else:
                    root = local_roots(len(x), np.concatenate(rows), np.concatenate(cols))
                    own = np.flatnonzero(root != np.arange(len(x)))
                    out[0].append(node[own])
                    out[1].append(node[root[own]])
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v or empty)) for v in out], names=["a", "b"])

    return run


def _tile_pairs(rows: DataFrame, key: str, extra: Column, tile: int, same_tile: Column | None = None) -> DataFrame:
    pairs = (tiled(rows, [key], "node", tile).groupBy(key, "_a", "_b")
             .agg(F.collect_list(F.struct("node", "vector", (F.col("_own") == F.col("_a")).alias("left"),
                                          extra.alias("extra"))).alias("m"))
             .where((F.size("m") > 1) | (same_tile if same_tile is not None else F.lit(False)))
             .where((F.col("_a") == F.col("_b")) | (F.exists("m", lambda x: x["left"]) & F.exists("m", lambda x: ~x["left"]))))
    return pairs.select("m.node", "m.vector", "m.left", "m.extra")


def unit_vector(col: str) -> Column:
    """The bytes of a vector; null if it is null, empty, zero, or holds a null or non-finite component."""
    v = F.col(col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(finite & F.exists(v, lambda x: x != 0), v)


def _pack(batches):
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            if v is None:
                out.append(None)
                continue
            x = np.array(v, "<f8")
            x = x / np.abs(x).max()
            out.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["_id", "vector"])


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                    tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED,
                    tile: int = TILE) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id reachable) and ``kept`` (it is that one).

    Each of ``tables`` random projections to eight dimensions is decoded to its E8 lattice point; a vector is sent to
    its own cell and to the ``probes`` nearest neighbouring ones, and pairs that meet in a cell at home to one of them
    are compared by cosine in double precision. Equal vectors are one class first. Cells give links as stars (one for
    each member, not all pairs); inside the components which these make, every pair is compared exactly, so a link
    counts once however often it was met. Large cells and components are cut into tiles.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing: no links, their
    own id as component, kept. Vectors of different lengths never link. Repeated rows are equal vectors, linked with
    each other. A null id stays null, and a component's id is its smallest one that is not null; such rows are not
    kept. An empty table gives an empty table. Other columns, and names in use here, do not matter.
    """
    id_type = vectors.schema[id_col].dataType
    packed = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").alias("_v"))
              .select("_id", unit_vector("_v").alias("_v")).mapInArrow(_pack, "_id long, vector binary"))
    rows = materialize(packed, "unit-vectors")
    classes = materialize(
        rows.where("vector is not null").groupBy("vector")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
        .select("vector", "_size", F.coalesce("_first", -F.abs(F.xxhash64("vector")) - 1).alias("node")), "vector-classes")
    met = classes.select("node", "vector").mapInArrow(_keys(tables, probes, scale, seed),
                                                      "node long, vector binary, key long, home boolean")
    stars = _tile_pairs(met, "key", F.col("home"), tile).mapInArrow(_pairs(threshold, False), "a long, b long")
    roots = components(stars)
    members = classes.join(roots, "node").select("root", "node", "vector", "_size")
    counts = (_tile_pairs(members, "root", F.col("_size"), tile).mapInArrow(_pairs(threshold, True), "a long, b long")
              .groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("_links")))
    # A class counts itself with all its rows in the tile it shares with itself; take the own row off.
    known = (classes.join(roots, "node", "left").join(counts, "node", "left")
             .select("vector", F.coalesce("root", "node").alias("root"),
                     (F.coalesce("_links", "_size") - 1).alias("n_links")))
    joined = rows.join(known, "vector", "left")
    first = joined.where("root is not null").groupBy("root").agg(F.min("_id").alias("_least"))
    out = joined.join(first, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return out.select(F.col("_id").cast(id_type).alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
