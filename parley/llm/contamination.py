"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.spans import hashes, scramble, word_spans

WORDS = 5
CONTAINMENT = 0.8
HASHES = 48
ITEMS_PER_BLOCK = 20_000
BLOCK_BYTES = 8_000_000
EXACT = 8  # items of no more shingles are looked up by their shingles, without MinHash
_U = np.uint64


def words_of(text: str | bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but space and \\t to \\r, in UTF-8."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.lower().split()  # of bytes: letters A-Z and white space in ASCII only


def shingles(w: list[bytes], n: int = WORDS) -> list[bytes]:
    """Runs of n words; of fewer words the whole sequence; of none nothing."""
    if len(w) < n:
        return [b" ".join(w)] if w else []
    return [b" ".join(w[i: i + n]) for i in range(len(w) - n + 1)]


def shingle_hashes(data: np.ndarray, edges: np.ndarray, n: int = WORDS):
    """A 64-bit hash of each run of n words within a part of ``data`` (cut at ``edges``), and the part's number."""
    starts, ends, part = word_spans(data, edges)
    h = hashes(data, starts, ends)
    if len(h) < n:
        return h[:0], part[:0]
    out = np.full(len(h) - n + 1, n, _U)
    for i in range(n):
        out = scramble(out * _U(0x9E3779B97F4A7C15) + h[i: i + len(out)])
    one = part[: len(out)] == part[n - 1:]
    return out[one], part[: len(out)][one]


def _seeds(count: int):
    r = np.random.default_rng(20)
    return r.integers(0, 2**63, count, dtype=np.uint64) | _U(1), r.integers(0, 2**63, count, dtype=np.uint64)


def minima(h: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """MinHash values (rows, count), of 32 bits, of the runs of ``h`` that begin at ``starts``."""
    mul, add = _seeds(count)
    out = np.empty((len(starts), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((h * mul[k] + add[k]) >> _U(32)).astype(np.uint32), starts)
    return out


def _every(part: np.ndarray, step: int) -> np.ndarray:
    """Places of every ``step``-th row of each part."""
    if not len(part):
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], part[1:] != part[:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
    return np.flatnonzero(place % step == 0)


def size_class(n: int) -> int:
    """The partition of an item of n different shingles: 16 for up to 16, 32 for up to 32, and so on."""
    return max(2 * EXACT, 1 << (n - 1).bit_length())


class Items:
    """Test items as a search index: one part for each size, banded by one MinHash value each; items of up to ``EXACT``
    shingles by as many of their rarest shingles as no document that contains them can lack."""

    def __init__(self, rows: list[tuple], containment: float, count: int, n: int):
        self.count, self.n, self.sets, self.short, self.parts = count, n, {}, {}, {}
        entries: dict[int, list] = {}
        few: list[tuple[int, np.ndarray, int]] = []
        for at, (item, text) in enumerate(rows):
            w = words_of(text)
            found = frozenset(shingles(w, n))
            if not found:
                continue
            self.sets[at] = (item, found, int(np.ceil(containment * len(found) - 1e-9)))
            if len(w) < n:
                self.short.setdefault(next(iter(found)), []).append(at)
                continue
            data = np.frombuffer(b" ".join(w), np.uint8)
            h = np.unique(shingle_hashes(data, np.array([0, len(data)]), n)[0])
            if len(found) <= EXACT:
                few.append((at, h, len(found) - self.sets[at][2] + 1))
                continue
            entries.setdefault(size_class(len(found)), []).append((at, minima(h, np.array([0]), count)[0]))
        self.few = None
        if few:
            value, times = np.unique(np.concatenate([h for _, h, _ in few]), return_counts=True)
            rarest = [(at, h[np.argsort(times[np.searchsorted(value, h)], kind="stable")[:n]]) for at, h, n in few]
            keys, ats = np.concatenate([h for _, h in rarest]), np.repeat([a for a, _ in rarest], [len(h) for _, h in rarest])
            seen = np.zeros(1 << 24, bool)
            seen[keys & _U(0xFFFFFF)] = True
            order = np.argsort(keys, kind="stable")
            self.few = (seen, keys[order], ats[order])
        for size, rows_ in sorted(entries.items()):
            ats = np.array([a for a, _ in rows_])
            values = np.stack([s for _, s in rows_])
            seen = np.zeros(1 << 24, bool)
            seen[self._slot(values)] = True
            order = np.argsort(values, axis=0, kind="stable")
            self.parts[size] = (seen, np.take_along_axis(values, order, 0), ats[order])

    def _slot(self, values):
        """Where a value stands in the part's table of values that occur at all."""
        return (values & np.uint32(0xFFFFFF)) ^ (np.arange(self.count, dtype=np.uint32) * np.uint32(0x51ED27) & np.uint32(0xFFFFFF))

    def candidates(self, h: np.ndarray, part: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) where the item shares a MinHash value with a window of the document, or one of a short
        item's rarest shingles is in the document.

        In the part of size U, windows are two neighbouring blocks of U shingles: an item of up to U shingles lies
        in one window wherever it stands, and fills a fair part of it however long the document is.
        """
        found: set[tuple[int, int]] = set()
        if self.few and len(h):
            seen, keys, ats = self.few
            hit = np.flatnonzero(seen[h & _U(0xFFFFFF)])
            low, high = (np.searchsorted(keys, h[hit], side) for side in ("left", "right"))
            for r, a, b in zip(part[hit].tolist(), low.tolist(), high.tolist()):
                found.update((r, int(i)) for i in ats[a:b])
        low, size, doc = None, 0, None
        for of in self.parts if len(h) else ():
            if low is None:
                at = _every(part, of)
                low, size, doc = minima(h, at, self.count), of, part[at]
            while size < of:
                at = _every(doc, 2)
                low, size, doc = np.minimum.reduceat(low, at, axis=0), size * 2, doc[at]
            same = np.flatnonzero(doc[1:] == doc[:-1])
            windows = low.copy()
            windows[same] = np.minimum(low[same], low[same + 1])
            seen, values, ats = self.parts[of]
            row, k = np.nonzero(seen[self._slot(windows)])
            for r, c in zip(row.tolist(), k.tolist()):
                a, b = (np.searchsorted(values[:, c], windows[r, c], side) for side in ("left", "right"))
                found.update((int(doc[r]), int(i)) for i in ats[a:b, c])
        return found


def _search(rows, out: pa.Schema, containment: float, count: int, n: int):
    def run(batches):
        items = Items(rows.value, containment, count, n)
        for batch in batches:
            ids = batch.column(0)
            texts = [(t or b"").lower() for t in batch.column(1).to_pylist()]
            at, found, begin = [], [], 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK_BYTES):
                    size += len(texts[end])
                    end += 1
                block = texts[begin:end]
                data = np.frombuffer(b"".join(block), np.uint8)
                edges = np.concatenate(([0], np.cumsum([len(t) for t in block])))
                pairs = items.candidates(*shingle_hashes(data, edges, n))
                if items.short:
                    for r in [r for r, t in enumerate(block) if len(t.split(None, n - 1)) < n]:
                        pairs.update((r, i) for i in items.short.get(b" ".join(block[r].split()), ()))
                own, last = None, None
                for r, i in sorted(pairs):
                    if r != last:
                        own, last = set(shingles(block[r].split(), n)), r
                    item, wanted, least = items.sets[i]
                    shared = len(wanted & own)
                    if shared >= least:
                        at.append(begin + r)
                        found.append((item, shared, len(wanted)))
                begin = end
            cols = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64()))] + [pa.array(c, f.type) for c, f in zip(cols, list(out)[1:])],
                schema=out)

    return run


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT,
                    words: int = WORDS, values: int = HASHES, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Pairs of a document's id and the id of an item that it contains, ``n_shared`` and ``n_item`` shingles.

    An item is contained if at least ``containment`` of its different word shingles are in the document. Items are
    the query set: they are sent to the tasks in blocks of ``items_per_block`` at most (short texts, so a block is
    bounded), and the documents are read once for each block, without a shuffle. Items of up to 8 different shingles are
    looked up by shingles and never missed. A longer item that is contained has a similarity of 0.19 or more with its
    window, so ``values`` = 48 MinHash values miss it with a probability below 0.0001; fuller overlaps far less often.

    Null and empty documents contain nothing; null and empty items are in no document; an item of fewer words than a
    shingle is one shingle, which only a document of the same few words has. Repeated documents and items give
    repeated pairs. Null ids are kept as they are. No items or no documents give an empty table.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField(item_col, items.schema[item_col].dataType),
                           T.StructField("n_shared", T.IntegerType()), T.StructField("n_item", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    wanted = items.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    n = -(-wanted.count() // items_per_block)
    out = None
    for k in range(n):
        part = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        block = spark.sparkContext.broadcast([(r.i, r.t) for r in part.collect()])
        found = rows.mapInArrow(_search(block, arrow, containment, values, words), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


# The same by a join of all shingles.
CONTAINED_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
    ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE
        list_transform(range(1, len(w) - {WORDS} + 2), lambda k: array_to_string(w[k:k + {WORDS} - 1], ' ')) END) AS s
        FROM d WHERE len(w) > 0),
    sh AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE
        list_transform(range(1, len(w) - {WORDS} + 2), lambda k: array_to_string(w[k:k + {WORDS} - 1], ' ')) END) AS s
        FROM i WHERE len(w) > 0),
    sizes AS (SELECT item_id, count(*) AS n_item FROM sh GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INT) AS n_shared, CAST(any_value(n_item) AS INT) AS n_item
FROM ds JOIN sh USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id
HAVING count(*) >= ceil({CONTAINMENT} * any_value(n_item) - 1e-9)"""
