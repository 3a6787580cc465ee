"""Fill-in-the-middle: texts cut at unit boundaries found on a wavelet matrix, put in a new order, and restored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 4_000_000

# Classes of bytes, three bits each. The bytes of one character behind its first are a class of their own, so that
# characters are counted by ranks too.
OTHER, LINE_FEED, BLANK, LETTER, DIGIT, FULL_STOP, COMMA, CONTINUED = range(8)
BITS = 3
# What ends a unit.
UNITS = {"line": (LINE_FEED,), "word": (LINE_FEED, BLANK), "sentence": (LINE_FEED, FULL_STOP),
         "clause": (LINE_FEED, FULL_STOP, COMMA)}


def _classes() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    of[[9, 11, 12, 13, 32]], of[10] = BLANK, LINE_FEED
    of[48:58], of[65:91], of[97:123] = DIGIT, LETTER, LETTER
    of[[33, 46, 63]], of[[44, 58, 59]] = FULL_STOP, COMMA
    of[0x80:0xC0], of[0xC0:] = CONTINUED, LETTER
    return of


CLASS_OF_BYTE = _classes()


class WaveletMatrix:
    """Ranks of any class at any position of a sequence of small numbers, from one bit vector a bit of the number.

    Level by level, from the highest bit, positions with a 0 move to the front and those with a 1 behind them, in order;
    a class is one run of the last order, and a rank takes one popcount a level. It needs ``bits`` bits a symbol and one
    count a 64 symbols and level.
    """

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for level in reversed(range(bits)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[: len(some)] = some
            word = packed.view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64)[:-1]))
            zeros = self.n - int(np.count_nonzero(bit))
            self.levels.append((word, before, zeros))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        word, before, _ = level
        cell = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[cell] + np.bitwise_count(word[cell] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each of the positions ``at`` (0 to n)."""
        at, start = np.asarray(at, np.int64), np.zeros(1, np.int64)
        for k, level in enumerate(self.levels):
            a, s = self._ones(level, at), self._ones(level, start)
            at, start = (a + level[2], s + level[2]) if symbol >> (self.bits - 1 - k) & 1 else (at - a, start - s)
        return at - start[0]

    def boundaries(self, classes, at: np.ndarray) -> np.ndarray:
        """How many symbols of any of ``classes`` stand before each position: the ranks, added up."""
        return sum((self.rank(c, at) for c in classes), np.zeros(len(at), np.int64))

    def place(self, classes, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest position from ``low`` to ``high`` before which ``number`` boundaries lie, by bisection."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high) >> 1
            enough = self.boundaries(classes, mid) >= number
            high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid + 1, high))
        return low


def cuts(data: np.ndarray, edges: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "line"):
    """For texts lying one behind the other in ``data`` (UTF-8, text k from ``edges[k]`` to ``edges[k + 1]``):
    the number n of units, both cuts, and the characters of the first two parts.

    The cuts lie behind ``first % (n + 1)`` and ``second % (n + 1)`` units, the smaller one first. What follows the
    last boundary of a text is a unit too.
    """
    matrix, ends = WaveletMatrix(CLASS_OF_BYTE[data]), UNITS[unit]
    start, stop = edges[:-1], edges[1:]
    seen = matrix.boundaries(ends, edges)
    whole = seen[1:] - seen[:-1]
    tail = np.zeros(len(whole), np.int64)
    full = np.flatnonzero(stop > start)
    tail[full] = ~np.isin(CLASS_OF_BYTE[data[stop[full] - 1]], ends)
    n = whole + tail
    a, b = first % (n + 1), second % (n + 1)

    def behind(k):
        at = matrix.place(ends, seen[:-1] + k, start, stop)
        return np.where(k > whole, stop, np.where(k == 0, start, at))

    p, q = behind(np.minimum(a, b)), behind(np.maximum(a, b))
    inner = [matrix.rank(CONTINUED, x) for x in (start, p, q)]
    return n, p, q, (p - start) - (inner[1] - inner[0]), (q - p) - (inner[2] - inner[1])


def _arrange(out: pa.Schema, at: dict[str, int], keep: list[int], unit: str, block_bytes: int):
    """Tasks' work: rows in, the kept columns with unit count, form, characters of the parts and output out."""
    p_mark, s_mark, m_mark = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def block(batch):
        texts = batch.column(at["text"]).cast(pa.binary()).to_pylist()
        forms = batch.column(at["form"]).to_pylist()
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        a, b = (batch.column(at[k]).to_numpy(zero_copy_only=False) for k in ("first", "second"))
        n, p, q, before, middle = cuts(np.frombuffer(b"".join(texts), np.uint8), edges, a, b, unit)
        p, q, made = (p - edges[:-1]).tolist(), (q - edges[:-1]).tolist(), []
        for k, (t, form) in enumerate(zip(texts, forms)):
            if form == "plain":
                made.append(t)
            elif form == "psm":
                made.append(b"".join((p_mark, t[: p[k]], s_mark, t[q[k]:], m_mark, t[p[k]: q[k]])))
            else:
                made.append(b"".join((s_mark, t[q[k]:], p_mark, t[: p[k]], m_mark, t[p[k]: q[k]])))
        plain = pc.equal(batch.column(at["form"]), "plain")
        parts = [pc.if_else(plain, pa.scalar(None, pa.int64()), pa.array(x)) for x in (before, middle)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(n), batch.column(at["form"]), *parts,
             pa.array(made, pa.binary()).cast(pa.string())], schema=out)

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(at["text"])).to_numpy(zero_copy_only=False))
            row = 0
            while row < batch.num_rows:  # a text longer than a block is a block of its own
                done = size[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(size, done + block_bytes, "right")))
                yield block(batch.slice(row, end - row))
                row = end

    return run


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1: the first groups of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7,
                   rate: int = 100, spm_rate: int = 50, out: str = "output", keep: list[str] | None = None,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input's rows and columns (those in ``keep``, by default all) with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``out``.

    A text is cut at two boundaries between its units (``unit``: line, word, sentence or clause; each with what ends
    it), drawn by a hash of ``seed`` and id, into prefix, middle and suffix. ``psm`` puts ``<P>`` prefix ``<S>`` suffix
    ``<M>`` middle, ``spm`` puts ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (``spm_rate`` of 100), and ``plain`` is the
    text itself: all texts beyond ``rate`` of 100, empty ones, and those that contain a mark.

    Classes of the bytes of a block of texts form one wavelet matrix; ranks of the classes that end a unit give the
    boundaries of every text, bisection on the ranks both cuts, and the rank of continued bytes the characters.

    Null texts are empty ones; a null id is drawn for like an empty word. Repeated rows give equal rows. Columns that
    already have one of the new names are replaced. Texts of any length are cut whole. An empty table stays empty.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", out]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {x.lower() for x in new}]
    h = draws(F.col(f"`{id_col}`"), seed)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when(marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm"))
    # By place, as names of the input may be anything.
    rows = docs.select(*[F.col(f"`{c}`") for c in names], text.alias("_"), form.alias("_"), h[0].alias("_"), h[1].alias("_"))
    rows = rows.toDF(*[f"c{k}" for k in range(len(names) + 4)])
    at = {k: len(names) + i for i, k in enumerate(("text", "form", "first", "second"))}
    fields = [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(names)]
    fields += [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
               T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
               T.StructField("made", T.StringType())]
    schema = T.StructType(fields)
    work = _arrange(to_arrow_schema(schema), at, list(range(len(names))), unit, block_bytes)
    return rows.mapInArrow(work, schema).toDF(*names, *new)


def restore(output: Column, form: Column) -> Column:
    """The text of an output of ``fill_in_middle``. No part holds a mark, so the marks are the only ones."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))


def middle_digest(docs: DataFrame) -> DataFrame:
    """One row per document: id, units, form, characters of prefix and middle, and SHA-256 of output and restored text."""
    return fill_in_middle(docs, keep=["doc_id"]).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


# The same with lists of lines.
MIDDLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS s FROM documents),
    h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, ('0x' || s[1:8])::BIGINT AS h1,
        ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
    f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
        greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 100
            THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
        coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
        ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p"""
