"""Quality by compression: Zstandard dictionaries of good and of bad text, and the difference of compressed sizes."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.spans import distinct, word_spans

SAMPLE = 3000
PIECE = 512
LEARN_BYTES = 32_000_000
NEAR = 4
BLOCK_BYTES = 8_000_000
_CLASS = np.arange(256, dtype=np.uint8)
for _mark, _from, _to in (("A", 65, 91), ("a", 97, 123), ("0", 48, 58), ("a", 128, 256)):
    _CLASS[_from:_to] = ord(_mark)
_RUNS = np.zeros(256, bool)
_RUNS[[ord(c) for c in "Aa0"]] = True


def shapes(texts: list[bytes]) -> list[bytes]:
    """Texts with their letters made alike: runs of capitals, of small letters and of digits become one mark, a word
    that repeats one of the four before it becomes ``=``. Marks, blanks and line breaks stay."""
    out, begin = [], 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[begin:end]), np.uint8)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts[begin:end]])))
        starts, ends, part = word_spans(data, edges)
        value = distinct(data, starts, ends)[0]
        again = np.zeros(len(value), bool)
        for k in range(1, min(NEAR, len(value) - 1) + 1):
            again[k:] |= (value[k:] == value[:-k]) & (part[k:] == part[:-k])
        mark = _CLASS[data]
        keep = np.ones(len(data), bool)
        keep[1:] = (mark[1:] != mark[:-1]) | ~_RUNS[mark[1:]]
        keep[starts] = True
        if again.any():
            step = np.zeros(len(data) + 1, np.int8)
            step[starts[again]] += 1
            step[ends[again]] -= 1
            keep[np.cumsum(step[:-1]) > 0] = False
            keep[starts[again]] = True
            mark[starts[again]] = ord("=")
        cut = np.concatenate(([0], np.cumsum(keep)))[edges].tolist()
        packed = mark[keep].tobytes()
        out += [packed[a:b] for a, b in zip(cut, cut[1:])]
        begin = end
    return out


class Dictionaries:
    """Two dictionaries each for texts and for their shapes, and a logistic curve over the two differences."""

    def __init__(self, blobs: list[bytes], curve: list[float], level: int):
        self.blobs, self.curve, self.level, self.ready = blobs, curve, level, None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def _compressors(self):
        if self.ready is None:
            import zstandard

            self.ready = []
            for b in self.blobs:
                d = zstandard.ZstdCompressionDict(b)
                d.precompute_compress(level=self.level)
                self.ready.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        return self.ready

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """For text and shape: (bytes with the bad dictionary - bytes with the good one) / their mean.

        Texts are compressed in pieces of ``PIECE`` bytes, so that a dictionary counts as much at the end of a long
        text as at its start; all pieces count.
        """
        compressors, out = self._compressors(), np.zeros((len(texts), 2))
        for k, channel in enumerate((texts, shapes(texts))):
            good_of, bad_of = compressors[2 * k].compress, compressors[2 * k + 1].compress
            for r, s in enumerate(channel):
                pieces = [s] if len(s) <= PIECE else [s[at: at + PIECE] for at in range(0, len(s), PIECE)]
                if s:
                    good, bad = sum(len(good_of(p)) for p in pieces), sum(len(bad_of(p)) for p in pieces)
                    out[r, k] = 2 * (bad - good) / (bad + good)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.curve[0] + self.differences(texts) @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples, their concatenation serves as a raw one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\n"


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (intercept first) of a logistic curve, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def moved(curve: np.ndarray, y: np.ndarray, share: float | None) -> np.ndarray:
    """The curve for a share of label 1 other than that of ``y``, which it was fitted on."""
    if share is not None and 0 < share < 1 and 0 < y.mean() < 1:
        curve = curve.copy()
        curve[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return curve


def training_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int,
                   id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[bytes, int]], float | None]:
    """At most ``limit`` (text, label) rows of each label, by a hash of the id: the documented bound of the fit.

    ``keep`` is a condition on ``_id`` that names the rows which may be learnt from. Repeated ids count once. The
    second result is the share of label 1 among all such rows, sampled or not (None: there are none).
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & keep).dropDuplicates(["_id"]))
    rank = F.xxhash64(F.lit("train"), F.col("_id"))
    picked = [known.where(F.col("_y") == y).orderBy(rank, "_id").limit(limit) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_t"))
    rows = texts.join(picked[0].union(picked[1]), "_id").dropDuplicates(["_id"]).orderBy(rank, "_id").collect()
    return [(bytes(r["_t"] or b""), r["_y"]) for r in rows], known.agg(F.avg("_y")).first()[0]


def pieces(texts: list[bytes], limit: int) -> list[bytes]:
    """Pieces of ``PIECE`` bytes from all over the texts, whole texts if they have ``limit`` bytes or fewer in all; else
    those with the smallest hashes of text and place, in order, up to the limit."""
    places = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), PIECE)]
    if sum(map(len, texts)) > limit:
        places = sorted(sorted(places, key=lambda p: (zlib.crc32(b"%d:%d" % p), p))[: limit // PIECE])
    return [texts[k][at: at + PIECE] for k, at in places]


def fit(rows: list[tuple[bytes, int]], share: float | None = None, size: int = 48_000, level: int = 3,
        learn_bytes: int = LEARN_BYTES) -> Dictionaries:
    """Dictionaries from two thirds of the rows, the calibrating curve from the rest.

    Dictionaries are trained on at most ``learn_bytes`` bytes of each label, in pieces from all parts of the texts.

    ``share`` is the part of good rows among all labelled ones; the sample may hold another, so the curve is moved.
    Without rows of both labels the score is the same for all texts: the share of good rows, 0.5 for none.
    """
    part = [k % 3 == 2 for k in range(len(rows))]
    learn = [r for r, held in zip(rows, part) if not held]
    held = [r for r, h in zip(rows, part) if h] or rows
    blobs = []
    for channel in (list, shapes):
        texts = channel([t for t, _ in learn])
        for y in (1, 0):
            blobs.append(_dictionary(pieces([t for t, (_, label) in zip(texts, learn) if label == y], learn_bytes), size))
    model = Dictionaries(blobs, [0.0, 0.0, 0.0], level)
    y = np.array([v for _, v in held], float)
    if len(y) == 0 or y.min() == y.max():
        even = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        model.curve = [float(np.log(even / (1 - even))), 0.0, 0.0]
        return model
    x = model.differences([t for t, _ in held])
    model.curve = [float(v) for v in moved(logistic(x, y), y, share)]
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text",
                   label: str = "quality", threshold: float = 0.7, sample: int = SAMPLE,
                   score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The input's rows and columns with ``score`` (0 to 1, higher: better) and ``predicted`` (score >= threshold).

    Only the text is an input of the score. Null and empty texts have no difference and get the curve's value at
    zero. Repeated rows get equal scores. Columns already named as the two new ones are replaced; others are kept.
    An empty table of documents gives an empty table; see ``fit`` for missing labels.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        fit(*training_texts(docs, labels, label, keep, sample, id_col, text_col)))

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores([bytes(t) if t is not None else b"" for t in texts]), dtype="float64")

    score = F.pandas_udf(of, "double").asNondeterministic()(F.col(f"`{text_col}`").cast("string").cast("binary"))
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]
    return (docs.select(*[F.col(f"`{c}`") for c in kept], score.alias(score_col))
            .withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int")))


def remainder(col: Column, n: int) -> Column:
    """crc32 of a value's text, modulo n."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (never learnt from), score, predicted."""
    done = quality_scores(docs.select("doc_id", "text"), labels, remainder(F.col("_id"), 4) != 2)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", "predicted")
