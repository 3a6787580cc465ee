"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.dictionary_quality import logistic, moved, remainder, training_texts
from parley.llm.spans import code_points, distinct, gather

SAMPLE = 2000
LANDMARKS = 160
NEGATIVES = 60_000
SURE = 8.0  # standard deviations
DECAY = 0.6
SYMBOLS = 64
STEPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]  # places of the second and third character of a triple
BLOCK_CHARS = 4_000_000

_SYMBOL = np.arange(0x110000, dtype=np.int64) % 36 + 28
for _c in range(26):
    _SYMBOL[65 + _c] = _SYMBOL[97 + _c] = _c
_EDGE = 26
_BREAK = np.zeros(0x110000, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(0x110000, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_TRIM = np.zeros(0x110000, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}<>*#%&$|-_"]] = True


def pieces(points: np.ndarray, edges: np.ndarray):
    """Words of texts (cut at ``edges``): starts, ends, text, sentence.

    Marks at the ends of a word are left out; three or more single characters in a row are one word, with the blanks
    between them. A sentence ends behind a word with ``.``, ``!`` or ``?`` in it and at a line's end.
    """
    inside = ~_BREAK[points]
    first = np.zeros(len(points) + 1, bool)
    first[edges] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | first[1:])) + 1
    text = np.searchsorted(edges, starts, "right") - 1
    stops = np.concatenate(([0], np.cumsum(_END[points])))
    sentence = stops[starts] + text
    for _ in range(3):  # up to three marks at each end
        starts = np.where((ends - starts > 1) & _TRIM[points[starts]], starts + 1, starts)
        ends = np.where((ends - starts > 1) & _TRIM[points[ends - 1]], ends - 1, ends)
    single = ends - starts == 1
    join = np.zeros(len(starts), bool)  # joined to the word before it
    join[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1]) & (starts[1:] - starts[:-1] <= 3)
    head = np.flatnonzero(~join)
    last = np.append(head[1:], len(starts)) - 1
    long = last - head >= 2
    keep = ~join | ~np.repeat(long, last - head + 1) if len(starts) else join
    out_end = ends.copy()
    out_end[head[long]] = ends[last[long]]
    return starts[keep], out_end[keep], text[keep], sentence[keep]


def triples(symbols: np.ndarray, offsets: np.ndarray):
    """For each gap pattern: places of triples, their word, their number and their weight."""
    word = np.repeat(np.arange(len(offsets) - 1), offsets[1:] - offsets[:-1])
    for j, k in STEPS:
        at = np.flatnonzero(word[k:] == word[: len(word) - k]) if len(word) > k else np.zeros(0, np.int64)
        yield word[at], (symbols[at] * SYMBOLS + symbols[at + j]) * SYMBOLS + symbols[at + k], DECAY ** (k - 2)


def framed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Characters of words as symbols, with a mark at both ends of each word."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size + 2)))
    out = np.full(offsets[-1], _EDGE, np.int64)
    index = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    out[np.repeat(offsets[:-1] + 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] = (
        _SYMBOL[points[index]])
    return out, offsets


def spread(symbols: np.ndarray, offsets: np.ndarray):
    """``(place, rows)``: words as rows over the triples that occur in them; triple t stands in column ``place[t]``,
    the last column is that of all triples which no word has."""
    found = list(triples(symbols, offsets))
    used = np.unique(np.concatenate([t for _, t, _ in found]))
    place = np.full(SYMBOLS**3, len(used), np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(offsets) - 1, len(used) + 1), np.float32)
    for word, triple, weight in found:
        np.add.at(out, (word, place[triple]), weight)
    return place, out / np.maximum(norms(symbols, offsets), 1e-9)[:, None].astype(np.float32)


def norms(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(offsets) - 1)
    for word, _, weight in triples(symbols, offsets):
        total += np.bincount(word, minlength=len(total)) * weight**2
    return np.sqrt(total)


def project(symbols: np.ndarray, offsets: np.ndarray, columns: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Kernel sums of words with combinations of landmarks given as (triples, n) columns."""
    total = np.zeros((len(offsets) - 1, columns.shape[1]))
    for word, triple, weight in triples(symbols, offsets):
        if len(word):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            total[word[head]] += np.add.reduceat(columns[triple if place is None else place[triple]], head, axis=0) * weight
    return total / np.maximum(norms(symbols, offsets), 1e-9)[:, None]


class Machine:
    """The decision function of a word, and the curve that turns the words of a text into its score.

    The kernel counts the triples of characters that two words share, also with up to two characters between them
    (each gap costs a factor), so letters put into an insult or left out of it change its value little.
    """

    def __init__(self, columns: np.ndarray, bias: float, curve: np.ndarray):
        self.columns, self.bias, self.curve = columns, bias, curve

    def words(self, points, starts, ends) -> np.ndarray:
        symbols, offsets = framed(points, starts, ends)
        return project(symbols, offsets, self.columns)[:, 0] + self.bias

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: the highest value of a word, the highest of another sentence, and how many are above 0."""
        out = np.full((len(texts), 3), -2.0)
        out[:, 2] = 0
        begin = 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and (end == begin or chars + len(texts[end]) <= BLOCK_CHARS):
                chars += len(texts[end])
                end += 1
            points = code_points("".join(texts[begin:end]))
            edges = np.concatenate(([0], np.cumsum([len(t) for t in texts[begin:end]])))
            starts, ends, text, sentence = pieces(points, edges)
            if len(starts):
                # Case counts in the hash but not in the value; that only costs some words a second look.
                of, seen = distinct(points, starts, ends)
                value = self.words(points, starts[seen], ends[seen])[of]
                head = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
                best, owner = np.maximum.reduceat(value, head), text[head]
                order = np.lexsort((-best, owner))
                owner, best = owner[order], best[order]
                top = np.concatenate(([True], owner[1:] != owner[:-1]))
                second = np.concatenate(([False], top[:-1])) & ~top
                out[begin + owner[top], 0] = np.maximum(best[top], -2)
                out[begin + owner[second], 1] = np.maximum(best[second], -2)
                out[begin: end, 2] = np.log1p(np.bincount(text, value > 0, minlength=end - begin))
            begin = end
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.curve[0] + self.features(texts) @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30):
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps on the points within the margin."""
    x = np.column_stack((x, np.ones(len(x), x.dtype)))  # single precision, to keep the driver small
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(len(w))
    reg[-1, -1] = 1e-8
    for _ in range(rounds):
        on = y * (x @ w.astype(x.dtype)) < 1
        near = x[on]
        a = near * weight[on][:, None].astype(x.dtype)
        new = np.linalg.solve((a.T @ near).astype(np.float64) + reg * weight.sum(), a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], w[-1]


def fit(rows: list[tuple[bytes, int]], share: float | None = None, landmarks: int = LANDMARKS, rounds: int = 3) -> Machine:
    """Train on the sentences of labelled texts.

    A text of label 0 has only clean sentences. One of label 1 has some sentence with a toxic word, which is not
    known: words typical of toxic texts stand for it, and in each text the word which the machine values most.
    Landmarks are those words and frequent clean ones. Without rows of both labels all scores are the share of label
    1 (0.5 if there are no rows).
    """
    texts = [t.decode("utf-8", "replace") for t, _ in rows]
    label = np.array([y for _, y in rows])
    constant = Machine(np.zeros((SYMBOLS**3, 1), np.float32), -1.0, np.zeros(4))
    if not len(label) or label.min() == label.max():
        even = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
        constant.curve[0] = np.log(even / (1 - even))
        return constant
    points = code_points("".join(texts))
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    held = np.arange(len(texts)) % 4 == 3
    lowered = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint32)
    starts, ends, text, _ = pieces(lowered, edges)
    of, seen = distinct(lowered, starts, ends)
    s, e = starts[seen], ends[seen]
    n = len(seen)
    pair = np.unique(of * len(texts) + text)
    word, owner = pair // len(texts), pair % len(texts)
    learn = ~held[owner]
    word, owner = word[learn], owner[learn]
    bad = label[owner] == 1
    tox = np.bincount(word[bad], minlength=n)
    clean = np.bincount(word[~bad], minlength=n)
    rate = ((label == 1) & ~held).sum() / (~held).sum()
    lift = (tox - rate * (tox + clean)) / np.sqrt(np.maximum(tox + clean, 1) * rate * (1 - rate) + 0.5)
    toxic_words = np.argsort(-lift, kind="stable")[: landmarks * 3 // 4]
    toxic_words = toxic_words[lift[toxic_words] > 0]
    clean_words = np.argsort(-clean, kind="stable")[: max(1, landmarks - len(toxic_words))]
    marks = np.unique(np.concatenate((toxic_words, clean_words)))
    place, dense = spread(*framed(lowered, s[marks], e[marks]))
    values, vectors = np.linalg.eigh((dense @ dense.T).astype(np.float64))
    good = values > 1e-6
    half = vectors[:, good] / np.sqrt(values[good])  # Nyström: features are kernel values times this
    columns = dense.T @ half.astype(np.float32)
    symbols, offsets = framed(lowered, s, e)
    # Clean words: the most frequent ones and as many others; the bound is NEGATIVES.
    frequent = np.argsort(-clean, kind="stable")[: NEGATIVES // 2]
    other = np.setdiff1d(np.flatnonzero(clean > 0), frequent)
    negative = np.concatenate((frequent[clean[frequent] > 0], other[:: max(1, -(-len(other) // (NEGATIVES // 2)))]))
    used = np.union1d(negative, np.flatnonzero(lift > 1))
    witness_value = np.full(n, -2.0)
    witness_value[used] = lift[used]
    row = np.full(n, -1)
    row[used] = np.arange(len(used))
    features = np.zeros((len(used), columns.shape[1]), np.float32)
    for at in range(0, len(used), 5_000):
        chars, ends_ = gather(symbols, offsets, used[at: at + 5_000])
        features[at: at + 5_000] = project(chars, ends_, columns, place)
    w, b = np.zeros(columns.shape[1]), -1.0
    order = np.argsort(owner[bad], kind="stable")
    bad_owner, bad_word = owner[bad][order], word[bad][order]
    head = np.flatnonzero(np.concatenate(([True], bad_owner[1:] != bad_owner[:-1])))
    for _ in range(rounds):
        value = witness_value[bad_word]
        top = np.maximum.reduceat(value, head)
        top = np.repeat(top, np.diff(np.append(head, len(value))))
        chosen = bad_word[((value == top) & (value > -2)) | (lift[bad_word] > SURE)]
        positive, times = np.unique(chosen, return_counts=True)
        x = np.concatenate((features[row[positive]], features[row[negative]]))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        weight = np.concatenate((np.minimum(times, 50) / np.minimum(times, 50).sum(),
                                 np.minimum(clean[negative], 50) / np.minimum(clean[negative], 50).sum())) * len(negative)
        w, b = linear_svm(x, y, weight)
        witness_value = np.full(n, -2.0)
        witness_value[used] = features @ w + b
    machine = Machine((columns @ w).astype(np.float32)[place][:, None], float(b), np.zeros(4))
    fitted = machine.features([t for t, h in zip(texts, held) if h])
    machine.curve = moved(logistic(fitted, label[held].astype(float)), label[held], share)
    return machine


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text",
                    label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE,
                    score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The input's rows and columns with ``score`` (0 to 1, higher: more toxic) and ``predicted``.

    Only the text is an input. Null and empty texts have no words and get the curve's value for that. Repeated rows
    get equal scores; columns already named as the two new ones are replaced, others kept. Very long texts and words
    are scored whole. An empty table gives an empty table; see ``fit`` for missing labels. The machine is fitted on
    at most ``sample`` labelled texts of each label.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        fit(*training_texts(docs, labels, label, keep, sample, id_col, text_col)))

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(["" if t is None else t for t in texts]), dtype="float64")

    score = F.pandas_udf(of, "double").asNondeterministic()(F.col(f"`{text_col}`").cast("string"))
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]
    return (docs.select(*[F.col(f"`{c}`") for c in kept], score.alias(score_col))
            .withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int")))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (never learnt from), score, predicted."""
    done = toxicity_scores(docs.select("doc_id", "text"), labels, remainder(F.col("_id"), 5) != 0)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", "predicted")
