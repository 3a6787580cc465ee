"""Spelling variants: words one insertion, deletion or replacement apart, met as pairs of trie nodes."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.spans import code_points, hashes
from parley.session import materialize, new_path, release

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_TIMES, SLIP, RATIO = 5, 3, 97, 2
FLUSH = 200_000  # different words that a task counts before it gives them out
PAIRS = 500_000  # pairs of nodes made at once
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words_of(key, text: str | None, slip: int = SLIP) -> dict[str, int]:
    """How often each word stands in a text: its runs of letters, A-Z lower-cased. Where ``slip`` divides the CRC-32 of
    ``key:run``, one character of the run is left out, the one at that hash modulo the run's length."""
    times: dict[str, int] = {}
    for run in RUN.findall(text.translate(_LOWER) if text else ""):
        times[run] = times.get(run, 0) + 1
    start, out, crc = zlib.crc32(f"{'' if key is None else key}:".encode()), {}, zlib.crc32
    for run, n in times.items():
        h = crc(run.encode(), start)
        if slip and h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] = out.get(run, 0) + n
    return out


def _counts(slip: int, least: int):
    """Partial counts of the words of ``least`` characters or more of a task's texts."""
    def table(times):
        return pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches):
        times: dict[str, int] = {}
        for batch in batches:
            for k in range(batch.num_rows):  # one text at a time, as texts may be very long
                for word, n in words_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), slip).items():
                    if len(word) >= least:
                        times[word] = times.get(word, 0) + n
                if len(times) >= FLUSH:
                    yield table(times)
                    times = {}
        yield table(times)

    return run


def _node_pairs(batches):
    """For each word, pairs (node of the forward trie, node of the reversed trie) of what is left and right of a place.

    ``kind`` 0: the place lies between two characters, so both nodes spell the whole word. 1: the place is a character,
    which is skipped. 2: the same, and leaving it out there is how the shorter word is made (the first of a run of
    equal characters, as leaving out any other of the run gives the same word).

    A node's number is a 64-bit hash of the path to it, so that every task numbers a node alike.
    """
    for batch in batches:
        words, number = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        n = batch.column(2).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(words):
            end, made = at, 0
            while end < len(words) and (end == at or made + 2 * len(words[end]) < PAIRS):
                made += 2 * len(words[end]) + 1
                end += 1
            size = np.fromiter(map(len, words[at:end]), np.int64, end - at)
            points = code_points("".join(words[at:end]))
            first = np.cumsum(size) - size
            places = np.repeat(np.arange(end - at), size + 1)  # 0 to length of each word
            place = np.arange(len(places)) - np.repeat(first + np.arange(end - at), size + 1)
            begin, stop = first[places], (first + size)[places]
            forward = hashes(points, begin, begin + place, 0)
            backward = hashes(points, begin + place, stop, 1)
            inner = np.flatnonzero(place < size[places])  # a character stands behind the place
            char = points[(begin + place)[inner]]
            same = np.zeros(len(inner), bool)
            same[1:] = (char[1:] == char[:-1]) & (place[inner][1:] > 0)
            kind = np.concatenate((np.zeros(len(places), np.int8), np.where(same, 1, 2).astype(np.int8)))
            word = at + np.concatenate((places, places[inner]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((forward, forward[inner])).view(np.int64)),
                 pa.array(np.concatenate((backward, backward[inner + 1])).view(np.int64)),
                 pa.array(kind), pa.array(number[word]), pa.array(n[word])], names=["p", "s", "kind", "k", "n"])
            at = end


def neighbours(words: DataFrame) -> DataFrame:
    """Of ``word, k, n`` (``k`` a number in code-point order), for each ``k`` with near words: ``n_near``, how many, and
    ``best``, the near word of the largest ``n``, the first in order among equals, as (-n, k).

    Words that share a pair at a skipped character differ by replacing it; one whose skipped pair is the pair of another
    between characters is that word with the character inserted. Two words meet so at exactly one pair. A pair has at
    most one word between characters and one word a letter of the alphabet, so its members are few; each one gets its
    count and its best partner from the pair's two best, without pairs of words being made.
    """
    pairs = words.select("word", "k", "n").mapInArrow(_node_pairs, "p long, s long, kind byte, k long, n long")
    met = (pairs.groupBy("p", "s").agg(F.collect_list(F.struct((-F.col("n")).alias("n"), "k", "kind")).alias("all"))
           .where(F.size("all") > 1))
    key = F.struct(F.col("x.n").alias("n"), F.col("x.k").alias("k"))

    def some(test):
        return F.slice(F.array_sort(F.transform(F.filter("all", test), lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k")))), 1, 2)

    met = met.select("all", some(lambda x: x["kind"] > 0).alias("skip"), some(lambda x: x["kind"] == 2).alias("cut"),
                     F.get(some(lambda x: x["kind"] == 0), F.lit(0)).alias("whole"),
                     F.size(F.filter("all", lambda x: x["kind"] > 0)).alias("n_skip"),
                     F.size(F.filter("all", lambda x: x["kind"] == 2)).alias("n_cut"))
    rows = met.select(F.explode("all").alias("x"), "skip", "cut", "whole", "n_skip", "n_cut")
    other = F.when(F.get("skip", F.lit(0))["k"] == F.col("x.k"), F.get("skip", F.lit(1))).otherwise(F.get("skip", F.lit(0)))
    longer = F.when(F.col("x.kind") == 2, F.col("whole"))
    rows = rows.select(
        key["k"].alias("k"),
        F.when(F.col("x.kind") == 0, F.col("n_cut"))
        .otherwise(F.col("n_skip") - 1 + F.when(longer.isNotNull(), 1).otherwise(0)).cast("long").alias("n_near"),
        F.when(F.col("x.kind") == 0, F.get("cut", F.lit(0))).otherwise(F.least(other, longer)).alias("best"))
    return rows.where("n_near > 0").groupBy("k").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``k, root`` of ``k, form``: the last word that following the forms leads to.

    Each round doubles the steps. A form is at least ``RATIO`` times as frequent, so chains are as short as the
    logarithm of the largest count, and rounds are the logarithm of that. Each round's table is written.
    """
    spark = forms.sparkSession
    at, path = forms.select("k", F.col("form").alias("root")), None
    while True:
        to = at.select(F.col("k").alias("root"), F.col("root").alias("_next"))
        step = at.join(to, "root", "left").select("k", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        old, path = path, new_path(spark, "roots")
        step.write.option("compression", "zstd").parquet(path)
        made = spark.read.schema("k long, root long, _moved boolean").parquet(path)
        if old:
            release(spark, [old])
        at = made.select("k", "root")
        if made.where("_moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                      least_times: int = LEAST_TIMES, slip: int = SLIP, ratio: int = RATIO) -> DataFrame:
    """One row per word of at least ``least_chars`` characters that stands ``least_times`` or more in all texts:
    ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the words one inserted, deleted or replaced character apart. ``form`` is the most frequent of them
    (the first in code-point order among equals) if its count ``form_n`` is at least ``ratio`` times ``n``, else null;
    ``root`` is the end of the chain of forms, the word itself without one. ``slip`` 0 takes the runs as they are.

    Null and empty texts have no words; a null id enters the slip's hash as an empty one. Repeated rows count again, as
    each is a row of the table. Words of any length are taken; a word of m characters gives 2 m + 1 pairs of numbers.
    Only the two columns are read. An empty table, or one without frequent words, gives an empty table.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    counted = (rows.mapInArrow(_counts(slip, least_chars), "word string, n long").groupBy("word")
               .agg(F.sum("n").alias("n")).where(F.col("n") >= least_times))
    # Numbers in order: partitions of a sorted table are in order, and so are the numbers of their rows.
    words = materialize(counted.orderBy("word").withColumn("k", F.monotonically_increasing_id()), "variant-words")
    near = materialize(neighbours(words), "variant-neighbours")
    sized = words.join(near, "k", "left").select("word", "k", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                 (-F.col("best.n")).alias("form_n"), F.col("best.k").alias("form"))
    real = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    sized = materialize(sized.withColumn("form_n", F.when(real, F.col("form_n")))
                        .withColumn("form", F.when(real, F.col("form"))), "variant-forms")
    ends = roots(sized.where("form IS NOT NULL").select("k", "form"))
    names = words.select(F.col("k").alias("_k"), F.col("word").alias("_word"))
    some = sized.where("form IS NOT NULL").join(ends, "k")
    named = (some.join(names.withColumnsRenamed({"_k": "form", "_word": "_form"}), "form")
             .join(names.withColumnsRenamed({"_k": "root", "_word": "_root"}), "root")
             .select("word", F.col("_form").alias("form"), F.col("_root").alias("root"), "n", "n_near", "form_n"))
    rest = sized.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"),
                                              "n", "n_near", "form_n")
    return named.unionByName(rest)


# The same with strings in place of numbered nodes; ``crc`` is the table of CRC-32 by bytes.
VARIANTS_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) AS run FROM low),
    each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
            string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT]
            ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h
        FROM each, crc),
    slipped AS (SELECT CASE WHEN h % {SLIP} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n
        FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {LEAST_CHARS} GROUP BY word
        HAVING sum(n) >= {LEAST_TIMES}),
    places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
    skips AS (SELECT word, n, word[1:i] AS p, word[i + 2:] AS s FROM places),
    links AS (SELECT a.word, b.word AS other, b.n AS m FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
        AND length(a.word) = length(b.word)
        UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON b.word = a.p || a.s
        UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON b.word = a.p || a.s),
    near AS (SELECT word, count(*) AS n_near FROM links GROUP BY word),
    best AS (SELECT word, other, m FROM links QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form,
        CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS at, 0 AS steps FROM forms
        UNION ALL SELECT k.word, f.form, steps + 1 FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(k.at, k.steps) FROM walk k WHERE k.word = f.word) AS root, n, n_near, form_n FROM forms f"""
