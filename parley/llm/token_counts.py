"""Token counts by distinct pre-tokens: each is encoded once, documents only hold its frequency."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.spans import code_points, distinct, gather
from parley.session import materialize

BLOCK_CHARS = 12_000_000
BLOCK_DOCS = 60_000
MOST_KNOWN = 2_000_000
ENTRY = np.dtype([("doc", "<u2"), ("freq", "u1")])  # of a list; a higher frequency takes several entries
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def character_classes(vocabulary: str) -> np.ndarray:
    """Letter, number, white space or other, for every code point, as the tokenizer's own pre-tokenizer sees it.

    Characters in a row of one class make one pre-token, so the pre-tokens of all characters show where classes end.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
    out = np.zeros(0x110000, np.uint8)

    def kind(c):
        for mark, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(cut(mark + c)) == 1:
                return k
        return SPACE

    for c in range(0x80):
        out[c] = kind(chr(c))
    every = [*range(0x80, 0xD800), *range(0xE000, 0x110000)]
    for _, (a, b) in cut("".join(map(chr, every))):
        out[every[a: b]] = kind(chr(every[a]))
    return out


def pretoken_starts(points: np.ndarray, edges: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the byte-level pattern start; ``edges`` are the ends of the texts, from 0 on.

    A run of letters, of numbers or of other characters is one, with one blank in front of it. Of white space in
    front of anything else the last character stands alone or, if it is a blank, joins what follows. An apostrophe
    that starts a pre-token takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    c = classes[points]
    first = np.zeros(n + 1, bool)
    first[edges] = True
    prev = np.concatenate(([SPACE], c[:-1]))
    blank = np.concatenate(([False], points[:-1] == 32))
    ahead = np.concatenate((c[1:], [SPACE])) != SPACE
    space = c == SPACE
    start = np.where(space, (prev != SPACE) | (ahead & ~first[1:]), (prev != c) & ~blank) | first[:-1]
    for i in np.flatnonzero((points == 39) & ((~blank & (prev != OTHER)) | first[:-1])).tolist():
        end = int(edges[np.searchsorted(edges, i, "right")])
        tail = "".join(map(chr, points[i + 1: min(i + 3, end)]))
        size = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") else 0
        if size:
            start[i + 1: i + size] = False
            if i + size < n:
                start[i + size] = True
    return np.flatnonzero(start)


def special_strings(vocabulary: str) -> list[str]:
    """Strings which the tokenizer takes as one token wherever they stand in a text, longest first."""
    with open(vocabulary, encoding="utf-8") as f:
        return sorted((t["content"] for t in json.load(f).get("added_tokens", [])), key=lambda s: (-len(s), s))


@lru_cache
def single_pieces(vocabulary: str) -> frozenset[str]:
    """Pre-tokens that are one piece because the vocabulary holds them: a table of a fixed size."""
    tokenizer = _tokenizer(vocabulary)
    words = [tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size())]
    words = [w for w in dict.fromkeys(words) if w and "\ufffd" not in w]
    return frozenset(w for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False)) if len(e) == 1)


def inverted_lists(texts: list[str], cut, classes: np.ndarray, single: frozenset[str]):
    """``(tokens, offsets, entries, known)``: list k is ``entries[offsets[k]:offsets[k + 1]]``, places and frequencies
    of the texts that hold ``tokens[k]``; ``known`` are the tokens of each text whose pre-tokens are one piece each,
    its special strings included."""
    parts = [cut(t) for t in texts]
    n = len(texts)
    flat = [s for p in parts for s in p]
    joined = "".join(flat)
    points = code_points(joined)
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))))
    owner = np.repeat(np.arange(n), [len(p) for p in parts])
    starts = pretoken_starts(points, edges, classes) if len(points) else np.zeros(0, np.int64)
    ends = np.concatenate((starts[1:], [len(points)])) if len(starts) else starts
    doc = owner[np.searchsorted(edges, starts, "right") - 1]
    of, seen = distinct(points, starts, ends)
    tokens = [joined[a:b] for a, b in zip(starts[seen].tolist(), ends[seen].tolist())]
    one = np.fromiter((t in single for t in tokens), bool, len(tokens))
    known = np.array([len(p) - 1 for p in parts], np.int64)
    if len(of):
        known += np.bincount(doc[one[of]], minlength=n)
        doc, of = doc[~one[of]], of[~one[of]]
    pair, freq = np.unique(of * max(1, n) + doc, return_counts=True)
    times = -(-freq // 255)
    entries = np.empty(times.sum(), ENTRY)
    entries["doc"], entries["freq"] = np.repeat(pair % max(1, n), times), 255
    entries["freq"][np.cumsum(times) - 1] = freq - 255 * (times - 1)
    token = np.repeat(pair // max(1, n), times)
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1])))
    return [tokens[t] for t in token[new]], np.concatenate((new, [len(token)])), entries, known


def packed(tokens: list[bytes], offsets: np.ndarray, entries: np.ndarray, buckets: int):
    """``(bucket, bytes)``: the lists of a block, those of one bucket of tokens compressed together. Equal tokens are
    in equal buckets, in whatever block."""
    bucket = np.fromiter((xxhash.xxh32_intdigest(t) % buckets for t in tokens), np.int64, len(tokens))
    order = np.argsort(bucket, kind="stable")
    length = np.fromiter(map(len, tokens), np.uint32, len(tokens))
    compress = zstandard.ZstdCompressor(level=3).compress
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = order[a:b]
        some, ends = gather(entries, offsets, own)
        yield int(bucket[own[0]]), compress(b"".join([
            np.array([b - a], np.uint32).tobytes(), length[own].tobytes(), np.diff(ends).astype(np.uint32).tobytes(),
            some.tobytes(), b"".join([tokens[k] for k in own])]))


def unpacked(blob: bytes):
    """``(tokens, sizes, entries)`` of a bucket."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    length, sizes = (np.frombuffer(raw, np.uint32, n, 4 + 4 * n * k).astype(np.int64) for k in (0, 1))
    at = 4 + 8 * n
    entries = np.frombuffer(raw, ENTRY, int(sizes.sum()), at)
    at += entries.nbytes
    ends = at + np.cumsum(length)
    return [raw[a:b].decode() for a, b in zip((ends - length).tolist(), ends.tolist())], sizes, entries


def _inverted(schema: pa.Schema, vocabulary: str, block_chars: int, buckets: int):
    """Blocks of documents: one row for each bucket of ``inverted_lists``, and one for each document."""
    def run(batches):
        classes, single = character_classes(vocabulary), single_pieces(vocabulary)
        specials = special_strings(vocabulary)
        cut = re.compile("|".join(map(re.escape, specials))).split if specials else (lambda s: [s])
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        ids, sizes, texts, chars = [], [], [], 0

        def flush():
            tokens, offsets, entries, known = inverted_lists(texts, cut, classes, single)
            blobs = list(packed([t.encode() for t in tokens], offsets, entries, buckets))
            n, k = len(texts), len(blobs)
            columns = [(pa.array(range(n), pa.int32()), None), (pa.array(ids, schema.field("_id").type), None),
                       (pa.array(sizes, pa.int64()), None), (pa.array(known, pa.int64()), None),
                       (None, pa.array([b for b, _ in blobs], pa.int32())), (None, pa.array([x for _, x in blobs], pa.binary()))]
            cols = [pa.array(np.full(n + k, block), pa.int64())]
            for field, (head, tail) in zip(list(schema)[1:], columns):
                cols.append(pa.concat_arrays([pa.nulls(n, field.type) if head is None else head,
                                              pa.nulls(k, field.type) if tail is None else tail]))
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            bytes_ = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, text, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_):
                ids.append(i)
                sizes.append(size)
                texts.append(text or "")
                chars += size
                if chars >= block_chars or len(texts) == BLOCK_DOCS:
                    yield flush()
                    block += 1
                    ids, sizes, texts, chars = [], [], [], 0
        if ids:
            yield flush()

    return run


def _sums(vocabulary: str):
    """Tokens that the lists of a partition add to their documents. All blocks' lists of a token are in one partition,
    where it is encoded once; rows come in order of their blocks, and a block's documents are summed before they go on."""
    def run(batches):
        tokenizer, pieces = _tokenizer(vocabulary), {}
        block, total = None, None

        def done():
            raw = zstandard.ZstdCompressor(level=3).compress(np.trim_zeros(total, "b").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([raw], pa.binary())], names=["_block", "_sums"])

        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != block:
                    if block is not None:
                        yield done()
                    block, total = of, np.zeros(BLOCK_DOCS, np.int64)
                tokens, sizes, entries = unpacked(blob)
                if len(pieces) > MOST_KNOWN:
                    pieces.clear()
                new = [t for t in tokens if t not in pieces]
                pieces.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False))))
                n = np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens))
                added = np.bincount(entries["doc"], entries["freq"] * np.repeat(n, sizes).astype(np.float64))
                total[: len(added)] += added.astype(np.int64)
        if block is not None:
            yield done()

    return run


def _added(batches):
    """Sums of the documents of each block, from those of all partitions; rows come in order of their blocks."""
    block, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(total), block)), pa.array(np.arange(len(total), dtype=np.int32)),
                                           pa.array(total)], names=["_block", "_ord", "_tokens"])

    for batch in batches:
        for of, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)
            if of != block:
                if block is not None:
                    yield done()
                block, total = of, np.zeros(0, np.int64)
            if len(part) > len(total):
                total = np.concatenate((total, np.zeros(len(part) - len(total), np.int64)))
            total[: len(part)] += part
    if block is not None:
        yield done()


def _tokenizer(vocabulary: str):
    """The library's tokenizer for strings that are pre-tokens already."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 vocabulary: str | None = None, block_chars: int = BLOCK_CHARS,
                 buckets: int | None = None) -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Documents are read once, in blocks; a block is kept in a written table as lists, of its distinct pre-tokens and
    the documents that hold them how often, in ``buckets`` by a hash of the pre-token (default: four for each shuffle
    partition, 256 at least). The lists are shuffled by bucket: every distinct pre-token of the corpus is encoded in
    one place, once, and its count joined to the lists of all blocks; token ids are never made. (A task that has met
    over ``MOST_KNOWN`` of them forgets their counts and encodes again.) Pre-tokens that are one piece of the
    vocabulary, among them all very frequent ones, are joined in the block itself, with a table of fixed size.

    Null and empty texts have no bytes and no tokens. A special string inside a text is one token. Repeated rows and
    repeated or null ids each keep their own row: rows are told apart by block and place, not by id. An empty table
    gives an empty table. Other columns of the input are not looked at. ``vocabulary`` is the path of a byte-level
    tokenizer file that every executor has (default: the 50k vocabulary).
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = T.StructType([
        T.StructField("_block", T.LongType()), T.StructField("_ord", T.IntegerType()),
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_bytes", T.LongType()),
        T.StructField("_known", T.LongType()), T.StructField("_bucket", T.IntegerType()),
        T.StructField("_lists", T.BinaryType())])
    buckets = buckets or max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = materialize(
        docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
        .mapInArrow(_inverted(to_arrow_schema(schema), vocabulary, block_chars, buckets), schema), "pretokens")
    sums = (blocks.where(F.col("_bucket").isNotNull()).select("_block", "_lists", "_bucket")
            .repartition("_bucket").sortWithinPartitions("_block").select("_block", "_lists")
            .mapInArrow(_sums(vocabulary), "_block long, _sums binary")
            .repartition("_block").sortWithinPartitions("_block")
            .mapInArrow(_added, "_block long, _ord int, _tokens long"))
    total = F.coalesce("_tokens", F.lit(0).cast("long")) + F.col("_known")
    return (blocks.where(F.col("_bucket").isNull()).select("_block", "_ord", "_id", "_bytes", "_known")
            .join(sums, ["_block", "_ord"], "left")
            .select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), total.alias("n_tokens"),
                    (total > limit).alias("over_limit")))
