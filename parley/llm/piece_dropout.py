"""SentencePiece segmentation of the merge type with seeded merge dropout, and its lossless decoding."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.spans import code_points, distinct, gather, scramble

SPACE = "▁"
LONG = 48  # longer chunks are merged one by one with a heap; the result is the same
BLOCK_CHARS = 2_000_000
_U = np.uint64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merger:
    """The pieces and merges of one model file, and segmentation with dropout.

    A candidate merge is a place (start, middle, end of the two symbols, in characters of its chunk) and the piece it
    makes. It is skipped for good if a hash of seed, variant, place and piece falls below ``dropout``. The variant is a
    64-bit key of the document and of the chunk's place in it, so every occurrence of a word is dealt anew. Candidates
    are processed by score, the leftmost first among equals, as without dropout.
    """

    def __init__(self, model: str, dropout: float = 0.1, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n = sp.vocab_size()
        self.seed, self.dropout = seed, dropout
        plain = [i for i in range(self.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)
                                                  or sp.is_unused(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(self.n) if sp.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("a model without byte fallback cannot be decoded losslessly")
        self.raw = [b""] * self.n
        for s, i in self.piece.items():
            self.raw[i] = s.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        score = np.full(self.n, -np.inf)
        keys, made = [], []
        for s, i in self.piece.items():
            score[i] = sp.get_score(i)
            for k in range(1, len(s)):
                a, b = self.piece.get(s[:k]), self.piece.get(s[k:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    made.append(i)
        self.score = score.astype(np.float32)
        self._fill(np.array(keys, np.int64), np.array(made, np.int32))
        self.table = dict(zip(keys, made))
        # By code point: the id of a character, -1 where there is none. A literal U+2581 is spelled in bytes, so that
        # decoding tells it from a blank.
        self.symbol = np.full(0x110000, -1, np.int32)
        for s, i in self.piece.items():
            if len(s) == 1:
                self.symbol[32 if s == SPACE else ord(s)] = i
        self.symbol[ord(SPACE)] = -1
        # Characters of no longer piece take part in no merge, so a text may be cut around them.
        self.alone = np.ones(0x110000, bool)
        self.alone[sorted({32 if c == SPACE else ord(c) for s in self.piece if len(s) > 1 for c in s})] = False
        if any(SPACE in s.lstrip(SPACE) for s in self.piece):
            raise ValueError("pieces with a blank behind a letter are not supported")

    def dropped(self, variant, start, middle, end, made):
        key = scramble(np.asarray(variant, _U) * _U(0x9E3779B97F4A7C15) + _U(self.seed & (2**64 - 1)))
        return self._skips(key, *(np.asarray(x) for x in (start, middle, end, made)))

    def _fill(self, keys, made):
        """A hash table of the merges: each key at the first free place from its own on."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.made[at[put]] = keys[put], made[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, made, at = keys[rest], made[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys):
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def lookup(self, a, b):
        """Id of the piece which two symbols make, -1 if none."""
        key = (a.astype(np.int64) << 20) | b
        at = self._place(key)
        found = self.keys[at]
        out = np.where(found == key, self.made[at], -1).astype(np.int32)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[(a < 0) | (b < 0)] = -1
        return out

    def pairs(self, sym, chunk_end):
        """Piece and score of each symbol with the next one of its chunk; no score where they make no piece."""
        made = np.full(len(sym), -1, np.int32)
        at = np.flatnonzero(~chunk_end)
        made[at] = self.lookup(sym[at], sym[at + 1])
        score = np.full(len(sym), -np.inf, np.float32)
        on = np.flatnonzero(made >= 0)
        score[on] = self.score[made[on]]
        return made, score

    def walk(self, sym: np.ndarray, offsets: np.ndarray, of: np.ndarray, variants: np.ndarray | None):
        """Segmentations of occurrences: occurrence k is chunk ``of[k]`` (short), dealt by ``variants[k]``; without
        variants nothing is skipped. ``sym`` holds the characters of all chunks one behind the other.

        All occurrences of a chunk go down one decision tree, level by level. A node is a chunk, its segmentation so
        far, the candidates skipped so far and so the next candidate, the best one left; its two edges are "taken" and
        "skipped". Symbols and scores are worked out once a node, an occurrence costs one hash a node it visits, and
        only edges that an occurrence takes are made. A node without a candidate is an end.

        Returns ``ids, start, ends, of_end, skipped``: final symbols and their starts of all ends, the ends' offsets, the
        end of each occurrence, and whether it skipped a candidate.
        """
        width = offsets[1:] - offsets[:-1]
        start = (np.arange(len(sym)) - np.repeat(offsets[:-1], width)).astype(np.int32)
        last = np.zeros(len(sym), bool)
        last[offsets[1:][width > 0] - 1] = True
        made, score = self.pairs(sym, last)
        sym, end = sym.astype(np.int32), start + 1
        node, place = of.astype(np.int64), np.arange(len(of))  # of the occurrences still on their way
        of_end, skipped = np.zeros(len(of), np.int64), np.zeros(len(of), bool)
        key = None
        if variants is not None and self.dropout > 0:
            key = scramble(variants.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(self.seed & (2**64 - 1)))
        done, n_ends = [], 0
        while len(width):
            head = np.cumsum(width) - width
            best = np.full(len(width), -np.inf, np.float32)
            full = np.flatnonzero(width > 0)
            if len(full):
                best[full] = np.maximum.reduceat(score, head[full])
            live = best > -np.inf
            # Ends: their symbols leave, and so do the occurrences that are there.
            out = np.flatnonzero(~live)
            number = np.full(len(width), -1, np.int64)
            number[out] = n_ends + np.arange(len(out))
            gone = ~live[node]
            of_end[place[gone]] = number[node[gone]]
            n_ends += len(out)
            at = np.repeat(~live, width)
            done.append((sym[at], start[at], width[out]))
            if not live.any():
                break
            node, place = node[~gone], place[~gone]
            # The leftmost of a node's best candidates.
            hit = np.flatnonzero(score == np.repeat(np.where(live, best, np.inf), width))
            owner = np.repeat(np.arange(len(width)), width)[hit]
            first = np.ones(len(hit), bool)
            first[1:] = owner[1:] != owner[:-1]
            hit, owner = hit[first], owner[first]
            cand = np.full(len(width), -1, np.int64)
            cand[owner] = hit
            # Taken or skipped, occurrence by occurrence.
            edge = 2 * node
            if key is not None:
                c = cand[node]
                skip = self._skips(key[place], start[c], start[c + 1], end[c + 1], made[c])
                skipped[place[skip]] = True
                edge += skip
            here = np.zeros(2 * len(width), bool)
            here[edge] = True
            edges = np.flatnonzero(here)
            child = np.cumsum(here) - 1
            node = child[edge]
            # Children: the parent's symbols, with the candidate merged or its score gone.
            parent, taken = edges >> 1, edges & 1 == 0
            c = cand[parent]
            (sym, start, end, made, score), offset, size, (merged, until) = self._children(
                (sym, start, end, made, score), head[parent], width[parent], c, taken)
            spot = offset + c - head[parent]
            score[spot], width = -np.inf, size
            t = spot[taken]
            sym[t], end[t], made[t] = merged, until, -1
            tail, lead = t + 1 < (offset + width)[taken], t > offset[taken]
            left, right = np.concatenate((t[tail], t[lead] - 1)), np.concatenate((t[tail] + 1, t[lead]))
            new = self.lookup(sym[left], sym[right])
            made[left] = new
            score[left] = np.where(new >= 0, self.score[new], -np.inf)
        ids, start, size = (np.concatenate(x) for x in zip(*done)) if done else (sym, start, np.zeros(0, np.int64))
        return ids, start, np.concatenate(([0], np.cumsum(size))), of_end, skipped

    @staticmethod
    def _children(columns, head, width, cand, taken):
        """The columns of all children, without the symbol behind a candidate that is taken; their offsets and sizes, and
        the symbols and ends of the merged ones."""
        size = width - taken
        offset = np.cumsum(size) - size
        shift, upto = head - offset, cand - head + 1  # up to the candidate, and behind it
        at = np.repeat(np.stack((shift, shift + taken), 1).ravel(), np.stack((upto, size - upto), 1).ravel())
        at += np.arange(len(at))
        _, _, end, made, _ = columns
        c = cand[taken]
        return tuple(x[at] for x in columns), offset, size, (made[c], end[c + 1])

    def _skips(self, key, start, middle, end, made):
        x = scramble(key ^ (start.astype(_U) << _U(42) | middle.astype(_U) << _U(21) | end.astype(_U)))
        x = scramble(x + made.astype(_U))
        return (x >> _U(11)).astype(np.float64) * 2.0**-53 < self.dropout

    def merge_one(self, sym: list[int], variant: int | None) -> tuple[list[int], list[int]]:
        """Final symbols and their starts of one long chunk, with an agenda on a heap."""
        sym = list(sym)
        n = len(sym)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda = []

        def offer(pairs):
            pairs = [(s, m, self.table.get((sym[s] << 20) | sym[m], -1)) for s, m in pairs if sym[s] >= 0 and sym[m] >= 0]
            pairs = [p for p in pairs if p[2] >= 0]
            if not pairs:
                return
            s, m, made = (np.array(x) for x in zip(*pairs))
            e = np.array([end[x] for x in m])
            gone = (self.dropped(np.full(len(s), variant, np.uint64), s, m, e, made) if self.dropout > 0 and variant is not None
                    else np.zeros(len(s), bool))
            for k in np.nonzero(~gone)[0]:
                heapq.heappush(agenda, (-self.score[made[k]], int(s[k]), int(m[k]), int(e[k]), int(made[k])))

        offer([(k, k + 1) for k in range(n - 1)])
        while agenda:
            _, s, m, e, made = heapq.heappop(agenda)
            if not (alive[s] and m < n and alive[m]) or end[s] != m or end[m] != e:
                continue
            sym[s], end[s], alive[m] = made, e, False
            if e < n:
                left[e] = s
            offer(([(left[s], s)] if left[s] >= 0 else []) + ([(s, e)] if e < n else []))
        starts = [k for k in range(n) if alive[k]]
        return [sym[k] for k in starts], starts

    def undropped(self, points: np.ndarray, offsets: np.ndarray, of: np.ndarray, variants: np.ndarray) -> np.ndarray:
        """Whether an occurrence, of chunk ``of`` and with its own variant, skips none of the candidates on its way, so
        that it is segmented as without dropout. Long chunks are not looked at (False)."""
        size = offsets[1:] - offsets[:-1]
        short = np.flatnonzero(size <= LONG)
        flat, ends = gather(self.symbol[points], offsets, short)
        out = size[of] <= LONG
        out[out] = ~self.walk(flat, ends, np.searchsorted(short, of[out]), variants[out])[4]
        return out

    def segment(self, points: np.ndarray, offsets: np.ndarray, of: np.ndarray, variants: np.ndarray | None):
        """Piece ids and their offsets of segmentations, and the segmentation of each occurrence (chunk ``of`` of those
        given by their characters, dealt by ``variants``); what is no piece is spelled in bytes."""
        sym = self.symbol[points]
        size = offsets[1:] - offsets[:-1]
        short = np.flatnonzero(size <= LONG)
        flat, ends = gather(sym, offsets, short)
        few = size[of] <= LONG
        near = np.flatnonzero(few)
        number = np.cumsum(size <= LONG) - 1  # of a chunk among the short ones
        ids, start, at, end, _ = self.walk(flat, ends, number[of[near]], None if variants is None else variants[near])
        index = np.zeros(len(of), np.int64)
        index[near] = end
        # Where a segmentation's chunk begins, to find the characters that are no piece.
        begin = np.zeros(len(at) - 1, np.int64)
        begin[end] = offsets[of[near]]
        ids, start, widths, begin = [ids], [start], [at[1:] - at[:-1]], [begin]
        n = len(widths[0])
        for k in np.flatnonzero(~few).tolist():
            i, s = self.merge_one(sym[offsets[of[k]]: offsets[of[k] + 1]].tolist(), None if variants is None else int(variants[k]))
            ids.append(np.array(i, np.int32))
            start.append(np.array(s, np.int32))
            widths.append(np.array([len(i)]))
            begin.append(np.array([offsets[of[k]]]))
            index[k], n = n, n + 1
        ids, start, widths, begin = (np.concatenate(x) for x in (ids, start, widths, begin))
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            owner = np.repeat(np.arange(n), widths)
            char = points[begin[owner[odd]] + start[odd]]
            spelled = {c: [self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in set(char.tolist())}
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(spelled[c]) for c in char.tolist()]
            place = np.repeat(ids < 0, times)
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[place] = [i for c in char.tolist() for i in spelled[c]]
            widths = np.bincount(owner, minlength=n)
        return ids, np.concatenate(([0], np.cumsum(widths))), index

    def chunk_starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where to cut: no merge reaches over these places. A blank starts a chunk with what follows it, and so does
        a character that is part of no longer piece."""
        alone = self.alone[points]
        blank = points == 32
        cut = np.ones(len(points), bool)
        cut[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        cut[edges[:-1][edges[:-1] < len(points)]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[str], keys: list, variants: int = 0):
        """Piece ids of texts, and their offsets.

        Every occurrence of a chunk has its own variant; all of them share the chunk's decision tree (``walk``). With
        ``variants`` above 0 there are only so many for each chunk.
        """
        lead = [" " + t if t else "" for t in texts]
        points = code_points("".join(lead))
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lead), np.int64, len(lead)))))
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts = self.chunk_starts(points, edges)
        ends = np.append(starts[1:], len(points))
        of, seen = distinct(points, starts, ends)
        begin = np.searchsorted(starts, edges)  # a document's first chunk
        doc = np.repeat(np.arange(len(texts)), begin[1:] - begin[:-1])
        seeds = np.array([xxhash.xxh64_intdigest(str(k).encode("utf-8", "surrogatepass"), self.seed) for k in keys], _U)
        place = np.arange(len(starts)) - begin[:-1][doc]
        variant = scramble(place.astype(_U) * _U(0x9E3779B97F4A7C15) + seeds[doc])
        chars, offsets = gather(points, np.append(starts, len(points)), seen)
        if self.dropout <= 0:  # all occurrences of a chunk are alike
            ids, at, index = self.segment(chars, offsets, np.arange(len(seen)), None)
            index = index[of]
        else:
            ids, at, index = self.segment(chars, offsets, of, variant % _U(variants) if variants > 0 else variant)
        ids, at = gather(ids, at, index)
        return ids, at[begin]

    def decode(self, ids) -> str:
        """The text of a list of ids. The blank put in front of every text is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


def _encode(out: pa.Schema, text_at: int, key_at: int, model: str, dropout: float, seed: int, variants: int,
            block_chars: int):
    def run(batches):
        merger = Merger(model, dropout, seed)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text_at).to_pylist()]
            keys = batch.column(key_at).to_pylist() if key_at >= 0 else texts
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= block_chars):
                    chars += len(texts[end])
                    end += 1
                ids, offsets = merger.encode(texts[at:end], keys[at:end], variants)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, lists], schema=out)
                at = end

    return run


def encode(docs: DataFrame, text_col: str = "text", key_col: str | None = "doc_id", dropout: float = 0.1,
           seed: int = 17, variants: int = 0, model: str | None = None, out_col: str = "piece_ids",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The input's rows and columns with ``out_col``, the piece ids of the text (array of int).

    Each candidate merge of each word is skipped by a hash keyed by the row's ``key_col`` (null: the word None; no key
    column: the text) and the place of the word. ``variants`` above 0 leaves each word only so many ways. ``dropout`` 0 gives the model's own segmentation.
    Null and empty texts have no pieces. The same key, text and seed always give the same ids, so repeated rows agree.
    A column already named ``out_col`` is replaced. Very long texts and words are processed whole. An empty table
    gives an empty table.
    """
    model = model or default_model()
    if out_col in docs.columns:
        docs = docs.drop(out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    names = docs.columns
    return docs.mapInArrow(_encode(to_arrow_schema(schema), names.index(text_col),
                                   names.index(key_col) if key_col else -1, model, dropout, seed, variants,
                                   block_chars), schema)


def _decode(out: pa.Schema, at: int, model: str):
    def run(batches):
        merger = Merger(model)
        for batch in batches:
            lists, texts = batch.column(at), []
            for k in range(batch.num_rows):  # row by row: a batch of ids as Python numbers would be large
                ids = lists[k].values
                texts.append(merger.decode(ids.to_numpy().tolist()) if ids is not None and len(ids) else "")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=out)

    return run


def decode(df: DataFrame, ids_col: str = "piece_ids", model: str | None = None, out_col: str = "decoded") -> DataFrame:
    """The input's rows and columns with ``out_col``, the text of the ids; null and no ids give the empty text."""
    model = model or default_model()
    if out_col in df.columns:
        df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    return df.mapInArrow(_decode(to_arrow_schema(schema), df.columns.index(ids_col), model), schema)


def segmentation_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1,
                        seed: int = 17, variants: int = 0, model: str | None = None) -> DataFrame:
    """One row per document: id, ``n_pieces``, ``ids_hash`` of the ids, ``lossless`` (decoding gives the text back)."""
    model = model or default_model()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    fields = [*rows.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]
    coded = to_arrow_schema(T.StructType(fields))
    both = to_arrow_schema(T.StructType([*fields, T.StructField("decoded", T.StringType())]))
    to_ids, to_text = _encode(coded, 1, 0, model, dropout, seed, variants, BLOCK_CHARS), _decode(both, 2, model)

    def round_trip(batches):  # both in one task, as the texts need not come back
        for batch in to_text(to_ids(batches)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pc.equal(batch.column(1), batch.column(3))],
                                             names=["_id", "piece_ids", "lossless"])

    done = rows.mapInArrow(round_trip, T.StructType([fields[0], fields[2], T.StructField("lossless", T.BooleanType())]))
    return done.select(F.col("_id").alias(id_col), F.size("piece_ids").alias("n_pieces"),
                       F.lower(F.lpad(F.hex(F.xxhash64("piece_ids")), 16, "0")).alias("ids_hash"), "lossless")
