"""Many words of a text replaced one after the other, in time that grows with the text and not with text times words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = 256  # texts worked on at once
LONGEST, KEPT = 64, 100_000  # runs that are remembered with what stands in them: their length and number

_BETWEEN = re.compile(r"([\x00-/:-@\[-^`{-\x7f]+)")  # characters of ASCII that no word holds
_MARK = 256  # texts are read byte by byte, so characters from here on are free to stand for tokens
_MARKS = re.compile("([\u0100-\U0010ffff])")


def _token(kind: str, value: bytes, mode: str) -> str:
    """As ``pii.token_for``."""
    if mode == "mask":
        return f"[{kind}:{'*' * 10}]"
    if mode == "token":
        return f"[{kind}]"
    if mode == "remove":
        return ""
    return f"[{kind}:{hashlib.sha256(value).hexdigest()[:8]}]"


class _Words:
    """Words numbered in the order of their turns, and the runs seen with the words that stand in them."""

    def __init__(self, words: list[bytes], kind: str, mode: str):
        import ahocorasick

        turn = sorted(range(len(words)), key=lambda i: (len(words[i].decode()), words[i]), reverse=True)
        self.number = np.empty(len(words), dtype=np.int64)
        self.number[turn] = np.arange(len(words))
        self.plain = [words[i].decode("latin-1") for i in turn]
        self.tokens = [_token(kind, words[i], mode) for i in turn]
        self.remove = mode == "remove"
        self.automaton = ahocorasick.Automaton()
        for n, w in enumerate(self.plain):
            self.automaton.add_word(w, n)
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.marks = [chr(_MARK + n) for n in range(len(turn))]
        # A token stands in brackets, so it can hold words of later turns only, and no word reaches across it.
        self.held = [tuple(m for m in self.inside(t) if m > n) for n, t in enumerate(self.tokens)]

    def inside(self, run: str) -> tuple[int, ...]:
        found = tuple(sorted({n for _, n in self.automaton.iter(run)}))
        if len(run) <= LONGEST:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[run] = found
        return found

    def found(self, run: str) -> tuple[int, ...]:
        found = self.known.get(run)
        return self.inside(run) if found is None else found

    def marked(self, run: str, found: tuple[int, ...], own: set[int]) -> str:
        for n in found:
            if n in own:
                run = run.replace(self.plain[n], self.marks[n])
        return run

    def removed(self, run: str, own: set[int]) -> str:
        """What is left grows together, so it is searched again after every word."""
        last = -1
        while (n := next((n for n in self.found(run) if n > last and n in own), None)) is not None:
            run, last = run.replace(self.plain[n], ""), n
        return run

    def replaced(self, text: bytes, own: set[int]) -> bytes:
        parts = _BETWEEN.split(text.decode("latin-1"))
        runs = parts[::2]
        if self.remove:
            made = {run: self.removed(run, own) for run in set(runs)}
            parts[::2] = [made[run] for run in runs]
            return "".join(parts).encode("latin-1")
        made = {self.plain[n]: self.marks[n] for n in own}
        for run in set(runs):
            if run not in made:
                made[run] = self.marked(run, self.found(run), own)
        parts[::2] = [made[run] for run in runs]
        finished: dict[str, str] = {}
        for n in sorted(own, reverse=True):
            token, held = self.tokens[n], self.held[n]
            finished[self.marks[n]] = _unmarked(self.marked(token, held, own), finished) if held else token
        return _unmarked("".join(parts), finished).encode("latin-1")


def _unmarked(text: str, finished: dict[str, str]) -> str:
    parts = _MARKS.split(text)
    if len(parts) == 1:
        return text
    parts[1::2] = [finished[m] for m in parts[1::2]]
    return "".join(parts)


def _replaced(texts: pa.Array, said: pa.Array, kind: str, mode: str) -> Iterator[pa.Array]:
    coded = said.flatten().dictionary_encode()
    words = _Words(coded.dictionary.to_pylist(), kind, mode)
    numbers = words.number[coded.indices.to_numpy(zero_copy_only=False)]
    sizes = pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for at in range(0, len(texts), TEXTS):
        rows = texts.slice(at, TEXTS).to_pylist()
        for i, text in enumerate(rows):
            end, size = ends[at + i], sizes[at + i]
            if text is not None and size:
                rows[i] = words.replaced(text, set(numbers[end - size:end].tolist()))
        yield pa.array(rows, pa.binary())


def words_replaced(text: Column, words: Column, kind: str, mode: str) -> Column:
    """``text`` with each of ``words`` replaced by its token wherever it stands, inside longer words and earlier tokens too:
    longer words first, among words of one length the last in order first.

    The words are runs of word characters, so what lies between runs is never touched and every different run of a text is
    worked on once. An automaton of all words of a batch tells which of them stand in a run. Strings are handled as their
    bytes. Null texts stay null; no words, or null, leave the text as it is.
    """
    def replace(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, said in batches:
            yield from _replaced(texts, said, kind, mode)

    return F.arrow_udf(replace, "binary")(text.cast("binary"), words.cast("array<binary>")).cast("string")
