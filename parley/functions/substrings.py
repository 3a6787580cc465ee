"""All places of many literal strings in a text, found in one pass."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "array<struct<c:int,at:int>>"
TEXTS = 256  # texts whose places are held at once


@lru_cache(maxsize=4)
def _automaton(literals: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, x in enumerate(literals):
        out.add_word(x, (k, len(x)))
    out.make_automaton()
    return out


def _places(automaton, texts: list[str | None], first: bool) -> pa.Array:
    numbers, starts, ends = array("i"), array("i"), array("i", [0])
    for t in texts:
        if automaton is not None and t:
            seen = set()
            for end, (k, n) in automaton.iter(t):
                if not first or k not in seen:
                    if first:
                        seen.add(k)
                    numbers.append(k)
                    starts.append(end - n + 1)
        ends.append(len(numbers))
    places = pa.StructArray.from_arrays([pa.array(np.asarray(numbers)), pa.array(np.asarray(starts))], ["c", "at"])
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends)), places)


def found_in(batches, literals: tuple[str, ...], first: bool):
    """The places of batches of texts, ``TEXTS`` texts at a time."""
    automaton = _automaton(literals) if literals else None
    for texts in batches:
        for at in range(0, len(texts), TEXTS):
            yield _places(automaton, texts.slice(at, TEXTS).to_pylist(), first)


def occurrences(text: Column, literals: list[str], first: bool = False) -> Column:
    """Where the literals (distinct, not empty) stand in ``text``: structs of ``c``, the literal's number, and ``at``, the
    place from 0 in characters, by falling in with the end of each; with ``first`` only the first place of each.

    An Aho-Corasick automaton of all literals reads the text once, however many they are; it is built once a worker. The
    list of literals is configuration and travels with the plan. Null texts have no places. A worker holds eight bytes for
    each place of ``TEXTS`` texts, whatever the size of its batches.
    """
    listed = tuple(literals)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from found_in(batches, listed, first)

    return F.arrow_udf(find, PLACES)(text)
