"""Pieces of many texts at once: positions, 128-bit hashes and distinct values, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have an inverse modulo 2**64
_WINDOW = 1 << 17


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache(maxsize=4)
def _powers(n: int, base: int):
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of each span of ``symbols``; equal spans have equal hashes wherever they are.

    Spans are in order of their starts. Running sums over windows give all hashes of a window at once.
    """
    out, at, base = np.empty(len(starts), _U), 0, _PRIMES[which]
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _WINDOW, "right")))
        s, e = starts[at:to] - low, ends[at:to] - low
        n = int(e.max()) if len(e) else 0
        power, inverse = _powers(1 << max(18, (n + 1).bit_length()), base)
        x = symbols[low: low + n].astype(_U)
        x = (x + _U(1)) * _U(0xD6E8FEB86659FD93 + 2 * which)
        x ^= x >> _U(29)
        total = np.zeros(n + 1, _U)
        np.cumsum(x * power[:n], out=total[1:])
        out[at:to] = scramble((total[e] - total[s]) * inverse[s] + (e - s).astype(_U))
        at = to
    return out


def distinct(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """``(of, first)``: for each span the number of its value, and for each value the span that has it first."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, g = hashes(symbols, starts, ends, 0), hashes(symbols, starts, ends, 1)
    order = np.argsort(h, kind="stable")
    hs, gs = h[order], g[order]
    new = np.ones(len(order), bool)
    new[1:] = hs[1:] != hs[:-1]
    if (gs[1:] != gs[:-1])[~new[1:]].any():  # two values share one hash: tell them apart by both
        order = np.lexsort((g, h))
        hs, gs = h[order], g[order]
        new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new]


def gather(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray):
    """The lists ``pick`` of a list array, one behind the other, and their offsets."""
    size = (offsets[1:] - offsets[:-1])[pick]
    ends = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(offsets[:-1][pick] - ends[:-1], size) + np.arange(ends[-1])], ends


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, edges: np.ndarray):
    """Starts and ends of words (runs of bytes other than space and \\t to \\r), cut at ``edges`` (sorted, from 0 to
    the length), and the number of the part that each word is in."""
    inside = ~_SPACES[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(edges, starts, "right") - 1
