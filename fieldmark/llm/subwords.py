"""Texts as numpy arrays: code points, their classes, tokens and hashed character n-grams, without a loop over words."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

OTHER, LETTER, DIGIT = 0, 1, 2
_KNOWN = 0x10000  # code points above are letters here and have no case
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For code points under 0x10000: class, lower case (of one code point), whether upper case."""
    chars = [chr(i) for i in range(_KNOWN)]
    kind = np.array([LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER for c in chars], np.uint8)
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    return kind, lower, np.array([c.isupper() for c in chars])


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(cp: np.ndarray) -> np.ndarray:
    kind = tables()[0]
    if cp.size and cp.max() >= _KNOWN:
        return np.where(cp < _KNOWN, kind[np.minimum(cp, _KNOWN - 1)], LETTER).astype(np.uint8)
    return kind[cp]


def lowered(cp: np.ndarray) -> np.ndarray:
    lower = tables()[1]
    if cp.size and cp.max() >= _KNOWN:
        return np.where(cp < _KNOWN, lower[np.minimum(cp, _KNOWN - 1)], cp)
    return lower[cp]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def gram_hashes(cp: np.ndarray, kind: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """uint64 hashes of all n-grams of the words, a mark at either end being a character; cp is lowered."""
    return np.concatenate([np.zeros(0, np.uint64), *gram_pieces(cp, kind, sizes)])


def gram_pieces(cp: np.ndarray, kind: np.ndarray, sizes: tuple[int, ...], piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """The same piece by piece, so that the arrays are bounded: an n-gram belongs to the piece that it begins in, and a piece
    reads on as far as its last n-gram does. No n-gram is lost or counted twice at a piece's end.
    """
    marked = np.concatenate(([0], np.where(kind == OTHER, 0, cp), [0])).astype(np.uint32)
    for n in sizes:
        for begin in range(0, len(marked) - n + 1, piece):
            part = marked[begin : begin + piece + n - 1]
            m = len(part) - n + 1
            inside, good = part != 0, np.ones(m, bool)
            for k in range(1, n - 1):
                good &= inside[k : k + m]
            if n <= 2:
                good &= inside[:m] | inside[n - 1 :]
            at = np.flatnonzero(good)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * _M1 + part[at + k]
            yield mix(h)


def tokens(cp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters, and of digits."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(kind, prepend=OTHER, append=OTHER))
    starts = edge[edge < len(cp)]
    starts = starts[kind[starts] != OTHER]
    stop = np.concatenate((np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(cp)]))
    return starts, stop[np.searchsorted(stop, starts, side="right")]


def token_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each token: a sum of code points times powers, by length, so equal tokens have equal hashes everywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    h = size.astype(np.uint64) * _M2
    wide = int(size.max())
    power = np.cumprod(np.full(24, _M1, np.uint64), dtype=np.uint64)
    at = np.arange(len(starts))
    for k in range(min(wide, 24)):
        at = at[size[at] > k]
        h[at] += cp[starts[at] + k].astype(np.uint64) * power[k]
    for i in at[size[at] > 24].tolist() if wide > 24 else ():
        rest = cp[starts[i] + 24 : ends[i]].astype(np.uint64)
        h[i] += (rest * (np.arange(1, len(rest) + 1, dtype=np.uint64) * _M2 + _M1)).sum(dtype=np.uint64)
    return mix(h)
