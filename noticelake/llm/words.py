"""Words of UTF-8 texts and Rabin-Karp hashes of word windows, in numpy.

A word is a run of bytes other than blank, \\t, \\n, \\v, \\f and \\r. Hashes are
polynomials modulo 2**64 over random byte values, so equal words have equal
hashes in every process. Long texts are worked through in segments."""

from __future__ import annotations

import functools

import numpy as np

SEGMENT = 1 << 16
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


@functools.cache
def _family(family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of an odd base and of its inverse, for one hash family."""
    rng = np.random.default_rng(1000 + family)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64)
    base = int(rng.integers(1, 2**62)) * 8 + 5
    grown = []
    for factor in (base, pow(base, -1, 2**64)):
        powers = np.full(SEGMENT + 1, factor % 2**64, np.uint64)
        powers[0] = 1
        grown.append(np.cumprod(powers, dtype=np.uint64))
    return values, *grown


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def folded(text: bytes | None) -> np.ndarray:
    """The bytes of a text in lower case with blanks for ASCII punctuation."""
    lower = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-8", "replace"), np.uint8).copy()
    lower[PUNCTUATION[lower]] = 0x20
    return lower


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words of ``buf`` start and end."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; a word longer than a segment is hashed in pieces."""
    values, powers, inverse = _family(family)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = int(np.searchsorted(ends, origin + SEGMENT, side="right"))
        if to <= at:
            h = np.uint64(0)
            for piece in range(origin, ends[at], SEGMENT):
                part = buf[piece:min(piece + SEGMENT, ends[at])]
                h = mix(np.array([h + (values[part] * powers[:len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[at], at = h, at + 1
            continue
        part = buf[origin:ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * powers[:len(part)], out=sums[1:])
        first = starts[at:to] - origin
        out[at:to] = mix((sums[ends[at:to] - origin] - sums[first]) * inverse[first])
        at = to
    return out


def window_hashes(words: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """The rolling hash of every ``size`` consecutive words."""
    _, powers, inverse = _family(family)
    n = max(0, len(words) - size + 1)
    out = np.empty(n, np.uint64)
    step = SEGMENT - size
    for at in range(0, n, step):
        part = words[at:at + step + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers[:len(part)], out=sums[1:])
        k = len(part) - size + 1
        out[at:at + k] = mix((sums[size:] - sums[:k]) * inverse[:k])
    return out


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values, by doubling."""
    least, have = values, 1
    while have * 2 <= size:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    return least if have == size else np.minimum(least[:len(least) - (size - have)], least[size - have:])


def covered(hit: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words whose start is hit."""
    steps = np.zeros(n + 1, np.int64)
    steps[:len(hit)] += hit
    steps[size:size + len(hit)] -= hit
    return np.cumsum(steps[:n]) > 0


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which of the values occur twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
