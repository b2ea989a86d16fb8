"""Words and five-word shingles as 64-bit hashes.

A word is a run of bytes other than blank, tab, newline, vertical tab, form feed and return, with
A-Z lower-cased. Its hash is a polynomial over random values of its bytes, so all words of a batch
of texts are hashed at once, as differences of running sums; words of more than ``LONGEST`` bytes
have a hash of their own kind. A shingle's hash mixes those of its words in order. Two different
shingles of a pair of documents share a hash with a chance of about (n_a + n_b)^2 / 2^64; two words
of up to ``LONGEST`` bytes with one of 2^-56 or less, unless they were built from the multiplier's powers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from xxhash import xxh3_64_intdigest

from palisade.llm.caches import only

SHINGLE = 5
#: Bytes that share a running sum, and of the longest word that is hashed by it.
CHUNK, LONGEST = 1 << 17, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]


def _powers(factor: int) -> np.ndarray:
    factors = np.full(CHUNK, factor, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS, _INVERSES = _powers(int(_MULTIPLIER)), _powers(pow(int(_MULTIPLIER), -1, 1 << 64))


def word_bounds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    blank = _BLANK[flat]
    edges = np.flatnonzero(np.concatenate([[True], blank]) != np.concatenate([blank, [True]]))
    return edges[::2], edges[1::2]


def _hash_of_chunk(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[flat] * _POWERS[: len(flat)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _INVERSES[starts]


def bounded_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words between ``starts`` and ``ends`` of ``flat``."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    cuts = range(0, len(flat), CHUNK)
    first = np.searchsorted(starts, [*cuts, len(flat)])
    apart = [np.flatnonzero(ends - starts > LONGEST)]
    for at, lo, hi in zip(cuts, first[:-1], first[1:]):
        whole = lo + int(np.searchsorted(ends[lo:hi], at + CHUNK, side="right"))
        hashes[lo:whole] = _hash_of_chunk(flat[at : at + CHUNK], starts[lo:whole] - at, ends[lo:whole] - at)
        apart.append(np.arange(whole, hi))  # at most one word, which the cut goes through
    for i in np.concatenate(apart).tolist():
        word = flat[starts[i] : ends[i]]
        if len(word) > LONGEST:
            hashes[i] = xxh3_64_intdigest(word.tobytes().lower())
        else:
            hashes[i] = _hash_of_chunk(word, np.array([0]), np.array([len(word)]))[0]
    return mixed(hashes + (ends - starts).astype(np.uint64))


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a newline behind each, and the place behind each newline."""
    flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return flat, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)


def hashed_texts(texts: Sequence[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order."""
    return [hashes for hashes, _ in hashed_lines(texts)]


def hashed_lines(texts: Sequence[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its words, and the number of words in each of its lines."""
    only("words")
    flat, stops = joined(texts)
    starts, ends = word_bounds(flat)
    hashes = bounded_hashes(flat, starts, ends)
    breaks = np.flatnonzero(flat == 10)
    sizes = np.diff(np.searchsorted(starts, breaks), prepend=0)
    word_stops = np.searchsorted(starts, stops)
    line_stops = np.searchsorted(breaks, stops)
    return list(zip(np.split(hashes, word_stops[:-1]), np.split(sizes, line_stops[:-1]))) if len(texts) else []


def word_hashes(text: bytes) -> np.ndarray:
    return hashed_texts([text])[0]


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order of place."""
    n = len(hashes) - size + 1
    value = np.full(max(n, 0), size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            value = value * _MULTIPLIER + hashes[k : k + len(value)]
    return mixed(value)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once; less of a fixed cost than ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles in order of hash; fewer words than ``size``: the whole sequence as one."""
    if not len(hashes):
        return hashes
    return distinct(windows(hashes, min(size, len(hashes))))


def shingle_sets(texts: Sequence[bytes]) -> list[np.ndarray]:
    return [shingle_set(hashes) for hashes in hashed_texts(texts)]
