"""Words and word shingles of whole texts as 64-bit hashes, in numpy, batch by batch.

A word is a maximal run of letters and digits of the lower-cased text. Texts are hashed in pieces of about
``PIECE_CHARS`` characters that never cut a word, so memory is bounded by that and by the longest text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np

PIECE_CHARS = 500_000
SHINGLE_WORDS = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, hence invertible modulo 2**64
_ABSENT = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter or digit, and its random value."""
    points = sys.maxunicode + 1
    inside = np.fromiter((chr(c).isalnum() for c in range(points)), bool, points)
    return inside, mix(np.arange(points, dtype=np.uint64))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``size`` positions."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    both = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words in a row of code points."""
    inside, values = _alphabet()
    flags = np.zeros(len(codes) + 2, np.int8)
    flags[1:-1] = inside[codes]
    edges = np.diff(flags)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    size = 1 << max(12, int(len(codes)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values[codes] * power[: len(codes)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mix(hashes ^ (ends - starts).astype(np.uint64))


def _long_text(text: str) -> np.ndarray:
    """Word hashes of one text, piece by piece."""
    parts, at = [], 0
    while at < len(text):
        end = min(at + PIECE_CHARS, len(text))
        while end < len(text) and text[end].isalnum():
            end += 1
        parts.append(_hash_words(code_points(text[at:end]))[1])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, doc, hash) for runs texts[first:last]: the word hashes in order and each one's text."""
    at = 0
    while at < len(texts):
        first, chars, run = at, 0, []
        while at < len(texts) and (not run or chars + len(texts[at] or "") < PIECE_CHARS):
            run.append((texts[at] or "").lower())
            chars += len(run[-1]) + 1
            at += 1
        if len(run) == 1:
            hashes = _long_text(run[0])
            yield first, at, np.zeros(len(hashes), np.int64), hashes
            continue
        starts, hashes = _hash_words(code_points("\n".join(run)))
        bounds = np.cumsum([len(t) + 1 for t in run])
        yield first, at, np.searchsorted(bounds, starts, side="right"), hashes


def shingles(doc: np.ndarray, words: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of ``size`` words; a text of fewer words has one shingle of all its words."""
    n = len(words)
    if n == 0:
        return doc, words
    padded = np.concatenate([words, np.full(size - 1, _ABSENT, np.uint64)])
    owner = np.concatenate([doc, np.full(size - 1, -1, doc.dtype)])
    total = np.zeros(n, np.uint64)
    for j in range(size):
        same = owner[j : j + n] == doc
        total += np.where(same, padded[j : j + n], _ABSENT) * np.uint64(pow(int(_BASE), j, 1 << 64))
    whole = owner[size - 1 : size - 1 + n] == doc
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = whole | first
    return doc[keep], mix(total[keep])


def distinct_counts(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, occurrences), ordered by doc and hash."""
    if len(doc) == 0:
        return doc, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def sequence_hash(doc: np.ndarray, words: np.ndarray, texts: int) -> np.ndarray:
    """One hash of each text's whole word sequence; 0 for a text without words."""
    out = np.zeros(texts, np.uint64)
    if len(words) == 0:
        return out
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
    sums = np.add.reduceat(mix(words ^ mix(place.astype(np.uint64))), starts)
    out[doc[starts]] = mix(sums) | np.uint64(1)
    return out
