"""Word and shingle hashing over Arrow string batches, vectorised with numpy.

Words are the runs of bytes outside ``0x20`` and ``0x09-0x0D``; ``A-Z`` are lower-cased.
UTF-8 continuation bytes are never separators, so working on bytes equals working on code points.

A word's hash is a polynomial over random per-byte values modulo 2**64, taken from prefix sums,
followed by a finaliser.  It does not depend on where the word stands, so a text can be hashed in
slices and its memory stays bounded by ``SLICE`` bytes times a small factor, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random value per byte; A-Z share those of a-z."""
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


_VALUES = _byte_values()
_powers: dict[str, np.ndarray] = {}


def power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < length:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(max(length, SLICE + 1), base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def _hash_slice(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in ``data``; ``breaks`` are forced word starts."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = power_tables(len(data))
    inside = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, dtype=bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[breaks] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    last = np.ones(len(data), dtype=bool)
    last[:-1] = ~inside[1:] | fresh[1:-1]
    ends = np.flatnonzero(inside & last)
    terms = _VALUES[data] * up[: len(data)]
    sums = np.cumsum(terms)
    hashes = (sums[ends] - sums[starts] + terms[starts]) * down[starts]
    return mix(hashes ^ (ends - starts + 1).astype(np.uint64) * _STEP), starts


def hash_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, in order, the hashes of its words (nulls: none)."""
    texts = texts.cast(pa.large_string())
    count = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    valid = ~np.asarray(texts.is_null())
    at = 0
    while at < count:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[upto])
        if hi - lo <= SLICE:
            hashes, starts = _hash_slice(data[lo:hi], offsets[at:upto] - lo)
            cuts = np.searchsorted(starts, offsets[at : upto + 1] - lo)
            for i in range(upto - at):
                yield hashes[cuts[i] : cuts[i + 1]] if valid[at + i] else hashes[:0]
        else:
            yield _hash_long(data[lo:hi]) if valid[at] else np.empty(0, np.uint64)
        at = upto


def _hash_long(data: np.ndarray) -> np.ndarray:
    """One text longer than a slice, cut behind white space."""
    parts, at = [], 0
    while at < len(data):
        upto = min(len(data), at + SLICE)
        if upto < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:upto]])
            while not len(spaces) and upto < len(data):  # one word longer than a slice
                upto = min(len(data), upto + SLICE)
                spaces = np.flatnonzero(_SPACE[data[at:upto]])
            if upto < len(data):
                upto = at + int(spaces[-1]) + 1
        parts.append(_hash_slice(data[at:upto], np.empty(0, np.int64))[0])
        at = upto
    return np.concatenate(parts)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words, by start; none if there are fewer words."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j in range(width):
        total = total * _BASE + words[j : j + count]
    return mix(total)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted set of window hashes; fewer words than ``width`` make one shingle, none makes none."""
    if not len(words):
        return words
    return np.unique(windows(words, min(width, len(words))))
