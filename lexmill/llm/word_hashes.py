"""64-bit hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from lexmill.llm.common import SPACE_CHARS, mix

#: Bytes of texts that are hashed at once; words of more bytes than LONG are hashed one by one.
PART, LONG = 1 << 18, 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_VALUES = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least n powers of an odd base, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1024), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out)
    return _POWERS[base]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in a row, and each text's number of words.

    A word's hash is a polynomial of random values of its bytes, from differences of running sums.
    """
    hashes, lengths, part, size = [], [], [], 0
    for k, text in enumerate(texts):
        part.append(text)
        size += len(text) + 1
        if size >= PART or k == len(texts) - 1:
            h, n = _hash_part(part)
            hashes.append(h)
            lengths.append(n)
            part, size = [], 0
    return np.concatenate([*hashes, np.empty(0, np.uint64)]), np.concatenate([*lengths, np.empty(0, np.int64)])


def _hash_part(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[1:] = ~_IS_SPACE[raw]
    edges = np.diff(inside)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * powers(_BASE, len(raw))[: len(raw)], out=sums[1:])
    sizes = stops - starts
    h = mix((sums[stops] - sums[starts]) * powers(_INVERSE, len(raw))[starts] + sizes.astype(np.uint64))
    for k in np.flatnonzero(sizes > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : stops[k]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)])).astype(np.int64)
