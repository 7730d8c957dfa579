"""Word shingles of texts as 64-bit hashes, by array operations over the bytes of many texts at once.

Words are not compared byte by byte: two different shingles are taken for one with a probability of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
#: White space: U+0009-U+000D and U+0020.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose outputs look random (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, A-Z as a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE[65:91] = _BYTE[97:123]


#: Bytes that are hashed together. A longer word is hashed by itself.
BLOCK = 1 << 18
with np.errstate(over="ignore"):
    #: Powers of the base and of its inverse modulo 2^64.
    _UP = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK + 1, _BASE, np.uint64))])
    _DOWN = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64))])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of blocks that end with a word; a word of BLOCK bytes or more is a block of its own."""
    start = 0
    while start < len(data):
        if len(data) - start <= BLOCK:
            yield start, len(data)
            return
        space = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, BLOCK, start)])
        if len(space):
            end = start + int(space[-1]) + 1
            yield start, end
        else:
            end = start + BLOCK
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            yield start, end
        start = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of a text in UTF-8, where each begins); memory beside the result is that of a block."""
    hashes, starts = [], []
    for a, b in _blocks(data):
        if b - a > BLOCK:
            hashes.append(np.array([xxhash.xxh3_64_intdigest(data[a:b].translate(_LOWER))], np.uint64))
            starts.append(np.array([a]))
            continue
        part = np.frombuffer(data, np.uint8, b - a, a)
        space = _SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = np.concatenate([[0][: not space[0]], edge, [len(part)][: not space[-1]]]).astype(np.int64)
        first, last = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _UP[: len(part)])])
            hashes.append(mix((sums[last] - sums[first]) * _DOWN[first] + (last - first).astype(np.uint64) * _M2))
        starts.append(first + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (hashes[0], starts[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(starts))


def shingle_sets(texts: list[bytes], width: int = 4) -> list[np.ndarray]:
    """For each text (UTF-8) its sorted distinct shingles of `width` words; of fewer words, one for the whole sequence."""
    hashes, starts = word_hashes(b"\n".join(texts))
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    with np.errstate(over="ignore"):
        n = len(hashes)
        out = np.zeros(max(0, n - width + 1), np.uint64)
        for i in range(width):
            out = mix(out * _M1 + hashes[i : n - width + 1 + i] + np.uint64(i + 1)) if len(out) else out
    sets, at = [], 0
    for c in counts.tolist():
        if c >= width:
            sets.append(np.unique(out[at : at + c - width + 1]))
        elif c:
            with np.errstate(over="ignore"):
                x = np.array([c], np.uint64) * _M2
                for h in hashes[at : at + c]:
                    x = mix(x * _M1 + h)
            sets.append(x)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += c
    return sets
