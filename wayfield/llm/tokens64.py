"""64-bit hashes of lower-cased (A-Z) words, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)], dtype=np.int8)
_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 14)
        for name, factor in (("up", int(MULTIPLIER)), ("down", pow(int(MULTIPLIER), -1, 1 << 64))):
            one = np.full(size, factor, dtype=np.uint64)
            one[0] = 1
            _powers[name] = np.multiply.accumulate(one)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """sums[i]: the polynomial of the first i bytes; a string's is (sums[end] - sums[start]) * down[start]."""
    up, _ = power_tables(len(raw) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUES[raw] * up[:-1], dtype=np.uint64)])


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text given as UTF-8 bytes (bytes.lower knows ASCII only), without building the words."""
    parts, at = [], 0
    while at < len(raw):
        cut = len(raw)
        if cut - at > BLOCK and (space := _SPACE.search(raw, at + BLOCK)):
            cut = space.end()
        block = np.frombuffer(raw[at:cut].lower(), dtype=np.uint8)
        at = cut
        edges = np.flatnonzero(np.diff(np.concatenate([[0], _IS_WORD[block], [0]])))
        starts, ends = edges[::2], edges[1::2]
        sums, (_, down) = prefix_sums(block), power_tables(len(block) + 1)
        parts.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * MULTIPLIER + words[i : n - k + 1 + i]
    return np.unique(mixed(h))
