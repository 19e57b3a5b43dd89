"""Parity sketches of sets and the block keys that a pigeonhole join needs.

A sketch deals the elements of a set over ``m`` blocks by their leading hash bits; a
block is the XOR of its elements' hashes, so every element that only one of two sets
holds changes at most one block: the number of differing blocks (the block-wise Hamming
distance) is a lower bound of the symmetric difference. Sets whose Jaccard similarity
reaches p/q differ in at most D = (q-p)(a+b)/(q+p) elements, hence in at most D blocks.
A set with more than D non-empty blocks therefore shares one with its partner, and, as
in any pigeonhole prefix, one among the D+1 first in an order that both sides use.
Blocks with most elements come first: they are the rarest, and passages that many
documents share seldom fill one.

Sizes fall into bands [2^k, 2^(k+1)). A set is indexed in its own band and, if a partner
of the band below can be large enough, there too. Where a set has fewer than D+k
non-empty blocks, the number of blocks is doubled until it has enough; it is indexed at each of these
levels, so of two partners the one that needs fewer levels finds the other.
"""

from __future__ import annotations

import numpy as np

from tabvet.llm.common import mix

LOAD = 0.40  # blocks per element of the largest set in a band
_B = np.uint64(0xD6E8FEB86659FD93)


def max_difference(a, b, p: int, q: int):
    """Largest symmetric difference of sets of sizes a and b with Jaccard at least p/q."""
    return (q - p) * (a + b) // (q + p)


def shared_keys(d):
    """How many keys two sets within symmetric difference ``d`` share at least."""
    return 1 + d // 8


def _first_blocks(s: np.ndarray, size: np.ndarray, bands: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the d first blocks of each row, at each level up to the first that has
    as many. ``s``: the rows' sorted hashes one after another, ``size``: their lengths."""
    rows, keys, level, left = [], [], 0, np.arange(len(size))
    m = np.maximum(8, (LOAD * (2 << bands)).astype(np.int64)).astype(np.uint64)
    while len(left):
        row = np.repeat(np.arange(len(left)), size)
        block = ((s >> np.uint64(32)) * m[row]) >> np.uint64(32)  # grows with s, which is sorted in each row
        new = np.ones(len(s), bool)
        new[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new)
        count, at = np.diff(np.append(starts, len(s))), row[starts]
        tag = (bands[at].astype(np.uint64) << np.uint64(8) | np.uint64(level)) + np.uint64(1) << np.uint64(32)
        key = mix(np.bitwise_xor.reduceat(mix(s ^ _B), starts) + mix((block[starts] + tag) ^ _B))
        order = ((255 - np.minimum(count, 255)).astype(np.uint64) << np.uint64(56)) | (key >> np.uint64(8))
        by = np.lexsort((order, at))
        blocks = np.bincount(at, minlength=len(left))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        take = by[rank < d[at]]
        rows.append(left[at[take]])
        keys.append(key[take])
        few = blocks < np.minimum(d, size)
        s, left, size, bands, d, m, level = s[few[row]], left[few], size[few], bands[few], d[few], m[few] * np.uint64(2), level + 1
    return np.concatenate(rows), np.concatenate(keys)


def dense_sketch(s: np.ndarray, words: int = 16) -> np.ndarray:
    """Parity bits of a set: each element toggles one of ``64 * words`` bits, so the Hamming
    distance of two sketches is at most the symmetric difference of their sets."""
    bits = np.bincount((mix(s + _B) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def block_keys(sets: list[np.ndarray], p: int = 75, q: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of sorted sets of distinct uint64 hashes: sets with Jaccard
    similarity of at least p/q share a key. An empty set has none."""
    used = [i for i, s in enumerate(sets) if len(s)]
    if not used:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.array([len(sets[i]) for i in used])
    band = np.frexp(n.astype(float))[1] - 1
    row, d = np.array(used), max_difference(n, n * q // p, p, q)  # the largest partner may be in the next band
    below = (1 << band) - 1
    down = (below > 0) & (below * q >= n * p)
    both = np.concatenate((row, row[down]))
    d = np.concatenate((d, max_difference(n, below, p, q)[down]))
    at, key = _first_blocks(np.concatenate([sets[i] for i in both]), np.concatenate((n, n[down])), np.concatenate((band, band[down] - 1)), d + shared_keys(d))
    return both[at], key
