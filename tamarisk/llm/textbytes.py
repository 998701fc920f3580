"""Vectorised work on UTF-8 text inside Arrow batches.

Texts are taken as the bytes of an Arrow string column, in chunks of about
``CHUNK`` bytes, so the memory of a task is bounded by the chunk or by its longest
single text.  Words are runs of bytes other than space and 0x09-0x0D, lower-cased
for A-Z only.  A hash stands for a word: a polynomial over a table of random
64-bit values, mixed afterwards; equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all of them."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers; n+1 long."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, whatever its place."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def gram_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of every span of ``size`` bytes, by slices and in place."""
    _, down = powers(len(prefix))
    h = (prefix[size:] - prefix[:-size]) * down[: len(prefix) - size]
    rest = h >> _U(30)
    h ^= rest
    h *= _U(0xBF58476D1CE4E5B9)
    np.right_shift(h, _U(27), out=rest)
    h ^= rest
    h *= _U(0x94D049BB133111EB)
    np.right_shift(h, _U(31), out=rest)
    h ^= rest
    return h


@dataclass
class Chunk:
    """Some rows of a batch: their bytes, concatenated, and where each text begins."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    n = len(texts)
    ends = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield Chunk(slice(at, to), raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


@dataclass
class Words:
    """Spans and hashes of the words of a chunk; ``first[i]:first[i+1]`` are those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def words(chunk: Chunk, lower: bool = True) -> Words:
    data = LOWER[chunk.data] if lower else chunk.data
    n = len(data)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[data], out=inside[1:-1])
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets), span_hash(prefix_hash(data), starts, ends))


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.astype(np.uint64, copy=False).view(np.int64)


class HashTable:
    """Positions of known 64-bit hashes, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift = _U(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.at = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        slot = (keys >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.at[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[left[won]]
            self.at[slot[won]] = left[won]
            lost = np.ones(len(left), dtype=bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.at[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        slot = slot[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            slot = (slot + 1) & self.mask
            hit = (self.keys[slot] == h[open_]) & (self.at[slot] >= 0)
            out[open_[hit]] = self.at[slot[hit]]
            go = ~hit & (self.at[slot] >= 0)
            open_, slot = open_[go], slot[go]
        return out
