"""Hashes of words and of spans of words, in NumPy over the bytes of many texts at once.

A span hash is a Rabin-Karp polynomial modulo 2**64: prefix sums of ``value * base**position`` give the hash of
any span with two look-ups and one multiplication, so all windows of a text cost the same whatever their width.
Words are the runs between ``[\\x20\\x09-\\x0D]``; their hashes are mixed before they enter a window's polynomial.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Odd bases of the two independent polynomials.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Longer words take a cryptographic digest: a polynomial modulo 2**64 has known collisions from about 1,000 bytes on.
LONG_WORD = 512
#: Bytes hashed at a time, so that temporary arrays stay small.
PIECE = 1 << 20
NO_ID = np.iinfo(np.int64).max

_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, inverse)
        )
        if size <= 2 * PIECE:
            _powers[base] = have
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of ``values[start:end]`` for every span."""
    up, down = _power_tables(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def texts_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column without copying; nulls are empty."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
        if hasattr(column, "chunks"):
            column = column.chunk(0) if column.num_chunks else None
    if column is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    large = str(column.type).startswith("large")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3
    solid = _SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def _pieces(starts: np.ndarray, ends: np.ndarray):
    """Runs of words that cover about PIECE bytes each."""
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        yield at, to
        at = to


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word; ``lower`` folds A-Z."""
    out = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    size = (ends - starts).astype(np.uint64)
    for at, to in _pieces(starts, ends):
        low, high = int(starts[at]), int(ends[to - 1])
        piece = data[low:high]
        values = (_LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)
        for target, base in zip(out, BASES):
            target[at:to] = span_hash(values, starts[at:to] - low, ends[at:to] - low, base)
    for target in out:
        np.copyto(target, mix(target + size * np.uint64(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[i] : ends[i]]
        digest = hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=16).digest()
        out[0][i], out[1][i] = np.frombuffer(digest, "<u8")
    return out


def window_hashes(words: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of spans of words, given the words' hashes."""
    return tuple(mix(span_hash(w, starts, ends, base)) for w, base in zip(words, BASES))
