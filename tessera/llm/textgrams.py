"""Word hashes and word n-gram sets of Arrow string columns, many documents at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Random odd values for the bytes, and the base of the rolling hash modulo 2**64.
BYTES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=_U) | _U(1)
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20
#: Bytes of text that are hashed at once: what each takes stays in the processor's cache, and the powers that a worker keeps stay few.
STRETCH = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mixed(a * _U(0xC2B2AE3D27D4EB4F) + mixed(b))


def packed(*cols: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, the first in rising order, as bytes: differences, then byte by byte, of each column as many bytes as it needs."""
    widths, planes = [], []
    for k, col in enumerate(cols):
        col = np.ascontiguousarray(np.asarray(col).astype(_U))
        if not k:
            col = np.diff(col, prepend=_U(0))
        widths.append(max(1, -(-int(col.max(initial=0)).bit_length() // 8)))
        # a plane at a time: a transposed array is copied byte by byte, many times as slowly
        planes += [col.view(np.uint8)[b::8] for b in range(widths[-1])]
    return bytes((len(cols), *widths)) + zstandard.compress(np.concatenate(planes), 1)


def unpacked(data: bytes) -> np.ndarray:
    """The columns again, as rows of an array."""
    widths = data[1 : 1 + data[0]]
    planes = iter(np.frombuffer(zstandard.decompress(data[1 + data[0] :]), np.uint8).reshape(sum(widths), -1))
    rows = None
    for k, width in enumerate(widths):
        for b in range(width):
            plane = next(planes)
            rows = np.zeros((len(widths), len(plane)), _U) if rows is None else rows
            rows[k].view(np.uint8)[b::8] = plane
    rows[0] = np.cumsum(rows[0], dtype=_U)
    return rows


_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, _U), np.zeros(0, _U))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        _powers = tuple(np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, b, _U)))) for b in (BASE, pow(BASE, -1, 2**64)))
    return _powers


def give_back() -> None:
    """Return freed memory to the system, so that workers that live on don't keep what their last task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def binary_view(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have no bytes."""
    strings = strings.fill_null("") if strings.null_count else strings
    wide = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, wide)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at


def word_hashes(strings: pa.Array, segment: int = STRETCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents [i, j) with the hashes of their lower-cased words and each word's document."""
    give_back()
    data, at = binary_view(strings)
    i = 0
    while i < len(strings):
        j = max(i + 1, int(np.searchsorted(at, at[i] + segment, "right")) - 1)
        j = min(j, len(strings))
        part = LOWER[data[at[i] : at[j]]]
        ink = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at[i : j + 1] - at[i]] = True
        starts = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate(([False], ink[:-1]))))
        ends = np.flatnonzero(ink & (edge[1:] | ~np.concatenate((ink[1:], [False])))) + 1
        power, inverse = _tables(len(part))
        rolled = np.concatenate((np.zeros(1, _U), np.cumsum(BYTES[part] * power[: len(part)])))
        words = mixed((rolled[ends] - rolled[starts]) * inverse[starts] + (ends - starts).astype(_U))
        yield i, j, words, np.searchsorted(at[i : j + 1] - at[i], starts, "right") - 1 + i
        i = j


def _joined(words: list[np.ndarray]) -> np.ndarray:
    acc = np.full(len(words[0]), _U(len(words)))
    for w in words:
        acc = mixed(acc * _U(0xC2B2AE3D27D4EB4F) + w)
    return acc


def shingle_sets(strings: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document.

    A document with fewer words has its whole sequence as one; one without words has none.
    """
    for i, j, words, doc in word_hashes(strings):
        bounds = np.searchsorted(doc, np.arange(i, j + 1))
        if len(words) >= n:
            grams = _joined([words[k : len(words) - n + 1 + k] for k in range(n)])
        for d in range(j - i):
            a, b = bounds[d], bounds[d + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield _joined([words[k : k + 1] for k in range(a, b)])
            else:
                yield np.zeros(0, _U)
