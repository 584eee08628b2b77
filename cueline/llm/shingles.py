"""Sets of word shingles as sorted 64-bit hashes, computed over whole Arrow batches with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import kept_for

#: Bytes of text hashed at once; longer texts are hashed part by part.
CHUNK = 1 << 20

_U, _ALL = np.uint64, (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_GOLD = 0x9E3779B97F4A7C15
_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(_GOLD))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x2545F4914F6CDD1D


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers; n is at most CHUNK + 2, so what is kept is bounded."""
    powers = kept_for("shingles")
    if base not in powers or len(powers[base]) < n:
        steps = np.full(max(n, CHUNK + 2), base, dtype=_U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            powers[base] = np.cumprod(steps, dtype=_U)
    return powers[base][:n]


def _raw_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, length) of the words of a byte array of at most CHUNK + 1 bytes; a word's value is the sum of its bytes' codes times powers of the base."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power(pow(_BASE, -1, 1 << 64), len(data) + 1)[starts]
    return value, starts, ends - starts


def _finish(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    return _mix(value + length.astype(_U) * _U(_GOLD))


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a byte array of at most CHUNK + 1 bytes; A-Z count as a-z."""
    value, starts, length = _raw_words(data)
    return _finish(value, length), starts


def long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a byte array of any length, CHUNK bytes at a time; a word may lie over several chunks."""
    out, value, length = [], 0, 0  # of a word that reaches the end of the last chunk
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        values, starts, lengths = _raw_words(part)
        if length:
            if len(starts) and starts[0] == 0:
                values[0] = _U((value + int(values[0]) * pow(_BASE, length, 1 << 64)) & _ALL)
                lengths[0] += length
            else:
                out.append(_finish(np.array([value], _U), np.array([length])))
            value = length = 0
        if len(starts) and not _SPACE[part[-1]]:
            value, length = int(values[-1]), int(lengths[-1])
            values, lengths = values[:-1], lengths[:-1]
        out.append(_finish(values, lengths))
    if length:
        out.append(_finish(np.array([value], _U), np.array([length])))
    return np.concatenate(out) if out else np.zeros(0, _U)


def _sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The set of each text, whose words lie between two bounds."""
    grams = np.zeros(0, _U)
    if len(words) >= width:
        grams = words[: len(words) - width + 1].copy()
        for j in range(1, width):
            grams = grams * _U(_GOLD) + words[j : len(words) - width + 1 + j]
        grams = _mix(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            value = _U(0)
            for x in words[a:b]:
                value = value * _U(_GOLD) + x
            yield _mix(np.array([value + _U(b - a)], _U))
        else:
            yield np.zeros(0, _U)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each binary value its sorted set of shingle hashes; null and texts without words give an empty set.

    A text of fewer than ``width`` words is one shingle.
    """
    with np.errstate(over="ignore"):
        waiting: list[np.ndarray] = []
        size = 0

        def together() -> Iterator[np.ndarray]:
            gap = np.array([0x20], np.uint8)
            data = np.concatenate([x for d in waiting for x in (d, gap)]) if waiting else np.zeros(0, np.uint8)
            words, starts = hash_words(data)
            ends = np.cumsum([len(d) + 1 for d in waiting])
            yield from _sets(words, np.concatenate([[0], np.searchsorted(starts, ends)]), width)

        for v in column:
            data = np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)
            if size + len(data) + len(waiting) > CHUNK:
                yield from together()
                waiting, size = [], 0
            if len(data) > CHUNK:
                words = long_words(data)
                yield from _sets(words, np.array([0, len(words)]), width)
            else:
                waiting.append(data)
                size += len(data)
        yield from together()
