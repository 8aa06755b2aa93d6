"""Recovery blocks: Reed-Solomon codes over the field of 256 elements."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed value: the field's polynomial, x^8 + x^4 + x^3 + x^2 + 1.
POLYNOMIAL = 0x11D


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(powers of the generator, twice over; logarithms)."""
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    return power, log


def multiply(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    power, log = _tables()
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    return np.where((a == 0) | (b == 0), 0, power[log[a] + log[b]]).astype(np.uint8)


def _inverse(x: int) -> int:
    power, log = _tables()
    return int(power[255 - log[x]])


def _rows(data: int, parity: int) -> np.ndarray:
    """A matrix of which all square parts can be inverted: 1 / (x + y) of different x and y (Cauchy)."""
    if data + parity > 256:
        raise ValueError("at most 256 shards")
    return np.array([[_inverse(x ^ (parity + y)) for y in range(data)] for x in range(parity)], np.uint8).reshape(parity, data)


def parity(shards: list[bytes], count: int) -> list[bytes]:
    """``count`` recovery shards for data shards of one length."""
    v = np.stack([np.frombuffer(s, np.uint8) for s in shards])
    out = []
    for row in _rows(len(shards), count):
        total = np.zeros(v.shape[1], np.uint8)
        for factor, shard in zip(row, v):
            total ^= multiply(shard, factor)
        out.append(total.tobytes())
    return out


def recover(shards: list[bytes | None], recovery: list[bytes | None]) -> list[bytes]:
    """The data shards; those that are None are solved for from as many recovery shards."""
    lost = [i for i, s in enumerate(shards) if s is None]
    there = [i for i, s in enumerate(recovery) if s is not None][: len(lost)]
    if len(there) < len(lost):
        raise ValueError(f"{len(lost)} shards are lost and {len(there)} are there to recover them")
    if not lost:
        return list(shards)
    rows = _rows(len(shards), len(recovery))[there]
    left = np.stack([np.frombuffer(recovery[i], np.uint8) for i in there]).copy()
    for i, shard in enumerate(shards):
        if shard is not None:
            left ^= multiply(rows[:, i : i + 1], np.frombuffer(shard, np.uint8)[None, :])
    matrix = rows[:, lost].copy()
    for i in range(len(lost)):  # elimination; no pivot is zero in any order that finds one
        pivot = i + int(np.flatnonzero(matrix[i:, i])[0])
        matrix[[i, pivot]], left[[i, pivot]] = matrix[[pivot, i]], left[[pivot, i]]
        factor = _inverse(int(matrix[i, i]))
        matrix[i], left[i] = multiply(matrix[i], factor), multiply(left[i], factor)
        for j in range(len(lost)):
            if j != i and matrix[j, i]:
                f = int(matrix[j, i])
                matrix[j] ^= multiply(matrix[i], f)
                left[j] ^= multiply(left[i], f)
    out = list(shards)
    for i, row in zip(lost, left):
        out[i] = row.tobytes()
    return out
