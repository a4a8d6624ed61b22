"""Arithmetic over the prime field of 2^61 - 1 on numpy arrays of uint64."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)


def reduce(s: np.ndarray) -> np.ndarray:
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b, by halves of 31 bits: 2^62 is 2 and 2^61 is 1 in this field."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = ah * bl + al * bh
    return reduce(((ah * bh) << np.uint64(1)) + (mid >> _30) + ((mid & _LOW30) << _31) + al * bl)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + (_P - b))


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce(a + b)


def power(a: np.ndarray, e: int) -> np.ndarray:
    out = np.ones_like(a)
    while e:
        if e & 1:
            out = mul(out, a)
        a = mul(a, a)
        e >>= 1
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    return power(a, P - 2)


def horner(coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Value at x of each row's polynomial, the highest coefficient first."""
    out = np.zeros_like(x)
    for k in range(coefficients.shape[1]):
        out = add(mul(out, x), coefficients[:, k])
    return out


def segment_products(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Product of the rows of each segment, by halving all segments at once."""
    lengths = np.diff(np.append(starts, len(values)))
    while len(values) > len(starts):
        position = np.arange(len(values)) - np.repeat(starts, lengths)
        even = np.flatnonzero(position % 2 == 0)
        paired = position[even] + 1 < np.repeat(lengths, (lengths + 1) // 2)
        out = values[even]
        out[paired] = mul(out[paired], values[even[paired] + 1])
        values, lengths = out, (lengths + 1) // 2
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return values


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A solution of each of many square systems, free unknowns 0. An inconsistent system gives some vector: check it."""
    n, m = right.shape
    a = np.concatenate([matrix, right[:, :, None]], axis=2)
    every, rank, row_of = np.arange(n), np.zeros(n, dtype=np.int64), np.full((n, m), -1)
    for c in range(m):
        usable = (a[:, :, c] != 0) & (np.arange(m)[None, :] >= rank[:, None])
        has, pivot = usable.any(axis=1), usable.argmax(axis=1)
        k, top, at = every[has], rank[has], pivot[has]
        if not len(k):
            continue
        lead = a[k, at]
        a[k, at] = a[k, top]
        lead = mul(lead, inverse(lead[:, c])[:, None])
        a[k, top] = lead
        factor = a[k, :, c]
        factor[np.arange(len(k)), top] = 0
        a[k] = sub(a[k], mul(factor[:, :, None], lead[:, None, :]))
        row_of[k, c] = top
        rank[k] += 1
    found = a[every[:, None], np.maximum(row_of, 0), m]
    return np.where(row_of >= 0, found, np.uint64(0))
