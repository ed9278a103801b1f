"""The suffix order of a string that fits one task, by a difference cover in numpy."""

from __future__ import annotations

import numpy as np


def rank(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 0, and how many."""
    top = int(values.max()) + 1 if len(values) else 0
    if top <= 1 << 24:
        there = np.zeros(top, dtype=np.int64)
        there[values] = 1
        number = np.cumsum(there)
        return number[values] - 1, int(number[-1]) if top else 0
    kinds, where = np.unique(values, return_inverse=True)
    return where, len(kinds)


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Positions of t (positive integers) in the order of their suffixes, by a difference cover modulo three."""
    n = len(t)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    kinds = int(t.max()) + 1
    padded = np.concatenate([t, np.zeros(4, dtype=t.dtype)]).astype(np.int64)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # where 3 divides n - 1, an empty suffix ends the ones
    sample = np.concatenate([ones, twos])
    pair = padded[:-1] * kinds + padded[1:]
    if kinds**2 * max(kinds, n + 4) >= 1 << 62:
        pair = rank(pair)[0]
    names, count = rank(pair[sample] * kinds + padded[sample + 2])
    if count < len(sample):
        order = suffix_order(names + 1)
        names = np.empty(len(sample), dtype=np.int64)
        names[order] = np.arange(len(sample))
    else:
        order = np.empty(len(sample), dtype=np.int64)
        order[names] = np.arange(len(sample))
    ranks = np.zeros(n + 4, dtype=np.int64)
    ranks[sample] = names + 1
    sample = sample[order]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    width = n + 4
    near = padded[rest] * width + ranks[rest + 1]
    by = np.argsort(near, kind="stable")
    rest, near = rest[by], near[by]
    is_one = sample % 3 == 1
    first, second = sample[is_one], sample[~is_one]
    below = np.searchsorted(padded[first] * width + ranks[first + 1], near)
    below += np.searchsorted(pair[second] * width + ranks[second + 2], pair[rest] * width + ranks[rest + 2])
    out = np.empty(n, dtype=np.int64)
    at = below + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = sample
    return out
