"""Words of whole texts as numpy arrays: the texts of a batch lie in one buffer of UTF-8 bytes, and words, n-grams and their hashes are computed for all of them at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; longer texts are handled alone.
CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


@dataclass
class Batch:
    """Lower-cased words of some texts. data: words with one blank after each. start, end: of each word in data. doc: number of each word's text. first: number of each text's first word, and the number of words at last."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1


def chunks(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of a string column of about CHUNK bytes."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
    at = 0
    while at < len(column):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK, side="right")))
        yield column.slice(at, to - at)
        at = to


#: Blanks and all ASCII signs, for words of letters and digits alone.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def split(column: pa.Array, blank: np.ndarray = _SPACE) -> Batch:
    """Lower-case A-Z and split at the blanks U+0020 and U+0009 to U+000D, or at the bytes that blank marks; null counts as empty."""
    n = len(column)
    joined = pc.binary_join_element_wise(pc.fill_null(column, "").cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    # each text has the separator after it, so no word spans two texts
    ends = np.cumsum(np.asarray(pc.binary_length(joined)), dtype=np.int64)
    flat = joined if joined.offset == 0 else pa.concat_arrays([joined])
    data = np.frombuffer(flat.buffers()[2], dtype=np.uint8)[: int(ends[-1]) if n else 0]
    data = _LOWER[data]
    space = blank[data]
    inside = ~space
    last = space.copy()
    last[1:] &= inside[:-1]  # the blank that follows a word
    if n:
        last[0] = False
    word_doc = np.searchsorted(ends, np.flatnonzero(last), side="right")
    kept = data[inside | last]
    kept[blank[kept]] = 0x20
    end = np.flatnonzero(kept == 0x20)
    start = np.concatenate([np.zeros(min(1, len(end)), dtype=np.int64), end[:-1] + 1])
    return Batch(kept, start, end, word_doc, np.searchsorted(word_doc, np.arange(n + 1)))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each data[start:end], all slices at once."""
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    wide = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    half = np.ndarray((len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))
    size, at = (end - start).astype(np.int64), start.astype(np.int64).copy()
    h = np.full(len(size), U(seed) + P5, dtype=np.uint64)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), x, dtype=np.uint64) for x in (U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1)]
            left, live = size[long] // 32, np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], wide[at[long[live]] + 8 * k])
                at[long[live]] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[long] = acc
        h += size.astype(np.uint64)
        rest = size % 32
        for k in range(3):
            live = np.flatnonzero(rest >= 8 * (k + 1))
            h[live] = _rot(h[live] ^ _round(np.zeros(len(live), dtype=np.uint64), wide[at[live]]), 27) * P1 + P4
            at[live] += 8
        live = np.flatnonzero(rest % 8 >= 4)
        h[live] = _rot(h[live] ^ (half[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        for k in range(3):
            live = np.flatnonzero(rest % 4 > k)
            h[live] = _rot(h[live] ^ (data[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def shingles(batch: Batch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in data of every k-word shingle, and each text's first shingle (with their number at last). A text of fewer words has one shingle, its whole sequence; one without words has none."""
    words = np.diff(batch.first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(len(words)), count)
    begin = batch.first[of] + np.arange(first[-1]) - first[of]
    stop = begin + np.minimum(k, words[of]) - 1
    return batch.start[begin], batch.end[stop], first


_BYTES = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    _BYTES[_b] = sum(1 << (8 * k) for k in range(8) if _b >> k & 1)


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group h[first[i]:first[i + 1]], how many have bit b set: an array of groups x 64."""
    groups, sizes = len(first) - 1, np.diff(first)
    out = np.zeros((groups, 64), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    runs = -(-sizes[full] // 255)  # byte counters hold runs of 255
    run_of = np.repeat(full, runs)
    run_first = np.concatenate([[0], np.cumsum(runs)])
    begin = first[run_of] + 255 * (np.arange(run_first[-1]) - np.repeat(run_first[:-1], runs))
    for k in range(8):
        lanes = np.add.reduceat(_BYTES[((h >> U(8 * k)) & U(255)).astype(np.intp)], begin)
        per_run = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
        out[full, 8 * k : 8 * k + 8] = np.add.reduceat(per_run, run_first[:-1], axis=0, dtype=np.int64)
    return out


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each group: a bit is 1 if set in over half the hashes; 0 for an empty group."""
    bits = bit_counts(h, first) * 2 > np.diff(first)[:, None]
    return (np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)).astype(np.uint64)
