"""Word shingles of whole texts as 64-bit fingerprints, by array arithmetic over a batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text taken together; a longer text is taken alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, the texts' bytes one after another, where each begins and the last ends); null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each word with A-Z lower-cased, how many words each text has). Words are runs without white space."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[LOWER[raw]] * up[:n], out=sums[1:])
    found = mix((sums[ends] - sums[starts]) * down[starts])
    return found, np.diff(np.searchsorted(starts, at))


def shingles(found: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all runs of k words, how many each text has); fewer words are one run, no words none."""
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    first = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
    size = np.repeat(np.minimum(counts, k), many)
    out = size.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    for i in range(k):
        here = size > i
        out[here] += found[first[here] + i] * factors[i]
    return mix(out), many


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    for _, raw, at in chunks(column):
        found, many = shingles(*words(raw, at), k)
        ends = np.cumsum(many)
        for a, b in zip(ends - many, ends, strict=True):
            s = np.sort(found[a:b])
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s
