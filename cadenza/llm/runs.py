"""Periodic runs of words in each text, by seeds and diagonals.

A run of period q that is max(12, 2q) words or longer matches itself, q words on, over max(12 - q, q) words or more. Lags are
taken by levels [L, 2L), the first of them 1 to 11. The guaranteed overlap of a level is two grams of its length less one or
more, so one of the grams that begin at multiples of that length lies inside: these are the seeds, and the index of all grams
gives the other places of a seed at the level's lags, at most two pairs a word and level (four at the first), whatever the text. Seeds next to each other
on one diagonal are one stretch, extended once at its ends; less than a gram is missing at either. Grams are numbered by
doubling, from numbers of different words, so nothing rests on hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Shortest run; grams of the first level, and its last lag.
LEAST, SEED, NEAR = 12, 3, 11


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the different pairs."""
    return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]


def stretches(grams: dict[int, np.ndarray], size: int, low: int, high: int) -> list[np.ndarray]:
    """(start, length, period) of the stretches that have one of the periods [low, high) and match themselves over a seed."""
    names, word = grams[size], grams[1]
    n = len(word)
    places = np.arange(len(names))
    key = names * (n + 1) + places
    key.sort()
    seed = np.arange(0, len(names), size)
    a, b = (np.searchsorted(key, names[seed] * (n + 1) + np.minimum(seed + lag, n)) for lag in (low, high))
    many = b - a
    first = np.repeat(seed, many)
    lag = key[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())] % (n + 1) - first
    if not len(lag):
        return [np.zeros(0, np.int64)] * 3
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    # the furthest place that a lag's seeds have covered: a seed that begins there goes on with the stretch
    covered = np.r_[True, (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + size)]
    start, end, lag = first[covered], first[np.r_[covered[1:], True]] + size, lag[covered]
    for g in sorted((g for g in grams if g < size), reverse=True):
        for _ in range(2):  # less than a gram is left, so less than two of a third or half
            names = grams[g]
            fits = np.flatnonzero(end + lag + g <= n)
            end[fits[names[end[fits]] == names[end[fits] + lag[fits]]]] += g
            fits = np.flatnonzero(start >= g)
            start[fits[names[start[fits] - g] == names[start[fits] - g + lag[fits]]]] -= g
    return [start, end - start + lag, lag]


def find_runs(word: np.ndarray) -> np.ndarray:
    """Rows of start, length, period, by start and period. word: a number for each word, alike for like words."""
    n = len(word)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    grams, found = {1: word}, []
    grams[SEED] = paired(paired(word[:-2], word[1:-1]), word[2:])
    size, low, high = SEED, 1, NEAR + 1
    while low <= n // 2:
        if grams[size].max() + 1 == len(grams[size]):  # no gram twice
            break
        found.append(stretches(grams, size, low, high))
        size, low, high = 2 * size, high, 2 * high
        if low <= n // 2:
            half = grams[size // 2]
            grams[size] = paired(half[: -(size // 2)], half[size // 2 :])
    if not found:
        return np.zeros((0, 3), np.int64)
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    long = length >= np.maximum(LEAST, 2 * period)
    rows = np.stack([start[long], length[long], period[long]], axis=1)
    # periods of one maximal stretch are multiples of the smallest
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word each word becomes in the texts that get a period of their own, or None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a, i = g % n, np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: its id, n_runs, the longest run's start, length, period and exponent_milli (1000 times length by period, rounded
    down), and the digests of all runs and of the text without what repeats.

    Words are runs without ASCII white space. A run is a stretch of words with smallest period q, of max(12, 2q) words or more,
    that no neighbouring word extends with that period. The longest comes first, then the earlier, then the smaller period; a
    text without runs has nulls there. A word goes if a run holds it after that run's first q words. A null text counts as
    empty: no runs. plant gives one text in ten, by the crc32 of its id, a period of its own first; texts with a null id are
    left as they are. with_text adds the text without what repeats, its words joined by one space, and the runs as a list.
    Rows don't depend on each other: nothing shuffles, repeated rows come out as often, and other columns are left out. A text
    takes memory in proportion to its length times the logarithm of its longest period.
    """

    def run(batches):
        for batch in batches:
            rows, lists, kept_texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                word, moved = numbered(words), planted(len(words), doc_id) if plant else None
                if moved is not None:
                    word = word[moved]
                runs = find_runs(word)
                if moved is not None:
                    words = [words[i] for i in moved.tolist()]
                if len(runs):
                    gone = dropped(len(words), runs)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    s, m, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    best = (s, m, q, 1000 * m // q)
                else:
                    best = (None,) * 4
                listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs.tolist())
                kept = b" ".join(words)
                rows.append((len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                if with_text:
                    lists.append(runs.tolist())
                    kept_texts.append(kept.decode())
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.string()) for i in range(7))]
            names = [id_col, *(c.split()[0] for c in SCHEMA.split(", "))]
            if with_text:
                columns += [pa.array(kept_texts, pa.string()), pa.array(lists, pa.list_(pa.list_(pa.int64())))]
                names += ["collapsed", "runs"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    more = ", collapsed string, runs array<array<long>>" if with_text else ""
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}{more}")
