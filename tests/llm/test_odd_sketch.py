"""Near duplicates against brute force, and the sketches against exact similarities."""

import random

import numpy as np
import pytest

from cadenza.llm import odd_sketch
from tests.llm.test_llm import SCHEMA, brute_components, corpus


def got(df, k, num, den):
    return sorted((tuple(r) for r in odd_sketch.near_duplicates(df, k, num, den).collect()), key=str)


def expected(rows, k, num, den):
    return sorted(((i, n, c, i == c) for i, n, c, _ in brute_components(rows, k, num, den)), key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(5, 85, 100), (5, 4, 5)])
def test_near_duplicates(spark, k, num, den):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    assert got(docs, k, num, den) == expected(corpus(), k, num, den)
    assert odd_sketch.near_duplicates(docs.limit(0), k, num, den).count() == 0


def test_near_duplicates_in_groups(spark, monkeypatch):
    """Groups of near copies at all distances, in small chunks, so that buckets are left open and every step has work."""
    monkeypatch.setattr(odd_sketch, "CHUNK", 5)
    rng = random.Random(4)
    bases = [[f"w{g}x{i}" for i in range(90)] for g in range(2)]
    bases.append([*bases[0][:80], *(f"v{i}" for i in range(10))])
    rows = []
    for i in range(150):
        words = list(bases[i % 3])
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            words[rng.randrange(90)] = f"x{rng.random()}" if i % 2 else f"y{rng.randrange(3)}"
        rows.append((i, " ".join(words[: rng.choice((90, 90, 88, 80))])))
    steps, real = [], odd_sketch.NearCopies.confirmed
    monkeypatch.setattr(odd_sketch.NearCopies, "confirmed", lambda self, pairs, sets: steps.append(found := real(self, pairs, sets)) or found)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, 5, 85, 100) == expected(rows, 5, 85, 100)
    assert len(steps) == 1


def test_doubtful_pairs_alone(spark, monkeypatch):
    """With no pair found by the nearest sketches, the comparison of chunks finds all links."""
    monkeypatch.setattr(odd_sketch, "CHUNK", 5)
    monkeypatch.setattr(odd_sketch.NearCopies, "nearest_hubs", lambda self, buckets, classes: classes.sparkSession.createDataFrame([], "a long, b long"))
    rows = [(i, " ".join(f"w{j}" if (j * 7 + i * 13) % 120 else f"x{i % 4}" for j in range(100 + i % 5))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 5, 85, 100) == expected(rows, 5, 85, 100)


def test_sketches_tell_similarities():
    """Sets at the threshold stay within the limit; unlike ones lie beyond it."""
    rng, sketches = np.random.default_rng(3), odd_sketch.Sketches(85, 100)
    pairs = {s: [] for s in (0.85, 0.95, 0.5)}
    for s, out in pairs.items():
        for _ in range(200):
            n = 600
            same = round(s * 2 * n / (1 + s))
            x = rng.integers(0, 1 << 63, 2 * n - same, np.uint64)
            _, odd = sketches.of([np.sort(x[:n]), np.sort(x[n - same :])])
            out.append(int(odd_sketch.distances(odd[:1].view(np.uint64), odd[1:].view(np.uint64))[0, 0]))
    assert max(pairs[0.85]) <= sketches.limit < np.percentile(pairs[0.5], 10)
    assert np.mean(pairs[0.95]) < np.mean(pairs[0.85]) / 2
