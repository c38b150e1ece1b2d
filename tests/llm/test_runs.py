"""Periodic runs against brute force: every lag and every place, on random, periodic and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import runs

SCHEMA = "doc_id long, text string, n_runs string, word int"


def plain_runs(words):
    """All maximal stretches of each period, less those with a smaller one."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts(seed=5):
    rng = random.Random(seed)
    word = lambda k: rng.choice("abcdefghij"[:k])
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a " * 300, "a b " * 6, "A a " * 9, "é ü " * 40, "x" * 5000]
    for _ in range(80):
        block = [word(rng.randint(1, 10)) for _ in range(rng.randint(1, 40))]
        out.append(" ".join([word(5) for _ in range(rng.randint(0, 30))] + block * rng.randint(1, 9) + block[: rng.randint(0, 40)] + [word(3) for _ in range(rng.randint(0, 30))]))
    out += [" ".join(word(2) for _ in range(400)) for _ in range(10)] + [" ".join("ab"[bin(i).count("1") % 2] for i in range(1024))]
    a, b = "a", "ab"
    while len(b) < 1000:
        a, b = b, b + a
    out += [" ".join(b), " ".join(str(i) for i in range(3000)), " ".join([*map(str, range(700))] * 3)]
    return out


def test_periodic_runs(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(texts())]
    rows += [(None, "a b c " * 9, None, None), rows[6], rows[6]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for plant in (False, True):
        got = sorted((tuple(r) for r in runs.periodic_runs(df, plant=plant).collect()), key=str)
        assert got == sorted((plain_row(i, t, plant) for i, t, *_ in rows), key=str)
    assert sum(r[2] is not None for r in got) > 50
    whole = runs.periodic_runs(df, with_text=True).filter("doc_id = 7").first()
    assert whole["collapsed"] == "a b" and whole["runs"] == [[0, 12, 2]]
    assert runs.periodic_runs(df.limit(0), with_text=True).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=150), st.integers(1, 6))
def test_runs_of_any_words(block, times):
    words = block * times
    assert [tuple(r) for r in runs.find_runs(np.array(words, np.int64)).tolist()] == plain_runs(words)


def test_runs_of_a_very_long_text():
    """A million equal words: the work grows with the text times the levels, not with its square."""
    assert runs.find_runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]
    assert runs.find_runs(np.arange(600_000) % 200_000).tolist() == [[0, 600_000, 200_000]]
