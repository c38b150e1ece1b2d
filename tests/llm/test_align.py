"""Alignments against whole texts cut by the two libraries, and pairs found by comparing every two tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cadenza.llm import align

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, ids int"


@pytest.fixture(scope="module")
def tool():
    return align.Aligner(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())


FIRST, SECOND = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
FIRST.encode_special_tokens = True


def plain(tool, text):
    """(tokens of both with their places, groups)."""
    if not text:
        return [], [], []
    a, b = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    if not b"".join(tool.bytes_a[i] for i in a) == (" " + text).encode() == b"".join(tool.bytes_b[i] for i in b):
        return [], [], []
    placed = []
    for ids, of in ((a, tool.bytes_a), (b, tool.bytes_b)):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(of[i])))
            at += len(of[i])
        placed.append(out)
    common = sorted({e for *_, e in placed[0]} & {e for *_, e in placed[1]})
    groups = [[[i for i, _, e in side if low < e <= high] for side in placed] for low, high in zip([0, *common], common, strict=False)]
    return *placed, groups


def expected(tool, rows):
    found, counts = [], Counter()
    for i, text, *_ in rows:
        a, b, groups = plain(tool, text)
        if len(a) > 2000:
            links, k = [], 0
            for x, s, e in a:  # the same in one sweep
                while k and b[k - 1][2] > s:
                    k -= 1
                while k < len(b) and b[k][1] < e:
                    links += [(x, b[k][0])] if b[k][2] > s else []
                    k += 1
        else:
            links = [(x, y) for x, s, e in a for y, p, q in b if s < q and p < e]
        counts.update(links)
        found.append((i, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, a, b, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest))
    return sorted(out, key=str)


def texts():
    rng = random.Random(6)
    words = ["thnation", "the", "of", "naïve", "ǅ", "日本語", "a\nb", "don't", "12345", "<s>", "<|endoftext|>", "<0x41>", "👍🏽", "ouble", "x" * 30, "\t", "", "  ", "\x00", "\x85", "\x1c", "…"]
    out = [None, "", " ", "a", " a", "a ", "a  b", "a\n b", "\n", "under▁score", "▁", "é" * 300, "x" * 5000, "ab" * 3000 + " " * 500 + "!" * 3000, "<s> </s> <unk> <|endoftext|>"]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + [" ".join(rng.choice(words) for _ in range(3000))]


@pytest.mark.parametrize("size", [align.RANGE, 7, 100])
def test_align(spark, tool, size):
    rows = [(i, t, "c", 1) for i, t in enumerate(texts())]
    if size == 7:
        rows = [r for r in rows if len(r[1] or "") < 500]
    rows += [(None, "null id", None, None), rows[20], rows[20]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in align.align(df, *FILES, range_bytes=size).collect()), key=str) == expected(tool, rows)
    assert align.align(df.limit(0), *FILES).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n▁1'é", max_size=60)))
def test_words_of_any_text(tool, text):
    """Words encoded one by one give the tokens of the whole text."""
    a, b, groups = plain(tool, text)
    (numbers,) = tool.numbers([text])
    sizes = [tool.sizes[4 * w : 4 * w + 4] for w in numbers]
    if not groups:
        assert not numbers or not all(s[2] for s in sizes)
    else:
        assert ";".join(tool.texts[w] for w in numbers) == ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        assert [sum(s[i] for s in sizes) for i in range(3)] == [len(a), len(b), len(groups)]
        assert [x.tolist() for x in tool.ids(numbers)] == [[i for i, *_ in a], [i for i, *_ in b]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab the\n1'é日", min_size=1, max_size=120), st.integers(1, 40), st.randoms())
def test_fragments_compose_in_any_order(tool, text, size, rng):
    a, b, groups = plain(tool, text)
    ends = [0, 0]
    parts = []
    for r in range(-(-len((" " + text).encode()) // size)):
        inside = [[(i, s, e) for i, s, e in side if r * size < e <= (r + 1) * size] for side in (a, b)]
        parts.append(tool.fragment([i for i, *_ in inside[0]], [i for i, *_ in inside[1]], ends[1] - ends[0]))
        ends = [x[-1][2] if x else e for x, e in zip(inside, ends, strict=True)]
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [tool.compose(*parts[i : i + 2])]
    done = tool.whole(parts[0])
    assert ";".join(done.text) == ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    assert done.sizes == (len(a), len(b), len(groups)) and sum(done.links.values()) == len(a) + len(b) - len(groups)
