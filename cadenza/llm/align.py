"""Alignment of the tokens of two tokenizers, by a monoid of fragments, and how often the tokens of each pair meet in the corpus.

Both tokenizers cut " " + text. Where tokens of both end at one byte, a group ends. A fragment is what a byte range knows of the
groups: the tokens up to its first common end (open prefix), the closed groups, and the tokens after its last common end (open
suffix). Fragments of neighbouring ranges compose, in any bracketing: suffix and prefix make one group more. Words are closed
fragments, encoded once and remembered; a short text is their product. A very long text is cut into byte ranges, whose
fragments are made and composed up a tree by Spark tasks.

A word, here, is a space with what follows it up to the next such space: neither tokenizer has tokens across its ends, as no
piece of the second's vocabulary goes on from another character to a space (checked when it is loaded), and the first splits
texts there. Pairs of tokens are counted in blocks of texts: each block sends its different pairs to buckets by the second
token, which sum them up, and gets back their counts.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import zlib
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .set_join import n_tasks, pa_type
from .shingles import U, mix

#: Bytes of a range of a long text; fragments composed at once; tokens and texts of a block; words a task remembers, and their characters;
#: words encoded together.
RANGE, FAN, BLOCK, MOST, KEEP, HELD, TOGETHER = 1 << 15, 8, 1 << 20, 1 << 15, 300_000, 1 << 24, 1 << 12
SPACE = "▁"
#: A pair of token ids is one number: the first id above, the second in the lower bits.
LOW = 16


def byte_of() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@dataclass
class Fragment:
    """Tokens of a byte range, as lists of ids. Without a common end (cut is False) all of them are in `prefix`."""

    prefix: tuple[list[int], list[int]]
    cut: bool = False
    sizes: tuple[int, int, int] = (0, 0, 0)  # tokens of both, groups
    text: list[str] = field(default_factory=list)
    links: dict[int, int] = field(default_factory=dict)
    suffix: tuple[list[int], list[int]] = ((), ())


class Aligner:
    """first: the text of a tokenizers file, of a byte-level BPE whose merges stand in the order of ids, as its ids are then ranks and tiktoken
    gives the same tokens many times as fast; second: a sentencepiece model."""

    def __init__(self, first: str, second: bytes):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        vocabulary, to = json.loads(first)["model"], byte_of()
        special = {t["id"] for t in json.loads(first).get("added_tokens", [])}
        read = {t: bytes(to[c] for c in t) for t, i in vocabulary["vocab"].items() if i not in special}
        merged = [vocabulary["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in vocabulary["merges"]]
        if merged != sorted(merged):
            raise ValueError("the first vocabulary's ids are not in the order of its merges")
        ranks = {b: vocabulary["vocab"][t] for t, b in read.items()}
        self.a = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=second)
        self.bytes_a = [b""] * (max(vocabulary["vocab"].values()) + 1)
        for b, i in ranks.items():
            self.bytes_a[i] = b
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of the second vocabulary goes on over a word's start")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = [*map(len, self.bytes_a)], [*map(len, self.bytes_b)]
        self.sizes_a, self.sizes_b = np.array(self.len_a), np.array(self.len_b)
        self.printed = [f"{i}{c}" for n, signs in ((len(self.len_a), ",|"), (len(self.len_b), ",;\n")) for c in signs for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.links, self.sizes, self.held = array("I"), array("q"), 0  # of all words; tokens of both, groups (0 where the bytes differ), links

    def joined(self, a: list[int], b: list[int]) -> tuple[str, int, list[int]]:
        """(groups as text, how many, linked pairs in order) of tokens that begin and end together."""
        len_a, len_b = self.len_a, self.len_b
        i = j = end_a = end_b = x = y = 0
        out, links = [], []
        end_a, end_b = len_a[a[0]], len_b[b[0]]
        while True:
            links.append(a[i] << LOW | b[j])
            if end_a == end_b:
                i, j = i + 1, j + 1
                out.append(f"{','.join(map(str, a[x:i]))}|{','.join(map(str, b[y:j]))}")
                if i == len(a):
                    return ";".join(out), len(out), links
                x, y, end_a, end_b = i, j, end_a + len_a[a[i]], end_b + len_b[b[j]]
            elif end_a < end_b:
                i += 1
                end_a += len_a[a[i]]
            else:
                j += 1
                end_b += len_b[b[j]]

    def learn(self, words: list[str]) -> None:
        """Encodes words and remembers their closed fragments, numbered on. Those that can follow each other are encoded as one text."""
        alone = [w for w in words if not w or w[0].isspace() or w[-1] == " "]
        plain = [w for w in words if w and not w[0].isspace() and w[-1] != " "] if alone else words
        for part in [*(plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)), *([w] for w in alone)]:
            self.encode(part)

    def encode(self, words: list[str]) -> None:
        """Words that follow each other as a text. Where bytes get lost, or a word's end isn't one of both tokenizers, halves are tried, so that
        in the end such a word is by itself; it then has no groups."""
        text = " ".join(words)
        a, raw = self.a.encode_ordinary(" " + text), (" " + text).encode()
        b = [*chain.from_iterable(self.b.encode([" ".join(words[i : i + 64]) for i in range(0, len(words), 64)], num_threads=1))]  # short texts go faster
        lengths = [len(w) for w in words] if len(raw) == len(text) + 1 else [len(w.encode()) for w in words]
        ends = np.cumsum(np.array(lengths) + 1)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
        sizes, texts, links = np.zeros((len(words), 4), np.int64), [""] * len(words), np.zeros(0, np.int64)
        if same:
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
            same = np.isin(ends, end_a).all() and np.isin(ends, end_b).all()
        if same:
            for i, x in enumerate((end_a, end_b)):
                sizes[:, i] = np.bincount(np.searchsorted(ends, x), minlength=len(ends))
            texts, sizes[:, 2], sizes[:, 3], links = self.aligned(a, b, end_a, end_b, ends)
        elif len(words) > 1:
            half = len(words) // 2
            self.encode(words[:half])
            self.encode(words[half:])
            return
        self.known.update(zip(words, range(len(self.texts), len(self.texts) + len(words)), strict=True))
        self.texts += texts
        self.sizes.frombytes(sizes.tobytes())
        self.links.frombytes(links.astype(np.uint32).tobytes())
        self.held += len(text)

    def aligned(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of words one after another, which end at `ends`: (text of the groups, their number, number of links) of each, and the links."""
        every, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        links = a[np.searchsorted(end_a, every)] << LOW | b[np.searchsorted(end_b, every)]
        of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        many_a, many_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        last = lambda of: np.r_[of[1:] != of[:-1], True].astype(np.int64)
        closes = (ends[np.searchsorted(ends, end_b)] == end_b).astype(np.int64)
        n_a, n_b = len(self.sizes_a), len(self.sizes_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[of_a]] = a + n_a * last(of_a)
        codes[np.arange(len(b)) + np.cumsum(many_a)[of_b]] = 2 * n_a + b + n_b * (last(of_b) + closes)
        texts = "".join(map(self.printed.__getitem__, codes.tolist())).split("\n")[:-1]
        count = lambda x: np.bincount(np.searchsorted(ends, x), minlength=len(ends))
        return texts, count(common), count(every), links

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's words; none for an empty text or one that has the second vocabulary's sign for a space."""
        if len(self.known) > KEEP or self.held > HELD:
            self.forget()
        split = [[] if not t or SPACE in t else words_of(t) for t in texts]
        self.learn([*(set().union(*split) - self.known.keys())])
        number = self.known.__getitem__
        return [[*map(number, words)] for words in split]

    def ids(self, numbers: list[int]) -> list[np.ndarray]:
        """The ids of both tokenizers of a text of words."""
        groups = [g.split("|") for g in ";".join([self.texts[w] for w in numbers]).split(";")]
        return [np.array(",".join([g[side] for g in groups]).split(","), np.int64) for side in (0, 1)]

    def fragment(self, a: list[int], b: list[int], lead: int) -> Fragment:
        """Of the tokens that end in a range; the second's begin `lead` bytes after the first's."""
        ends = [np.cumsum([n[i] for i in ids], dtype=np.int64) for n, ids in ((self.len_a, a), (self.len_b, b))]
        _, i, j = np.intersect1d(ends[0], ends[1] + lead, assume_unique=True, return_indices=True)
        if not len(i):
            return Fragment((a, b))
        p, q, r, s = i[0] + 1, j[0] + 1, i[-1] + 1, j[-1] + 1
        out = Fragment((a[:p], b[:q]), True, suffix=(a[r:], b[s:]))
        return self.add(out, a[p:r], b[q:s])

    def add(self, out: Fragment, a: list[int], b: list[int]) -> Fragment:
        """Adds closed groups at the end of `out`."""
        if a:
            text, n, links = self.joined(a, b)
            out.text.append(text)
            out.sizes = _plus(out.sizes, (len(a), len(b), n))
            for k in links:
                out.links[k] = out.links.get(k, 0) + 1
        return out

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        if not x.cut:
            return Fragment(_both(x.prefix, y.prefix), y.cut, y.sizes, y.text, y.links, y.suffix)
        if not y.cut:
            x.suffix = _both(x.suffix, y.prefix)
            return x
        self.add(x, *_both(x.suffix, y.prefix))
        x.sizes, x.suffix = _plus(x.sizes, y.sizes), y.suffix
        x.text += y.text
        for k, n in y.links.items():
            x.links[k] = x.links.get(k, 0) + n
        return x

    def whole(self, x: Fragment) -> Fragment:
        """A whole text's fragment: its prefix is a group, too."""
        return self.compose(Fragment(([], []), True), x)


def _plus(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int, int]:
    return x[0] + y[0], x[1] + y[1], x[2] + y[2]


def _both(x: tuple, y: tuple) -> tuple[list[int], list[int]]:
    return [*x[0], *y[0]], [*x[1], *y[1]]


#: A space that is followed by white space or the end.
ODD = re.compile(r" (?:\s|\Z)")


def words_of(text: str) -> list[str]:
    """The text, cut before each single space that a character other than white space follows; those spaces left out."""
    out = text.split(" ")
    if text[:1] != " " and not ODD.search(text):
        return out
    done = [out[0]]
    for w in out[1:]:
        if not w or w[0].isspace() or done[-1][-1:] in ("", " "):
            done[-1] += " " + w
        else:
            done.append(w)
    return done


_ready: dict[bytes, Aligner] = {}


def aligner(files: tuple[str, bytes]) -> Aligner:
    """One for each worker."""
    key = hashlib.sha256(files[1] + files[0].encode()).digest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = Aligner(*files)
    return _ready[key]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel().astype(np.int64)


COLUMNS = ["goes", "block", "bucket", "payload", "ids"]


class Counts:
    """Counts pairs over all blocks. A block's rows: one with what it keeps (bucket -1), and one for each bucket of its pairs."""

    def __init__(self, kind: pa.DataType, id_kind: str, buckets: int):
        self.kind, self.buckets = kind, buckets
        self.schema = f"goes int, block long, bucket int, payload binary, ids array<{id_kind}>"

    def rows(self, block: int, ids: list, facts: list[tuple], doc: np.ndarray, part: np.ndarray, size: np.ndarray, keys: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
        """facts: (n_a, n_b, n_groups, digest) of each text; doc and part: each text's parts, in order of texts, repeated; size: how many
        different pairs each part has, keys and often: these pairs, and how often they are there, part after part."""
        both, times = np.unique(doc.astype(np.int64) << 32 | part, return_counts=True)
        doc, part = both >> 32, both & 0xFFFFFFFF
        uses = np.zeros(len(size), np.int64)
        np.add.at(uses, part, times)
        pairs, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at, often * np.repeat(uses, size))
        bucket = (mix((pairs & ((1 << LOW) - 1)).astype(np.uint64)) % U(self.buckets)).astype(np.int64)
        order = np.lexsort((pairs, bucket))
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        pairs, total, cuts = pairs[order], total[order], np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        steps = np.diff(part, prepend=0) + (1 << 32)  # parts rise within a text; what falls between texts stays positive
        head = pickle.dumps((facts, *map(packed, (doc, steps, times, size, place[at], often)), len(pairs), cuts), 5)
        used = [b for b in range(self.buckets) if cuts[b] < cuts[b + 1]]
        payload = [head, *(pickle.dumps([packed(np.diff(pairs[cuts[b] : cuts[b + 1]], prepend=0)), packed(total[cuts[b] : cuts[b + 1]])], 5) for b in used)]
        columns = [pa.array([block % self.buckets, *used], pa.int32()), pa.array([block] * len(payload), pa.int64()), pa.array([-1, *used], pa.int32()), pa.array(payload, pa.binary()), pa.array([ids] + [None] * len(used), pa.list_(self.kind))]
        return pa.RecordBatch.from_arrays(columns, names=COLUMNS)

    @staticmethod
    def summed(batches):
        """Sums the buckets' counts; each block gets back its pairs' counts, and which are the highest of their second token."""
        blocks, keys, counts = [], [], []
        for batch in batches:
            schema = batch.schema
            own = np.asarray(batch.column(2).to_numpy()) < 0
            if own.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(own)) for c in batch.columns], schema=schema)
            for i in np.flatnonzero(~own).tolist():
                k, n = pickle.loads(batch.column(3)[i].as_py())  # noqa: S301
                blocks.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
                keys.append(np.cumsum(unpacked(k)))
                counts.append(unpacked(n))
        if not blocks:
            return
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        second, of = np.unique(every & ((1 << LOW) - 1), return_inverse=True)
        highest = np.zeros(len(second), np.int64)
        np.maximum.at(highest, of, total)
        back = total << 1 | (total == highest[of])
        ends = np.cumsum([0, *map(len, keys)])
        for i in range(0, len(blocks), 64):
            part = blocks[i : i + 64]
            payload = [packed(back[at[ends[i + k] : ends[i + k + 1]]]) for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([pa.array([b % (1 << 31) for b, _ in part], pa.int32()), pa.array([b for b, _ in part], pa.int64()), pa.array([k for _, k in part], pa.int32()), pa.array(payload, schema.field(3).type), pa.nulls(len(part), schema.field(4).type)], schema=schema)

    @staticmethod
    def answers(id_col: str):
        def done(head, ids, parts):
            facts, doc, steps, times, size, place, often, many, cuts = head
            doc, steps, times, size, place, often = map(unpacked, (doc, steps, times, size, place, often))
            part = np.cumsum(steps - (1 << 32))
            back = np.zeros(many, np.int64)
            for b, x in parts:
                back[cuts[b] : cuts[b + 1]] = x
            count, best = (back >> 1)[place] * often, (back & 1)[place] * often
            ends = np.r_[0, np.cumsum(size)]
            sums = []
            for x in (best, count):
                run = np.r_[0, np.cumsum(x)]
                out = np.zeros(len(facts), np.int64)
                np.add.at(out, doc, (run[ends[1:]] - run[ends[:-1]])[part] * times)
                sums.append(pa.array(out))
            a, b, g, digest = ([f[i] for f in facts] for i in range(4))
            n_links = [p + q - r for p, q, r in zip(a, b, g, strict=True)]
            columns = [ids, *(pa.array(x, pa.int64()) for x in (a, b, g, n_links)), *sums, pa.array(digest, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        def run(batches):
            block, head, ids, parts = None, None, None, []
            for batch in batches:
                for b, k, payload, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                    if k < 0:
                        if block is not None:
                            yield done(head, ids, parts)
                        block, head, ids, parts = b, pickle.loads(payload.as_py()), given.values, []  # noqa: S301
                    else:
                        parts.append((k, unpacked(payload.as_py())))
            if block is not None:
                yield done(head, ids, parts)

        return run


def _blocks(texts: DataFrame, files, counts: Counts, size: int) -> DataFrame:
    """Blocks of short texts; and of each long text (bucket -2) a row for each byte range, numbered in `goes`."""

    def run(batches):
        tool, base = aligner(files.value), TaskContext.get().partitionId() << 32
        made, most = 0, max(BLOCK, 1000 * counts.buckets)
        for batch in batches:
            column, i = batch.column(1), 0
            while i < len(column):  # some texts at a time
                texts, j, total = [], i, 0
                while j < len(column) and total < 1 << 22 and j - i < MOST:
                    texts.append(column[j].as_py() or "")
                    total += len(texts[-1])
                    j += 1
                numbers = [np.array(x, np.int64) for x in tool.numbers(texts)]
                sizes, links = np.array(tool.sizes, np.int64).reshape(-1, 4), np.array(tool.links, np.int64)
                starts = np.cumsum(sizes[:, 3]) - sizes[:, 3]
                fits = [len(x) > 0 and bool(sizes[x, 2].all()) for x in numbers]
                long = [f and len(t) * 4 > size and len(t.encode()) > size for f, t in zip(fits, texts, strict=True)]
                short = [r for r in range(len(texts)) if not long[r]]
                ids = batch.column(0).slice(i, j - i)
                for r in np.flatnonzero(long).tolist():
                    ranges = _ranges(tool, numbers[r], size)
                    payload = [pickle.dumps((len(ranges), x), 5) for x in ranges]
                    columns = [pa.array(range(len(ranges)), pa.int32()), pa.array([base + made] * len(ranges), pa.int64()), pa.array([-2] * len(ranges), pa.int32()), pa.array(payload, pa.binary()), pa.array([[ids[r].as_py()]] * len(ranges), pa.list_(counts.kind))]
                    yield pa.RecordBatch.from_arrays(columns, names=COLUMNS)
                    made += 1
                k = 0
                while k < len(short):
                    at, tokens = k, 0
                    while k < len(short) and (k == at or tokens < most):
                        tokens += int(sizes[numbers[short[k]], :2].sum())
                        k += 1
                    facts = []
                    for r in short[at:k]:
                        if fits[r]:
                            text = ";".join([tool.texts[w] for w in numbers[r].tolist()])
                            facts.append((*sizes[numbers[r], :3].sum(0).tolist(), hashlib.sha256(text.encode()).hexdigest()))
                        else:
                            facts.append((0, 0, 0, ""))
                    words = [numbers[r] if fits[r] else numbers[r][:0] for r in short[at:k]]
                    used, part = np.unique(np.concatenate(words), return_inverse=True)
                    size_of = sizes[used, 3]
                    held = links[np.repeat(starts[used] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())]
                    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
                    yield counts.rows(base + made, [ids[r].as_py() for r in short[at:k]], facts, doc, part, size_of, held, np.ones(len(held), np.int64))
                    made += 1
                i = j

    return texts.mapInArrow(run, counts.schema)


def _ranges(tool: Aligner, numbers: np.ndarray, size: int) -> list[tuple]:
    """(ids of both that end there, how much later the second's begin) of each byte range of a text."""
    ids = tool.ids(numbers.tolist())
    ends = [np.cumsum(n[x]) for n, x in zip((tool.sizes_a, tool.sizes_b), ids, strict=True)]
    n = -(-int(ends[0][-1]) // size)
    cuts = [np.searchsorted(e, np.arange(n + 1) * size, "right") for e in ends]
    out = []
    for r in range(n):
        begin = [int(e[c[r] - 1]) if c[r] else 0 for e, c in zip(ends, cuts, strict=True)]
        out.append((*(x[c[r] : c[r + 1]].astype(np.uint16).tobytes() for x, c in zip(ids, cuts, strict=True)), begin[1] - begin[0]))
    return out


def _tree(ranges: DataFrame, files, counts: Counts) -> DataFrame:
    """The long texts' blocks: fragments composed up a tree, FAN at a time, each step in as many tasks as there are groups."""
    rows = ranges.select("block", F.col("goes").alias("at"), "payload", "ids")
    many = ranges.agg(F.max("goes")).first()[0]
    many, first = (-1 if many is None else many) + 1, True
    schema = "block long, at int, payload binary, " + counts.schema.split(", ")[-1]

    def compose(leaf: bool):
        def run(batches):
            tool, key, fragment, ids = aligner(files.value), None, None, None

            def row():
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([pickle.dumps(fragment, 5)], pa.binary()), pa.array([ids], pa.list_(counts.kind))], names=["block", "at", "payload", "ids"])

            for batch in batches:
                for block, at, payload, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                    new = pickle.loads(payload.as_py())  # noqa: S301
                    if leaf:
                        _, (a, b, lead) = new
                        new = tool.fragment(np.frombuffer(a, np.uint16).tolist(), np.frombuffer(b, np.uint16).tolist(), lead)
                    if (block, at // FAN) != key:
                        if key is not None:
                            yield row()
                        key, fragment, ids = (block, at // FAN), new, given
                    else:
                        fragment = tool.compose(fragment, new)
            if key is not None:
                yield row()

        return run

    while many > 1 or first:
        up = F.floor(F.col("at") / FAN)
        rows = rows.repartition(n_tasks(ranges), "block", up).sortWithinPartitions("block", "at").mapInArrow(compose(first), schema)
        many, first = -(-many // FAN), False

    def finish(batches):
        tool = aligner(files.value)
        for batch in batches:
            for block, payload, ids in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                x = tool.whole(pickle.loads(payload.as_py()))  # noqa: S301
                text = ";".join(x.text)
                facts = [(*x.sizes, hashlib.sha256(text.encode()).hexdigest())]
                keys, often = np.array([*x.links.keys()], np.int64), np.array([*x.links.values()], np.int64)
                yield counts.rows(block, ids, facts, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(keys)]), keys, often)

    return rows.mapInArrow(finish, counts.schema)


def align(df: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE) -> DataFrame:
    """Per row: its id, n_a and n_b (tokens), n_groups, n_links (pairs of tokens whose bytes overlap), n_best (links whose pair
    meets as often as any of its second token, in all texts together), count_sum (of the links' counts) and groups_sha256.

    first: path of a byte-level BPE for the tokenizers library, see Aligner; second: of a sentencepiece model. Both are read by the
    driver and broadcast (a few MB, whatever the table). The digest is of `a1,a2|b1;a3|b2,b3`, the ids of each group. Null and
    empty texts, and texts that the second vocabulary can't give back byte by byte, have no tokens: zeros, and an empty digest.
    Texts longer than range_bytes are cut into ranges of that many. Repeated rows count as often as they are there; other columns are left out; an empty table gives no rows. The driver gets
    one number.
    """
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        files = df.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    texts = df.select(id_col, text_col)
    n = n_tasks(texts)
    counts = Counts(pa_type(texts), texts.schema[0].dataType.simpleString(), n)
    made = cut(_blocks(texts, files, counts, range_bytes))
    sent = made.filter("bucket > -2").unionByName(_tree(made.filter("bucket = -2"), files, counts))
    back = sent.repartition(n, "goes").mapInArrow(counts.summed, counts.schema).repartition(n, "block").sortWithinPartitions("block", "bucket")
    kind = texts.schema[0].dataType.simpleString()
    return back.mapInArrow(counts.answers(id_col), f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
