"""Byte-level BPE by monoid tree reduction.

A piece of text is halved down to short leaves. Two encoded neighbours join by encoding a window around their boundary anew;
the window grows until the tokens outside it can't change: a sequence of tokens is the encoding of its bytes exactly when
each two neighbours, encoded together, give these two tokens again. Decoding joins bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LEAF = 24
#: Pieces whose tokens a task remembers; beyond that it starts afresh.
KEEP = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.seen: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The leaf case: always the pair of lowest rank, the leftmost of equals."""
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 2 * LEAF:
            return self._merge_long(parts)
        costs = [get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            best = min(costs)
            if best == 1 << 60:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same for a wide window, with a heap of pairs over a linked list."""
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive: list[bytes | None] = list(parts)
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            j = after[i]
            if alive[i] is None or j < 0 or len(alive[i]) + len(alive[j]) != size or get(alive[i] + alive[j]) != rank:
                continue
            alive[i], alive[j] = alive[i] + alive[j], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(alive[a] + alive[b])) is not None:
                    heapq.heappush(heap, (r, a, len(alive[a]) + len(alive[b])))
        return [x for x in alive if x is not None]

    def stable(self, a: bytes, b: bytes) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > KEEP:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        left = right = 1
        while True:
            i, j = max(0, len(a) - left), min(len(b), right)
            window = self.merge(b"".join([*a[i:], *b[:j]]))
            fits_left, fits_right = i == 0 or self.stable(a[i - 1], window[0]), j == len(b) or self.stable(window[-1], b[j])
            if fits_left and fits_right:
                return [*a[:i], *window, *b[j:]]
            left, right = left * (1 if fits_left else 2), right * (1 if fits_right else 2)

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else [self.ranks[t] for t in self.tree(raw)]

    def joined_ids(self, text: str) -> str:
        """The ids of a whole text in decimal, comma-joined. Each match of the pattern is encoded by itself."""
        seen, out = self.seen, []
        for piece in self.pattern.findall(text):
            ids = seen.get(piece)
            if ids is None:
                ids = ",".join(map(str, self.encode_piece(piece)))
                if len(piece) <= 64:
                    if len(seen) >= KEEP:
                        seen.clear()
                    seen[piece] = ids
            out.append(ids)
        return ",".join(out)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 16:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: its id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the ids' bytes).

    with_ids adds the ids themselves. A null text counts as empty: no tokens. Rows don't depend on each other: nothing
    shuffles, repeated rows come out as often, and any other columns are left out. The vocabulary is broadcast; its size is
    the file's. Halves need no order between them, so a very long text takes memory in proportion to itself only.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        bpe = TreeBPE(shared.value, pattern)
        for batch in batches:
            n, digests, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                joined = bpe.joined_ids(text or "")
                ids = list(map(int, joined.split(","))) if joined else []
                n.append(len(ids))
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
