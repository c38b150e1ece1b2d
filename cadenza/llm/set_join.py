"""Exact Jaccard self-join of shingle sets: classes, numbers of links, and the components of the links.

Every shingle is counted over all texts, exactly: each block of texts sends its distinct shingles, in buckets by value, to be
summed up, and gets back those that more than one text holds, with their counts. A set orders its shingles by these counts,
rarest first; sets that are similar enough share one of their first shingles, so only such shingles are listed, and only for
sets that have a shared one among their first.

Set relations then save most comparisons. In each list (a shingle, by size bands) the set with the least share of shingles of
its own is compared with the others, and a set joins the cluster of the nearest such hub. A cluster is kept in chunks by the
distance from its hub. By the triangle inequality of the Jaccard distance, the hub's answers give those of whole chunks: two
chunks that are near enough link in full, two that are too far apart are skipped, and only where the bounds leave doubt are
the members of one compared with those of the other, inside a task. Across clusters, lists are skipped through by blocks (the
sets of a cluster and size band in a list, with bounds of sizes and of what follows the shared position), and the distance of
the two hubs decides about chunks in the same way. No pairs of members are ever written, only how many links each has, and
chains of links that hold a component together.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, stars
from .shingles import U, shingle_sets

#: Bits of a shingle's fingerprint that are kept; shingles a block collects before it is sent; classes it may hold.
BITS, BLOCK, MOST = 48, 1 << 20, 65_535
#: Members of a chunk, and shingles they may hold; steps of distance from the hub that part chunks; columns compared at once.
CHUNK, CHUNK_SHINGLES, STEPS, COLUMNS = 512, 1 << 20, 20, 4096
EPS = 1e-9


def class_id(s: np.ndarray) -> int:
    """Fingerprint of a set, 64 bits."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def planes(x: np.ndarray) -> bytes:
    """48-bit numbers byte plane by byte plane: of sorted ones, the upper planes compress to nearly nothing."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T.tobytes()


def unplaned(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) * 8 // BITS, 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(b, np.uint8).reshape(BITS // 8, -1).T
    return out.view(np.uint64).ravel()


def n_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class SetJoin:
    """Sets of k-word shingles; two link when den * intersection >= num * union."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den

    def need(self, n: Column, m: Column) -> Column:
        """The least overlap of two sets of n and m that links them."""
        return F.ceil((n + m) * self.num / (self.num + self.den) - EPS)

    def band(self, n: Column) -> Column:
        """Sets that may link are in the same band of sizes or in neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / math.log(self.den / self.num) + EPS).cast("int")

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def _blocks(self, texts: DataFrame, buckets: int) -> DataFrame:
        """Blocks of texts: a row with what the block keeps to itself (bucket -1), and one for each bucket of its shingles."""
        edges = np.array([(i << BITS) // buckets for i in range(buckets)], np.uint64)
        kind, block_size = pa_type(texts), max(BLOCK, 200 * buckets)

        def rows(block: int, ids: list[pa.Array], place: list[int], size: list[int], sids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            lens = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([np.zeros(0, np.uint64), *sets])
            order = np.argsort(every, kind="stable")
            own, every = np.repeat(np.arange(len(sets)), lens).astype(np.uint16)[order], every[order]
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
            different, often = every[first], np.diff(np.r_[first, len(every)])
            cuts = np.r_[np.searchsorted(different, edges), len(different)]
            often = often.astype(np.uint16)
            head = pickle.dumps((np.array(place, np.int32), np.array(size, np.int64), np.array(sids, np.int64), lens, own, often, cuts), 5)
            used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            payload = [head, *(pickle.dumps((planes(different[cuts[b] : cuts[b + 1]]), often[cuts[b] : cuts[b + 1]].tobytes()), 5) for b in used)]
            return pa.RecordBatch.from_arrays([
                pa.array([block % buckets, *used], pa.int32()), pa.array([block] * len(payload), pa.int64()), pa.array([-1, *used], pa.int32()), pa.array(payload, pa.large_binary()),
                pa.array([pa.concat_arrays(ids).to_pylist()] + [None] * len(used), pa.list_(kind)),
            ], names=["goes", "block", "bucket", "payload", "ids"])

        def run(batches):
            made, ids, place, size, sids, sets, total = TaskContext.get().partitionId() << 32, [], [], [], [], [], 0
            known: dict[int, int] = {}
            for batch in batches:
                done = 0
                for r, full in enumerate(shingle_sets(batch.column(1), self.k)):
                    size.append(len(full))
                    if len(full):
                        s = full >> U(64 - BITS)
                        s = s[np.r_[True, s[1:] != s[:-1]]]
                        sid = class_id(full)
                        if sid not in known:
                            known[sid] = len(sids)
                            sids.append(sid)
                            sets.append(s)
                            total += len(s)
                        place.append(known[sid])
                    else:
                        place.append(-1)
                    if total >= block_size or len(sids) >= MOST or len(place) >= MOST:
                        ids.append(batch.column(0).slice(done, r + 1 - done))
                        yield rows(made, ids, place, size, sids, sets)
                        made, done, ids, place, size, sids, sets, total, known = made + 1, r + 1, [], [], [], [], [], 0, {}
                if done < batch.num_rows:
                    ids.append(batch.column(0).slice(done))
            if place:
                yield rows(made, ids, place, size, sids, sets)

        return texts.mapInArrow(run, f"goes int, block long, bucket int, payload binary, ids array<{texts.schema[0].dataType.simpleString()}>")

    @staticmethod
    def _shared(batches):
        """Sums the buckets' counts; each block gets back which of its shingles others hold too. Blocks' own rows pass on."""
        blocks, values, counts = [], [], []
        for batch in batches:
            own = np.asarray(batch.column(2).to_numpy()) < 0
            if own.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(own)) for c in batch.columns], schema=batch.schema)
            schema = batch.schema
            for i in np.flatnonzero(~own):
                value, often = pickle.loads(batch.column(3)[int(i)].as_py())  # noqa: S301
                blocks.append((batch.column(1)[int(i)].as_py(), batch.column(2)[int(i)].as_py()))
                values.append(unplaned(value))
                counts.append(np.frombuffer(often, np.uint16))
        if not blocks:
            return
        every, at = np.concatenate(values), np.cumsum([0, *map(len, values)])
        order = np.argsort(every, kind="stable")
        first = np.r_[True, every[order][1:] != every[order][:-1]]
        sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), np.flatnonzero(first))
        total = np.empty(len(every), np.int64)
        total[order] = sums[np.cumsum(first) - 1]
        for i in range(0, len(blocks), 64):
            part, payload = blocks[i : i + 64], []
            for k in range(i, i + len(part)):
                t = total[at[k] : at[k + 1]]
                shared = np.flatnonzero(t > 1)
                payload.append(pickle.dumps((shared.astype(np.uint32), planes(values[k][shared]), np.minimum(t[shared], (1 << 32) - 1).astype(np.uint32)), 5))
            none = pa.nulls(len(part), schema.field(4).type)
            yield pa.RecordBatch.from_arrays([pa.array([b % (1 << 31) for b, _ in part], pa.int32()), pa.array([b for b, _ in part], pa.int64()), pa.array([k for _, k in part], pa.int32()), pa.array(payload, schema.field(3).type), none], schema=schema)

    def _facts(self, batches, kind):
        """From each block: (id, n, sid) of its rows; and, without an id and with `members`, the classes that may link: sid,
        size, shared shingles, and the shingles to be listed under, whose positions follow the `alone` ones that no other text
        has."""
        names = ["id", "n", "sid", "alone", "tokens", "members"]
        types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.large_binary()]

        def table(m, **given):
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(m, t) for c, t in zip(names, types, strict=True)], names=names)

        def done(head, ids, parts):
            place, size, sids, lens, own, often, cuts = head
            often = often.astype(np.int64)
            yield table(len(place), id=ids, n=pa.array(size), sid=pa.array(np.append(sids, 0)[place], mask=place < 0))
            if not parts:
                return
            at = np.concatenate([cuts[b] + shared for b, shared, _, _ in parts])
            value, total = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            begin, m = np.cumsum(often) - often, often[at]
            owner = own[np.repeat(begin[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())].astype(np.int64)
            value, total = np.repeat(value, m), np.repeat(total, m)
            order = np.lexsort((value, total, owner))
            owner, value = owner[order], value[order]
            held = np.bincount(owner, minlength=len(sids))
            start, out = np.cumsum(held) - held, []
            for c in np.flatnonzero(held):
                n, alone = int(lens[c]), int(lens[c] - held[c])
                if alone < self.prefix(n):
                    mine = value[start[c] : start[c] + held[c]]
                    out.append((n, sids[c], alone, mine[: self.prefix(n) - alone].view(np.int64), planes(np.sort(mine))))
            for i in range(0, len(out), 2000):
                some = list(zip(*out[i : i + 2000], strict=True))
                yield table(len(some[0]), **{c: pa.array(x, t) for c, x, t in zip(names[1:], some, types[1:], strict=True)})

        block, head, ids, parts = None, None, None, []
        for batch in batches:
            for b, k, payload, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if k < 0:
                    if block is not None:
                        yield from done(head, ids, parts)
                    block, head, ids, parts = b, pickle.loads(payload.as_py()), given.values, []  # noqa: S301
                else:
                    shared, value, total = pickle.loads(payload.as_py())  # noqa: S301
                    if len(shared):
                        parts.append((k, shared.astype(np.int64), unplaned(value), total))
        if block is not None:
            yield from done(head, ids, parts)

    def facts(self, texts: DataFrame) -> DataFrame:
        """texts: (id, text), read once. Its rows, the classes that may link, and their lists; see _facts."""
        n, kind = n_tasks(texts), pa_type(texts)
        id_kind = texts.schema[0].dataType.simpleString()
        sent = self._blocks(texts, n).repartition(n, "goes")
        back = sent.mapInArrow(self._shared, sent.schema).repartition(n, "block").sortWithinPartitions("block", "bucket")
        return cut(back.mapInArrow(lambda batches: self._facts(batches, kind), f"id {id_kind}, n long, sid long, alone long, tokens array<long>, members binary"))

    def fits(self, x: str, y: str) -> Column:
        """Whether two listed sets can link, by their sizes and what follows their positions."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        near = F.least(n, m) * self.den >= F.greatest(n, m) * self.num
        return near & (F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) >= self.need(n, m))

    def overlaps(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, na, nb, common) of pairs of classes. A class a with many partners is met in as many places as there are
        tasks; each place gets its set once, and each partner's set."""
        n = n_tasks(pairs)
        pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(n)).cast("int").alias("salt"))
        left = pairs.select("a", "salt").distinct().join(sets.withColumnRenamed("sid", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "n", "members")
        right = pairs.join(sets.withColumnRenamed("sid", "b"), "b").select("a", "salt", "b", "n", "members")

        def run(batches):
            hub, size = None, 0
            for batch in batches:
                out = []
                for a, b, m, members in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                    s = unplaned(members.as_py())
                    if b is None:
                        hub, size = s, m
                    else:
                        out.append((a, b, size, m, in_both(hub, s)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["a", "b", "na", "nb", "common"])

        met = left.unionByName(right).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return met.mapInArrow(run, "a long, b long, na long, nb long, common long")

    def clusters(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """(sid, g, d): classes put into the cluster of a hub g, and their distance from it."""
        order = F.struct((F.col("alone") / F.col("n")).alias("share"), F.xxhash64("sid").alias("h"), "sid", "n", "pos")
        hubs = lists.groupBy("token", "band").agg(F.min(order).alias("p"), F.count("*").alias("listed")).filter("listed > 1")
        x, y = lists.alias("x"), hubs.select("token", "band", "p.share", "p.sid", "p.n", "p.pos").alias("y")
        pairs = x.join(y, ["token", "band"]).filter((F.col("x.sid") != F.col("y.sid")) & self.fits("x", "y")).groupBy(F.col("y.sid").alias("a"), F.col("x.sid").alias("b")).agg(F.min("y.share").alias("share"))
        near = self.overlaps(pairs, sets).filter(F.col("common") * 2 >= F.col("na") + F.col("nb") - F.col("common"))
        near = cut(near.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d")))
        roots = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        best = roots.groupBy(F.col("b").alias("sid")).agg(F.min(F.struct("d", F.xxhash64("a").alias("h"), F.col("a").alias("g"))).alias("m"))
        return best.select("sid", "m.g", "m.d")

    def compared(self, pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, gain): members of two chunks, compared with each other. A row without b says how many documents a gains by
        its links; the others are links that hold together what is linked. pairs: (i, j) of chunks, i <= j; members: (sid,
        chunk, w)."""
        sides = pairs.select("i", "j", F.col("i").alias("chunk"), F.lit(0).alias("side")).unionByName(pairs.filter("i < j").select("i", "j", F.col("j").alias("chunk"), F.lit(1).alias("side")))
        packed = members.join(sets, "sid").groupBy("chunk").agg(F.collect_list(F.struct("sid", "w", "n", "members")).alias("held"))  # a chunk's size is bounded
        rows = sides.join(packed, "chunk").select("i", "j", "side", "held")

        def links(x, y):
            n, m = np.array([s[2] for s in x]), np.array([s[2] for s in y])
            value = np.concatenate([s[3] for s in (*x, *y)])
            who = np.repeat(np.arange(len(x) + len(y)), [len(s[3]) for s in (*x, *y)])
            left = who < len(x)
            both = np.intersect1d(value[left], value[~left])
            common = np.zeros((len(x), len(y)), np.float32)
            spot = np.minimum(np.searchsorted(both, value), max(0, len(both) - 1))
            hit = both[spot] == value if len(both) else np.zeros(len(value), bool)
            spot, who = spot[hit], who[hit]
            for c in range(0, len(both), COLUMNS):
                now = (spot >= c) & (spot < c + COLUMNS)
                table = np.zeros((len(x) + len(y), min(COLUMNS, len(both) - c)), np.float32)
                table[who[now], spot[now] - c] = 1
                common += table[: len(x)] @ table[len(x) :].T
            return self.den * common.astype(np.int64) >= self.num * (n[:, None] + m[None, :] - common.astype(np.int64))

        def compare(key, sides):
            x, y = sides
            inner = key[0] == key[1]
            y = x if inner else y
            if not x or not y:
                return []
            link = links(x, y)
            if inner:
                np.fill_diagonal(link, False)
            wx, wy = np.array([s[1] for s in x]), np.array([s[1] for s in y])
            out = [(s[0], None, int(g)) for s, g in zip(x, link @ wy, strict=True) if g]
            out += [] if inner else [(s[0], None, int(g)) for s, g in zip(y, link.T @ wx, strict=True) if g]
            i, j = np.nonzero(link)
            ends = stars(np.array([s[0] for s in x])[i], np.array([s[0] for s in y])[j])
            out += [(a, b, None) for a, b in zip(*(e.tolist() for e in ends), strict=True)]
            return out

        def run(batches):
            key, sides = None, ([], [])
            for batch in batches:
                out = []
                for i, j, side, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (i, j) != key:
                        if key is not None:
                            out += compare(key, sides)
                        key, sides = (i, j), ([], [])
                    sides[side].extend((x["sid"], x["w"], x["n"], unplaned(x["members"])) for x in held)
                yield table(out)
            if key is not None:
                yield table(compare(key, sides))

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["a", "b", "gain"])

        met = rows.repartition(n_tasks(pairs), "i", "j").sortWithinPartitions("i", "j", "side")
        return met.mapInArrow(run, "a long, b long, gain long")

    def run(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        facts = self.facts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        rows = facts.filter("members is null").select("id", "n", "sid")
        sets = facts.filter("members is not null").select("sid", "n", "members").dropDuplicates(["sid"])
        lists = facts.filter("members is not null").select("sid", "n", "alone", F.posexplode("tokens").alias("at", "token"))
        lists = lists.select("token", "sid", "n", (F.col("alone") + F.col("at")).alias("pos"), "alone").dropDuplicates(["token", "sid"])
        lists = lists.withColumn("band", self.band(F.col("n")))
        zero, apart = F.lit(0).cast("long"), 1 - self.num / self.den

        classes = rows.filter("sid is not null").groupBy("sid").agg(F.count("*").alias("w"), F.min("id").alias("least"))
        listed = sets.select("sid", "n").join(classes, "sid").join(self.clusters(lists, sets), "sid", "left")
        listed = cut(listed.select("sid", "n", "w", "least", F.coalesce("g", "sid").alias("g"), F.coalesce("d", F.lit(0.0)).alias("d")))
        step = F.floor(F.col("d") * STEPS).cast("int")
        parts = listed.groupBy("g", step.alias("step")).agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("parts"))
        listed = listed.withColumn("step", step).join(cut(parts), ["g", "step"]).withColumn("chunk", F.xxhash64("g", "step", F.pmod(F.xxhash64("sid"), F.col("parts"))))
        listed = cut(listed.select("sid", "n", "w", "g", "d", "chunk"))
        chunks = cut(listed.groupBy("g", "chunk").agg(F.count("*").alias("size"), F.sum("w").alias("weight"), F.min("d").alias("near"), F.max("d").alias("far"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("sid").alias("first")))

        # clusters that meet in a list: blocks of lists by size band, skipped by sizes and positions
        blocks = lists.join(listed.select("sid", "g"), "sid").groupBy("token", "band", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"))
        several = blocks.groupBy("token").agg(F.min("g").alias("ga"), F.max("g").alias("gb")).filter("ga <> gb").select("token")
        blocks = cut(blocks.join(several, "token", "left_semi"))
        probe = blocks.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
        x, y = probe.alias("x"), blocks.alias("y")
        alike = lambda p, q: (F.col(f"{p}.high") * self.den >= F.col(f"{q}.low") * self.num) & (F.col(f"{q}.high") * self.den >= F.col(f"{p}.low") * self.num)
        can = (F.col("x.g") != F.col("y.g")) & alike("x", "y") & (F.least("x.rest", "y.rest") >= self.need(F.col("x.low"), F.col("y.low")))
        meet = x.join(y, ["token", "band"]).filter(can).select(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b")).distinct()
        hubs = self.overlaps(meet, sets).select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"), (F.col("common") * self.den >= (F.col("na") + F.col("nb") - F.col("common")) * self.num).alias("link"))

        # chunks of one cluster, and of two that meet: nearest and farthest that their members can be
        x, y = chunks.alias("x"), chunks.alias("y")
        ends = [F.col(f"{p}.{c}").alias(f"{c}_{p}") for p in "xy" for c in ("chunk", "size", "weight", "first")]
        ordered = (F.col("x.chunk") < F.col("y.chunk")) | ((F.col("x.chunk") == F.col("y.chunk")) & (F.col("x.size") > 1))
        far = F.col("x.far") + F.col("y.far")
        inner = x.join(y, F.col("x.g") == F.col("y.g")).filter(ordered & alike("x", "y")).select(
            F.greatest(F.col("x.near") - F.col("y.far"), F.col("y.near") - F.col("x.far"), F.lit(0.0)).alias("lo"), far.alias("hi"), F.lit(None).cast("boolean").alias("link"), *ends)
        z = hubs.alias("z")
        outer = z.join(x, F.col("z.a") == F.col("x.g")).join(y, F.col("z.b") == F.col("y.g")).filter(alike("x", "y")).select((F.col("z.d") - far).alias("lo"), (F.col("z.d") + far).alias("hi"), F.when(far == 0, F.col("z.link")).alias("link"), *ends)
        sure = F.coalesce("link", F.col("hi") <= apart - EPS)
        met = cut(inner.unionByName(outer).filter("link or link is null").filter(F.col("lo") <= apart + EPS).withColumn("sure", sure))
        doubtful = met.filter("not sure").select(F.least("chunk_x", "chunk_y").alias("i"), F.greatest("chunk_x", "chunk_y").alias("j"))
        found = cut(self.compared(doubtful, listed.select("sid", "chunk", "w"), sets))

        # whole chunks gain whole chunks; a chunk that links with itself gains itself less the member's own class
        whole = met.filter("sure")
        more = whole.select(F.col("chunk_x").alias("chunk"), F.col("weight_y").alias("more"), (F.col("chunk_x") == F.col("chunk_y")).alias("own"))
        more = more.unionByName(whole.filter("chunk_x <> chunk_y").select(F.col("chunk_y").alias("chunk"), F.col("weight_x").alias("more"), F.lit(False).alias("own")))
        more = more.groupBy("chunk").agg(F.sum("more").alias("more"), F.max(F.col("own").cast("int")).alias("own"))
        gains = found.filter("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("gain").alias("gain"))
        placed = cut(listed.join(more, "chunk", "left").join(chunks.select("chunk", "first"), "chunk").join(gains, "sid", "left"))
        extra = F.coalesce("more", zero) + F.coalesce("gain", zero) - F.when(F.col("own") == 1, F.col("w")).otherwise(zero)
        edges = found.filter("b is not null").select("a", "b").union(whole.select("first_x", "first_y")).union(placed.filter("more is not null").select("sid", "first"))
        named = placed.select("sid", extra.alias("extra")).join(components(edges).toDF("sid", "comp"), "sid", "left")
        named = classes.join(named, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        low = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        answers = cut(named.join(low, "comp").select("sid", "component_id", (F.col("w") - 1 + F.coalesce("extra", zero)).alias("n_links")))
        found = rows.join(answers, "sid", "left")
        return found.select("id", "n", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", zero).alias("n_links"))


def pa_type(texts: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(texts.schema[0].dataType)


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def jaccard_components(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, n_shingles, component_id (the least id reachable over links, its own included), and
    n_links (how many other rows it links with).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct k-word shingles, or the whole sequence
    where there are fewer words. Sets link when den * intersection >= num * union. Null and empty texts link with nothing.
    Null ids don't count for the least id, unless a component has no other; rows with the same id are as many rows.
    Shingles are told apart by 48 bits of a fingerprint (64 in n_shingles), sets by 64. Other columns are left out; an empty
    table gives no rows. df is read once, and should come from a table or a checkpoint: blocks of its rows go by their order.
    """
    out = SetJoin(k, num, den).run(df, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, with all its columns, less the rows whose component has a smaller id. Rows with a null id stay."""
    from .bloom import without

    found = jaccard_components(df, k, num, den, id_col, text_col)
    return without(df, id_col, found.filter(F.col("component_id") < F.col(id_col)), id_col)
