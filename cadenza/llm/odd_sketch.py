"""Near duplicates by MinHash in bands, judged by odd sketches and confirmed on full sets.

Each different set of word shingles gets samples (MinHash values). Bands of samples give the candidates: sets with one band in
common share a bucket. The samples are also folded into an odd sketch, a small bitmap that holds the parity of the samples
that fall on each bit; the bits in which two sketches differ tell how many samples differ, precisely so where few do. No pairs of a bucket are listed:

1. every set meets one hub of each of its buckets, the sketches choose the nearest, and that pair is checked on the full sets;
2. in buckets that the links so far leave in several components, members meet in chunks, sketch by sketch inside a task; what
   is one component already is left out;
3. what is apart there, though its sketches are near enough for a link, is compared on the full sets, in chunks.

A link is missed if its sets share no band (1 in 10^8 at the threshold, less above) or if their sketches are farther apart than the
limit, which lies about six standard deviations out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, used_up
from .components import components
from .set_join import BITS, SetJoin, class_id, n_tasks, planes
from .shingles import U, mix, shingle_sets

#: Samples of a band; the share of links at the threshold that may share no band; 64-bit words of a sketch.
ROWS, MISS, WORDS = 6, 1e-8, 16
#: Shingles sampled together; members of a chunk, and shingles they may have; sets a task remembers.
SAMPLED, CHUNK, CHUNK_SHINGLES, KEEP = 1 << 17, 512, 1 << 20, 1 << 20


class Sketches:
    """The samples, bands and sketches for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        s = num / den
        self.bands = max(1, math.ceil(math.log(MISS) / math.log1p(-(s**ROWS)))) if s < 1 else 1
        self.samples = self.bands * ROWS
        rng = np.random.default_rng(12)
        self.xor, self.factor = rng.integers(0, 1 << 64, self.samples, np.uint64), rng.integers(0, 1 << 64, self.samples, np.uint64) | U(1)
        self.row = rng.integers(0, 1 << 64, ROWS, np.uint64) | U(1)
        bits, differ = 64 * WORDS, self.samples * (1 - s) + 6 * math.sqrt(self.samples * s * (1 - s)) + 1
        odd = bits * (1 - (1 - 2 / bits) ** (2 * differ)) / 2
        #: Bits in which the sketches of two sets that link may differ.
        self.limit = math.ceil(odd + 3 * math.sqrt(odd))

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(keys of the bands, sketches), a row for each set; no set is empty."""
        value, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        least = np.empty((len(sets), self.samples), np.uint64)
        for i in range(self.samples):
            least[:, i] = np.minimum.reduceat((value ^ self.xor[i]) * self.factor[i], at)
        place = np.arange(1, self.samples + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        keys = mix((least.reshape(len(sets), self.bands, ROWS) * self.row).sum(2, dtype=np.uint64) + place[: self.bands])
        bit = (mix(least ^ mix(place)) % U(64 * WORDS)).astype(np.int64) + np.arange(len(sets))[:, None] * 64 * WORDS
        odd = (np.bincount(bit.ravel(), minlength=len(sets) * 64 * WORDS) & 1).astype(np.uint8)
        return keys.view(np.int64), np.packbits(odd).view(np.int64).reshape(len(sets), WORDS)


def signed(texts: DataFrame, k: int, sketches: Sketches) -> DataFrame:
    """(id, n, sid) of each row of texts; keys and odd go with the first row that a task meets of each set."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            size, sids, new, wait, made = [], [], [], [], [(np.zeros((0, sketches.bands), np.int64), np.zeros((0, WORDS), np.int64))]
            for s in shingle_sets(batch.column(1), k):
                size.append(len(s))
                sids.append(class_id(s) if len(s) else None)
                new.append(len(s) > 0 and sids[-1] not in seen)
                if new[-1]:
                    if len(seen) >= KEEP:
                        seen.clear()
                    seen.add(sids[-1])
                    wait.append(s)
                    if sum(map(len, wait)) >= SAMPLED or len(wait) >= 1024:
                        made.append(sketches.of(wait))
                        wait = []
            if wait:
                made.append(sketches.of(wait))
            given, lists = np.array(new, bool), []
            for x in map(np.concatenate, zip(*made, strict=True)):
                ends = np.r_[0, np.cumsum(given * x.shape[1])].astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()), mask=pa.array(~given)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sids, pa.int64()), *lists], names=["id", "n", "sid", "keys", "odd"])

    return texts.mapInArrow(run, f"id {texts.schema[0].dataType.simpleString()}, n long, sid long, keys array<long>, odd array<long>")


def full_sets(texts: DataFrame, k: int, needed: DataFrame) -> DataFrame:
    """(sid, n, members) of the sets needed: (sid, least) with the least id of a row that has the set. Only rows whose id may be
    one of those are shingled anew."""
    needed = cut(needed)
    bits = bloom.size_for(needed.count())
    table = bloom.words(needed.select(F.xxhash64("least").alias("key")), "key", bits)
    flagged = bloom.flag(texts.withColumn("key", F.xxhash64("id")), "key", table, bits, "may").filter("may").select("text")

    def run(batches):
        for batch in batches:
            sids, size, members = [], [], []
            for s in shingle_sets(batch.column(0), k):
                if len(s):
                    sids.append(class_id(s))
                    s = s >> U(64 - BITS)
                    s = s[np.r_[True, s[1:] != s[:-1]]]
                    size.append(len(s))
                    members.append(planes(s))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(size, pa.int64()), pa.array(members, pa.binary())], names=["sid", "n", "members"])

    return flagged.mapInArrow(run, "sid long, n long, members binary").join(needed.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each sketch of x differs from each of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for w in range(WORDS):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


class NearCopies:
    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.sketches, self.exact = Sketches(num, den), SetJoin(k, num, den)

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets link."""
        met = self.exact.overlaps(pairs, sets)
        return cut(met.filter(F.col("common") * self.den >= (F.col("na") + F.col("nb") - F.col("common")) * self.num).select("a", "b"))

    def nearest_hubs(self, buckets: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b): each set b with the hub a, of those of its buckets, whose sketch is nearest, if it is near enough."""
        pairs = buckets.filter("sid <> hub").select("hub", "sid").distinct()
        hub, one = classes.select(F.col("sid").alias("hub"), F.col("n").alias("m"), F.col("odd").alias("other")), classes.select("sid", "n", "odd")
        both = pairs.join(hub, "hub").join(one, "sid")
        differ = sum(F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("other")[i])) for i in range(WORDS))
        near = both.select("sid", "hub", "n", "m", differ.alias("d")).filter((F.col("d") <= self.sketches.limit) & (F.least("n", "m") * self.den >= F.greatest("n", "m") * self.num))
        best = near.groupBy("sid").agg(F.min(F.struct("d", F.xxhash64("hub").alias("h"), "hub")).alias("best"))
        return best.select(F.col("best.hub").alias("a"), F.col("sid").alias("b"))

    def meetings(self, buckets: DataFrame, joined: DataFrame, classes: DataFrame) -> DataFrame:
        """(i, j, side, bucket, sid, comp, n, odd, keys): the chunks of buckets that hold several components, two and two; side 0
        is chunk i. Chunks of the component that most of a bucket belongs to don't meet each other."""
        placed = buckets.select(F.col("key").alias("bucket"), "sid").join(joined, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        placed = placed.join(classes.select("sid", "n"), "sid")
        parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
        several = parts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        fill = F.greatest(F.col("c") / CHUNK, F.col("m") / CHUNK_SHINGLES)
        parts = parts.join(several.select("bucket", F.col("top.comp").alias("top")), "bucket").withColumn("own", F.when(fill > 0.5, F.ceil(fill).cast("int")).otherwise(0))
        mixed = parts.filter("own = 0").groupBy("bucket").agg(F.ceil(F.greatest(F.sum("c") / CHUNK, F.sum("m") / CHUNK_SHINGLES)).cast("int").alias("mixed"))
        parts = cut(parts.join(mixed, "bucket", "left").select("bucket", "comp", "top", "own", "mixed"))
        pure = F.col("own") > 0
        chunk = F.when(pure, F.xxhash64("bucket", "comp", F.pmod(F.xxhash64("sid"), F.col("own")))).otherwise(F.xxhash64("bucket", F.pmod(F.xxhash64("comp"), F.col("mixed")), F.lit("mixed")))
        held = cut(placed.join(parts, ["bucket", "comp"]).select("bucket", "sid", "comp", "n", F.when(pure, F.col("comp")).alias("pure"), (pure & (F.col("comp") == F.col("top"))).alias("most"), chunk.alias("chunk")))
        chunks = cut(held.select("bucket", "chunk", "pure", "most").distinct())
        x, y = chunks.filter("not most").alias("x"), chunks.alias("y")
        apart = F.col("x.pure").isNull() | F.col("y.pure").isNull() | (F.col("x.pure") != F.col("y.pure"))
        pairs = x.join(y, F.col("x.bucket") == F.col("y.bucket")).filter(apart & (F.col("y.most") | (F.col("x.chunk") <= F.col("y.chunk")))).select(F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j"))
        sides = pairs.select("i", "j", F.col("i").alias("chunk"), F.lit(0).alias("side")).unionByName(pairs.filter("i <> j").select("i", "j", F.col("j").alias("chunk"), F.lit(1).alias("side")))
        members = held.select("bucket", "chunk", "sid", "comp", "n").join(classes.select("sid", "odd", "keys"), "sid")
        n = n_tasks(classes)
        return sides.join(members, "chunk").select("i", "j", "side", "bucket", "sid", "comp", "n", "odd", "keys").repartition(n, "i", "j").sortWithinPartitions("i", "j", "side")

    def met(self, meetings: DataFrame, found, schema: str) -> DataFrame:
        """What found(i, j, x, y, near) gives for each meeting: x and y are lists of (bucket, sid, comp, n, odd, keys), y is x where a
        chunk meets itself, and near tells which are of two components, of sizes and sketches that allow a link."""
        num, den, limit = self.num, self.den, self.sketches.limit
        names = [c.split()[0] for c in schema.split(", ")]

        def judged(key, sides):
            x, y = sides[0], sides[0] if key[0] == key[1] else sides[1]
            if not x or not y:
                return []
            column = lambda c: (np.array([r[c] for r in x]), np.array([r[c] for r in y]))
            (p, q), (n, m), (a, b) = column(2), column(3), column(4)
            d = distances(a, b)
            near = (d <= limit) & (p[:, None] != q[None, :]) & (np.minimum(n[:, None], m[None, :]) * den >= np.maximum(n[:, None], m[None, :]) * num)
            return found(*key, x, y, near, d) if near.any() else []

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

        def run(batches):
            key, sides = None, ([], [])
            for batch in batches:
                out = []
                for i, j, side, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (i, j) != key:
                        if key is not None:
                            out += judged(key, sides)
                        key, sides = (i, j), ([], [])
                    sides[side].append(rest)
                yield table(out)
            if key is not None:
                yield table(judged(key, sides))

        return meetings.mapInArrow(run, schema)

    def doubtful(self, meetings: DataFrame) -> DataFrame:
        """(i, j, chunk, sid): the members of two chunks that may link. A pair counts only in the first band that it shares."""

        def found(i, j, x, y, near, d):
            kx, ky = np.array([r[5] for r in x]), np.array([r[5] for r in y])
            bucket, left, right = x[0][0], np.zeros(len(x), bool), np.zeros(len(y), bool)
            for r in np.flatnonzero(near.any(1)):
                c = np.flatnonzero(near[r])
                same = ky[c] == kx[r]
                here = kx[r][same.argmax(1)] == bucket
                left[r] |= here.any()
                right[c[here]] = True
            if not left.any():
                return []
            base = int(mix(np.array([(i ^ (j * 3)) & (1 << 64) - 1], np.uint64)).view(np.int64)[0])
            one, two = base & ~1, base | 1
            if i == j:
                return [(one, one, one, x[r][1]) for r in np.flatnonzero(left | right)]
            return [(one, two, one, x[r][1]) for r in np.flatnonzero(left)] + [(one, two, two, y[r][1]) for r in np.flatnonzero(right)]

        return cut(self.met(meetings, found, "i long, j long, chunk long, sid long"))

    def run(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        facts = cut(signed(texts, self.k, self.sketches))
        rows = facts.select("id", "n", "sid")
        classes = cut(facts.filter("keys is not null").select("sid", "n", "keys", "odd").dropDuplicates(["sid"]))
        least = rows.filter("sid is not null").groupBy("sid").agg(F.min("id").alias("least"))

        bands = classes.select("sid", F.explode("keys").alias("key"))
        hubs = bands.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("sid", "key").alias("h"), "sid")).alias("hub")).filter("c > 1")
        buckets = cut(bands.join(hubs.select("key", F.col("hub.sid").alias("hub")), "key"))
        used_up()
        sets = cut(full_sets(texts, self.k, buckets.select("sid").distinct().join(least, "sid")))
        used_up()

        links = self.confirmed(self.nearest_hubs(buckets, classes), sets)
        used_up()
        joined = cut(components(links).toDF("sid", "comp"))
        used_up(links)
        rest = self.doubtful(self.meetings(buckets, joined, classes))
        used_up(buckets, classes)
        more = self.exact.compared(rest.select("i", "j").distinct(), rest.select("sid", "chunk", F.lit(1).alias("w")).distinct(), sets)
        links = cut(joined.select(F.col("comp").alias("a"), F.col("sid").alias("b")).union(more.filter("b is not null").select("a", "b")))
        used_up(sets, rest, joined)

        named = least.join(components(links).toDF("sid", "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        low = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        answers = cut(named.join(low, "comp").select("sid", "component_id"))
        used_up(links)
        return rows.join(answers, "sid", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, n_shingles, component_id (the least id reachable over links, its own included) and kept
    (whether it is that id itself).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct k-word shingles, or the whole sequence
    where there are fewer words. Sets link when den * intersection >= num * union. Null and empty texts link with nothing and
    are kept. Null ids don't count for the least id, unless a component has no other: then its rows are kept. Rows with
    the same id are as many rows. Sets are compared by 48 bits of their shingles' fingerprints (64 in n_shingles). Other columns
    are left out; an empty table gives no rows. df is read twice, and should come from a table or a checkpoint.
    """
    out = NearCopies(k, num, den).run(df, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
