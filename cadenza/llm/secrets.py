"""Secret scans with DataFrame functions only: three fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Kinds in their order, their patterns, the group whose length counts, and the least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the entropy scan: whole runs of 20 such characters or more, tried once a run.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW, BITS_HEX, BITS_MIXED, BITS_CASES, BITS_LETTERS = 20, 2.9, 3.8, 3.6, 3.4
#: Allowed although they may look random: numbers with separators, lower-case words with a number, paths of words, one
#: character again and again, the alphabet. The word patterns are for runs with a digit; those without have limits of their own.
ALLOWED = r"^[0-9+/_=-]++$|^(.)\1++$|^(?i:abcdefghijklmnopqrstuvwxyz)++$"
ALLOWED_WORDS = r"^[a-z]+[0-9]{0,4}$|^[A-Z]?[a-z]*+(?:[/_=+-][A-Z]?[a-z]*+[0-9]{0,4}+)++$"
#: Words that tell of a sample; they are left out of a candidate, and what is left of it is judged.
SAMPLES = r"(?i)(?<![A-Za-z0-9])(?:example|sample|placeholder)s?(?![A-Za-z0-9])[+/_=-]*"
CONSONANTS = r"(?i)[b-df-hj-np-tv-xz]{8}"
#: Matches whose places are summed up together; characters of a candidate, and of a text, that are worked on together.
BLOCK, PIECE, PART = 256, 512, 4096
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _match_spans(text: Column, pattern: str, kind: int) -> tuple[Column, Column]:
    """(spans of all matches, the matches). Positions are running sums over the lengths of matches and of what lies between
    them, by blocks, so that work stays in proportion to the matches of a long text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lens = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))), found,
        lambda gap, m: F.struct(F.char_length(gap).cast("long").alias("gap"), F.char_length(m).cast("long").alias("m")),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(lens, b * BLOCK + 1, BLOCK))
    zero = F.lit(0).cast("long")
    totals = F.transform(blocks, lambda k: F.aggregate(k, zero, lambda a, x: a + x["gap"] + x["m"]))
    offsets = F.aggregate(totals, F.array(zero), lambda a, t: F.array_append(a, F.element_at(a, -1) + t))
    none = F.array().cast(SPANS)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        return F.struct((start + x["m"]).alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["m"]).alias("end"))).alias("out"))

    spans = F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), lambda k, o: F.aggregate(k, F.struct(o.alias("at"), none.alias("out")), step, lambda s: s["out"])))
    return spans, found


def window_entropy(s: Column) -> Column:
    """The largest Shannon entropy, in bits, of any WINDOW characters in a row of an ASCII string; below 0 for fewer.

    As the window moves on, the counts of the character that leaves and of the one that comes change, and with them the sum of
    c log2 c; nothing else is counted anew. Long strings are scanned in pieces that overlap by a window, so the work is in
    proportion to the length.
    """
    weight = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 2)]
    rise = F.array(*(F.lit(weight[c + 1] - weight[c]) for c in range(WINDOW + 1)))  # of the sum, from c to c + 1
    most = F.lit(1e9)
    times = lambda c, held: F.char_length(held) - F.char_length(F.replace(held, c, F.lit("")))

    def step(state: Column, c: Column) -> Column:
        held = state["held"]
        full = F.char_length(held) == WINDOW
        rest = F.when(full, F.substring(held, 2, WINDOW)).otherwise(held)
        less = F.when(full, F.get(rise, times(F.substring(held, 1, 1), held) - 1)).otherwise(F.lit(0.0))
        least = F.when(full, F.least(state["least"], state["sum"])).otherwise(state["least"])
        return F.struct(F.concat(rest, c).alias("held"), (state["sum"] - less + F.get(rise, times(c, rest))).alias("sum"), least.alias("least"))

    start = F.struct(F.lit("").alias("held"), F.lit(0.0).alias("sum"), most.alias("least"))
    last = lambda state: F.when(F.char_length(state["held"]) == WINDOW, F.least(state["least"], state["sum"])).otherwise(state["least"])
    pieces = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    least = F.array_min(F.transform(pieces, lambda p: F.aggregate(F.split(p, ""), start, step, last)))
    return F.when(least < most, F.lit(math.log2(WINDOW)) - least / WINDOW).otherwise(F.lit(-1.0))


def suspicious(s: Column) -> Column:
    """Hex strings, mixed strings and strings without a digit each have their limit; what the allow-list names is left alone.
    Without a digit, a string must have a quarter of its letters in each case, vowels for a quarter of its letters at
    most, or eight consonants in a row."""
    rest = F.regexp_replace(s, SAMPLES, "")
    count = lambda kind: F.char_length(F.regexp_replace(rest, f"[^{kind}]", ""))
    letters, capitals, vowels = count("A-Za-z"), count("A-Z"), count("AEIOUaeiou")
    both = F.least(capitals, letters - capitals) * 4 >= letters
    digits, hexes = rest.rlike("[0-9]"), rest.rlike("^[0-9a-fA-F]+$")
    limit = F.when(hexes, F.lit(BITS_HEX)).when(digits, F.lit(BITS_MIXED)).when(both, F.lit(BITS_CASES)).otherwise(F.lit(BITS_LETTERS))
    open_ = F.when(digits, ~rest.rlike(ALLOWED_WORDS)).otherwise(hexes | both | (vowels * 4 <= letters) | rest.rlike(CONSONANTS))
    return ~rest.rlike(ALLOWED) & open_ & (window_entropy(rest) >= limit)


def find_secrets(df: DataFrame, text_col: str = "text", base_out: str = "__base", spans_out: str = "__spans") -> DataFrame:
    """df and two columns: arrays of (start, kind, end) in code points, end exclusive, sorted by start, then kind.

    base_out holds the fixed patterns' spans, spans_out these and the entropy scan's (kind 3). Null or empty texts have none.
    Rows don't depend on each other: nothing shuffles; repeated rows and any other columns pass through, and columns of df
    with the names of the two are replaced. Work is in proportion to a text's length, also where one candidate fills it.
    """
    own = fresh(df, "__scan")
    df = df.withColumn(own, F.coalesce(F.col(text_col), F.lit("")))
    text, none, parts = F.col(own), F.array().cast(SPANS), []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        spans, found = _match_spans(text, pattern, k)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        long_enough = F.filter(F.arrays_zip(spans.alias("s"), values.alias("v")), lambda x: F.char_length(x["v"]) >= least)
        df = df.withColumn(f"{own}_{kind}", F.when(text.rlike(pattern), F.transform(long_enough, lambda x: x["s"])).otherwise(none))
        parts.append(F.col(f"{own}_{kind}"))
    spans, found = _match_spans(text, CANDIDATE, len(KINDS))
    marked = F.filter(F.arrays_zip(spans.alias("s"), found.alias("v")), lambda x: suspicious(x["v"]))
    df = df.withColumn(f"{own}_entropy", F.when(text.rlike(CANDIDATE), F.transform(marked, lambda x: x["s"])).otherwise(none))
    df = df.withColumn(base_out, F.sort_array(F.concat(*parts)))
    df = df.withColumn(spans_out, F.sort_array(F.concat(F.col(base_out), F.col(f"{own}_entropy"))))
    return df.drop(own, f"{own}_entropy", *(f"{own}_{k[0]}" for k in KINDS))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of each row; other columns are left out, no rows give none."""
    found = find_secrets(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return found.select(
        F.col("id").alias(id_col), *(F.expr(f"cast(size(filter(__base, x -> x.kind = {k})) as long)").alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)),
        F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with the same columns, each found span (overlapping or touching ones as one) replaced by `mark`; other texts stay as
    they are, null ones null. A text is put together in parts of PART characters, so a long one with many spans is no worse."""
    base, spans = fresh(df, "__base"), fresh(df, "__spans")
    found = find_secrets(df, text_col, base, spans)
    text = F.col(text_col)

    def rebuilt(part: Column, i: Column) -> Column:
        begin = (i * PART).cast("long")
        near = F.filter(spans, lambda x: (x["start"] < begin + PART) & (x["end"] >= begin))
        carried = F.aggregate(F.filter(near, lambda x: x["start"] < begin), F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x["end"]))
        between = lambda a, b: F.substring(part, (a - begin + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))

        def step(s: Column, x: Column) -> Column:
            new = F.concat(s["out"], between(F.greatest(s["at"], begin), x["start"]), F.lit(mark))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] > s["at"], new).otherwise(s["out"]).alias("out"))

        start = F.struct(carried.alias("at"), F.lit("").alias("out"))
        return F.aggregate(F.filter(near, lambda x: x["start"] >= begin), start, step, lambda s: F.concat(s["out"], between(F.greatest(s["at"], begin), begin + PART)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    new = F.when(F.size(spans) > 0, F.array_join(F.transform(parts, rebuilt), "")).otherwise(text)
    return found.withColumn(text_col, new).select(*df.columns)
