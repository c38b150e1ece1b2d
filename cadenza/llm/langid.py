"""Language ID by word-first backoff: known words count by their log frequency in each language; an unseen word falls back to
character n-grams, at each place the longest one that is known.

Words and n-grams are told apart by 64-bit fingerprints; the model is a sorted array of them and a matrix of log frequencies,
for words and for each length. A batch's different words are looked up once, all at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .shingles import U, mix

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
GRAM = 4
UNDECIDED = "und"
#: The classifier is fitted on about this many labelled documents a language, picked by hash: the only bound on its size. All
#: labelled languages, and all words and n-grams of these documents, are learned.
SAMPLE_DOCS = 1500
#: Characters of text that are worked on together; a longer text is taken alone.
CHARS = 4_000_000


def word_keys(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def gram_keys(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(for n = 1 to GRAM: the key of the n characters that begin at each place of ^word$, 0 where there are fewer; the word of
    each place). The last place, $ alone, is left out; ^ alone is no n-gram."""
    sizes = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + U(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    first = left == sizes[owner]
    keys, key = [], np.zeros(len(codes), np.uint64)
    for n in range(1, GRAM + 1):
        key = mix(key + np.r_[codes[n - 1 :], np.zeros(n - 1, np.uint64)] * U(0x9E3779B97F4A7C15))
        keys.append(np.where((left >= n) & ~((n == 1) & first), key, U(0)))
    here = left > 1
    return [k[here] for k in keys], owner[here]


def _count_batches(batches):
    """(lang, n, key, count); n is 0 for words, else the n-gram's length. Counts are summed within a batch."""
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).extend(WORD.findall(text.lower()))
        for lang, words in by.items():
            if not words:
                continue
            counted = pa.array(words, pa.large_string()).value_counts()
            kinds, often = counted.field(0).to_pylist(), counted.field(1).to_numpy()
            grams, owner = gram_keys(kinds)
            for n, keys in enumerate([word_keys(kinds), *grams]):
                weight = (often if n == 0 else often[owner])[keys != 0]
                some, at = np.unique(keys[keys != 0], return_inverse=True)
                sums = np.bincount(at, weight, len(some)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), n)), pa.array(some.view(np.int64)), pa.array(sums)], names=["lang", "n", "key", "count"])


@dataclass
class LangModel:
    """Sorted keys and, for each, its log probability in each language: for words (0) and n-grams of each length."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)

    def find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each key, whether it is known)."""
        if not len(self.keys[n]):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys[n], keys), len(self.keys[n]) - 1)
        return at, self.keys[n][at] == keys

    def rows(self, words: list[str]) -> np.ndarray:
        """Each word's log probabilities; for an unseen one the mean, over its places, of the longest known n-gram there."""
        at, known = self.find(0, word_keys(words))
        out = np.zeros((len(words), len(self.langs)))
        out[known] = self.logs[0][at[known]]
        unseen = np.flatnonzero(~known)
        for i in range(0, len(unseen), 50_000):
            part = unseen[i : i + 50_000]
            grams, owner = gram_keys([words[k] for k in part])
            open_, places = np.ones(len(owner), bool), np.zeros(len(part))
            total = np.zeros((len(part), len(self.langs)))
            for n in range(GRAM, 0, -1):
                at, hit = self.find(n, grams[n - 1])
                hit &= open_ & (grams[n - 1] != 0)
                open_ &= ~hit
                places += np.bincount(owner[hit], minlength=len(part))
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(owner[hit], self.logs[n][at[hit], k], len(part))
            out[part] = total / np.maximum(1, places)[:, None]
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text."""
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(w) for w in found], np.int64)
        langs, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
        if not sizes.sum() or not self.langs:
            return langs, scores
        coded = pa.array([w for words in found for w in words], pa.large_string()).dictionary_encode()
        rows, which, doc = self.rows(coded.dictionary.to_pylist()), coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
        total = np.stack([np.bincount(doc, rows[which, k], len(texts)) for k in range(len(self.langs))], 1)
        scaled = total / np.sqrt(np.maximum(1, sizes))[:, None]
        p = np.exp(scaled - scaled.max(1)[:, None])
        best = p.argmax(1)
        some = sizes > 0
        scores[some] = (p[np.arange(len(p)), best] / p.sum(1))[some]
        return [self.langs[b] if s else UNDECIDED for b, s in zip(best, some, strict=True)], scores


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> LangModel:
    """Fits on the labelled rows given (null languages and texts are left out), about sample_docs of each language: all of a
    language that has fewer. The driver gets the counts of their tokens as numbers in columns."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = cut(rows.groupBy("lang").agg((sample_docs / F.count("*")).alias("share")))  # a row a language
    chance = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), 11) / float(1 << 53)
    sample = rows.join(F.broadcast(sizes), "lang").filter(chance < F.col("share"))
    counts = sample.select("lang", "text").mapInArrow(_count_batches, "lang string, n long, key long, count long")
    table = counts.groupBy("lang", "n", "key").agg(F.sum("count").alias("count")).toArrow()
    langs = sorted(table["lang"].unique().to_pylist())
    model, of = LangModel(langs), {g: i for i, g in enumerate(langs)}
    if not langs:
        return model
    coded = table["lang"].combine_chunks().dictionary_encode()
    lang = np.array([of[g] for g in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
    length, key, count = table["n"].to_numpy(), table["key"].to_numpy().view(np.uint64), table["count"].to_numpy()
    for n in range(GRAM + 1):
        here = length == n
        keys, at = np.unique(key[here], return_inverse=True)
        held = np.zeros((len(keys), len(langs)), np.float32)
        held[at, lang[here]] = count[here]
        totals = np.bincount(lang[here], count[here], len(langs)) + 1
        model.keys.append(keys)
        model.logs.append((np.log(held + 0.5) - np.log(totals + 0.5 * max(1, len(keys)))).astype(np.float32))
    return model


def predict(df: DataFrame, model: LangModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df and two columns: the likeliest learned language and its probability (0 to 1) after dividing log odds by the root of the
    word count. `und` and 0 for a null text, one without letters, or a model without languages. Ties: the first name.
    Whole texts are read; no row depends on another, nothing shuffles, and all other columns pass through; columns of df that
    have the names of the two are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    rows = df.select(F.col(text_col).alias("__text"), *kept)

    def run(batches):
        for batch in batches:
            texts, a = batch.column(0).to_pylist(), 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b] or "") <= CHARS):
                    size += len(texts[b] or "")
                    b += 1
                langs, scores = shared.value.score(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, lang_out, score_out])
                a = b

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, f"{fields}`{lang_out}` string, `{score_out}` double")
