"""What a message asks for: entities, synonyms, parts, complexity, mode of retrieval, and what a reply lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convlog import intent

# Entity words by kind, synonyms by term, words that make a question complex, signs that a message refers to an earlier one.
ENTITIES = {
    "mood": ["happy", "sad", "energetic", "chill", "melancholic", "upbeat", "dark", "romantic", "mellow", "intense", "dreamy"],
    "time_period": ["70s", "80s", "90s", "2000s", "2010s", "recent", "classic", "vintage", "new", "modern"],
    "context": ["workout", "study", "party", "sleep", "focus", "driving", "dinner", "cooking", "running", "relaxing"],
}
SYNONYMS = {
    "track": ["song", "tune", "record"],
    "artist": ["musician", "band", "singer", "performer"],
    "similar": ["like", "sounds like", "in the style of", "reminiscent of"],
    "recommend": ["suggest", "find me", "show me"],
}
COMPLEX = ["compare", "difference between", "versus", "pros and cons", "best way to", "how does", "relationship between"]
SPLITTERS = ["who", "what", "recommend"]
SNIPPET_INTENTS, DIRECT_INTENTS = ["artist_info", "genre_info"], ["chit_chat", "out_of_scope"]


def words_in(text: Column, words: list[str]) -> Column:
    """The words, in their order, that the lower-cased text contains."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def has_any(text: Column, words: list[str]) -> Column:
    return F.size(words_in(text, words)) > 0


def entities(text: Column) -> dict[str, Column]:
    return {kind: words_in(text, words) for kind, words in ENTITIES.items()}


def expanded(text: Column, each: int = 2) -> Column:
    """The text and the first `each` synonyms of every term in it, sorted and without repeats."""
    none = F.array().cast("array<string>")
    more = F.concat(*(F.when(F.contains(F.lower(text), F.lit(t)), F.array(*map(F.lit, s[:each]))).otherwise(none) for t, s in SYNONYMS.items()))
    return F.when(F.size(more) > 0, F.concat(text, F.lit(" "), F.array_join(F.array_sort(F.array_distinct(more)), " "))).otherwise(text)


def parts(text: Column, most: int = 3, longer: int = 10) -> Column:
    """Up to `most` questions in a message: split at 'and' if it asks who, what or for a recommendation, and at question marks if there
    are several; short parts are left out. A message that falls into no parts is one itself."""
    long_ones = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: F.char_length(x) > longer)
    none = F.array().cast("array<string>")
    joined = F.contains(F.lower(text), F.lit(" and ")) & has_any(text, SPLITTERS)
    by_and = F.when(joined, long_ones(F.split(text, r"(?i)\s+and\s+"))).otherwise(none)
    many = F.char_length(text) - F.char_length(F.replace(text, F.lit("?"), F.lit(""))) > 1
    by_mark = F.when(many, F.transform(long_ones(F.split(text, r"\?")), lambda x: F.concat(x, F.lit("?")))).otherwise(none)
    found = F.slice(F.concat(by_and, by_mark), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def complexity(text: Column) -> Column:
    """simple, moderate (2 points) or complex (4): long texts 1 or 2, several parts 2, three kinds of entities 1, a complex term 2."""
    size = F.char_length(text)
    points = F.when(size > 200, 2).when(size > 100, 1).otherwise(0) + F.when(F.size(parts(text)) > 1, 2).otherwise(0)
    kinds = sum((F.when(F.size(e) > 0, 1).otherwise(0) for e in entities(text).values()), F.lit(0))
    points = points + F.when(kinds > 2, 1).otherwise(0) + F.when(has_any(text, COMPLEX), 2).otherwise(0)
    return F.when(points >= 4, "complex").when(points >= 2, "moderate").otherwise("simple")


def retrieval_mode(name: Column, level: Column) -> Column:
    return F.when(name.isin(DIRECT_INTENTS), "dense").when(name.isin(SNIPPET_INTENTS) & (level == "simple"), "snippet").when((name == "recommendation") | (level == "moderate"), "hybrid").otherwise("dense")


def analysis(rows: DataFrame, text: str = "text", expand: bool = True, find: bool = True, split: bool = True) -> DataFrame:
    """rows with all that a message tells: intent, confidence, expanded, entities (a map of lists), variants (its parts, 3 at most), level
    and mode. Without `expand` the text stays as it is, without `find` there are no entities, without `split` it is its own only part; the
    level follows what was found."""
    said = F.col(text)
    name, sure = intent(said)
    none = F.array().cast("array<string>")
    held = F.create_map(*(x for k, e in entities(said).items() for x in (F.lit(k), e if find else none)))
    rows = rows.withColumns({"intent": name, "confidence": sure, "expanded": expanded(said) if expand else said, "entities": held, "variants": parts(said) if split else F.array(said)})
    size, kinds = F.char_length(said), sum((F.when(F.size(F.col("entities")[k]) > 0, 1).otherwise(0) for k in ENTITIES), F.lit(0))
    points = F.when(size > 200, 2).when(size > 100, 1).otherwise(0) + F.when(F.size("variants") > 1, 2).otherwise(0) + F.when(kinds > 2, 1).otherwise(0) + F.when(has_any(said, COMPLEX), 2).otherwise(0)
    rows = rows.withColumn("level", F.when(points >= 4, "complex").when(points >= 2, "moderate").otherwise("simple"))
    return rows.withColumn("mode", retrieval_mode(F.col("intent"), F.col("level")))


def numbered_lines(text: Column, most: int = 20) -> Column:
    """The items of a numbered list, at most `most`."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+[.)]\s+(.+)$"), F.lit(1)), 1, most)
