"""Checks of answers and tool output in a conversation log, without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .questions import has_any

# Marks of a reference to something said before, and of a tool that failed.
REFERRING = [" it ", " they ", " them ", " that ", " this ", "the artist", "the band", "the song", " their "]
ERRORS = ["failed to fetch", "not found", "not available", "engine not available", "no results", "no recently played", "no tracks found"]
# Least length of an answer, of a word of the question and of a tool's word; share of words that grounds an answer.
LEAST_ANSWER, QUESTION_WORD, TOOL_WORD, GROUNDED = 20, 4, 5, 0.2
TIERS = ["low", "medium", "high"]


def refers_back(text: Column) -> Column:
    return has_any(text, REFERRING)


def output_flags(text: Column, confidence: Column, least: float = 0.4) -> Column:
    """What is wrong with a tool's output: 'empty', 'error', 'unsure', in this order."""
    text = F.coalesce(text, F.lit(""))
    marks = F.array(F.when(F.trim(text) == "", "empty"), F.when(has_any(text, ERRORS), "error"), F.when(confidence < least, "unsure"))
    return F.array_compact(marks)


def long_words(text: Column, least: int) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.char_length(w) >= least))


def answer_check(rows: DataFrame, question: str = "question", answer: str = "answer", tools: str = "tools") -> DataFrame:
    """Adds faithfulness (tool words used by the answer, times 5, at most 1; 0.5 without such words), relevance (the question's words
    that the answer has; 1 without any), completeness (long enough), score (their mean), is_correct and reason. Null texts are
    empty; null tools mean that none was called."""
    said = F.trim(F.lower(F.coalesce(answer, F.lit(""))))
    asked, told = long_words(F.coalesce(question, F.lit("")), QUESTION_WORD), long_words(F.coalesce(tools, F.lit("")), TOOL_WORD)
    rows = rows.withColumn("__said", said).withColumn("__asked", asked).withColumn("__told", told)
    share = F.size(F.filter("__asked", lambda w: F.contains(F.col("__said"), w))) / F.nullif(F.size("__asked"), F.lit(0))
    used = F.size(F.array_intersect("__told", F.split("__said", r"\s+"))) / F.nullif(F.size("__told"), F.lit(0))
    rows = rows.withColumn("__r", F.coalesce(share, F.lit(1.0))).withColumn("__f", F.when(used.isNull(), 0.5).otherwise(F.least(F.lit(1.0), used * 5)))
    rows = rows.withColumn("__c", (F.char_length("__said") >= LEAST_ANSWER).cast("double"))
    why = F.array_compact(F.array(
        F.when(F.col("__c") == 0, "answer too short"), F.when(F.col("__r") < GROUNDED, "question's words are missing"), F.when((F.col("__f") < 0.1) & F.col(tools).isNotNull(), "tool output is not used"),
    ))
    return rows.select(
        *(c for c in rows.columns if not c.startswith("__")), F.round("__f", 3).alias("faithfulness"), F.round("__r", 3).alias("relevance"), F.col("__c").alias("completeness"),
        F.round((F.col("__f") + F.col("__r") + F.col("__c")) / 3, 3).alias("score"), ((F.col("__c") == 1) & (F.col("__r") >= GROUNDED)).alias("is_correct"), F.array_join(why, "; ").alias("reason"),
    )


def verdict(correct: Column, score: Column, attempts: Column, most: int = 2) -> Column:
    """'accept' what is correct or scores 0.5, else 'retry' until `most` attempts, then 'stop'."""
    return F.when(correct | (score >= 0.5), "accept").when(attempts < most, "retry").otherwise("stop")


def best_tier(rows: DataFrame, by: str, tier: str) -> DataFrame:
    """The best of TIERS in each group."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier))
    return rows.groupBy(by).agg(F.max_by(tier, rank).alias("best"))


def ordered_without_repeats(rows: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """Each group's keys in order of their first appearance."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(by, key).agg(F.min(order).alias("__at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", key))), lambda x: x[key]).alias("keys"))
