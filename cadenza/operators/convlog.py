"""Deterministic labels over conversation logs and play events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Intents in order, with their keywords.
INTENTS = {
    "artist_info": ["who is", "tell me about", "what do you know about", "biography", "history of", "background on", "artist info", "about the band", "when did", "where is", "discography", "influences", "style of"],
    "genre_info": ["what is", "explain", "describe", "genre", "subgenre", "music style", "what does", "characteristics of", "origins of"],
    "recommendation": ["recommend", "suggest", "find me", "similar to", "sounds like", "more of", "playlist", "tracks like", "what should i listen to", "based on", "fans of", "if i like", "like"],
    "history": ["recently played", "what have i been", "my listening", "my history", "i've been listening", "last week", "my taste", "my playlists", "what did i listen", "my spotify"],
    "explore_my_taste": ["my top", "top tracks", "top artists", "what do i like", "what kind of music", "my music profile", "what genres", "music taste", "my vibe"],
    "discover": ["discover", "surprise me", "something new", "new music", "what should i try", "find me something", "outside my bubble", "underrated", "hidden gem"],
    "chit_chat": ["hello", "hi", "hey", "thanks", "thank you", "bye", "how are you", "what's up", "good morning", "good night"],
}
CLARIFY_BELOW = 0.4


def intent(text: Column) -> tuple[Column, Column]:
    """(intent, confidence): the intent with most keywords in the text, the first of equals; none: artist_info at 0.3."""
    low = F.lower(text)
    counts = F.array(*(sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0)) for keys in INTENTS.values()))
    names, most = F.array(*map(F.lit, INTENTS)), F.array_max(counts)
    name = F.element_at(names, F.array_position(counts, most).cast("int"))
    return F.when(most > 0, name).otherwise("artist_info"), F.when(most > 0, F.least(F.lit(1.0), most / 3)).otherwise(F.lit(0.3))


def route(name: Column, confidence: Column) -> Column:
    return F.when(name == "chit_chat", "rewrite").when(confidence < CLARIFY_BELOW, "clarify").otherwise("rewrite")


def trim_history(turns: DataFrame, keep: int = 20) -> DataFrame:
    """The last `keep` turns of each conversation, from the first user turn among them on."""
    last = turns.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("k") <= keep)
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return last.withColumn("first", first).filter(F.col("turn") >= F.col("first")).drop("k", "first")


def stalls(turns: DataFrame, least: int = 2) -> DataFrame:
    """Runs of consecutive turns of one role: conv_id, role, start, length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1))
    runs = turns.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.min("turn").alias("start"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("run")


def recently_played(plays: DataFrame, n: int = 50) -> DataFrame:
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return plays.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= min(n, 50)).select("user_id", "rank", "event_id", "item")


def top_items(plays: DataFrame, n: int, days: int | None = None) -> DataFrame:
    """Each user's n most played items, over the days before the last event or over all time; ties by item."""
    if days:
        end = plays.agg(F.max("ts").alias("end")).withColumn("one", F.lit(1))
        plays = plays.withColumn("one", F.lit(1)).join(F.broadcast(end), "one").filter(F.col("ts") > F.col("end") - F.expr(f"interval {days} days"))
    counts = plays.groupBy("user_id", "item").agg(F.count("*").alias("plays"))
    best = Window.partitionBy("user_id").orderBy(F.desc("plays"), "item")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def taste_drift(short: DataFrame, long: DataFrame) -> DataFrame:
    """new, stable and fading items of each user between two top lists."""
    s, o = short.select("user_id", "item", F.lit(True).alias("s")), long.select("user_id", "item", F.lit(True).alias("l"))
    kind = F.when(F.col("s") & F.col("l"), "stable").when(F.col("s"), "new").otherwise("fading")
    return s.join(o, ["user_id", "item"], "full").select("user_id", "item", kind.alias("kind"))
