"""What tool output leaves to be desired, given what was asked, and agents that go round in circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .answers import ERRORS
from .questions import has_any

# The tools that serve each intent (intents without an entry go with any tool), and how often the same tools in a row are a stall.
TOOLS = {
    "artist_info": ["get_artist_context"],
    "genre_info": ["get_genre_context", "get_artist_context", "recommend_by_genre"],
    "recommendation": ["recommend_similar_tracks", "recommend_for_artist", "recommend_by_genre", "recommend_for_playlist", "get_related_artists", "search_tracks"],
    "history": ["get_recently_played", "get_top_tracks", "get_top_artists"],
    "explore_my_taste": ["get_top_artists", "get_top_tracks", "get_taste_analysis", "search_taste_memory", "manage_taste_memory"],
    "discover": ["get_spotify_recommendations", "get_related_artists", "get_top_artists"],
}
STALLED = 3


def issues(rows: DataFrame) -> DataFrame:
    """rows (intent, entities: array, tools: array, output, confidence: 'low' or another tier or null, and others) with `issues`, an array:
    'empty' or 'error' by the output, 'low confidence' by the tier, 'mismatch' if the intent has tools and none of those used is one, and,
    only where there is nothing else, 'missing: ' and the entities that the output doesn't name. Null outputs are empty, null arrays too."""
    none = F.array().cast("array<string>")
    output, used = F.coalesce("output", F.lit("")), F.coalesce("tools", none)
    wanted = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in TOOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("intent")), none)
    hard = F.array_compact(F.array(
        F.when(F.trim(output) == "", "empty").when(has_any(output, ERRORS), "error"), F.when(F.col("confidence") == "low", "low confidence"),
        F.when((F.size(wanted) > 0) & (F.size(used) > 0) & ~F.arrays_overlap(wanted, used), "mismatch"),
    ))
    missing = F.filter(F.coalesce("entities", none), lambda e: ~F.contains(F.lower(output), F.lower(e)))
    soft = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing: "), F.array_join(missing, ",")))).otherwise(none)
    return rows.withColumn("issues", F.when(F.size(hard) > 0, hard).otherwise(soft))


def stalls(rows: DataFrame, by: str, order: str, threshold: int = STALLED) -> DataFrame:
    """rows (by, order, tools: array, and others) with stall_count, how many rows before one, without a break, used the same tools in any
    order, and stalled: whether there are `threshold` or more. A row without tools never continues a run."""
    w = Window.partitionBy(by).orderBy(order)
    named = rows.withColumn("__s", F.array_join(F.array_sort("tools"), ","))
    same = (F.size("tools") > 0) & F.col("__s").eqNullSafe(F.lag("__s").over(w))
    runs = named.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    place = F.row_number().over(Window.partitionBy(by, "__run").orderBy(order)) - 1
    return runs.withColumn("stall_count", place).withColumn("stalled", F.col("stall_count") >= threshold).drop("__s", "__new", "__run")
