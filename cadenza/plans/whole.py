"""Registered queries on popularity, decades and the genre map, on profiles with all their genres, and on tools in conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, convlog, profile, quantiles, reports, rerank, validation
from ..operators import questions as Q
from ..operators.answers import ERRORS
from .dialogue import _LIST
from .registry import _INTENT, _genre, query

_DECADE = "(try_cast(substr(release_date, 1, 4) as integer) // 10 * 10) || 's'"


def _decades(lib):
    return lib.tracks.withColumn("decade", S.decade_of(S.year_of(F.col("release_date"))))


@query("k18_popularity_ends", "select * from (select 'most' as which, row_number() over (order by popularity desc, track_id) as place, track_id, popularity as value from tracks where popularity is not null) where place <= 10 union all select * from (select 'least', row_number() over (order by popularity, track_id) as place, track_id, popularity from tracks where popularity is not null) where place <= 10 union all select * from (select 'faved', row_number() over (order by score desc, track_id) as place, track_id, cast(score as double) from faves where score > 0) where place <= 10")
def _(lib):
    """The 10 most and least popular tracks and the 10 best liked ones; each task keeps 10 before anything moves."""
    known = lib.tracks.filter("popularity is not null").select(F.lit("").alias("which"), "track_id", F.col("popularity").alias("value"))
    faved = lib.faves.filter("score > 0").select(F.lit("").alias("which"), "track_id", F.col("score").cast("double").alias("value"))
    ends = [("most", known, F.desc("value")), ("least", known, F.asc("value")), ("faved", faved, F.desc("value"))]
    parts = [audit.first_of(rows.withColumn("which", F.lit(name)), "which", [order, F.col("track_id")], 10) for name, rows, order in ends]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("which", F.col("place").cast("long").alias("place"), "track_id", "value")


@query("k19_decade_shares", "select playlist_id, " + ", ".join(f"round(count(*) filter (where decade = '{d}') / greatest(1, count(*) filter (where decade in ({', '.join(repr(x) for x in rerank.DECADES)}))), 6) as \"{d}\"" for d in rerank.DECADES) + f" from members join (select track_id, {_DECADE} as decade from tracks) using (track_id) where decade is not null group by 1")
def _(lib):
    """How each playlist's tracks are spread over the decades."""
    rows = lib.members.join(_decades(lib).filter("decade is not null").select("track_id", "decade"), "track_id")
    return reports.share_pivot(rows, "playlist_id", "decade", rerank.DECADES)


@query("k19_decade_popularity", "select playlist_id, decade, count(*) as n, round(min(popularity), 6) as low, round(quantile_cont(popularity, 0.25), 6) as q1, round(quantile_cont(popularity, 0.5), 6) as q2, round(quantile_cont(popularity, 0.75), 6) as q3, round(max(popularity), 6) as high "
       f"from members join (select track_id, popularity, {_DECADE} as decade from tracks) using (track_id) where decade is not null and popularity is not null group by 1, 2")
def _(lib):
    """Five numbers of popularity for each playlist and decade."""
    rows = lib.members.join(_decades(lib).filter("decade is not null and popularity is not null").select("track_id", "decade", "popularity"), "track_id")
    by = ["playlist_id", "decade"]
    numbers = quantiles.counted_quantiles(rows.groupBy(*by, "popularity").agg(F.count("*").alias("n")), "popularity", [0.0, 0.25, 0.5, 0.75, 1.0], by)
    return numbers.select(*by, "n", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("low", "q1", "q2", "q3", "high"))))


@query("k24_map_health", "select count(*) filter (where gen_4 is not null) as mapped, count(*) filter (where gen_4 is null and first_genre is not null) as unmapped, count(*) filter (where first_genre is null) as none, round(count(*) filter (where gen_4 is not null) * 100 / count(*), 4) as mapped_pct from track_genre")
def _(lib):
    """How many tracks have a genre that the map knows, one that it doesn't, or none."""
    g, f = F.col("gen_4"), F.col("first_genre")
    return _genre(lib).agg(F.count_if(g.isNotNull()).alias("mapped"), F.count_if(g.isNull() & f.isNotNull()).alias("unmapped"), F.count_if(f.isNull()).alias("none"), F.round(F.count_if(g.isNotNull()) * 100 / F.count("*"), 4).alias("mapped_pct"))


def _lists_sql(members: str, by: str) -> tuple[str, str]:
    ranked = f"ranked as (select {by}, first_genre, row_number() over (partition by {by} order by count(*) desc, first_genre) as k from {members} join tracks using (track_id) where first_genre is not null group by 1, 2)"
    json = lambda test: f"'[' || coalesce(string_agg('\"' || first_genre || '\"', ',' order by k) filter (where {test}), '') || ']'"
    return f"select {by}, {json('k <= 5')} as top_genres, {json('k > 5')} as other_genres from ranked group by 1", ranked


@query("d06_artist_genre_lists", *_lists_sql("track_artists", "artist_id"))
def _(lib):
    return profile.genre_lists(lib.track_artists.join(lib.tracks, "track_id"), "artist_id", "first_genre")


@query("d07_playlist_genre_lists", *_lists_sql("members", "playlist_id"))
def _(lib):
    return profile.genre_lists(lib.members.join(lib.tracks, "track_id"), "playlist_id", "first_genre")


# conversations: each assistant turn is the output of the first tool, by name, for the intent of its own text

_TOOL = "case own " + " ".join(f"when '{k}' then '{min(v)}'" for k, v in validation.TOOLS.items()) + " end"
_NAMED = [w for words in Q.ENTITIES.values() for w in words]
_OUTPUTS = f"""{_INTENT}, said as (
  select conv_id, turn, role, text, intent as own, lag(text) over t as question, lag(intent) over t as intent from turns join labelled using (conv_id, turn) window t as (partition by conv_id order by turn)
), outputs as (
  select *, {_TOOL} as tool, list_filter({_LIST(_NAMED)}, lambda w: contains(lower(coalesce(question, '')), w)) as entities, case turn % 7 when 0 then 'low' when 1 then 'high' end as confidence from said where role = 'assistant'
)"""
_FLAGS = f"[case when trim(text, ' ') = '' then 'empty' when len(list_filter({_LIST(ERRORS)}, lambda w: contains(lower(text), w))) > 0 then 'error' end, case when confidence = 'low' then 'low confidence' end, case when tool is not null and (" + " or ".join(f"(intent = '{k}' and tool not in ({', '.join(repr(t) for t in v)}))" for k, v in validation.TOOLS.items()) + ") then 'mismatch' end]"


def _outputs(lib):
    t = Window.partitionBy("conv_id").orderBy("turn")
    rows = lib.turns.select("conv_id", "turn", "role", "text", convlog.intent(F.col("text"))[0].alias("own"))
    rows = rows.withColumn("question", F.lag("text").over(t)).withColumn("intent", F.lag("own").over(t)).filter("role = 'assistant'")
    tool = F.try_element_at(F.create_map(*(F.lit(x) for k, v in validation.TOOLS.items() for x in (k, min(v)))), F.col("own"))
    tier = F.when(F.col("turn") % 7 == 0, "low").when(F.col("turn") % 7 == 1, "high")
    found = F.filter(F.array(*map(F.lit, _NAMED)), lambda w: F.contains(F.lower(F.coalesce("question", F.lit(""))), w))
    return rows.select("conv_id", "turn", "intent", found.alias("entities"), F.array_compact(F.array(tool)).alias("tools"), F.col("text").alias("output"), tier.alias("confidence"))


@query("m10_output_issues", f"select conv_id, turn, case when len(hard) > 0 then array_to_string(hard, '; ') when len(missing) > 0 then 'missing: ' || array_to_string(missing, ',') else '' end as issues from (select *, list_filter({_FLAGS}, lambda x: x is not null) as hard, list_filter(entities, lambda e: not contains(lower(text), e)) as missing from outputs)", _OUTPUTS)
def _(lib):
    """What is wrong with each tool output, by all five checks."""
    return validation.issues(_outputs(lib)).select("conv_id", "turn", F.array_join("issues", "; ").alias("issues"))


@query("m11_tool_stalls", "select conv_id, turn, cast(row_number() over (partition by conv_id, run order by turn) - 1 as integer) as stall_count, row_number() over (partition by conv_id, run order by turn) - 1 >= 3 as stalled from (select *, sum(case when tool = before then 0 else 1 end) over (partition by conv_id order by turn) as run from (select *, lag(tool) over (partition by conv_id order by turn) as before from outputs))", _OUTPUTS)
def _(lib):
    """How long each conversation has been calling the same tools."""
    return validation.stalls(_outputs(lib), "conv_id", "turn").select("conv_id", "turn", "stall_count", "stalled")
