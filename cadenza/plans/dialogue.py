"""Registered queries on conversation logs and membership plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convlog, merge, questions as Q
from .registry import _INTENT, query

_LIST = lambda words: "[" + ", ".join("'" + w + "'" for w in words) + "]"
_IN = lambda words: f"list_filter({_LIST(words)}, lambda w: contains(lower(text), w))"
_LONG = "list_filter(list_transform({}, lambda x: trim(x, ' ')), lambda x: length(x) > 10)"
_AND = f"case when contains(lower(text), ' and ') and len({_IN(Q.SPLITTERS)}) > 0 then " + _LONG.format(r"regexp_split_to_array(text, '(?i)\s+and\s+')") + " else [] end"
_MARK = "case when length(text) - length(replace(text, '?', '')) > 1 then list_transform(" + _LONG.format("string_split(text, '?')") + ", lambda x: x || '?') else [] end"
_ASKED = f"""asked as (
  select *, case when len(found) > 0 then found else [text] end as parts from (select *, list_slice(list_concat({_AND}, {_MARK}), 1, 3) as found from turns)
), graded as (
  select *, case when points >= 4 then 'complex' when points >= 2 then 'moderate' else 'simple' end as level from (
    select *, case when length(text) > 200 then 2 when length(text) > 100 then 1 else 0 end + case when len(parts) > 1 then 2 else 0 end
      + case when {' + '.join(f"cast(len({_IN(w)}) > 0 as integer)" for w in Q.ENTITIES.values())} > 2 then 1 else 0 end + case when len({_IN(Q.COMPLEX)}) > 0 then 2 else 0 end as points from asked)
)"""


@query("m02_entities", "select conv_id, turn, " + ", ".join(f"array_to_string({_IN(w)}, ',') as {k}" for k, w in Q.ENTITIES.items()) + " from turns")
def _(lib):
    return lib.turns.select("conv_id", "turn", *(F.array_join(e, ",").alias(k) for k, e in Q.entities(F.col("text")).items()))


_MORE = "list_concat(" + ", ".join(f"case when contains(lower(text), '{t}') then {_LIST(s[:2])} else [] end" for t, s in Q.SYNONYMS.items()) + ")"


@query("m03_expand", f"select conv_id, turn, case when len(more) > 0 then text || ' ' || array_to_string(list_sort(list_distinct(more)), ' ') else text end as expanded from (select *, {_MORE} as more from turns)")
def _(lib):
    return lib.turns.select("conv_id", "turn", Q.expanded(F.col("text")).alias("expanded"))


@query("m04_parts", "select conv_id, turn, array_to_string(parts, '|') as parts from asked", _ASKED)
def _(lib):
    return lib.turns.select("conv_id", "turn", F.array_join(Q.parts(F.col("text")), "|").alias("parts"))


@query("m05_complexity", "select conv_id, turn, level from graded", _ASKED)
def _(lib):
    return lib.turns.select("conv_id", "turn", Q.complexity(F.col("text")).alias("level"))


_MODE = "case when intent in ('chit_chat', 'out_of_scope') then 'dense' when intent in ('artist_info', 'genre_info') and level = 'simple' then 'snippet' when intent = 'recommendation' or level = 'moderate' then 'hybrid' else 'dense' end"


@query("m06_retrieval_mode", f"select conv_id, turn, {_MODE} as mode from graded join labelled using (conv_id, turn)", f"{_ASKED}, {_INTENT}")
def _(lib):
    return lib.turns.select("conv_id", "turn", Q.retrieval_mode(convlog.intent(F.col("text"))[0], Q.complexity(F.col("text"))).alias("mode"))


@query("m15_last_reply", "select conv_id, arg_max(substr(text, 1, 500), turn) filter (where role = 'assistant' and regexp_matches(text, '[1-5]\\.')) as reply, arg_min(text, turn) filter (where role = 'user') as request from turns group by 1")
def _(lib):
    """The last reply that lists something, and what was asked first."""
    by = lambda f, mine, c: f(c, F.when(mine, F.col("turn")))
    listed = (F.col("role") == "assistant") & F.col("text").rlike(r"[1-5]\.")
    return lib.turns.groupBy("conv_id").agg(by(F.max_by, listed, F.substring("text", 1, 500)).alias("reply"), by(F.min_by, F.col("role") == "user", F.col("text")).alias("request"))


@query("m16_memory_stats", "select role as namespace, least(count(*), 100) as n, count(distinct conv_id) as conversations from turns group by 1")
def _(lib):
    return lib.turns.groupBy(F.col("role").alias("namespace")).agg(F.least(F.count("*"), F.lit(100)).alias("n"), F.countDistinct("conv_id").alias("conversations"))


_ENTITIES = ", ".join(f"array_to_string({_IN(w)}, ',') as {k}" for k, w in Q.ENTITIES.items())


@query("m17_analysis", f"select conv_id, turn, intent, round(cast(confidence as double), 6) as confidence, level, {_MODE} as mode, len(parts) as n_parts, array_to_string(parts, '|') as variants, {_ENTITIES}, case when len(more) > 0 then text || ' ' || array_to_string(list_sort(list_distinct(more)), ' ') else text end as expanded from (select *, {_MORE} as more from graded) join labelled using (conv_id, turn)", f"{_ASKED}, {_INTENT}")
def _(lib):
    analysed = Q.analysis(lib.turns)
    lists = [F.array_join(F.col("entities")[k], ",").alias(k) for k in Q.ENTITIES]
    return analysed.select("conv_id", "turn", "intent", F.round("confidence", 6).alias("confidence"), "level", "mode", F.size("variants").cast("long").alias("n_parts"), F.array_join("variants", "|").alias("variants"), *lists, "expanded")


# membership plans: the stored counts leave out tracks with ids divisible by 10 of playlists that start with 1

_PLAN = """now as (select playlist_id, count(*) as n from members where playlist_id not like '9%' group by 1),
was as (select playlist_id, count(*) as n, case when playlist_id like '2%' then 'excluded' else 'active' end as status, case when playlist_id like '3%' then 1.0 else 48.0 end as hours from members where playlist_id not like '4%' and (playlist_id not like '1%' or track_id % 10 > 0) group by 1)"""


@query("l04_sync_plan", "select playlist_id, coalesce(w.status, 'excluded') as status, case when n.playlist_id is null then 'archived' when w.playlist_id is null then 'new' when coalesce(w.status, 'excluded') = 'excluded' then 'excluded' when n.n <> w.n then 'stale' else 'current' end as state, n.n is not null and coalesce(w.status, 'excluded') = 'active' and n.n is distinct from w.n and coalesce(w.hours >= 23, true) as needs_sync from now n full join was w using (playlist_id)", _PLAN)
def _(lib):
    count = lambda rows: rows.groupBy("playlist_id").agg(F.count("*").alias("n"))
    now = count(lib.members.filter("playlist_id not like '9%'"))
    was = count(lib.members.filter("playlist_id not like '4%' and (playlist_id not like '1%' or track_id % 10 > 0)"))
    was = was.withColumn("status", F.when(F.col("playlist_id").startswith("2"), "excluded").otherwise("active")).withColumn("hours", F.when(F.col("playlist_id").startswith("3"), 1.0).otherwise(48.0))
    return merge.sync_plan(now, was)


@query("l06_capped_additions", "select playlist_id, n from (select playlist_id, count(*) as n, sum(count(*)) over (order by count(*), playlist_id) as running from members where track_id not in (select track_id from audio_features) group by 1) where running <= 2000")
def _(lib):
    return merge.within_budget(lib.members.join(lib.audio_features, "track_id", "left_anti").groupBy("playlist_id").agg(F.count("*").alias("n")), "n", "playlist_id", 2000)


@query("l07_gap_fill", "select track_id from tracks where track_id not in (select track_id from audio_features) order by track_id limit 50")
def _(lib):
    return lib.tracks.join(lib.audio_features, "track_id", "left_anti").select("track_id").orderBy("track_id").limit(50)
