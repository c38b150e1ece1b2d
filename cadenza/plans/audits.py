"""Registered queries on audits of rankings, samples, answers and their metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import answers, audit, convlog, profile, questions
from ..sources.domain import AUDIO
from .dialogue import _IN
from .models import _COS, _corpus
from .registry import _IMPUTED, _INTENT, _KEY_SQL, _PROFILE_SQL, _RING_SQL, SIMILARITY, _genre, _profile, query
from .reports import _METRICS, _SCORED, _measured

_KNOWN = "genred as (select track_id, first_genre, popularity, track_id in (select track_id from faves) as good from tracks where first_genre is not null)"


def _genred(lib):
    return lib.tracks.filter("first_genre is not null").select("track_id", "track_name", "first_genre", "popularity")


def _top(lib, k):
    return audit.first_of(_genred(lib), "first_genre", [F.desc("popularity"), F.col("track_id")], k)


# scalars and groups

@query("b02_decade", "select decade, count(*) as n from (select (try_cast(substr(release_date, 1, 4) as integer) // 10 * 10) || 's' as decade from tracks) group by 1")
def _(lib):
    return lib.tracks.groupBy(S.decade_of(S.year_of(F.col("release_date"))).alias("decade")).agg(F.count("*").alias("n"))


_B13 = ["danceability", "energy", "valence"]


@query("b13_weighted_cosine", "select track_id, round(case when norm > 0 then greatest(0, least(1, dot / norm)) else 0 end, 6) as score from (select track_id, 2 * d * 0.5 + e * 0.4 as dot, sqrt(2 * d * d + e * e) * sqrt(2 * 0.25 + 0.16) as norm from (select track_id, coalesce(danceability, 0) as d, coalesce(energy, 0) as e from audio_features))")
def _(lib):
    mine, asked = [F.coalesce(c, F.lit(0.0)) for c in _B13], [F.lit(x) for x in (0.5, 0.4, 0.3)]
    return lib.audio_features.select("track_id", F.round(S.weighted_cosine(mine, asked, [2.0, 1.0, -1.0]), 6).alias("score"))


@query("b16_genre_tokens", "select track_id, array_to_string(list_filter(list_transform(string_split('[''' || genre_cat || ''', ' || track_name || ']', ','), lambda x: lower(trim(regexp_replace(x, '[\\[\\]''\"]', '', 'g')))), lambda x: x <> ''), '|') as tokens from tracks")
def _(lib):
    text = F.concat(F.lit("['"), "genre_cat", F.lit("', "), "track_name", F.lit("]"))
    return lib.tracks.select("track_id", F.array_join(F.transform(S.list_items(text), F.lower), "|").alias("tokens"))


@query("b20_any_missing", "select track_id, " + " or ".join(f"{c} is null" for c in AUDIO) + " as missing from audio_features")
def _(lib):
    return lib.audio_features.select("track_id", F.exists(F.array(*AUDIO), F.isnull).alias("missing"))


@query("b22_has_coordinates", "select track_id, coalesce(top <> 0 or \"left\" <> 0, false) as placed from track_genre")
def _(lib):
    return _genre(lib).select("track_id", F.coalesce((F.col("top") != 0) | (F.col("left") != 0), F.lit(False)).alias("placed"))


@query("d05_mode", "select artist_id, first_genre from (select artist_id, first_genre, row_number() over (partition by artist_id order by count(*) desc, first_genre) as k from track_artists join tracks using (track_id) where first_genre is not null group by 1, 2) where k = 1")
def _(lib):
    return profile.mode_of(lib.track_artists.join(lib.tracks, "track_id"), "artist_id", "first_genre").select("artist_id", "first_genre")


@query("d15_active_members", "select playlist_id, count(*) as n from members join audio_features using (track_id) where tempo is not null group by 1")
def _(lib):
    active = lib.audio_features.filter("tempo is not null").select("track_id")
    return lib.members.join(active, "track_id").groupBy("playlist_id").agg(F.count("*").alias("n"))


@query("d18_statistics", "select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(max(value), 6) as high, round(stddev_samp(value), 6) as std from events group by 1")
def _(lib):
    r = lambda c, name: F.round(c, 6).alias(name)
    return lib.table("events").groupBy("event_type").agg(F.count("value").alias("n"), r(F.avg("value"), "mean"), r(F.percentile("value", 0.5), "median"), r(F.max("value"), "high"), r(F.stddev_samp("value"), "std"))


@query("e05_top_tracks", "select track_id, popularity from tracks order by popularity desc, track_id limit 25")
def _(lib):
    return lib.tracks.select("track_id", "popularity").orderBy(F.desc("popularity"), "track_id").limit(25)


@query("e07_latest_day", "select event_id, user_id from events where cast(ts as date) = (select max(cast(ts as date)) from events)")
def _(lib):
    plays = lib.plays.withColumn("day", F.to_date("ts"))
    return plays.join(F.broadcast(plays.agg(F.max("day").alias("day"))), "day").select("event_id", "user_id")


@query("e08_first_play", "select user_id, event_type, min_by(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def _(lib):
    return lib.plays.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("e11_sample", "select track_id from tracks order by md5(track_id || '-42'), track_id limit 500")
def _(lib):
    return audit.hash_sample(lib.tracks.select("track_id"), "track_id", 500)


# features

@query("f07_with_vectors", "select track_id, e.vec_id is not null as found, round(coalesce(list_sum(embedding::double[]), 0), 4) as total from tracks left join embeddings e on track_id = vec_id")
def _(lib):
    v = lib.table("embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = lib.tracks.join(v, "track_id", "left").withColumn("vector", F.coalesce("v", F.array_repeat(F.lit(0.0), 64)))
    return rows.select("track_id", F.isnotnull("v").alias("found"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("f13_labels", "select track_id, 1 as label from tracks where track_id in (select track_id from faves) union all (select track_id, 0 from tracks where track_id not in (select track_id from faves) order by md5(track_id || '-42'), track_id limit 300)")
def _(lib):
    return audit.labelled(lib.tracks.select("track_id"), lib.faves, "track_id", 300)


@query("f14_first_known_tag", "select track_id, arg_min(tag, pos) as tag from (select track_id, unnest(string_split(genre_cat, ' ')) as tag, generate_subscripts(string_split(genre_cat, ' '), 1) as pos from tracks) where tag < 'N' group by 1")
def _(lib):
    tags = lib.tracks.select("track_id", F.posexplode(F.split("genre_cat", " ")).alias("pos", "tag"))
    known = tags.select("tag").filter("tag < 'N'").distinct()
    return tags.join(known, "tag").groupBy("track_id").agg(F.min_by("tag", "pos").alias("tag"))


# rankings

@query("g07_funnel", "select t.track_id as request_id, (select count(*) from tracks) as corpus, n as same_cluster, least(n, 100) as kept from track_genre t join (select gen_4, count(*) as n from track_genre group by 1) using (gen_4) where t.track_id % 100 = 0")
def _(lib):
    genre = _genre(lib).select("track_id", "gen_4")
    sizes = genre.groupBy("gen_4").agg(F.count("*").alias("n"))
    total = lib.tracks.agg(F.count("*").alias("corpus")).withColumn("one", F.lit(1))
    asked = genre.filter("track_id % 100 = 0").join(sizes, "gen_4").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    return asked.select(F.col("track_id").alias("request_id"), "corpus", F.col("n").alias("same_cluster"), F.least("n", F.lit(100)).alias("kept"))


@query("i03_for_playlists", "select request_id, track_id, score, place from (select *, row_number() over (partition by request_id order by score desc, track_id) as place from sims anti join asked using (request_id, track_id)) where place <= 20",
       f"{_PROFILE_SQL}, {_IMPUTED}, asked as (select playlist_id as request_id, track_id from members), cent as (select request_id, " + ", ".join(f'avg(coalesce("{c}", 0)) as "{c}"' for c in SIMILARITY) + " from asked join imputed using (track_id) group by 1), "
       f"sims as (select r.request_id, c.track_id, round(greatest(0, least(1, ({_COS('c', 'r')}) / (sqrt({' + '.join(f'coalesce(c.{chr(34)}{x}{chr(34)}, 0) ** 2' for x in SIMILARITY)}) * sqrt({_COS('r', 'r')})))), 9) as score from imputed c, cent r)")
def _(lib):
    return audit.for_playlists(_corpus(lib), lib.members.select(F.col("playlist_id").alias("request_id"), "track_id"), SIMILARITY, 20)


_TEXT = "rendered as (select first_genre, string_agg(k || '. ' || track_name, chr(10) order by k) as text from (select *, row_number() over (partition by first_genre order by popularity desc, track_id) as k from tracks where first_genre is not null) where k <= 5 group by 1)"


def _rendered(lib):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "track_name"))), lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["track_name"]))
    return _top(lib, 5).groupBy("first_genre").agg(F.array_join(lines, "\n").alias("text"))


@query("i11_numbered_text", "select * from rendered", _TEXT)
def _(lib):
    return _rendered(lib)


@query("m12_track_lines", "select first_genre, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[0-9]+\\.\\s+', '')), '|') as names from rendered", _TEXT)
def _(lib):
    return _rendered(lib).select("first_genre", F.array_join(questions.numbered_lines(F.col("text")), "|").alias("names"))


@query("k02_null_matrix", "select track_id, " + ", ".join(f"cast({c} is null as integer) as {c}" for c in AUDIO) + " from audio_features order by md5(track_id || '-42'), track_id limit 500")
def _(lib):
    return audit.hash_sample(lib.audio_features, "track_id", 500).select("track_id", *(F.isnull(c).cast("int").alias(c) for c in AUDIO))


@query("k26_scaled_centroids", "select gen_8, " + ", ".join(f"round(case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else 0 end, 6) as {c}" for c in AUDIO) + " from (select gen_8, " + ", ".join(f"avg({c}) as {c}" for c in AUDIO) + " from profile where gen_8 is not null group by 1)", _PROFILE_SQL)
def _(lib):
    return audit.scaled_centroids(_profile(lib).filter("gen_8 is not null"), "gen_8", AUDIO)


@query("k29_member_statistics", "select f.track_id is not null as good, count(tempo) as n, round(avg(tempo), 6) as mean, min(tempo) as low, round(quantile_cont(tempo, 0.25), 4) as q1, round(median(tempo), 4) as q2, round(quantile_cont(tempo, 0.75), 4) as q3, max(tempo) as high from audio_features left join faves f using (track_id) group by 1")
def _(lib):
    rows = lib.audio_features.join(lib.faves.select("track_id", F.lit(True).alias("in")), "track_id", "left")
    q = lambda p, name: F.round(F.percentile("tempo", p), 4).alias(name)
    return rows.groupBy(F.isnotnull("in").alias("good")).agg(F.count("tempo").alias("n"), F.round(F.avg("tempo"), 6).alias("mean"), F.min("tempo").alias("low"), q(0.25, "q1"), q(0.5, "q2"), q(0.75, "q3"), F.max("tempo").alias("high"))


_NUMBER = lambda k: _RING_SQL % k


@query("k31_harmonic_profile", "select playlist_id, modal, round(sum(n * d) / sum(n), 6) as mean_distance, " + ", ".join(f"coalesce(sum(n) filter (where d = {i}), 0) as at_{i}" for i in range(7)) + f" from (select c.playlist_id, modal, n, coalesce(least(abs({_NUMBER('c.k')} - {_NUMBER('modal')}), 24 - abs({_NUMBER('c.k')} - {_NUMBER('modal')}), 6), 6) as d from counts c join (select playlist_id, k as modal from counts qualify row_number() over (partition by playlist_id order by n desc, k) = 1) m on m.playlist_id = c.playlist_id) group by 1, 2",
       f"keyed as (select track_id, nullif({_KEY_SQL}, '') as k from audio_features), counts as (select playlist_id, k, count(*) as n from members join keyed using (track_id) where k is not null group by 1, 2)")
def _(lib):
    keyed = lib.audio_features.select("track_id", S.key_mode(F.col("key"), F.col("mode"), strict=True).alias("key_mode")).filter("key_mode is not null")
    return audit.harmonic_profile(lib.members.join(keyed, "track_id"), "playlist_id", "key_mode")


@query("k32_rerank_audit", "select first_genre, count(*) as n, count(*) filter (where good) as members from (select *, row_number() over (partition by first_genre order by popularity desc, track_id) as k from genred) where k <= 100 group by 1", _KNOWN)
def _(lib):
    rows = _top(lib, 100).join(lib.faves.select("track_id", F.lit(True).alias("good")), "track_id", "left")
    return rows.groupBy("first_genre").agg(F.count("*").alias("n"), F.count("good").alias("members"))


@query("k33_known_ranks", "select first_genre, count(*) as n, round(avg(k), 6) as mean, median(k) as median, min(k) as best, max(k) as worst, count(*) filter (where k <= 10) as top_10, count(*) filter (where k <= 50) as top_50 from (select *, rank() over (partition by first_genre order by popularity desc) as k from genred) where good group by 1", _KNOWN)
def _(lib):
    ranked = audit.ranked_by_value(_genred(lib), "first_genre", "popularity")
    return audit.known_ranks(ranked, lib.faves, "first_genre", "track_id", (10, 50))


@query("k34_failures", "select first_genre, count(*) filter (where not good) as n, round(avg(popularity) filter (where not good), 6) as mean, round(avg(popularity) filter (where not good) - avg(popularity) filter (where good), 6) as gap from (select *, row_number() over (partition by first_genre order by popularity desc, track_id) as k from genred) where k <= 20 group by 1", _KNOWN)
def _(lib):
    return audit.failures(_top(lib, 20), lib.faves, "first_genre", "track_id", "popularity")


@query("k36_side_by_side", "select first_genre, place, a.track_id as a, b.track_id as b from (select *, row_number() over (partition by first_genre order by popularity desc, track_id) as place from genred) a join (select *, row_number() over (partition by first_genre order by good desc, track_id) as place from genred) b using (first_genre, place) where place <= 20", _KNOWN)
def _(lib):
    rows = _genred(lib).join(lib.faves.select("track_id", F.lit(1).alias("good")), "track_id", "left")
    return audit.side_by_side(_top(lib, 20), audit.first_of(rows, "first_genre", [F.desc_nulls_last("good"), F.col("track_id")], 20), "first_genre", "track_id")


@query("k39_sync_delta", "select playlist_id, count(*) - count(*) filter (where track_id % 5 <> 0) as delta, count(*) <> count(*) filter (where track_id % 5 <> 0) as needs_sync from members group by 1")
def _(lib):
    old = lib.members.filter("track_id % 5 <> 0").groupBy("playlist_id").agg(F.count("*").alias("was"))
    now = lib.members.groupBy("playlist_id").agg(F.count("*").alias("now"))
    delta = F.col("now") - F.coalesce("was", F.lit(0))
    return now.join(old, "playlist_id", "left").select("playlist_id", delta.alias("delta"), (delta != 0).alias("needs_sync"))


# models

_LONG = _SCORED + ", l as (" + " union all ".join(f"select source, model, '{m}' as metric, {m} as v from measured" for m in _METRICS) + ")"


@query("j08_best_model", "select metric, model, mean from (select *, row_number() over (partition by metric order by case when metric in ('brier', 'log_loss') then mean else -mean end, model) as k from (select metric, model, round(avg(v), 5) as mean from l group by 1, 2) where mean is not null) where k = 1", _LONG)
def _(lib):
    return audit.best_model(_measured(lib), "model", _METRICS)


@query("j11_disagreements", "select source, a.brier as va, b.brier as vb, round(a.brier - b.brier, 6) as delta from (select * from measured where model = 'a') a join (select * from measured where model = 'b') b using (source) order by abs(round(a.brier - b.brier, 6)) desc, source limit 5", _SCORED)
def _(lib):
    return audit.disagreements(_measured(lib), "source", "model", "a", "b", "brier")


@query("j12_stability", "select model, count(*) as runs, round(avg(brier), 6) as mean, min(brier) as low, max(brier) as high from measured group by 1", _SCORED)
def _(lib):
    return _measured(lib).groupBy("model").agg(F.count("*").alias("runs"), F.round(F.avg("brier"), 6).alias("mean"), F.min("brier").alias("low"), F.max("brier").alias("high"))


# conversations

@query("m09_refers_back", f"select conv_id, turn, len({_IN(answers.REFERRING)}) > 0 as refers from turns")
def _(lib):
    return lib.turns.select("conv_id", "turn", answers.refers_back(F.col("text")).alias("refers"))


@query("m10_output_flags", f"select conv_id, turn, concat_ws(',', case when trim(text, ' ') = '' then 'empty' end, case when len({_IN(answers.ERRORS)}) > 0 then 'error' end, case when confidence < 0.4 then 'unsure' end) as flags from turns join labelled using (conv_id, turn)", _INTENT)
def _(lib):
    return lib.turns.select("conv_id", "turn", F.array_join(answers.output_flags(F.col("text"), convlog.intent(F.col("text"))[1]), ",").alias("flags"))


@query("m13_without_repeats", "select user_id, string_agg(item, ',' order by first) as items from (select user_id, item, min(event_id) as first from plays where item is not null group by 1, 2) group by 1")
def _(lib):
    found = answers.ordered_without_repeats(lib.plays, "user_id", "item", "event_id")
    return found.select("user_id", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("items"))


@query("m14_best_tier", "select user_id, case when max(value) >= 400 then 'high' when max(value) >= 100 then 'medium' else 'low' end as best from events where value is not null group by 1")
def _(lib):
    tier = F.when(F.col("value") >= 400, "high").when(F.col("value") >= 100, "medium").otherwise("low")
    return answers.best_tier(lib.table("events").filter("value is not null").withColumn("tier", tier), "user_id", "tier")


_ROUTED = f"{_INTENT}, routed as (select conv_id, turn, intent, case when intent <> 'chit_chat' and confidence < 0.4 then 'clarify' else 'rewrite' end as route from labelled)"


@query("o03_route_accuracy", "select expected, count(*) as n, round(avg(case when route = expected then 1.0 else 0 end), 6) as accuracy from routed join (select conv_id, arg_min(route, turn) as expected from routed group by 1) using (conv_id) group by 1", _ROUTED)
def _(lib):
    rows = lib.turns.select("conv_id", "turn", convlog.route(*convlog.intent(F.col("text"))).alias("route"))
    first = rows.groupBy("conv_id").agg(F.min_by("route", "turn").alias("expected"))
    return rows.join(first, "conv_id").groupBy("expected").agg(F.count("*").alias("n"), F.round(F.avg((F.col("route") == F.col("expected")).cast("int")), 6).alias("accuracy"))


_STEPS = f"{_ROUTED}, steps as (select conv_id, string_agg(intent, ',' order by turn) as used, count(*) filter (where intent = 'artist_info') > 0 as matched from routed group by 1)"


def _steps(lib):
    rows = lib.turns.select("conv_id", "turn", convlog.intent(F.col("text"))[0].alias("intent"))
    used = F.transform(F.array_sort(F.collect_list(F.struct("turn", "intent"))), lambda x: x["intent"])
    return rows.groupBy("conv_id").agg(F.array_join(used, ",").alias("used"), (F.size(F.array_except(F.array(F.lit("artist_info")), F.collect_set("intent"))) == 0).alias("matched"))


@query("o04_steps", "select * from steps", _STEPS)
def _(lib):
    return _steps(lib)


@query("o06_trajectory_accuracy", "select count(*) as n, round(avg(case when matched then 1.0 else 0 end), 6) as accuracy from steps", _STEPS)
def _(lib):
    return _steps(lib).agg(F.count("*").alias("n"), F.round(F.avg(F.col("matched").cast("int")), 6).alias("accuracy"))


_WORDS = lambda c, n: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) >= {n}))"
_CHECKED = f"""asked as (
  select conv_id, turn, role, trim(lower(coalesce(text, '')), ' ') as said, lag(text) over t as question, lag(text, 2) over t as tools from turns window t as (partition by conv_id order by turn)
), worded as (
  select *, {_WORDS("coalesce(question, '')", 4)} as kw, {_WORDS("coalesce(tools, '')", 5)} as tw from asked where role = 'assistant'
), parted as (
  select *, case when length(said) >= 20 then 1.0::double else 0 end as c, coalesce(len(list_filter(kw, lambda w: contains(said, w)))::double / nullif(len(kw), 0), 1) as r,
    case when len(tw) = 0 then 0.5 else least(1, 5 * (len(list_intersect(tw, regexp_split_to_array(said, '\\s+')))::double / len(tw))) end as f from worded
), checked as (
  select conv_id, turn, round(f, 3) as faithfulness, round(r, 3) as relevance, c as completeness, round((f + r + c) / 3, 3) as score, c = 1 and r >= 0.2 as is_correct,
    concat_ws('; ', case when c = 0 then 'answer too short' end, case when r < 0.2 then 'question''s words are missing' end, case when f < 0.1 and tools is not null then 'tool output is not used' end) as reason from parted
)"""


def _checked(lib):
    t = Window.partitionBy("conv_id").orderBy("turn")
    rows = lib.turns.withColumn("question", F.lag("text").over(t)).withColumn("tools", F.lag("text", 2).over(t)).filter("role = 'assistant'")
    return answers.answer_check(rows, answer="text").drop("role", "text", "question", "tools")


@query("o07_answer_check", "select * from checked", _CHECKED)
def _(lib):
    return _checked(lib)


@query("o08_verdict", "select conv_id, turn, case when is_correct or score >= 0.5 then 'accept' when turn // 2 < 2 then 'retry' else 'stop' end as verdict from checked", _CHECKED)
def _(lib):
    return _checked(lib).select("conv_id", "turn", answers.verdict(F.col("is_correct"), F.col("score"), F.floor(F.col("turn") / 2)).alias("verdict"))
