"""Registered reports, metrics and joins beyond the core registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import convlog, features, profile, reports, retrieval, scoring
from ..sources.domain import AUDIO
from .registry import _INTENT, _KEY_SQL, _PROFILE_SQL, _genre, _profile, query

LONG = "long as (" + " union all ".join(f"select '{c}' as feature, {c} as value from audio_features" for c in AUDIO) + ")"


# joins and aggregates

@query("c03_member_features", "select playlist_id, count(*) as n, round(avg(tempo), 4) as tempo from members join audio_features using (track_id) join track_genre using (track_id) where gen_4 is not null group by 1")
def _(lib):
    rows = lib.members.join(lib.audio_features, "track_id").join(_genre(lib).filter("gen_4 is not null"), "track_id")
    return rows.groupBy("playlist_id").agg(F.count("*").alias("n"), F.round(F.avg("tempo"), 4).alias("tempo"))


@query("c06_primary_artist", "select track_id, min(artist_id) as artist_id from track_artists group by 1")
def _(lib):
    return profile.keep_first(lib.track_artists, ["track_id"], [F.col("artist_id")])


@query("c12_enrich_by_id", "select event_id, item, coalesce(popularity, 0.0) as popularity, t.track_id is not null as known from plays left join (select * from tracks where track_id % 2 = 0) t on item = t.track_id")
def _(lib):
    known = lib.tracks.filter("track_id % 2 = 0").select("track_id", "popularity")
    rows = lib.plays.select("event_id", "item").join(known, F.col("item") == F.col("track_id"), "left")
    return rows.select("event_id", "item", F.coalesce("popularity", F.lit(0.0)).alias("popularity"), F.col("track_id").isNotNull().alias("known"))


@query("c13_artist_tracks", "select artist_name, track_id, track_name from artists join track_artists using (artist_id) join tracks using (track_id)")
def _(lib):
    return lib.track_artists.join(lib.artists, "artist_id").join(lib.tracks.select("track_id", "track_name"), "track_id").select("artist_name", "track_id", "track_name")


_ARTIST_XY = "axy as (select artist_id, avg(top) as top, avg(\"left\") as \"left\" from track_artists join tracks using (track_id) join genre_xy using (first_genre) group by 1)"


def _artist_xy(lib):
    rows = lib.track_artists.join(lib.tracks.select("track_id", "first_genre"), "track_id").join(F.broadcast(lib.genre_xy), "first_genre")
    return rows.groupBy("artist_id").agg(F.avg("top").alias("top"), F.avg("left").alias("left"))


@query("d11_artist_centroid", "select artist_id, round(top, 6) as top, round(\"left\", 6) as \"left\" from axy", _ARTIST_XY)
def _(lib):
    return _artist_xy(lib).select("artist_id", F.round("top", 6).alias("top"), F.round("left", 6).alias("left"))


@query("f04_artist_coordinates", "select track_id, round(coalesce(a.top, g.top), 6) as top, round(coalesce(a.\"left\", g.\"left\"), 6) as \"left\" from track_genre g left join (select track_id, min(artist_id) as artist_id from track_artists group by 1) using (track_id) left join axy a using (artist_id)", _ARTIST_XY)
def _(lib):
    first = lib.track_artists.groupBy("track_id").agg(F.min("artist_id").alias("artist_id"))
    rows = _genre(lib).join(first, "track_id", "left").join(_artist_xy(lib).toDF("artist_id", "at", "al"), "artist_id", "left")
    return rows.select("track_id", F.round(F.coalesce("at", "top"), 6).alias("top"), F.round(F.coalesce("al", "left"), 6).alias("left"))


@query("f05_playlist_profile", "select m.track_id, " + ", ".join(f"round(avg(p.{c}), 6) as pp_{c}" for c in AUDIO) + " from members m join p using (playlist_id) group by 1",
       "p as (select playlist_id, " + ", ".join(f"avg({c}) as {c}" for c in AUDIO) + " from members join audio_features using (track_id) group by 1)")
def _(lib):
    return features.playlist_neighbourhood(lib.members, lib.audio_features, AUDIO).select("track_id", *(F.round(f"pp_{c}", 6).alias(f"pp_{c}") for c in AUDIO))


@query("d14_modal_key", "select playlist_id, key_mode, tempo from (select playlist_id, key_mode, row_number() over (partition by playlist_id order by count(*) desc, key_mode) as r from k group by 1, 2) join (select playlist_id, round(avg(tempo), 6) as tempo from k group by 1) using (playlist_id) where r = 1",
       f"k as (select playlist_id, tempo, {_KEY_SQL} as key_mode from members join audio_features using (track_id))")
def _(lib):
    rows = lib.members.join(lib.audio_features, "track_id").withColumn("key_mode", S.key_mode(F.col("key"), F.col("mode")))
    return profile.mode_of(rows, "playlist_id", "key_mode").join(rows.groupBy("playlist_id").agg(F.round(F.avg("tempo"), 6).alias("tempo")), "playlist_id")


@query("d17_fill_rate", "select count(*) as n, count(distinct first_genre) as genres, count(*) - count(first_genre) as missing, round(count(first_genre) / count(*), 6) as fill from tracks")
def _(lib):
    return lib.tracks.agg(F.count("*").alias("n"), F.countDistinct("first_genre").alias("genres"), F.count_if(F.col("first_genre").isNull()).alias("missing"), F.round(F.count("first_genre") / F.count("*"), 6).alias("fill"))


@query("e02_partition_quantile", "select track_id, popularity > quantile_cont(popularity, 0.95) over (partition by genre_cat) as is_top from tracks")
def _(lib):
    limits = lib.tracks.groupBy("genre_cat").agg(F.percentile("popularity", 0.95).alias("limit"))
    return lib.tracks.join(F.broadcast(limits), "genre_cat").select("track_id", (F.col("popularity") > F.col("limit")).alias("is_top"))


@query("e09_union_by_name", "select track_id, first_genre, cast(null as double) as score from tracks union all select track_id, null, score from faves")
def _(lib):
    return lib.tracks.select("track_id", "first_genre").unionByName(lib.faves, allowMissingColumns=True)


@query("e10_set_difference", "select track_id from tracks except select track_id from faves")
def _(lib):
    return lib.tracks.select("track_id").join(lib.faves, "track_id", "left_anti")


# library reports

@query("k04_shared_names", "select track_name, count(distinct track_id) as ids from tracks group by 1 having count(distinct track_id) > 1")
def _(lib):
    return lib.tracks.groupBy("track_name").agg(F.countDistinct("track_id").alias("ids")).filter("ids > 1")


@query("k05_histograms", "select feature, cast(coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * 50), 49), 0) as integer) as bin, count(*) as n from long join (select feature, min(value) as lo, max(value) as hi from long group by 1) using (feature) where value is not null group by 1, 2", LONG)
def _(lib):
    return reports.histogram(lib.audio_features, AUDIO)


@query("k06_keys", f"select {_KEY_SQL} as key_mode, count(*) as n from audio_features group by 1 order by n desc, key_mode limit 15")
def _(lib):
    return lib.audio_features.groupBy(S.key_mode(F.col("key"), F.col("mode")).alias("key_mode")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key_mode").limit(15)


@query("k07_coordinate_coverage", "select genre_source, count(*) as n, round(count(top) * 100 / count(*), 4) as pct from track_genre group by 1")
def _(lib):
    return reports.coverage(_genre(lib), "genre_source", F.col("top").isNotNull())


_Z = " + ".join(f"coalesce(pow((x.{c} - s.m_{c}) / greatest(coalesce(s.s_{c}, 0), 1e-9), 2), 0)" for c in AUDIO)
_DIST = "s as (select playlist_id, " + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in AUDIO) + f" from members join audio_features using (track_id) group by 1), dist as (select m.playlist_id, m.track_id, round(sqrt({_Z}), 6) as distance from members m join audio_features x using (track_id) join s using (playlist_id))"


@query("k09_centroid_outliers", "select playlist_id, track_id, distance, distance > cut as is_outlier from dist join (select playlist_id, quantile_cont(distance, 0.95) as cut from dist group by 1) using (playlist_id)", _DIST)
def _(lib):
    lib.keep("members", "audio_features")
    rows = lib.members.join(lib.audio_features.select("track_id", *AUDIO), "track_id")
    return reports.centroid_outliers(rows, "playlist_id", AUDIO).select("playlist_id", "track_id", "distance", "is_outlier")


@query("k12_embedding_coverage", "select label, count(*) as n, round(count(*) filter (where list_sum(list_transform(embedding, lambda x: abs(x))) > 0) * 100 / count(*), 4) as pct from embeddings group by 1")
def _(lib):
    return reports.coverage(lib.table("embeddings"), "label", F.exists("embedding", lambda x: x != 0))


@query("k13_describe", "select feature, count(value) as n, count(*) - count(value) as nulls, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as low, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as q2, round(quantile_cont(value, 0.75), 6) as q3, round(max(value), 6) as high from long group by 1", LONG)
def _(lib):
    return reports.describe(lib.audio_features, AUDIO)


@query("k15_genre_shares", "select playlist_id, " + ", ".join(f"round(count(*) filter (where gen_8 = 'g8_{i}') / greatest(1, count(gen_8)), 6) as g8_{i}" for i in range(8)) + " from members join track_genre using (track_id) group by 1")
def _(lib):
    return reports.share_pivot(lib.members.join(_genre(lib), "track_id"), "playlist_id", "gen_8", [f"g8_{i}" for i in range(8)])


@query("k17_tag_words", "select tag, count(*) as n from (select unnest(string_split(lower(genre_cat), ' ')) as tag from tracks) where tag <> '' group by 1 order by n desc, tag limit 25")
def _(lib):
    tags = lib.tracks.select(F.explode(F.split(F.lower("genre_cat"), " ")).alias("tag")).filter("tag <> ''")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(25)


@query("k18_most_playlisted", "select track_id, track_name, n from tracks join (select track_id, count(*) as n from playlist_tracks group by 1) using (track_id) order by n desc, track_id limit 20")
def _(lib):
    counts = lib.playlist_tracks.groupBy("track_id").agg(F.count("*").alias("n"))
    return lib.tracks.join(counts, "track_id").select("track_id", "track_name", "n").orderBy(F.desc("n"), "track_id").limit(20)


@query("k20_genre_medians", "select gen_8, " + ", ".join(f"round(median({c}), 4) as {c}" for c in AUDIO) + " from track_genre join audio_features using (track_id) where gen_8 is not null group by 1")
def _(lib):
    out = profile.medians(_genre(lib).join(lib.audio_features, "track_id").filter("gen_8 is not null"), ["gen_8"])
    return out.select("gen_8", *(F.round(c, 4).alias(c) for c in AUDIO))


@query("k21_genre_coverage", "select gen_6, count(*) as n, round(count(tempo) * 100 / count(*), 4) as pct from track_genre left join audio_features using (track_id) group by 1")
def _(lib):
    return reports.coverage(_genre(lib).join(lib.audio_features, "track_id", "left"), "gen_6", F.col("tempo").isNotNull())


@query("k22_density_grid", "select cast(least(floor((top - t0) / nullif(t1 - t0, 0) * 20), 19) as integer) as cx, cast(least(floor((\"left\" - l0) / nullif(l1 - l0, 0) * 20), 19) as integer) as cy, count(*) as n from track_genre, (select min(top) as t0, max(top) as t1, min(\"left\") as l0, max(\"left\") as l1 from track_genre) where top is not null group by 1, 2")
def _(lib):
    return reports.density_grid(_genre(lib), "top", "left")


@query("k24_unmapped_genres", "select first_genre, count(*) as n from tracks where first_genre not in (select first_genre from genre_map) group by 1 order by n desc, first_genre limit 25")
def _(lib):
    loose = lib.tracks.filter("first_genre is not null").join(F.broadcast(lib.genre_map), "first_genre", "left_anti")
    return loose.groupBy("first_genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "first_genre").limit(25)


@query("k25_centroid_distances", "select x.g as a, y.g as b, round(sqrt((x.t - y.t) ** 2 + (x.l - y.l) ** 2), 6) as distance from c x join c y on x.g < y.g", "c as (select gen_8 as g, avg(top) as t, avg(\"left\") as l from track_genre where gen_8 is not null group by 1 having count(*) >= 5 order by count(*) desc, g limit 15)")
def _(lib):
    return reports.centroid_distances(_genre(lib), "gen_8", "top", "left")


@query("k27_zone_sizes", "select x.first_genre as name, count(*) as n from track_genre g join genre_xy x on sqrt((g.top - x.top) ** 2 + (g.\"left\" - x.\"left\") ** 2) <= 1500 group by 1")
def _(lib):
    centres = lib.genre_xy.select(F.col("first_genre").alias("name"), F.col("top").alias("top0"), F.col("left").alias("left0"))
    return retrieval.within_radius(_genre(lib), centres, 1500.0).groupBy("name").agg(F.count("*").alias("n"))


@query("k28_correlation_pairs", "select * from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from audio_features" for i, a in enumerate(AUDIO) for b in AUDIO[i + 1 :]) + ")")
def _(lib):
    return scoring.correlations(lib.audio_features, AUDIO)


@query("k30_faves_by_genre", "select gen_4, count(*) as n, round(avg(fave_score), 6) as fave_score from profile group by 1", _PROFILE_SQL)
def _(lib):
    return _profile(lib).groupBy("gen_4").agg(F.count("*").alias("n"), F.round(F.avg("fave_score"), 6).alias("fave_score"))


@query("k37_row_counts", "select 'tracks' as name, count(*) as n from tracks union all select 'artists', count(*) from artists union all select 'members', count(*) from members union all select 'plays', count(*) from plays")
def _(lib):
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("tracks", lib.tracks).unionAll(count("artists", lib.artists)).unionAll(count("members", lib.members)).unionAll(count("plays", lib.plays))


@query("k38_call_estimate", "select cast(sum(greatest(1, ceil(n / 100))) as bigint) as pages, cast(sum(greatest(1, ceil(n / 50))) as bigint) as small_pages from (select count(*) as n from members group by playlist_id)")
def _(lib):
    sizes = lib.members.groupBy("playlist_id").agg(F.count("*").alias("n"))
    pages = lambda size: F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / size))).cast("long")
    return sizes.agg(pages(100).alias("pages"), pages(50).alias("small_pages"))


# two rankings of each genre's tracks: by popularity and by tempo

_RANKS = "ranks as (select first_genre, track_id, popularity, tempo, row_number() over (partition by first_genre order by popularity desc, track_id) as r0, row_number() over (partition by first_genre order by tempo desc, track_id) as r1 from tracks join audio_features using (track_id) where first_genre is not null and tempo is not null)"


def _rated(lib):
    return lib.tracks.join(lib.audio_features, "track_id").filter("first_genre is not null and tempo is not null").select("first_genre", "track_id", "popularity", "tempo")


@query("k35_rank_shift", "select first_genre, count(*) as n, round(avg(abs(r0 - r1)), 6) as mean_shift, max(r0 - r1) as max_rise, max(r1 - r0) as max_fall, count(*) filter (where r0 = r1) as unchanged from ranks group by 1", _RANKS)
def _(lib):
    rows = _rated(lib)
    place = lambda c: rows.withColumn("rank", F.row_number().over(Window.partitionBy("first_genre").orderBy(F.desc(c), "track_id")))
    return reports.rank_shift(place("popularity"), place("tempo"), "first_genre", "track_id")


@query("j19_spearman", "select first_genre, count(*) as n, round(corr(a, b), 6) as spearman from (select first_genre, rank() over (partition by first_genre order by popularity) + (count(*) over (partition by first_genre, popularity) - 1) / 2 as a, rank() over (partition by first_genre order by tempo) + (count(*) over (partition by first_genre, tempo) - 1) / 2 as b from ranks) group by 1", _RANKS)
def _(lib):
    return reports.rank_correlation(_rated(lib), "first_genre", "popularity", "tempo")


@query("j18_regression_line", "select gen_4, round(regr_slope(fave_score, tempo), 6) as slope, round(regr_intercept(fave_score, tempo), 6) as intercept, round(regr_r2(fave_score, tempo), 6) as r2 from profile where gen_4 is not null group by 1", _PROFILE_SQL)
def _(lib):
    r = lambda f, n: F.round(f("fave_score", "tempo"), 6).alias(n)
    return _profile(lib).filter("gen_4 is not null").groupBy("gen_4").agg(r(F.regr_slope, "slope"), r(F.regr_intercept, "intercept"), r(F.regr_r2, "r2"))


# scored labels: quality against two scores derived from the documents

_SCORED = """scored as (
  select source, doc_id as item, quality as label, 'a' as model, coalesce(n_chars, 0) % 1000 / 1000 as score from documents join labels using (doc_id)
  union all select source, doc_id, quality, 'b', doc_id * 7919 % 1000 / 1000 from documents join labels using (doc_id)
), measured as (
  select source, model, count(*) as n, round(avg(case when (score >= 0.5) = (label = 1) then 1.0 else 0 end), 6) as accuracy,
    round(coalesce(count(*) filter (where label = 1 and score >= 0.5) / nullif(count(*) filter (where score >= 0.5), 0), 0), 6) as precision,
    round(coalesce(count(*) filter (where label = 1 and score >= 0.5) / nullif(count(*) filter (where label = 1), 0), 0), 6) as recall,
    round(coalesce(2 * count(*) filter (where label = 1 and score >= 0.5) / nullif(count(*) filter (where score >= 0.5) + count(*) filter (where label = 1), 0), 0), 6) as f1,
    round((sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2) / nullif(count(*) filter (where label = 1) * count(*) filter (where label <> 1), 0), 6) as roc_auc,
    round(avg(label) filter (where k <= 10), 6) as precision_at_k, round(avg((score - label) ** 2), 4) as brier,
    round(avg(-ln(case when label = 1 then greatest(1e-15, least(1 - 1e-15, score)) else 1 - greatest(1e-15, least(1 - 1e-15, score)) end)), 6) as log_loss
  from (select *, rank() over (partition by source, model order by score) + (count(*) over (partition by source, model, score) - 1) / 2 as r, row_number() over (partition by source, model order by score desc, item) as k from scored)
  group by 1, 2
)"""
_METRICS = ["accuracy", "f1", "roc_auc", "brier", "log_loss"]


def _scored_labels(lib):
    rows = lib.table("documents").select("doc_id", "source", "n_chars").join(lib.table("labels"), "doc_id")
    made = rows.select("source", F.col("doc_id").alias("item"), F.col("quality").alias("label"), (F.coalesce("n_chars", F.lit(0)) % 1000 / 1000).alias("a"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("b"))
    return made.unpivot(["source", "item", "label"], ["a", "b"], "model", "score")


def _measured(lib):
    return scoring.metrics(_scored_labels(lib), ["source", "model"])


@query("j04_metrics", "select * from measured", _SCORED)
def _(lib):
    return _measured(lib)


@query("j06_compare_models", "select metric, count(*) filter (where lead > 0) as wins_a, count(*) filter (where lead < 0) as wins_b, count(*) filter (where lead = 0) as ties, round(avg(va), 5) as mean_a, round(avg(vb), 5) as mean_b, case when wins_a > wins_b then 'a' when wins_b > wins_a then 'b' else 'tie' end as winner from (select x.metric, x.v as va, y.v as vb, (x.v - y.v) * case when x.metric in ('brier', 'log_loss') then -1 else 1 end as lead from l x join l y on x.source = y.source and x.metric = y.metric and x.model = 'a' and y.model = 'b') group by 1",
       _SCORED + ", l as (" + " union all ".join(f"select source, model, '{m}' as metric, {m} as v from measured" for m in _METRICS) + ")")
def _(lib):
    return scoring.compare(_measured(lib), "source", "model", "a", "b", _METRICS)


@query("o09_regression_gate", "select source, metric, x.v as was, y.v as now, case when y.v is null then 'missing' else 'dropped' end as reason from (select * from l where model = 'a') x left join (select * from l where model = 'b') y using (source, metric) where x.v is not null and (y.v is null or x.v - y.v > 0.05)",
       _SCORED + ", l as (" + " union all ".join(f"select source, model, '{m}' as metric, {m} as v from measured" for m in ("accuracy", "f1")) + ")")
def _(lib):
    m = _measured(lib)
    return scoring.regressions(m.filter("model = 'a'"), m.filter("model = 'b'"), "source", ["accuracy", "f1"])


@query("j03_stratified_split")
def _(lib):
    return scoring.stratified_split(lib.table("labels").select("doc_id", "quality"), "quality", "doc_id")


# evaluation of labels in the conversation log: expected is the intent of a conversation's first turn

_EXPECTED = f"{_INTENT}, first as (select conv_id, arg_min(intent, turn) as expected from labelled group by 1), judged as (select expected, intent as predicted, confidence from labelled join first using (conv_id))"


def _judged(lib):
    name, sure = convlog.intent(F.col("text"))
    rows = lib.turns.select("conv_id", "turn", name.alias("predicted"), sure.alias("confidence"))
    return rows.join(rows.groupBy("conv_id").agg(F.min_by("predicted", "turn").alias("expected")), "conv_id")


@query("o01_confusion", "select expected, " + ", ".join(f"count(*) filter (where predicted = '{k}') as {k}" for k in convlog.INTENTS) + " from judged group by 1", _EXPECTED)
def _(lib):
    return scoring.confusion(_judged(lib), list(convlog.INTENTS))


@query("o02_label_f1", "select expected, n, round(2 * tp / (n + coalesce(said, 0)), 6) as f1 from (select expected, count(*) as n, count(*) filter (where predicted = expected) as tp from judged group by 1) left join (select predicted as expected, count(*) as said from judged group by 1) using (expected)", _EXPECTED)
def _(lib):
    return scoring.label_f1(_judged(lib))


@query("o05_tool_correctness", "select user_id as key, len(list_filter(e, lambda x: not list_contains(a, x))) = 0 and (len(e) > 0 or len(a) = 0) as matched, round(case when len(e) = 0 then case when len(a) = 0 then 1 else 0 end else len(list_filter(e, lambda x: list_contains(a, x))) / len(e) end, 6) as correctness from (select user_id, coalesce(list(distinct event_type) filter (where value < 20), []) as e, coalesce(list(distinct event_type) filter (where value >= 60), []) as a from events group by 1)")
def _(lib):
    pick = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    rows = lib.table("events").groupBy(F.col("user_id").alias("key")).agg(pick(F.col("value") < 20).alias("expected"), pick(F.col("value") >= 60).alias("actual"))
    return scoring.tool_scores(rows)
