"""All registered queries of the engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import convlog, features, merge, profile, retrieval
from ..operators.storage import cut
from ..sources.domain import AUDIO, KEYS, SQL, Library

_QUERIES: dict[str, Callable[[Library], DataFrame]] = {}
_SQL: dict[str, str] = {}
AS_OF_YEAR = 2026
SIMILARITY = [*AUDIO, "popularity", "top", "left", "fave_score"]


def query(name: str, sql: str = "", with_: str = ""):
    def add(f: Callable[[Library], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = f"with {SQL}{', ' + with_ if with_ else ''} {sql}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Library(spark, sf_dir))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _genre(lib: Library) -> DataFrame:
    return profile.track_genre(lib.tracks, lib.genre_map, lib.genre_xy)


def _profile(lib: Library) -> DataFrame:
    return profile.track_profile(lib.tracks, lib.audio_features, _genre(lib), lib.faves)


def _corpus(lib: Library) -> DataFrame:
    """The imputed tracks, made once for all uses in a query."""
    if "_corpus" not in lib.__dict__:
        lib.keep("tracks", "audio_features", "track_artists")
        lib.__dict__["_corpus"] = cut(features.impute(cut(_profile(lib)), lib.track_artists))
    return lib.__dict__["_corpus"]


_KEY_SQL = f"coalesce(list_extract([{', '.join(repr(k) for k in KEYS)}], case when key >= 0 then key + 1 end) || ' ' || list_extract(['Minor', 'Major'], mode + 1), '')"
_RING_SQL = "case %s " + " ".join(f"when '{k}' then {v}" for k, v in S.RING.items()) + " end"
_PROFILE_SQL = """
profile as (
  select t.*, """ + ", ".join(f"a.{c}" for c in AUDIO) + """, a.features_source, a.key, a.mode, a.duration_ms, g.gen_4, g.gen_6, g.gen_8, g.top, g."left", g.genre_source, coalesce(f.score, 0.0) as fave_score
  from tracks t left join audio_features a using (track_id) left join track_genre g using (track_id) left join faves f using (track_id)
)"""  # fmt: skip


# scalar functions

@query("b01_year", "select track_id, try_cast(substr(release_date, 1, 4) as integer) as year, (try_cast(substr(release_date, 1, 4) as integer) // 10 * 10) || 's' as decade from tracks")
def _(lib):
    year = S.year_of(F.col("release_date"))
    return lib.tracks.select("track_id", year.alias("year"), S.decade_of(year).alias("decade"))


@query("b03_key_mode", f"select track_id, {_KEY_SQL} as key_mode from audio_features")
def _(lib):
    return lib.audio_features.select("track_id", S.key_mode(F.col("key"), F.col("mode")).alias("key_mode"))


@query("b04_list_items", "select track_id, array_to_string(list_filter(list_transform(string_split('[''' || track_name || ''', ' || genre_cat || ', ]', ','), lambda x: trim(regexp_replace(x, '[\\[\\]''\"]', '', 'g'))), lambda x: x <> ''), '|') as items from tracks")
def _(lib):
    text = F.concat(F.lit("['"), "track_name", F.lit("', "), "genre_cat", F.lit(", ]"))
    return lib.tracks.select("track_id", F.array_join(S.list_items(text), "|").alias("items"))


@query("b05_number_in", "select track_id, try_cast(regexp_extract(coalesce(first_genre, ''), '(\\d+\\.?\\d*)', 0) as double) as number from tracks")
def _(lib):
    return lib.tracks.select("track_id", S.number_in(F.coalesce("first_genre", F.lit(""))).alias("number"))


@query("b06_genre_tag", "select conv_id, turn, " + "".join(f"case when contains(lower(text), '{g}') then '{g}' else " for g in reversed(S.GENRES)) + "null" + " end" * len(S.GENRES) + " as tag from turns")
def _(lib):
    return lib.turns.select("conv_id", "turn", S.genre_tag(F.col("text")).alias("tag"))


@query("b07_slug", "select track_id, regexp_replace(replace(lower(track_name), ' ', '_'), '[^a-z0-9_]', '', 'g') as slug from tracks")
def _(lib):
    return lib.tracks.select("track_id", S.slug(F.col("track_name")).alias("slug"))


@query("b08_key_distance", f"select track_id, coalesce(least(d, 24 - d, 6), 6) as distance from (select track_id, abs({_RING_SQL % 'k'} - 4) as d from (select track_id, {_KEY_SQL} as k from audio_features))")
def _(lib):
    return lib.audio_features.select("track_id", S.key_distance(S.key_mode(F.col("key"), F.col("mode")), F.lit("C Minor")).alias("distance"))


@query("b09_tempo_compatible", "select track_id, abs(tempo - 160) <= 5 or abs(tempo - 320) <= 5 or abs(tempo - 80) <= 5 as fits, abs(tempo - 160) as deviation from audio_features where tempo is not null")
def _(lib):
    return lib.audio_features.filter("tempo is not null").select("track_id", S.tempo_compatible(F.col("tempo"), F.lit(160.0)).alias("fits"), F.abs(F.col("tempo") - 160).alias("deviation"))


@query("b11_one_hot", "select track_id, array_to_string(list_transform(['g4_0', 'g4_1', 'g4_2', 'g4_3'], lambda v: case when v = gen_4 then '1' else '0' end), '') as hot from track_genre")
def _(lib):
    hot = S.one_hot(F.col("gen_4"), [f"g4_{i}" for i in range(4)])
    return _genre(lib).select("track_id", F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query("b12_min_max", "select track_id, round(case when hi > lo then (popularity - lo) / (hi - lo) else 0 end, 6) as scaled from tracks, (select min(popularity) as lo, max(popularity) as hi from tracks)")
def _(lib):
    bounds = lib.tracks.agg(F.min("popularity").alias("lo"), F.max("popularity").alias("hi")).withColumn("one", F.lit(1))
    rows = lib.tracks.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one")
    return rows.select("track_id", F.round(S.min_max(F.col("popularity"), F.col("lo"), F.col("hi")), 6).alias("scaled"))


@query("b17_track_uri", "select track_id, 'spotify:track:' || track_id as uri from tracks")
def _(lib):
    return lib.tracks.select("track_id", S.track_uri(F.col("track_id")).alias("uri"))


# joins

@query("c01_track_profile", "select * exclude (" + ", ".join(AUDIO) + "), " + ", ".join(f"round({c}, 6) as {c}" for c in AUDIO) + " from profile", _PROFILE_SQL)
def _(lib):
    return _profile(lib)


@query("c04_missing_audio", "select track_id from tracks where track_id not in (select track_id from audio_features)")
def _(lib):
    return lib.tracks.join(lib.audio_features, "track_id", "left_anti").select("track_id")


@query("c05_first_artist", "select t.track_id, coalesce(a.artist_name, '') as artist_name from tracks t left join (select track_id, arg_min(artist_name, artist_id) as artist_name from track_artists join artists using (artist_id) group by 1) a using (track_id)")
def _(lib):
    first = lib.track_artists.join(lib.artists, "artist_id").groupBy("track_id").agg(F.min_by("artist_name", "artist_id").alias("artist_name"))
    return lib.tracks.select("track_id").join(first, "track_id", "left").select("track_id", F.coalesce("artist_name", F.lit("")).alias("artist_name"))


@query("c08_radius", "select x.first_genre as name, g.track_id, round(sqrt((g.top - x.top) ** 2 + (g.\"left\" - x.\"left\") ** 2), 6) as enoa_distance from track_genre g join genre_xy x on sqrt((g.top - x.top) ** 2 + (g.\"left\" - x.\"left\") ** 2) <= 500")
def _(lib):
    centres = lib.genre_xy.select(F.col("first_genre").alias("name"), F.col("top").alias("top0"), F.col("left").alias("left0"))
    return retrieval.within_radius(_genre(lib), centres, 500.0).select("name", "track_id", F.round("enoa_distance", 6).alias("enoa_distance"))


# aggregates

_MEDIANS = ", ".join(f"round(median({c}), 4) as {c}" for c in AUDIO)


@query("d01_artist_medians", f"select artist_id, {_MEDIANS} from audio_features join track_artists using (track_id) where features_source = 'spotify' group by 1")
def _(lib):
    out = profile.medians(lib.audio_features.filter("features_source = 'spotify'").join(lib.track_artists, "track_id"), ["artist_id"])
    return out.select("artist_id", *(F.round(c, 4).alias(c) for c in AUDIO))


@query("d02_genre_medians", f"select first_genre, {_MEDIANS} from audio_features join tracks using (track_id) where first_genre is not null group by 1")
def _(lib):
    out = profile.medians(lib.audio_features.join(lib.tracks, "track_id").filter("first_genre is not null"), ["first_genre"])
    return out.select("first_genre", *(F.round(c, 4).alias(c) for c in AUDIO))


@query("d03_global_medians", "select " + ", ".join(f"round(coalesce(median({c}), 0), 4) as {c}" for c in AUDIO) + " from audio_features")
def _(lib):
    return features.overall_medians(lib.audio_features, AUDIO).select(*(F.round(c, 4).alias(c) for c in AUDIO))


@query("d04_track_genre", "select * from track_genre")
def _(lib):
    return _genre(lib)


_MODE = "(select {by}, {v} from (select {by}, {v}, row_number() over (partition by {by} order by count(*) desc, {v}) as k from grouped where {v} is not null group by {by}, {v}) where k = 1)"


def _group_sql(members: str, by: str) -> tuple[str, str]:
    modes = " ".join(f"left join {_MODE.format(by=by, v=v)} using ({by})" for v in ("gen_4", "gen_6", "gen_8"))
    top = f"(select {by}, string_agg(first_genre, ',' order by n desc, first_genre) as top_genres from (select {by}, first_genre, count(*) as n, row_number() over (partition by {by} order by count(*) desc, first_genre) as k from grouped where first_genre is not null group by 1, 2) where k <= 5 group by 1)"
    return f"select * from (select {by}, round(avg(top), 6) as top, round(avg(\"left\"), 6) as \"left\", count(*) as track_count from grouped group by 1) {modes} left join {top} using ({by})", f"grouped as (select * from {members} join track_genre using (track_id))"


@query("d06_artist_genre", *_group_sql("track_artists", "artist_id"))
def _(lib):
    return profile.group_profile(lib.track_artists, _genre(lib), "artist_id")


@query("d07_playlist_genre", *_group_sql("members", "playlist_id"))
def _(lib):
    return profile.group_profile(lib.members, _genre(lib), "playlist_id")


@query("d08_n_playlists", "select track_id, count(*) as n_playlists from playlist_tracks group by 1")
def _(lib):
    return lib.playlist_tracks.groupBy("track_id").agg(F.count("*").alias("n_playlists"))


@query("d09_playlist_diversity", "select track_id, count(distinct o_orderstatus) as diversity from playlist_tracks join orders on playlist_id = o_orderkey group by 1")
def _(lib):
    labels = lib.table("orders").select(F.col("o_orderkey").alias("playlist_id"), "o_orderstatus")
    return lib.playlist_tracks.join(labels, "playlist_id").groupBy("track_id").agg(F.countDistinct("o_orderstatus").alias("diversity"))


@query("d10_centroid", "select playlist_id, " + ", ".join(f"round(avg({c}), 8) as {c}" for c in AUDIO) + " from members join audio_features using (track_id) group by 1")
def _(lib):
    return lib.members.join(lib.audio_features, "track_id").groupBy("playlist_id").agg(*(F.round(F.avg(c), 8).alias(c) for c in AUDIO))


@query("d16_source_counts", "select genre_source, count(*) as n from track_genre group by 1")
def _(lib):
    return _genre(lib).groupBy("genre_source").agg(F.count("*").alias("n"))


@query("d19_genre_pivot", "select playlist_id, " + ", ".join(f"round(count(*) filter (where gen_4 = 'g4_{i}') / greatest(1, count(gen_4)), 6) as g4_{i}" for i in range(4)) + " from members join track_genre using (track_id) group by 1")
def _(lib):
    names = [f"g4_{i}" for i in range(4)]
    counts = lib.members.join(_genre(lib), "track_id").groupBy("playlist_id").pivot("gen_4", names).agg(F.count("track_id")).fillna(0)
    total = F.greatest(F.lit(1), sum((F.col(c) for c in names), F.lit(0)))
    return counts.select("playlist_id", *(F.round(F.col(c) / total, 6).alias(c) for c in names))


# feature matrix

_IMPUTED = (
    "am as (select artist_id, " + ", ".join(f"median({c}) as {c}" for c in AUDIO) + " from audio_features join track_artists using (track_id) group by 1), "
    "ta as (select track_id, " + ", ".join(f"arg_min({c}, artist_id) filter (where {c} is not null) as a_{c}" for c in AUDIO) + " from track_artists join am using (artist_id) group by 1), "
    "gm as (select first_genre, true as g_any, " + ", ".join(f"median({c}) as g_{c}" for c in AUDIO) + " from audio_features join tracks using (track_id) where first_genre is not null group by 1), "
    "om as (select " + ", ".join(f"coalesce(median({c}), 0) as o_{c}" for c in AUDIO) + " from audio_features), "
    "imputed as (select track_id, " + ", ".join(f"coalesce({c}, a_{c}, g_{c}, o_{c}) as {c}" for c in AUDIO) + ", case when "
    + " and ".join(f"{c} is not null" for c in AUDIO) + " then features_source when " + " or ".join(f"({c} is null and a_{c} is not null)" for c in AUDIO)
    + " then 'imputed_artist' when g_any and (" + " or ".join(f"coalesce({c}, a_{c}) is null" for c in AUDIO) + ") then 'imputed_genre' when "
    + " or ".join(f"coalesce({c}, a_{c}, g_{c}) is null" for c in AUDIO) + " then 'imputed_global' else features_source end as features_source, popularity, top, \"left\", fave_score "
    "from profile left join ta using (track_id) left join gm using (first_genre), om)"
)


@query("f01_impute", "select track_id, features_source, " + ", ".join(f"round({c}, 4) as {c}" for c in AUDIO) + " from imputed", f"{_PROFILE_SQL}, {_IMPUTED}")
def _(lib):
    return features.impute(_profile(lib), lib.track_artists).select("track_id", "features_source", *(F.round(c, 4).alias(c) for c in AUDIO))


@query("f02_collaborative", "select track_id, coalesce(n, 0.0) as n_playlists, coalesce(k, 0.0) as playlist_diversity from tracks left join (select track_id, cast(count(*) as double) as n, cast(count(distinct o_orderstatus) as double) as k from playlist_tracks join orders on playlist_id = o_orderkey group by 1) using (track_id)")
def _(lib):
    labels = lib.table("orders").select(F.col("o_orderkey").alias("playlist_id"), F.col("o_orderstatus").alias("label"))
    return features.collaborative(lib.tracks, lib.playlist_tracks, labels).select("track_id", "n_playlists", "playlist_diversity")


@query(
    "f03_temporal",
    "select track_id, round(coalesce((year - y0) / nullif(y1 - y0, 0), case when year is not null and y1 = y0 then 0 end, 0.5), 6) as year_normalized, round(coalesce((duration_ms - d0) / nullif(d1 - d0, 0), 0.5), 6) as duration_ms_normalized, "
    f"cast(coalesce({AS_OF_YEAR} - year, mid, 0) as double) as years_since_release from y, (select min(year) as y0, max(year) as y1, min(duration_ms) as d0, max(duration_ms) as d1, median({AS_OF_YEAR} - year) as mid from y)",
    _PROFILE_SQL + ", y as (select *, try_cast(substr(release_date, 1, 4) as integer) as year from profile)",
)
def _(lib):
    out = features.temporal(_profile(lib).withColumn("year", S.year_of(F.col("release_date"))), AS_OF_YEAR)
    return out.select("track_id", F.round("year_normalized", 6).alias("year_normalized"), F.round("duration_ms_normalized", 6).alias("duration_ms_normalized"), "years_since_release")


# retrieval and recommendation

_DOT = lambda a, b: " + ".join(f"coalesce({a}.{c if c != 'left' else chr(34) + 'left' + chr(34)}, 0) * coalesce({b}.{c if c != 'left' else chr(34) + 'left' + chr(34)}, 0)" for c in SIMILARITY)
_SCORED = f"scored as (select r.track_id as request_id, c.track_id, round(greatest(0, least(1, ({_DOT('c', 'r')}) / (sqrt({_DOT('c', 'c')}) * sqrt({_DOT('r', 'r')})))), 9) as score from imputed c, imputed r where r.track_id % 100 = 0)"


def _scored(lib: Library, k: int) -> DataFrame:
    """Seeds are the tracks whose id is divisible by 100."""
    corpus = _corpus(lib)
    seeds = corpus.filter("track_id % 100 = 0").withColumn("request_id", F.col("track_id"))
    return retrieval.similar(corpus, seeds, SIMILARITY, k)


@query("g01_topk_similar", "select request_id, rank, track_id, round(score, 6) as score from (select *, row_number() over (partition by request_id order by score desc, track_id) as rank from scored) where rank <= 10", f"{_PROFILE_SQL}, {_IMPUTED}, {_SCORED}")
def _(lib):
    return _scored(lib, 10).select("request_id", "rank", "track_id", F.round("score", 6).alias("score"))


@query(
    "i04_cluster_diverse",
    "select request_id, track_id, cluster_id from (select *, row_number() over (partition by request_id order by case when place > 1 then 1 else 0 end, score desc, track_id) as pick from (select *, row_number() over (partition by request_id, cluster_id order by score desc, track_id) as place from (select *, track_id % 8 as cluster_id, row_number() over (partition by request_id order by score desc, track_id) as rank from scored) where rank <= 100)) where pick <= 10",
    f"{_PROFILE_SQL}, {_IMPUTED}, {_SCORED}",
)
def _(lib):
    scored = _scored(lib, 100).withColumn("cluster_id", F.col("track_id") % 8)
    return retrieval.cluster_diverse(scored, 10, 8).select("request_id", "track_id", "cluster_id")


@query("i08_results", "select request_id, rank, 'spotify:track:' || track_id as uri, coalesce(track_name, cast(track_id as varchar)) as name from (select *, row_number() over (partition by request_id order by score desc, track_id) as rank from scored) join tracks using (track_id) where rank <= 5", f"{_PROFILE_SQL}, {_IMPUTED}, {_SCORED}")
def _(lib):
    named = _scored(lib, 5).join(lib.tracks.select("track_id", "track_name"), "track_id")
    return named.select("request_id", "rank", S.track_uri(F.col("track_id")).alias("uri"), F.coalesce("track_name", F.col("track_id").cast("string")).alias("name"))


# reports

@query("k01_null_report", "select column_name as column, count(*) filter (where v is null) as nulls, round(count(*) filter (where v is null) * 100 / count(*), 4) as pct from (" + " union all ".join(f"select '{c}' as column_name, {c} as v from audio_features" for c in AUDIO) + ") group by 1")
def _(lib):
    return profile.null_report(lib.audio_features.select(*AUDIO))


@query("k08_outliers", "select feature, round(q1, 6) as q1, round(q3, 6) as q3, count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers, round(count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) * 100 / count(*), 4) as pct from long join (select feature, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from long group by 1) using (feature) group by feature, q1, q3",
       "long as (select * from (" + " union all ".join(f"select '{c}' as feature, {c} as v from audio_features" for c in AUDIO) + ") where v is not null)")
def _(lib):
    return profile.outlier_bounds(lib.audio_features, AUDIO)


@query("k10_hierarchy", "select gen_4, gen_6, gen_8, count(*) as n from track_genre group by all")
def _(lib):
    return _genre(lib).groupBy("gen_4", "gen_6", "gen_8").agg(F.count("*").alias("n"))


@query("k11_decades", "select (try_cast(substr(release_date, 1, 4) as integer) // 10 * 10) || 's' as decade, count(*) as n, round(median(popularity), 6) as popularity from tracks group by 1")
def _(lib):
    return lib.tracks.groupBy(S.decade_of(S.year_of(F.col("release_date"))).alias("decade")).agg(F.count("*").alias("n"), F.round(F.median("popularity"), 6).alias("popularity"))


@query("k14_playlist_sizes", "select playlist_id, count(*) as n from members group by 1")
def _(lib):
    return lib.members.groupBy("playlist_id").agg(F.count("*").alias("n"))


@query("k16_artist_stats", "select artist_id, count(distinct track_id) as tracks, count(distinct playlist_id) as playlists from track_artists join playlist_tracks using (track_id) group by 1 order by tracks desc, artist_id limit 30")
def _(lib):
    rows = lib.track_artists.join(lib.playlist_tracks, "track_id")
    return rows.groupBy("artist_id").agg(F.countDistinct("track_id").alias("tracks"), F.countDistinct("playlist_id").alias("playlists")).orderBy(F.desc("tracks"), "artist_id").limit(30)


@query("k19_genre_five_numbers", "select first_genre, round(min(popularity), 6) as low, round(quantile_cont(popularity, 0.25), 6) as q1, round(quantile_cont(popularity, 0.5), 6) as q2, round(quantile_cont(popularity, 0.75), 6) as q3, round(max(popularity), 6) as high from tracks group by 1")
def _(lib):
    return profile.five_numbers(lib.tracks, "first_genre", "popularity")


@query("k23_jaccard", "select a.playlist_id as a, b.playlist_id as b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) as jaccard from s a join s b using (name) join n x on x.playlist_id = a.playlist_id join n y on y.playlist_id = b.playlist_id group by 1, 2",
       "s as (select distinct playlist_id, first_genre as name from members join tracks using (track_id) where first_genre is not null), n as (select playlist_id, count(*) as n from s group by 1)")
def _(lib):
    return profile.jaccard_matrix(lib.members.join(lib.tracks, "track_id"), "playlist_id", "first_genre")


@query("k28_correlations", "select round(corr(danceability, valence), 6) as dance_valence, round(corr(energy, loudness), 6) as energy_loudness, round(corr(tempo, acousticness), 6) as tempo_acousticness from audio_features")
def _(lib):
    pair = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return lib.audio_features.agg(pair("danceability", "valence", "dance_valence"), pair("energy", "loudness", "energy_loudness"), pair("tempo", "acousticness", "tempo_acousticness"))


# merges: the old snapshot is the tracks with even ids, the new one those with ids divisible by 3 and other names

_OLD_NEW = "old as (select track_id, track_name, first_genre from tracks where track_id % 2 = 0), new as (select track_id, 'new ' || track_name as track_name, case when track_id % 5 > 0 then 'x' end as first_genre from tracks where track_id % 3 = 0)"


def _old_new(lib: Library) -> tuple[DataFrame, DataFrame]:
    t = lib.tracks.select("track_id", "track_name", "first_genre")
    new = t.filter("track_id % 3 = 0").select("track_id", F.concat(F.lit("new "), "track_name").alias("track_name"), F.when(F.col("track_id") % 5 > 0, "x").alias("first_genre"))
    return t.filter("track_id % 2 = 0"), new


@query("l01_insert_if_absent", "select * from old union all select * from new where track_id not in (select track_id from old)", _OLD_NEW)
def _(lib):
    return merge.insert_if_absent(*_old_new(lib), ["track_id"])


@query("l02_upsert", "select track_id, case when n.track_id is not null then n.track_name else o.track_name end as track_name, coalesce(n.first_genre, o.first_genre) as first_genre from old o full join new n using (track_id)", _OLD_NEW)
def _(lib):
    return merge.upsert(*_old_new(lib), ["track_id"], overwrite=["track_name"], if_given=["first_genre"])


@query("l03_replace_rows", "select * from new union all select * from old where track_id not in (select track_id from new)", _OLD_NEW)
def _(lib):
    return merge.replace_rows(*_old_new(lib), ["track_id"])


@query("l05_sync_members", "select playlist_id, track_id, case when playlist_id not like '1%' then removed_at when s.track_id is not null then null else coalesce(removed_at, '2026-01-01') end as removed_at from o full join s using (playlist_id, track_id)",
       "o as (select playlist_id, track_id, case when track_id % 10 = 1 then '2025-01-01' end as removed_at from members where track_id % 3 <> 2), s as (select playlist_id, track_id from members where track_id % 3 > 0 and playlist_id like '1%')")
def _(lib):
    old = lib.members.filter("track_id % 3 <> 2").withColumn("removed_at", F.when(F.col("track_id") % 10 == 1, "2025-01-01"))
    snapshot = lib.members.filter("track_id % 3 > 0 and playlist_id like '1%'")
    return merge.sync_members(old, snapshot, lib.members.select("playlist_id").filter("playlist_id like '1%'"), "2026-01-01")


# conversation logs and play events

_COUNTS = ", ".join(f"({' + '.join('cast(contains(lower(text), ' + chr(39) + k.replace(chr(39), chr(39) * 2) + chr(39) + ') as integer)' for k in keys)}) as {name}" for name, keys in convlog.INTENTS.items())
_INTENT = f"counted as (select conv_id, turn, {_COUNTS} from turns), labelled as (select conv_id, turn, case " + "when m = 0 then 'artist_info' " + " ".join(f"when {k} = m then '{k}'" for k in convlog.INTENTS) + f" end as intent, case when m = 0 then 0.3 else least(1.0, m / 3) end as confidence from (select *, greatest({', '.join(convlog.INTENTS)}) as m from counted))"


@query("m01_intent", "select conv_id, turn, intent, round(cast(confidence as double), 6) as confidence from labelled", _INTENT)
def _(lib):
    name, sure = convlog.intent(F.col("text"))
    return lib.turns.select("conv_id", "turn", name.alias("intent"), F.round(sure, 6).alias("confidence"))


@query("m07_route", "select conv_id, turn, case when intent <> 'chit_chat' and confidence < 0.4 then 'clarify' else 'rewrite' end as route from labelled", _INTENT)
def _(lib):
    return lib.turns.select("conv_id", "turn", convlog.route(*convlog.intent(F.col("text"))).alias("route"))


@query("m08_trim_history", "select conv_id, turn, role from (select *, min(case when role = 'user' then turn end) over (partition by conv_id) as first from (select *, row_number() over (partition by conv_id order by turn desc) as k from turns) where k <= 20) where turn >= first")
def _(lib):
    return convlog.trim_history(lib.turns).select("conv_id", "turn", "role")


@query("m11_stalls", "select conv_id, any_value(role) as role, min(turn) as start, count(*) as length from (select *, sum(fresh) over (partition by conv_id order by turn) as run from (select *, case when role is distinct from lag(role) over (partition by conv_id order by turn) then 1 else 0 end as fresh from turns)) group by conv_id, run having count(*) >= 2")
def _(lib):
    return convlog.stalls(lib.turns)


@query("n01_recently_played", "select user_id, rank, event_id, item from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from plays) where rank <= 50")
def _(lib):
    return convlog.recently_played(lib.plays)


_TOP = "select user_id, item, plays, row_number() over (partition by user_id order by plays desc, item) as rank from (select user_id, item, count(*) as plays from {} group by 1, 2) qualify rank <= {}"
_RECENT = "recent as (select * from plays where ts > (select max(ts) from plays) - interval 7 days)"


@query("n02_top_items", _TOP.format("plays", 20))
def _(lib):
    return convlog.top_items(lib.plays, 20)


@query("n03_taste_drift", "select user_id, item, case when s.rank is not null and l.rank is not null then 'stable' when s.rank is not null then 'new' else 'fading' end as kind from s full join l using (user_id, item)", f"{_RECENT}, s as ({_TOP.format('recent', 10)}), l as ({_TOP.format('plays', 10)})")
def _(lib):
    return convlog.taste_drift(convlog.top_items(lib.plays, 10, 7), convlog.top_items(lib.plays, 10))
