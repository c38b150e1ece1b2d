"""The operators over their whole tables, as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, exact_dedup, html_text, langid, line_dedup, odd_sketch, packing, ppm, runs, secrets, set_join
from .common import crc_mod, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_decisions(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), k=5, num=85, den=100)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_html_extraction, op3_line_dedup, op4_byte_bpe, op5_ngram_jaccard_join, op6_nearest_neighbours, op7_lm_scoring, op8_exact_dedup, op9_secret_scan, op10_language_id,
    op11_periodic_runs, op12_minhash_near_dedup, op13_cross_tokenizer_alignment,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components_sql(k: int) -> str:
    """Sets of k-word shingles that link at 85 of 100, and their components."""
    return rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents
), shingles as (
  select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < {k} then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i+{k - 1}], ' ')) end) as s from w
), sized as (
  select doc_id, len(s) as n, s from shingles
), tokens as (
  select doc_id, n, t, row_number() over (partition by doc_id order by f, t) as p
  from (select doc_id, n, t, count(*) over (partition by t) as f from (select doc_id, n, unnest(s) as t from sized))
), pairs as (
  select distinct a.doc_id as a, b.doc_id as b from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id
    and a.p <= a.n - ceil(0.85 * a.n) + 1 and b.p <= b.n - ceil(0.85 * b.n) + 1 and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links as (
  select p.a, p.b from (select a, b, len(list_intersect(x.s, y.s)) as i, x.n + y.n as m from pairs join sized x on x.doc_id = a join sized y on y.doc_id = b) p where 100 * i >= 85 * (m - i)
), both_ways as (
  select a, b from links union select b, a from links
), reach as (
  select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join both_ways l on l.a = r.other
)
select s.doc_id, s.n as n_shingles, r.component_id, coalesce(l.n_links, 0) as n_links
from sized s join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)
left join (select a as doc_id, count(*) as n_links from both_ways group by a) l using (doc_id)
"""


ORACLE_SQL = {
    "op3_line_dedup": rf"""
with lines as (
  select doc_id, line - 1 as line, list_sort(list_distinct(list_filter(regexp_split_to_array(parts[line], '[\x20\x09-\x0D]+'), lambda w: w <> ''))) as words
  from (select doc_id, string_split({_LOWER}, chr(10)) as parts from documents), unnest(range(1, len(parts) + 1)) as u(line)
), sets as (
  select row_number() over (order by doc_id, line) as s, words, len(words) as n, doc_id, line
  from (select words, doc_id, line, row_number() over (partition by words order by doc_id, line) as k from lines where len(words) > 0) where k = 1
), tokens as (
  select s, n, w, row_number() over (partition by s order by f, w) as p
  from (select s, n, w, count(*) over (partition by w) as f from (select s, n, unnest(words) as w from sets))
), pairs as (
  select distinct a.s as a, b.s as b
  from tokens a join tokens b on a.w = b.w and a.s < b.s and a.p <= a.n - ceil(0.8 * a.n) + 1 and b.p <= b.n - ceil(0.8 * b.n) + 1 and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), near as (
  select distinct p.b as s from pairs p join sets x on x.s = p.a join sets y on y.s = p.b
  where 5 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n - len(list_intersect(x.words, y.words)))
), judged as (
  select l.doc_id, l.line, (s.s in (select s from near) or (l.doc_id, l.line) <> (s.doc_id, s.line)) as gone
  from lines l join sets s on s.words = l.words where len(l.words) > 0
)
select d.doc_id, count(j.line) as n_lines, count(*) filter (where j.gone) as n_removed, coalesce(string_agg(j.line, ',' order by j.line) filter (where j.gone), '') as removed
from documents d left join judged j using (doc_id) group by d.doc_id
""",
    "op5_ngram_jaccard_join": _components_sql(4),
    "op12_minhash_near_dedup": f"select doc_id, n_shingles, component_id, doc_id = component_id as kept from ({_components_sql(5)})",
    "op8_exact_dedup": f"""
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from (select doc_id, sha256({_LOWER}) as text_sha256 from documents) window g as (partition by text_sha256)
""",
}
