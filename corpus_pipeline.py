"""A corpus pipeline of the operators: language ID, exact dedup, n-gram Jaccard join, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import exact_dedup, langid, packing, secrets, set_join
from cadenza.llm.common import fresh, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told (null texts, texts without letters) go; the others get the predicted one
    where theirs is null. A corpus without a single labelled document passes whole, less those."""
    model = langid.fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "__lang"), fresh(docs, "__score")
    found = langid.predict(docs, model, lang_out=lang, score_out=score).filter(F.col(lang) != langid.UNDECIDED)
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z's case) the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at Jaccard 0.8 or more the one with the least doc_id stays."""
    return set_join.one_of_each(docs, k=5, num=4, den=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows where it was given. No document goes."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(kind)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: which piece of which document goes into which bin."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("n-gram Jaccard join", near_duplicates), ("secret scan", secret_scan), ("best-fit packing", pack)]

#: Language ID and the components of near-copies can't be put into SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each stage's rows written as Parquet to the shared folder and read again. A stage's input goes when the
    stage is written; what run() returns stays."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
