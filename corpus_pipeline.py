"""A training corpus from raw documents, in five stages: a quality classifier rejects documents, an n-gram join leaves one
document of each group of near duplicates, repeated passages are cut, benchmark passages are cut, and texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Texts
that a stage cuts keep their document, with n_chars counted anew. The second and third stage tell documents apart by
doc_id: documents without one pass these as they are, and those that share one count as documents of their own, later than
all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontaminate, ngram_join, quality, suffix_dedup
from veilframe.llm.common import join_on_id, materialize, remove_path, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _by_key(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage, of rows that have a unique key as doc_id and their id as own_id, and the documents without a doc_id."""
    rows = docs.filter("doc_id is not null").withColumn("own_id", F.col("doc_id"))
    shared = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if shared.limit(1).count():
        shared = materialize(shared, "shared")
        last = rows.agg(F.max("doc_id")).first()[0]
        keyed = join_on_id(rows, shared, "doc_id", "left_semi").withColumn("doc_id", F.lit(last) + 1 + F.monotonically_increasing_id())
        rows = materialize(join_on_id(rows, shared, "doc_id", "left_anti").unionByName(keyed), "keyed")  # so that keys stay
    done = stage(rows).drop("doc_id").withColumnRenamed("own_id", "doc_id")
    return done.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranking of text features scores at or above its threshold stay as they are."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays, as it is."""

    def least(rows: DataFrame) -> DataFrame:
        dropped = ngram_join.similarity_components(rows).filter("doc_id <> component_id").select("doc_id")
        return join_on_id(rows, materialize(dropped, "dropped"), "doc_id", "left_anti")

    return _by_key(docs, least)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings that an earlier document has too are cut."""
    cut = lambda rows: suffix_dedup.remove_repeats(rows, keep=("lang", "source", "own_id"))
    return _by_key(docs, lambda rows: cut(rows).withColumn("n_chars", F.length("text").cast("long")))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of the benchmark are cut."""
    return _documents(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"), keep=("lang", "source")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and text as decoded from the ids."""
    rows = bpe.encode_documents(docs, bpe.default_tokenizer(), "round_trip", keep=("lang", "source"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]
#: Ranking, fixed points over links and tokenisation have no SQL form; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and reread as the next one's docs. What a stage wrote is deleted once the next
    one is through, and what it needed on the way when it is itself."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
        if before:
            remove_path(spark, before)
        before = keep.paths[-1]
    return docs
