"""The corpus pipeline: STAGES in order, each from the documents that the one before kept.

Language identification, near-duplicate removal, benchmark decontamination, mixing to
target weights, sharding. Every stage but the last returns the columns of documents; the last
returns each document's shard and slot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import decontamination, language_id, mixing, near_dup, sharding
from netquarry.llm.common import held_out, packed, removed, row_hash, shared_dir, table

#: Share of the one-versus-rest values from which a language stands out.
LEAST_SCORE = 0.3
#: Near-duplicates, found by SimHash and MinHash, share this part (a fraction) of their five-word shingles: exact Jaccard similarity.
SHINGLE, SIMILARITY = 5, (4, 5)
#: The mixture takes this share of all tokens, each document once at most: with sources of equal size the largest that still reaches the weights.
MIX_SHARE = (6, 10)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in which no language stands out, go.

    Every other row stays as it is, repeated rows and very long texts too, with all columns, whatever their names. With
    no labelled row nothing can be told, and documents with a letter stay. An empty table stays empty.
    """
    model = language_id.train(docs.where(~held_out("doc_id", 4, 2)))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs.select(packed(docs), "text"), model, out_col="language")
    return found.where((F.col("language.lang_pred") != "und") & (F.col("language.score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest id stays, and of repeated rows one. Candidates are the links of the
    texts' SimHash fingerprints, as op7's, and the pairs of MinHash buckets beyond them; an exact check follows both.

    Null ids come last, and of rows with one id the one with the smallest hash over all columns stays. Null texts and
    texts without words are one group; texts are compared whole. Columns stay, whatever their names. An empty table stays empty.
    """
    rows = docs.select(packed(docs), F.col("doc_id").alias("id"), F.col("text").alias("words"), row_hash(docs).alias("mark"), row_hash(docs, F.lit(1)).alias("second"))
    first = near_dup.first_rows(rows, "mark", "id", "words", shingle=SHINGLE, similarity=SIMILARITY).select(F.col("doc_id").alias("kept"), F.col("row_hash").alias("kept_mark"))
    kept = rows.drop("words").join(first, (F.col("mark") == F.col("kept_mark")) & F.col("id").eqNullSafe(F.col("kept")), "left_semi")
    return kept.dropDuplicates(["mark", "second", "id"]).select("row.*")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go.

    All other rows stay as they are, with all columns: null and empty texts hold none, very long ones are searched
    whole, repeated rows go or stay together. An empty table or benchmark drops nothing.
    """
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the tree's budgets take, each row once at most, with all columns, whatever their names.

    Null and blank texts have no tokens and aren't taken; null languages and sources are nodes of their own; repeated rows
    count each. An empty table stays empty.
    """
    return mixing.mixed_rows(docs, share=MIX_SHARE)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row; equal texts (null is one of them) share a shard. An empty table gives an empty result."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The classifier and the fingerprints can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet to the shared folder and read again as the next one's."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            removed(spark, before)
        before = f"{folder}/{name}"
    return docs
