"""One query for each corpus operator, with production parameters and over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import ann, decontamination, fill_in_middle, language_id, language_model, license_scan, line_dedup, mixing, prefix_trie, quality, sharding, simhash, warc
from netquarry.llm.common import cut, held_out, removed, shared_dir, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each document row; null texts and texts without a letter are ``und`` with score 0. Other cases as in ``language_id.identify``; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model).select("doc_id", "held_out", "language.lang_pred", "language.score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: the 20 nearest of each row whose id is divisible by 20. Unsound vectors take no part; cases as in ``ann.search``."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, domain, language, origin, tokens, budget, epoch``: a row for each time that a document is taken; cases as in ``mixing.mix``."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each document row; a null or empty text is one empty line. Cases as in ``line_dedup.drop_shared_lines``."""
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each page row, from archives written, read back and then deleted. Cases as in ``warc.write_archives``."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = cut(warc.page_records(spark, path))
    removed(spark, path)
    return found


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each document row under the law ``bytes``; cases as in ``sharding.shard``."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each document row; texts without words have fingerprint zero. Cases as in ``simhash.simhash_components``."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document row, null and empty texts too; without labels the score is 0.5. Cases as in ``quality.scored``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), quality.document_statistics(F.col("text").cast("binary")).alias("features"))
    docs = cut(docs)
    model = quality.train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document row; a null text is empty: the end alone. Cases as in ``language_model.scored``."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 7, 2))
    model, counts = language_model.train(docs.where(~F.col("held_out")))
    return language_model.scored(docs, model, counts, keep=("held_out",))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id, distance`` for each document row and benchmark item that it holds; clean documents have no row. Cases as in ``decontamination.benchmark_hits``."""
    return decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row for each node of the trie of rebuilt conversations.

    Rows without a conv_id are left out; null roles and texts are empty; null turns come first, ties by role and text; repeated rows are turns of their own. Other cases as in ``prefix_trie``."""
    turns, convs = prefix_trie.forked(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of each document row; cases as in ``fill_in_middle.fill_in_middle``."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = fill_in_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each document row; without places the labels are empty and the words null. Cases as in ``license_scan.license_places``."""
    found = license_scan.license_places(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts, labels = F.transform(base, lambda p: p["first_word"]), lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_nearest_neighbours, op3_mixing, op4_line_dedup, op5_warc, op6_sharding, op7_simhash_near_dedup, op8_quality_classifier, op9_lm_scoring, op10_decontamination, op11_prefix_trie, op12_fill_in_middle, op13_license_scan)}


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.oracle_sql(), "op4_line_dedup": OP4_SQL, "op11_prefix_trie": prefix_trie.oracle_sql(), "op12_fill_in_middle": fill_in_middle.oracle_sql()}
