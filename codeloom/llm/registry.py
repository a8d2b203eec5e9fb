"""The queries of the corpus operators: one opN_<name> each, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_model, licenses, line_dedup, media, mixing, near_join, quality_rules, toxicity, warc
from .common import table


def op1_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a Jaccard similarity of 0.8 of five-word shingles, over all documents: class and number of links of each."""
    return near_join.near_classes(table(spark, sf_dir, "documents"))


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of cropped and edited copies among the images drawn from all embeddings."""
    images = media.vector_media(table(spark, sf_dir, "embeddings"))
    return media.copy_classes(images).withColumnRenamed("id", "vec_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the weights of their sources: the words that the mix takes of each."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "quota")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases, and the notices and licenses found, in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of the documents that are not held out; the log10 probability of every document under it."""
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(docs.where(~language_model.held_out(F.col("doc_id"))))
    return language_model.score_documents(docs, model)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and their decoded texts, as digests."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), bpe.default_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document with a smaller id holds, as digests."""
    found = line_dedup.deduped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, cutoffs learnt from the labels."""
    found = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels that are not held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT l.*, s.owner IS NOT NULL AND l.doc_id <> s.owner AS gone FROM keyed l LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8_SQL = r"""
WITH rows AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
owned AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest, n >= 100) AS owner FROM rows)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND owner <> page_id THEN owner END AS refers_to
FROM owned
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_near_join": op1_near_join,
        "op2_image_copies": op2_image_copies,
        "op3_source_mix": op3_source_mix,
        "op4_license_scan": op4_license_scan,
        "op5_language_model": op5_language_model,
        "op6_bpe": op6_bpe,
        "op7_line_dedup": op7_line_dedup,
        "op8_warc": op8_warc,
        "op9_quality_rules": op9_quality_rules,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op8_warc": OP8_SQL}
