"""The driver tables as corpora: documents are files, pages are markup, conversations are two-level paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The language that stands in for each document language.
EXT_OF_LANG = {"en": ".py", "de": ".js", "fr": ".html", "es": ".rs"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, least: int = 4, share: int = 8_000_000) -> DataFrame:
    """The rows dealt evenly over ``least`` tasks a core, or one for each ``share`` bytes if these are more.

    For rows that cost much more than their bytes: a reader cuts a table by its bytes, and a million parts are one
    split or two, however long each takes. Deal out the narrow rows, before texts are spelled from them.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(least * spark.sparkContext.defaultParallelism, -(-size // share)))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(doc_id, path, ext, content): source/doc_id.ext."""
    ext = F.lit(".txt")
    for lang, e in EXT_OF_LANG.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", ext.alias("ext"), F.col("text").alias("content"))
    return docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id", "ext").alias("path"), "ext", "content")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(page_id, path, ext, content): markup with one line per tag."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.lit(".html").alias("ext"),
        F.replace("html", F.lit(">"), F.lit(">\n")).alias("content"),
    )


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.lit(".txt").alias("ext"), F.col("text").alias("content"))
