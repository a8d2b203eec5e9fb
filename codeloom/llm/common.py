"""What the corpus operators share: the shared folder, written tables, text primitives."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
#: The same as a Java character class.
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets one of its own; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: the driver and the executors have no folder in common")
        found = os.path.join(tempfile.gettempdir(), "codeloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives lost executors. ``sweep`` deletes what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete all that ``written`` wrote so far, once results have been used or stored. Returns the number of folders."""
    n = 0
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())
        n += 1
    return n


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def local_path(uri: str) -> str | None:
    """The mounted path behind a URI, or None for a store that only Spark or Arrow reaches."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return parts.path
    return None


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast byte path; the rest is mapped code point by code point."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def blank_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks; null and blank texts have none."""
    body = blank_trim(F.coalesce(text, F.lit("")))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK_RUN))


def bind(value: Column, use) -> Column:
    """Evaluate value once and hand it to use as a lambda variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_key(text: Column) -> Column:
    """A 64-bit digest that tells apart rows which repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
