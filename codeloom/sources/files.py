"""Sources and sinks on file systems that Spark reaches."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.excludes import extension


def list_tree(spark: SparkSession, root: str, exts: tuple | None = None, skip: tuple = ()) -> list[str]:
    """Paths under root, relative to it: names with one of the endings, in no folder of a skipped name.

    Names alone reach the driver, folder by folder, as they do when Spark lists a source. Spark's own listing cannot
    be used: it leaves out names that begin with an underscore or a dot, and so every package's __init__.py.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    top = jvm.Path(root)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [(top, "")]
    while todo:
        folder, inside = todo.pop()
        for status in store.listStatus(folder):
            name = status.getPath().getName()
            if status.isDirectory():
                if name not in skip and not status.isSymlink():
                    todo.append((status.getPath(), f"{inside}{name}/"))
            elif not exts or name.endswith(tuple(exts)):
                found.append(inside + name)
    return sorted(found)


def read_tree(spark: SparkSession, root: str, exts: tuple | None = None, skip: tuple = ()) -> DataFrame:
    """files(path, ext, content) under root (see ``list_tree``). Bytes that are no UTF-8 are dropped, as a tolerant reader
    does. The tasks read the files, from a mounted folder or through Arrow's file systems."""
    paths = list_tree(spark, root, exts, skip)
    uri = root.rstrip("/").removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = (fs.LocalFileSystem(), uri.removeprefix("file:")) if ":" not in uri.removeprefix("file:").split("/")[0] else fs.FileSystem.from_uri(uri)
        for batch in batches:
            names, held, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    names.append(name)
                    held.append(f.read())
                size += len(held[-1])
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held, pa.binary())], names=["path", "content"])
                    names, held, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held, pa.binary())], names=["path", "content"])

    tasks = max(1, min(len(paths) // 64, 4096))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks, "path")
    raw = listed.mapInArrow(run, "path string, content binary")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return raw.select("path", extension(F.col("path")).alias("ext"), text.alias("content"))


def two_versions(base: DataFrame, head: DataFrame) -> DataFrame:
    """files(version, path, ext, content) of two trees in one frame: one job measures both."""
    return base.withColumn("version", F.lit("base")).unionByName(head.withColumn("version", F.lit("head")))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with a fixed schema; a leading byte-order mark is dropped."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json(F.regexp_replace("value", "^﻿", ""), schema).alias("x")).select("x.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """One line per row of a one-column frame."""
    df.write.mode("overwrite").text(path)


def start_checkpoints(spark: SparkSession, path: str) -> None:
    """An empty log; an error if there is one."""
    spark.createDataFrame([], "sha string, subject string").write.mode("error").parquet(path)


def append_checkpoint(spark: SparkSession, path: str, sha: str, subject: str) -> None:
    """The checkpoint log only grows; a revert is a row that names the commit it undoes."""
    spark.createDataFrame([(sha, subject)], "sha string, subject string").write.mode("append").parquet(path)


def revert_checkpoint(spark: SparkSession, path: str, sha: str) -> None:
    append_checkpoint(spark, path, f"undo-{sha}", f"revert: {sha}")


def archive(files: list[tuple[str, bytes]], prefix: str) -> bytes:
    """A zip whose bytes depend on its content alone: sorted names, one date, fixed rights."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files):
            info = zipfile.ZipInfo(f"{prefix}/{name}", (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, data)
    return out.getvalue()


def verify_archive(data: bytes, files: list[tuple[str, bytes]], prefix: str) -> list[str]:
    """Differences between an archive, opened again, and what it should hold."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = {n: hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist()}
    want = {f"{prefix}/{n}": hashlib.sha256(d).hexdigest() for n, d in files}
    return sorted(n for n in found.keys() | want.keys() if found.get(n) != want.get(n))
