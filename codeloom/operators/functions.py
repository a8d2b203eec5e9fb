"""Functions of a corpus: files(path, ext, content) -> one row per function.

Syntax trees live and die inside an Arrow batch; what leaves it are flat rows. A file that does not parse gives
one row with ``error`` set, never a failed job. Files of other languages do not enter Python at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import languages
from codeloom.operators import duplicates, pyast
from codeloom.sources.checkpoints import written

PY = "path string, function string, line int, end_line int, body_start int, complexity int, params array<string>, arguments string, is_method boolean, error string"
JS = "path string, function string, line int, end_line int, complexity int, params array<string>, error string"
JS_SHAPES = JS + ", n_lines int, fingerprint string"
JS_BLOCKS = JS_SHAPES + ", tokens array<string>"

_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _rows(files: DataFrame, schema: str, analyse) -> DataFrame:
    fields = [x.split(" ") for x in schema.split(", ")]
    arrow = pa.schema([(n, _KINDS[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, error = analyse(content or "")
                out += [{"path": path, **r} for r in found]
                if error is not None:
                    out.append({"path": path, "error": error})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def python_functions(files: DataFrame) -> DataFrame:
    return _rows(files.where(F.col("ext") == ".py"), PY, pyast.functions)


def js_functions(files: DataFrame, canonical: bool = False, blocks: bool = False, tokens: bool = True) -> DataFrame:
    """blocks: with shapes, and their tokens if wanted; without, the narrow form that builds none."""

    def analyse(source: str):
        from codeloom.jsast import shapes

        return shapes.analyze(source, canonical, blocks, tokens)

    schema = (JS_BLOCKS if tokens else JS_SHAPES) if blocks else JS
    return _rows(files.where(F.col("ext").isin(*languages.JS_EXTS)), schema, analyse)


def complexity(files: DataFrame) -> DataFrame:
    """path, function, line, complexity of both languages."""
    cols = ("path", "function", "line", "complexity")
    both = python_functions(files).where("error IS NULL").select(*cols)
    return both.unionByName(js_functions(files).where("error IS NULL").select(*cols))


def parse_errors(files: DataFrame) -> DataFrame:
    cols = ("path", "error")
    both = python_functions(files).where("error IS NOT NULL").select(*cols)
    return both.unionByName(js_functions(files).where("error IS NOT NULL").select(*cols))


def complexity_totals(rows: DataFrame, *by: str) -> DataFrame:
    """functions, total_complexity, avg_complexity (2 decimals), max_complexity; zeros for none."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("functions"),
        F.coalesce(F.sum("complexity"), F.lit(0)).cast("long").alias("total_complexity"),
        F.coalesce(F.round(F.avg("complexity"), 2), F.lit(0.0)).alias("avg_complexity"),
        F.coalesce(F.max("complexity"), F.lit(0)).cast("int").alias("max_complexity"),
    )


def most_complex(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.orderBy(F.desc("complexity"), "path", "line").limit(n)


def over_threshold(rows: DataFrame, threshold: int = 10) -> DataFrame:
    return rows.where(F.col("complexity") > threshold)


def structural_blocks(files: DataFrame, canonical: bool = False, min_lines: int = 5, tokens: bool = True) -> DataFrame:
    return js_functions(files, canonical, blocks=True, tokens=tokens).where(F.col("error").isNull() & (F.col("n_lines") >= min_lines))


def clusters_of(blocks: DataFrame) -> DataFrame:
    """fingerprint, n, path, line, function (the first member's) of shapes found more than once."""
    return blocks.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line", "function")).alias("at")
    ).where("n > 1").select("fingerprint", "n", "at.*")


def near_pairs_of(blocks: DataFrame, cap: int = 4000, least: float = 0.85) -> DataFrame:
    """Similar shapes of the budget's pairs: bigram Dice over the shape's tokens, in first-seen order."""
    texts = blocks.select("path", "line", F.col("fingerprint").alias("h"), F.array_join("tokens", "\x1f").alias("block"))
    pairs = duplicates.capped_pairs(texts, cap, inclusive=False, extra=_counted)
    near = duplicates.scored(pairs.where(duplicates.close_lengths(F.size("a_t"), F.size("b_t"))))
    return near.where(F.col("ratio") >= least).select(F.round("ratio", 2).alias("ratio"), "a_path", "a_line", "b_path", "b_line")


def _counted(texts: DataFrame) -> DataFrame:
    """Tokens and bigrams once per shape, not once per pair."""
    return texts.withColumn("t", F.split("block", "\x1f")).withColumn("g", duplicates.numbered_bigrams(F.col("t")))


def structural_clusters(files: DataFrame, canonical: bool = False, min_lines: int = 5) -> DataFrame:
    return clusters_of(structural_blocks(files, canonical, min_lines, tokens=False))


def structural_near_pairs(files: DataFrame, canonical: bool = False, min_lines: int = 5, cap: int = 4000, least: float = 0.85) -> DataFrame:
    """Files are parsed once: the shapes are written before they are numbered and paired."""
    return near_pairs_of(written(structural_blocks(files, canonical, min_lines), "shapes"), cap, least)
