"""Line inventory: files(path, ext, content) -> code, blank and comment counts.

The comment state of a file is folded inside its row, so the inventory is a narrow
projection: no line is exploded and nothing is shuffled until the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import languages, text


# What a line is, as bits of one number.
BLANK, OPENS, ENDS, ENDS_AFTER, REMARK = (1 << i for i in range(5))


def line_bits(lines: Column, marker: Column, start: Column, end: Column) -> Column:
    """For each line: blank, starts a block, holds a block's end, holds one after its first marker, starts with the line marker.

    Lines are stripped in a pass of their own: a column expression that is used twice inside a lambda runs twice.
    """
    none = F.lit("\0")  # a marker that no line has
    marker, start, end = (F.coalesce(x, none) for x in (marker, start, end))
    has = lambda test, bit: F.when(test, bit).otherwise(0)

    def bits(line: Column) -> Column:
        opens = line.startswith(start)
        after = F.when(opens, F.substr(line, F.length(start) + 1).contains(end)).otherwise(False)
        full = has(opens, OPENS) + has(line.contains(end), ENDS) + has(after, ENDS_AFTER) + has(line.startswith(marker), REMARK)
        return F.when(line == "", BLANK).otherwise(full)

    return F.transform(F.transform(lines, text.strip), bits)


def fold_lines(lines: Column, marker: Column, start: Column, end: Column) -> Column:
    """(block, code, blank, comment) after the last line. First rule that holds: blank, in a block, block start, marker, code."""
    zero = F.struct(*[F.lit(0).alias(x) for x in ("block", "code", "blank", "comment")])

    def step(acc: Column, line: Column) -> Column:
        bit = lambda b: line.bitwiseAND(b) != 0
        one = lambda c: c.cast("int")
        inside = acc["block"] == 1
        block = F.when(inside, one(~bit(ENDS))).otherwise(one(bit(OPENS) & ~bit(ENDS_AFTER)))
        remark = inside | (line.bitwiseAND(OPENS | REMARK) != 0)
        return (
            F.when(line == BLANK, F.struct(acc["block"].alias("block"), acc["code"].alias("code"), (acc["blank"] + 1).alias("blank"), acc["comment"].alias("comment")))
            .otherwise(
                F.struct(block.alias("block"), (acc["code"] + one(~remark)).alias("code"), acc["blank"].alias("blank"), (acc["comment"] + one(remark)).alias("comment"))
            )
        )

    return F.aggregate(line_bits(lines, marker, start, end), zero, step)


def inventory(files: DataFrame) -> DataFrame:
    """path, ext, code, blank, comment, total of every file."""
    ext = F.col("ext")
    counts = fold_lines(
        text.split_lines(F.col("content")), languages.line_marker(ext), languages.block_start(ext), languages.block_end(ext)
    )
    found = files.select("path", "ext", counts.alias("n"))
    return found.select(
        "path", "ext", *[F.col(f"n.{x}").cast("long").alias(x) for x in ("code", "blank", "comment")],
        (F.col("n.code") + F.col("n.blank") + F.col("n.comment")).cast("long").alias("total"),
    )


COUNTS = ("code", "blank", "comment", "total")


def totals(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in COUNTS], F.count(F.lit(1)).alias("files")
    )


def largest(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("code"), "path").limit(n)


def snapshot(counts: DataFrame) -> DataFrame:
    """One row: per_file (a map of counts) and totals, as the snapshot file has them. For trees of a size that a file holds."""
    entry = F.struct(*COUNTS)
    return counts.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", entry)))).alias("per_file"),
        F.struct(*[F.sum(x).alias(x) for x in COUNTS], F.count(F.lit(1)).alias("files")).alias("totals"),
    )


def totals_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta, percent (0.0 for a zero base) of two one-row totals."""
    names = (*COUNTS, "files")

    def melted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias(name)) for m in names])).alias("x")).select("x.*")

    both = melted(before, "before").join(melted(after, "after"), "metric", "full")
    return both.select(
        "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"),
        F.round(F.coalesce(text.percent_delta(F.col("before"), F.col("after")), F.lit(0.0)), 1).alias("percent"),
    )
