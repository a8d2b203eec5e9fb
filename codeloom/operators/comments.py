"""C-family comments: everything outside quotes after // and between /* and */ goes, one block per line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import languages, text

def _closing(line: str, at: int) -> int:
    """Where the quote that opens at ``at`` closes, or -1. A backslash takes the character after it along."""
    quote, at = line[at], at + 1
    while at < len(line):
        if line[at] == quote:
            return at
        at += 2 if line[at] == "\\" else 1
    return -1


def _markers(line: str) -> tuple[int, int]:
    """Places of the first // and the first /* outside quotes; the line's length where there is none."""
    slashes = block = len(line)
    at = 0
    while at < len(line) and slashes == len(line):
        c = line[at]
        if c in "'\"" and (end := _closing(line, at)) > 0:
            at = end
        elif line.startswith("//", at):
            slashes = at
        elif line.startswith("/*", at):
            block = min(block, at)
        at += 1
    return slashes, block


def strip_line(line: str, inside: bool) -> tuple[str, bool]:
    """The line without comments, and whether a block stays open."""
    if inside:
        _, closed, line = line.partition("*/")
        if not closed:
            return "", True
    if "/" not in line:
        return line, False
    slashes, block = _markers(line)
    code = line[:slashes]
    if block >= slashes:
        return code, False
    _, closed, rest = code[block + 2 :].partition("*/")
    return code[:block] + rest, not closed


def strip_all(lines: list[str]) -> list[str]:
    out, inside = [], False
    for line in lines:
        line, inside = strip_line(line, inside)
        out.append(line)
    return out


def strip_c_comments(files: DataFrame) -> DataFrame:
    """path, lines: C-family files without comments, others as they are. Only files with a marker go through Python."""

    @F.pandas_udf("array<string>")
    def stripped(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: strip_all(list(x)))

    lines = text.split_lines(F.col("content"))
    commented = F.col("ext").isin(*languages.C_FAMILY) & (F.col("content").contains("//") | F.col("content").contains("/*"))
    marked = files.select("path", lines.alias("lines"), F.coalesce(commented, F.lit(False)).alias("c"))
    return marked.where("NOT c").select("path", "lines").unionByName(
        marked.where("c").select("path", stripped("lines").alias("lines"))
    )
