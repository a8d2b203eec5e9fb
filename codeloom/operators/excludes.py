"""Path predicates: extensions, skipped directories, exclude patterns in two dialects.

Patterns are turned into one regular expression on the driver, so an exclude is a filter that moves
down to the scan; there is no join with a pattern table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.languages import SKIP_DIRS


def glob_regex(pattern: str, segment: bool = False) -> str:
    """A glob as a regular expression. segment: * stops at a slash and ** crosses it; otherwise * crosses too."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*" if segment else ".*")
        elif c == "?":
            out.append("[^/]" if segment else ".")
        elif c == "[" and not segment and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body.startswith('!') else body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def exclude_regex(patterns: list[str], dialect: str = "python") -> str | None:
    """One expression for all patterns, matched against the whole path.

    python: * crosses slashes; dir/** takes dir itself too; a pattern without a slash matches any one segment;
    leading dots and slashes of pattern and path do not count. segment: * stops at slashes, only ** crosses;
    the segment rule holds for patterns without a star.
    """
    parts = []
    for raw in patterns:
        if dialect == "segment":
            p = raw.removeprefix("./")
            parts.append(glob_regex(p, segment=True))
            if p.endswith("/**"):
                parts.append(glob_regex(p[:-3], segment=True))
            if "/" not in p and "*" not in p:
                parts.append(f"(?:.*/)?{re.escape(p)}(?:/.*)?")
            continue
        p = raw.replace("\\", "/").lstrip("./")
        parts.append(glob_regex(p))
        if p.endswith("/**"):
            parts.append(glob_regex(p[:-3]))
        if "/" not in p:
            parts.append(f"(?:.*/)?{glob_regex(p).replace('.*', '[^/]*')}(?:/.*)?")
    return f"^(?:{'|'.join(parts)})$" if parts else None


def excluded(path: Column, patterns: list[str], dialect: str = "python") -> Column:
    found = exclude_regex(patterns, dialect)
    if found is None:
        return F.lit(False)
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    plain = F.regexp_replace(plain, r"^\./" if dialect == "segment" else r"^[./]+", "")
    return plain.rlike(f"(?s){found}")


def skipped(path: Column, names: tuple = SKIP_DIRS, dotted: bool = True) -> Column:
    """Whether a directory of the path is one that scans skip, or begins with a dot."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = (lambda d: d.isin(*names) | (d.startswith(".") & ~d.isin(".", ".."))) if dotted else (lambda d: d.isin(*names))
    return F.exists(dirs, hidden)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def scan(
    files: DataFrame, exts: tuple, patterns: list[str] = (), dialect: str = "python", single_file: bool = False, apply_excludes: bool = True,
    skip: tuple = SKIP_DIRS, dotted: bool = True,
) -> DataFrame:
    """The files that a scan takes. A single-file target is not pruned; whether it is excluded is the scan's choice."""
    exts = tuple(e if e.startswith(".") else "." + e for e in exts)
    kept = files.where(F.col("ext").isin(*exts))
    if not single_file:
        kept = kept.where(~skipped(F.col("path"), skip, dotted))
    if apply_excludes or not single_file:
        kept = kept.where(~excluded(F.col("path"), list(patterns), dialect))
    return kept
