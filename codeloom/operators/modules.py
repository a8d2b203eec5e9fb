"""Modules: what JavaScript and TypeScript files import and export, resolved to files of the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import languages

_SPECIFIER = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)(['"])([^'"\n]+)\1"""
_EXPORTED = r"\bexport\s+(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
_NAMES = r"\bimport\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}"


def folded(path: Column) -> Column:
    """A path without . and .. segments; one that climbs out of the tree is null."""
    empty = F.array().cast("array<string>")
    out = F.aggregate(
        F.split(path, "/"), empty,
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(out, "/")


def module_key(path: Column) -> Column:
    """What an import may call a file: its path without the ending, a folder's index by the folder."""
    ends = "|".join(e.replace(".", r"\.") for e in languages.JS_EXTS)
    return F.regexp_replace(F.regexp_replace(path, f"({ends})$", ""), "(^|/)index$", "")


def imports(files: DataFrame) -> DataFrame:
    """path, specifier: every import, re-export and require of a file, once each."""
    found = F.regexp_extract_all("content", F.lit(_SPECIFIER), F.lit(2))
    return files.where(F.col("ext").isin(*languages.JS_EXTS)).select("path", F.explode(F.array_distinct(found)).alias("specifier"))


def import_edges(files: DataFrame) -> DataFrame:
    """src, dst: imports of one file of the tree by another."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    relative = imports(files).where(F.col("specifier").rlike(r"^\.{1,2}(/|$)"))
    wanted = relative.select(F.col("path").alias("src"), module_key(folded(F.concat(folder, "specifier"))).alias("key")).where("key IS NOT NULL")
    known = files.where(F.col("ext").isin(*languages.JS_EXTS)).select(F.col("path").alias("dst"), module_key(F.col("path")).alias("key"))
    return wanted.join(known, "key").select("src", "dst").distinct()


def packages(files: DataFrame) -> DataFrame:
    """key: names of packages that the files import, scopes kept, deeper paths dropped."""
    outside = imports(files).where(~F.col("specifier").rlike(r"^(\.|/|node:)"))
    return outside.select(F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1).alias("key")).distinct()


def dependencies(manifests: DataFrame) -> DataFrame:
    """path, key: packages that package.json files (path, content) ask for at run time."""
    declared = F.map_keys(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>"))
    return manifests.select("path", F.explode(declared).alias("key"))


def exports(files: DataFrame) -> DataFrame:
    """path, key: names that a file exports where it declares them."""
    found = F.regexp_extract_all("content", F.lit(_EXPORTED), F.lit(1))
    return files.where(F.col("ext").isin(*languages.JS_EXTS)).select("path", F.explode(F.array_distinct(found)).alias("key"))


def imported_names(files: DataFrame) -> DataFrame:
    """key: names that some file imports by name."""
    lists = files.where(F.col("ext").isin(*languages.JS_EXTS)).select(F.explode(F.regexp_extract_all("content", F.lit(_NAMES), F.lit(1))).alias("names"))
    one = lists.select(F.explode(F.split("names", ",")).alias("name"))
    return one.select(F.regexp_extract(F.btrim("name"), r"^(?:type\s+)?([\w$]+)", 1).alias("key")).where("key <> ''").distinct()
