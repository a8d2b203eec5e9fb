"""Text primitives as column expressions. Regular expressions follow Unicode classes, as Python's do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """Evaluate value once and hand it to use as a lambda variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_lines(content: Column) -> Column:
    """Lines under universal newlines; a trailing newline opens no further line."""
    parts = F.split(F.coalesce(content, F.lit("")), r"\r\n|\r|\n", -1)
    # bound, so that the split runs once
    return bind(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


#: Unicode white space.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Strip, and make every run of white space one space."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def mask_literals(text: Column) -> Column:
    """Quoted strings become STR, then whole numbers and decimals NUM."""
    return F.regexp_replace(F.regexp_replace(text, r"""(['"]).*?\1""", "STR"), r"(?U)\b\d+(\.\d+)?\b", "NUM")


def normalized(line: Column, mask: bool = False) -> Column:
    found = squeeze(line)
    return mask_literals(found) if mask else found


def path_key(path: Column) -> Column:
    """Forward slashes, no leading ./, case folded (sharp s as ss)."""
    slashed = F.replace(F.btrim(path), F.lit("\\"), F.lit("/"))
    return F.replace(F.lower(F.regexp_replace(slashed, r"^(\./)+", "")), F.lit("ß"), F.lit("ss"))


def block_key(entry: Column) -> Column:
    """path:line in its canonical form; a path alone stays one."""
    text = F.btrim(entry)
    tail = F.regexp_extract(text, r"^(.*):([^/:]*)$", 2)
    has_line = F.element_at(F.split(text, "/"), -1).contains(":")
    keyed = F.concat(path_key(F.regexp_extract(text, r"^(.*):([^:]*)$", 1)), F.lit(":"), F.btrim(tail))
    return F.when(text == "", F.lit(None)).when(has_line, keyed).otherwise(path_key(text))


def identifier(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\W", "_")


def display_path(path: Column, cwd: str) -> Column:
    root = cwd.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def pipe_escape(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def percent_delta(before: Column, after: Column) -> Column:
    """Percent of change; null for a missing or zero base."""
    return F.when(before != 0, (after - before) / before * 100)


def delta_label(before: Column, after: Column, zero: str) -> Column:
    """Signed percent with one decimal, halves to the even digit; ``zero`` where there is no base to compare with."""
    percent = percent_delta(before, after)
    digits = F.replace(F.format_number(F.abs(percent), 1), F.lit(","), F.lit(""))
    return F.when(percent.isNull(), F.lit(zero)).otherwise(F.concat(F.when(percent < 0, "-").otherwise("+"), digits, F.lit("%")))


def verdict(before: Column, after: Column, lower_is_better: bool = True) -> Column:
    good = after < before if lower_is_better else after > before
    return F.when(before.isNull() | after.isNull(), F.lit(None)).when(before == after, "neutral").when(good, "good").otherwise("bad")


def bar_width(value: Column, largest: Column, full: int = 380) -> Column:
    return F.greatest(F.lit(2), F.round(value / F.greatest(largest, F.lit(1)) * full)).cast("int")
