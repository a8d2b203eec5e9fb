"""Reports: sections out of Markdown, batches, comment upsert, a self-contained page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name and color of the tiers' badges.
TIERS = {1: ("Tier 1", "#1a7f37"), 2: ("Tier 2", "#9a6700"), 3: ("Tier 3", "#cf222e")}


def section_bullets(lines: DataFrame, heading: str) -> DataFrame:
    """lines(doc, line_no, line) -> doc, line_no, item, reason: bullets under the heading, up to the next heading of its level.

    The section is carried forward by a running maximum inside the document.
    """
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").startswith("## "), F.struct("line_no", F.trim(F.substr("line", F.lit(4))).alias("title")))
    placed = lines.select("doc", "line_no", "line", F.max(mark).over(order)["title"].alias("title"))
    bullets = placed.where((F.lower("title") == heading.lower()) & F.col("line").rlike(r"^\s*[-*] "))
    body = F.regexp_replace("line", r"^\s*[-*]\s+", "")
    parts = F.split(body, " — ", 2)
    return bullets.select("doc", "line_no", F.trim(F.get(parts, F.lit(0))).alias("item"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("reason"))


def frontmatter(lines: DataFrame) -> DataFrame:
    """lines(doc, line_no, line) -> doc, name, has_description of the header between the first two --- lines; block scalars count."""
    order = Window.partitionBy("doc").orderBy("line_no")
    fences = F.sum((F.trim("line") == "---").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    header = lines.withColumn("fences", fences).where((F.col("fences") == 1) & (F.trim("line") != "---"))
    following = F.lead("line").over(order)
    own = header.withColumn("next", following)
    value = F.trim(F.regexp_extract("line", r"^\w+:(.*)$", 1))
    block = value.rlike(r"^[|>][+-]?$")
    described = F.col("line").startswith("description:") & F.when(block, F.coalesce(F.col("next").rlike(r"^\s+\S"), F.lit(False))).otherwise(value != "")
    named = F.when(F.col("line").startswith("name:"), F.regexp_replace(value, r"""^['"]|['"]$""", ""))
    return own.groupBy("doc").agg(F.max(named).alias("name"), F.max(described).alias("has_description"))


def contract_fault(header) -> str | None:
    """Why a package cannot be published: its manual's header must have a name of plain characters and a description."""
    if header is None:
        return "no header between two --- lines"
    if not header["name"]:
        return "the header has no name"
    if not re.fullmatch(r"[A-Za-z0-9._-]+", header["name"]):
        return f"the name has characters that are not allowed: {header['name']!r}"
    return None if header["has_description"] else "the header has no description"


def batches(rows: DataFrame) -> DataFrame:
    """rows(content): a list, or an object with ``batches`` -> sha, category, tier, summary, verification of its objects."""
    doc = F.try_parse_json("content")
    entries = F.coalesce(F.try_variant_get(doc, "$.batches", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    found = rows.select(F.posexplode(entries).alias("i", "raw")).where(F.schema_of_variant("raw").startswith("OBJECT"))
    field = lambda n, k="string": F.try_variant_get("raw", f"$.{n}", k).alias(n)
    return found.select("i", field("sha"), field("category"), field("tier", "int"), field("summary"), field("verification"))


def not_touched(rows: DataFrame) -> DataFrame:
    """rows(content) -> item, reason of a plan's notTouched list: strings, or objects under either spelling."""
    doc = F.try_parse_json("content")
    found = rows.select(F.explode(F.try_variant_get(doc, "$.notTouched", "array<variant>")).alias("raw"))
    field = lambda n: F.try_variant_get("raw", f"$.{n}", "string")
    plain = F.when(~F.schema_of_variant("raw").startswith("OBJECT"), F.try_variant_get("raw", "$", "string"))
    return found.select(
        F.coalesce(field("item"), field("name"), plain).alias("item"), F.coalesce(field("reason"), field("why"), F.lit("")).alias("reason")
    ).where("item IS NOT NULL")


def upsert_comments(state: DataFrame, events: DataFrame, marker: str) -> DataFrame:
    """id, body, action after events(seq, body): one comment with the marker, holding the last marked body.

    state(id, body). Events without the marker do nothing. The oldest marked comment is updated, younger
    ones are deleted, none means one is created (id null). Comments without the marker stay as they are.
    """
    marked = state.where(F.col("body").contains(marker))
    keep = marked.agg(F.min("id").alias("keep"))
    last = events.where(F.col("body").contains(marker)).agg(F.max(F.struct("seq", "body")).alias("x")).select(F.col("x.body").alias("new"))
    joined = state.crossJoin(keep).crossJoin(last)  # one row each
    is_marked = F.col("body").contains(marker)
    action = (
        F.when(~is_marked | F.col("new").isNull(), "keep").when(F.col("id") > F.col("keep"), "delete")
        .when(F.col("body") == F.col("new"), "keep").otherwise("update")
    )
    old = joined.select("id", F.when(action == "update", F.col("new")).otherwise(F.col("body")).alias("body"), action.alias("action"))
    made = last.crossJoin(keep).where("keep IS NULL AND new IS NOT NULL").select(F.lit(None).cast("long").alias("id"), F.col("new").alias("body"), F.lit("create").alias("action"))
    return old.unionByName(made)


def last_per_key(events: DataFrame, key: str, order: str, *payload: str) -> DataFrame:
    """The last event per key: an upsert by key. One partially aggregated shuffle, no window over a hot key."""
    return events.groupBy(key).agg(F.max(F.struct(order, *payload)).alias("x")).select(key, "x.*")


def tier_badge(tier: Column) -> Column:
    found = F.struct(F.concat(F.lit("Tier "), F.coalesce(tier.cast("string"), F.lit("?"))).alias("name"), F.lit("#57606a").alias("color"))
    for t, (name, color) in TIERS.items():
        found = F.when(tier == t, F.struct(F.lit(name).alias("name"), F.lit(color).alias("color"))).otherwise(found)
    return found


# ---------------------------------------------------------------- page (driver side, small frames)


def _number(value, digits: int = 0) -> str:
    return "—" if value is None else f"{value:,.{digits}f}"


def _badge(before, after) -> str:
    if before is None or after is None or not before:
        return '<span class="flat">no baseline</span>'
    kind = "flat" if after == before else "good" if after < before else "bad"
    return f'<span class="{kind}">{(after - before) / before * 100:+.1f}%</span>'


def _bar(label: str, before, after, full: int = 380) -> str:
    top = max(before or 0, after or 0, 1)
    rows = ""
    for y, (name, v) in enumerate((("before", before), ("after", after))):
        width = max(2, round((v or 0) / top * full))
        rows += f'<rect x="90" y="{20 + 22 * y}" width="{width}" height="16" class="{name}"/><text x="{96 + width}" y="{33 + 22 * y}">{_number(v)}</text>'
    return f'<svg width="{full + 180}" height="70" role="img" aria-label="{html.escape(label)}"><text x="0" y="14">{html.escape(label)}</text>{rows}</svg>'


def page(metrics: Iterable, batch_rows: Iterable, untouched: Iterable, places: Iterable, title: str, cap: int = 40) -> str:
    """A self-contained page from collected rows: metrics(metric, base, head), batches, items left alone, places."""
    metrics, places = list(metrics), list(places)
    cards = "".join(
        f'<div class="card"><h3>{html.escape(m["metric"])}</h3><b>{_number(m["head"])}</b> <small>was {_number(m["base"])}</small> {_badge(m["base"], m["head"])}</div>'
        for m in metrics
    )
    bars = "".join(_bar(m["metric"], m["base"], m["head"]) for m in metrics)
    name = lambda t: TIERS.get(t, (f"Tier {t}", "#57606a"))
    table = "".join(
        f'<tr><td><code>{html.escape(str(b["sha"] or ""))}</code></td><td>{html.escape(b["category"] or "")}</td><td style="color:{name(b["tier"])[1]}">{name(b["tier"])[0]}</td>'
        f'<td>{html.escape(b["summary"] or "")}</td><td>{html.escape(b["verification"] or "")}</td></tr>'
        for b in batch_rows
    )
    left = "".join(f'<li>{html.escape(u["item"])}{" — " + html.escape(u["reason"]) if u["reason"] else ""}</li>' for u in untouched)
    spots = "".join(f'<li><code>{html.escape(p["path"])}:{p["line"]}</code></li>' for p in places[:cap])
    more = f"<p>and {len(places) - cap} more</p>" if len(places) > cap else ""
    style = (
        "body{font:15px system-ui;margin:2em auto;max-width:60em}.card{display:inline-block;padding:1em;margin:.4em;border:1px solid #d0d7de}"
        ".good{color:#1a7f37}.bad{color:#cf222e}.flat{color:#57606a}rect.before{fill:#afb8c1}rect.after{fill:#0969da}td{padding:.2em .6em}"
    )
    return (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>'
        f"{cards}{bars}<h2>Batches</h2><table>{table}</table><h2>Left alone</h2><ul>{left}</ul><h2>Duplicates</h2><ul>{spots}</ul>{more}</body></html>"
    )
