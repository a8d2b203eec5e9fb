"""Change plans: validation, conflicts, groups that can run side by side.

changes(plan_order, id, tier, category, files, cluster, targets, est): files and blocks in canonical keys.
Conflicts are equi-joins on exploded keys; only changes that share a key ever meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import block_key, path_key
from codeloom.sources.checkpoints import written

CHANGE = (
    "plan_order long, id string, tier int, category string, files array<string>, cluster array<string>, targets array<string>, "
    "est long, description string"
)


def read_plan(plans: DataFrame) -> DataFrame:
    """plans(plan, content) -> plan, index, raw (VARIANT): one row per entry of ``changes``, an array or an object keyed by id.

    A byte-order mark is dropped. A document that is no JSON, or has no changes, gives no rows.
    """
    text = F.regexp_replace("content", "^﻿", "")
    doc = F.try_parse_json(text)
    body = F.coalesce(F.try_variant_get(doc, "$.changes", "variant"), doc)
    as_list = F.try_variant_get(body, "$", "array<variant>")
    as_map = F.try_variant_get(body, "$", "map<string,variant>")
    # one pass: a document is parsed once, whichever of the two it is
    entry = lambda i, key, raw: F.struct((i + 1).alias("index"), key.cast("string").alias("key"), raw.alias("raw"))
    listed = F.transform(as_list, lambda v, i: entry(i, F.lit(None), v))
    mapped = F.transform(F.map_entries(as_map), lambda e, i: entry(i, e["key"], e["value"]))
    return plans.select("plan", F.explode(F.coalesce(listed, mapped)).alias("x")).select("plan", "x.index", "x.key", "x.raw")


def _strings(value: Column) -> Column:
    """A scalar or a list as a list of strings; a block object as path:line."""
    one = lambda v: F.coalesce(
        F.concat(F.try_variant_get(v, "$.path", "string"), F.coalesce(F.concat(F.lit(":"), F.try_variant_get(v, "$.line", "string")), F.lit(""))),
        F.try_variant_get(v, "$", "string"),
    )
    many = F.try_variant_get(value, "$", "array<variant>")
    listed = F.transform(many, one)
    single = one(value)
    return F.coalesce(listed, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))


def changes_of(entries: DataFrame) -> DataFrame:
    """Typed changes of ``read_plan`` rows, usable ones and others alike; ``valid`` tells which are usable."""
    field = lambda name, kind: F.try_variant_get("raw", f"$.{name}", kind)
    is_object = F.schema_of_variant("raw").startswith("OBJECT")
    tier_kind = F.schema_of_variant(field("tier", "variant"))
    block = lambda *names: F.array_distinct(
        F.filter(F.transform(_strings(F.coalesce(*[field(n, "variant") for n in names])), block_key), lambda x: x.isNotNull())
    )
    rows = entries.select(
        "plan", F.col("index").cast("long").alias("plan_order"),
        F.coalesce(field("id", "string"), "key", F.col("index").cast("string")).alias("id"),
        F.when(tier_kind == "BIGINT", field("tier", "int")).alias("tier"),
        F.coalesce(field("category", "string"), F.lit("?")).alias("category"),
        F.filter(F.transform(_strings(field("files", "variant")), path_key), lambda p: p != "").alias("files"),
        block("duplicateCluster", "duplicate_cluster").alias("cluster"),
        block("target", "targetBlock", "target_block").alias("targets"),
        F.coalesce(field("estLinesSaved", "long"), field("est_lines_saved", "long")).alias("est"),
        F.coalesce(field("description", "string"), field("summary", "string"), F.lit("")).alias("description"),
        is_object.alias("is_object"),
    )
    return rows.withColumn("valid", F.col("is_object") & F.col("tier").isNotNull())


def plan_errors(changes: DataFrame) -> DataFrame:
    """plan, plan_order, error: entries that are no objects, tiers that are no integers, ids that come again."""
    bad = changes.where("NOT valid").select(
        "plan", "plan_order",
        F.when(~F.col("is_object"), F.format_string("change #%d: not an object", "plan_order"))
        .otherwise(F.format_string("change %s: tier must be an integer", "id")).alias("error"),
    )
    good = changes.where("valid")
    first = good.groupBy("plan", "id").agg(F.min("plan_order").alias("first"))
    again = good.join(first, ["plan", "id"]).where("plan_order > first").select(
        "plan", "plan_order", F.format_string("change id %s appears twice (#%d and #%d)", "id", "first", "plan_order").alias("error")
    )
    return bad.unionByName(again)


def duplicate_ids(changes: DataFrame) -> DataFrame:
    return changes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blind_spots(changes: DataFrame) -> DataFrame:
    """Tier-1 changes that declare no cluster: copies of each other cannot be told for them."""
    return changes.where((F.col("tier") == 1) & (F.size("cluster") == 0))


def deferred(changes: DataFrame) -> DataFrame:
    reason = F.when(
        F.col("tier") != 1,
        F.concat(F.lit("tier "), "tier", F.lit(" is never parallelized (parallel execution is scoped to tier 1)")),
    ).when(F.size("files") == 0, "no files declared: independence cannot be proven, so it runs serially")
    return changes.withColumn("reason", reason).where("reason IS NOT NULL")


def candidates(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("tier") == 1) & (F.size("files") > 0))


def _meetings(changes: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """a, b, rule, shared: each way in which change a stands in conflict with a later change b, and so some pairs more than once.

    Files, clusters (2) and targets (3) are exploded once, and one join pairs them: files meet files (1), blocks blocks.
    """

    def marked(column: str, role: int) -> Column:
        return F.transform(F.array_distinct(column), lambda k: F.struct(F.lit(role).alias("role"), k.alias("shared")))

    roles = F.array(marked("files", 1), marked("cluster", 2), marked("targets", 3))
    keys = changes.select("plan_order", F.explode(F.flatten(F.array_compact(roles))).alias("x")).where("x.shared IS NOT NULL")
    side = lambda df, name, role: df.select(F.col("plan_order").alias(name), F.col("x.role").alias(role), (F.col("x.role") == 1).alias("is_file"), F.col("x.shared").alias("shared"))
    last = keys if later is None else keys.join(later.select("plan_order"), "plan_order", "left_semi")
    pairs = side(keys, "a", "ra").join(side(last, "b", "rb"), ["is_file", "shared"]).where("a < b AND ra + rb < 6")
    return pairs.select("a", "b", F.greatest("ra", "rb").alias("rule"), "shared")


def conflicts(changes: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """a, b (a before b in plan order), rule (1 file, 2 cluster, 3 target in cluster), shared (smallest key): one row per pair.

    A pair's lowest rule names it, with that rule's smallest shared key. A key that very many changes share
    makes as many pairs: they are the result. later(plan_order): the changes wanted as b, else all.
    """
    best = _meetings(changes, later).groupBy("a", "b").agg(F.min(F.struct("rule", "shared")).alias("x"))
    return best.select("a", "b", "x.rule", "x.shared")


def reason(rule: Column, shared: Column) -> Column:
    head = F.when(rule == 1, "same file: ").when(rule == 2, "duplicate cluster overlap: ").otherwise(
        "target block is inside the other change's duplicate cluster: "
    )
    return F.concat(head, shared)


def groups(changes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """plan_order, color: first-fit in plan order over the conflict graph.

    The color of a change depends on earlier neighbours alone. A change without one has color 1; the others pass one
    task in plan order, each with its earlier neighbours, which holds their numbers and colors and no edges.
    """
    own = written(candidates(changes).select("plan_order", "files", "cluster", "targets"), "plan-candidates")
    edges = (_meetings(own) if edges is None else edges).select(F.col("a").cast("long"), F.col("b").cast("long"))
    in_turn = edges.repartition(1).sortWithinPartitions("b")
    colored = written(in_turn.mapInArrow(_colors, "plan_order long, color int"), "plan-colors")
    free = own.select("plan_order").join(colored.select("plan_order"), "plan_order", "left_anti")
    return colored.unionByName(free.withColumn("color", F.lit(1)))


#: Rounds in which a batch's changes are colored together; what is left then is colored one by one.
ROUNDS = 6


def _gaps(at: np.ndarray, color: np.ndarray, n: int) -> np.ndarray:
    """For places 0 to n - 1 the smallest color from 1 that no pair (place, color) has."""
    base = int(color.max(initial=0)) + 1
    place, taken = np.divmod(np.unique(at * base + color), base)
    rank = np.arange(len(place)) - np.searchsorted(place, np.arange(n))[place]
    # in a place's rising colors those before its first gap stand at their rank, and none after it
    return 1 + np.bincount(place[taken == rank + 1], minlength=n)


class FirstFit:
    """Colors of nodes that come in rising order with their earlier neighbours, of which those never seen have color 1."""

    def __init__(self):
        self.nodes, self.colors, self.n = np.empty(1024, np.int64), np.empty(1024, np.int32), 0
        self.open, self.used = None, np.empty(0, np.int64)  # the last node, and its neighbours' colors so far

    def _known(self, nodes: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(nodes), np.int64)
        at = np.minimum(np.searchsorted(self.nodes[: self.n], nodes), self.n - 1)
        return np.where(self.nodes[at] == nodes, self.colors[at], 1).astype(np.int64)

    def _settle(self, nodes: np.ndarray, colors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = self.n + len(nodes)
        if end > len(self.nodes):
            room = max(end, 2 * len(self.nodes)) - self.n
            self.nodes, self.colors = (np.concatenate([x[: self.n], np.empty(room, x.dtype)]) for x in (self.nodes, self.colors))
        self.nodes[self.n : end], self.colors[self.n : end] = nodes, colors
        self.n = end
        return nodes, colors

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """The last node's color: all its neighbours have come."""
        if self.open is None:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        node, color = np.array([self.open]), _gaps(np.zeros(len(self.used), np.int64), self.used, 1)
        self.open, self.used = None, np.empty(0, np.int64)
        return self._settle(node, color)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Nodes that edges (a, b), in the order of b, complete, with their colors. The last b stays open."""
        out = [self.close()] if self.open is not None and self.open != b[0] else []
        new = np.r_[True, b[1:] != b[:-1]]
        own, at = b[new], np.cumsum(new) - 1
        m = len(own)
        inner = np.minimum(np.searchsorted(own, a), m - 1)
        color = np.where(own[inner] == a, 0, self._known(a))  # 0: a node of this batch, not colored yet
        at, inner = np.r_[np.zeros(len(self.used), np.int64), at], np.r_[np.zeros(len(self.used), np.int64), inner]
        color = np.r_[self.used, color]
        got = np.zeros(m, np.int64)
        for _ in range(ROUNDS):
            ready = got == 0
            ready[at[color == 0]] = ready[-1] = False
            if not ready.any():
                break
            chosen = ready[at]
            got[ready] = _gaps(at[chosen], color[chosen], m)[ready]
            waits = np.flatnonzero(color == 0)
            color[waits] = got[inner[waits]]
        starts = np.searchsorted(at, np.arange(m + 1))
        for i in [*np.flatnonzero(got[:-1] == 0).tolist(), m - 1]:
            own_colors, late = color[starts[i] : starts[i + 1]], inner[starts[i] : starts[i + 1]]
            own_colors = np.where(own_colors == 0, got[late], own_colors)
            if i < m - 1:
                taken, got[i] = set(own_colors.tolist()), 1
                while got[i] in taken:
                    got[i] += 1
            else:
                self.open, self.used = int(own[i]), np.unique(own_colors)
        return [*out, self._settle(own[:-1], got[:-1])]


def _colors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fit = FirstFit()
    row = lambda nodes, colors: pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(colors, pa.int32())], names=["plan_order", "color"])
    for batch in batches:
        if batch.num_rows:
            for found in fit.add(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))):
                yield row(*found)
    yield row(*fit.close())


def scanned_conflicts(edges: DataFrame, colored: DataFrame) -> DataFrame:
    """The conflicts that first-fit meets: a later change against the members of groups up to the one it lands in."""
    a = colored.select(F.col("plan_order").alias("a"), F.col("color").alias("ca"))
    b = colored.select(F.col("plan_order").alias("b"), F.col("color").alias("cb"))
    return edges.join(a, "a").join(b, "b").where("ca < cb").select(*edges.columns)


def openers(colored: DataFrame) -> DataFrame:
    """plan_order of the change that opens each group after the first."""
    return colored.groupBy("color").agg(F.min("plan_order").alias("plan_order")).where("color > 1").select("plan_order")


def blocked_by(edges: DataFrame, colored: DataFrame) -> DataFrame:
    """plan_order, blockers: for the change that opens a group after the first, its conflicts in group 1."""
    ones = colored.where("color = 1").select(F.col("plan_order").alias("a"))
    met = edges.join(openers(colored).select(F.col("plan_order").alias("b")), "b").join(ones, "a")
    return met.groupBy(F.col("b").alias("plan_order")).agg(
        F.array_sort(F.collect_list(F.struct("a", reason(F.col("rule"), F.col("shared")).alias("reason")))).alias("blockers")
    )


def group_files(changes: DataFrame, colored: DataFrame) -> DataFrame:
    return changes.join(colored, "plan_order").groupBy("color").agg(
        F.array_sort(F.collect_list("plan_order")).alias("members"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"),
    )


def group_sizes(changes: DataFrame, colored: DataFrame) -> DataFrame:
    """color, members, files: what ``group_files`` gathers, as numbers, so that no group stands in one row."""
    placed = changes.select("plan_order", "files").join(colored, "plan_order")
    files = placed.select("color", F.explode("files").alias("file")).groupBy("color").agg(F.count_distinct("file").alias("files"))
    members = colored.join(changes.select("plan_order"), "plan_order", "left_semi").groupBy("color").agg(F.count(F.lit(1)).alias("members"))
    return members.join(files, "color", "left").select("color", "members", F.coalesce("files", F.lit(0)).alias("files"))


def partition_totals(changes: DataFrame, colored: DataFrame) -> DataFrame:
    placed = colored.agg(F.count(F.lit(1)).alias("parallelizable"), F.coalesce(F.max("color"), F.lit(0)).alias("group_count"))
    rest = deferred(changes).agg(F.count(F.lit(1)).alias("deferred"))
    return placed.crossJoin(rest).select(  # one row each
        (F.col("parallelizable") + F.col("deferred")).alias("total_changes"), "parallelizable", "group_count"
    )


# ---------------------------------------------------------------- rules of the plan's prose


def effective_tier(changes: DataFrame, overrides: list[tuple[str, int]]) -> DataFrame:
    """Overrides(pattern, tier) raise a change's tier if one of its files matches; they never lower it."""
    from codeloom.operators.excludes import excluded

    tier = F.col("tier")
    for raised in sorted({t for _, t in overrides}):
        own = [p for p, t in overrides if t == raised]
        hit = F.exists("files", lambda p: excluded(p, own))  # noqa: B023 (used at once)
        tier = F.when(hit, F.greatest(tier, F.lit(raised))).otherwise(tier)
    return changes.withColumn("effective_tier", tier)


# What a change must pass by tier.
VERIFICATION = {1: "tests and build", 2: "tests, build and characterization test", 3: "human sign-off"}


def verification_bar(tier: Column) -> Column:
    found = F.lit(VERIFICATION[3])
    for t in (2, 1):
        found = F.when(tier == t, VERIFICATION[t]).otherwise(found)
    return found


def execution_order(changes: DataFrame) -> DataFrame:
    return changes.orderBy("tier", "id")


def sign_off(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("tier") == 3) | (F.col("category") == "judgment call"))


def projected_reduction(changes: DataFrame, code: DataFrame, target_percent: float) -> DataFrame:
    """One row: estimated lines saved, percent of the code lines, whether the target is met."""
    saved = changes.agg(F.coalesce(F.sum("est"), F.lit(0)).alias("saved"))
    both = saved.crossJoin(code.agg(F.sum("code").alias("code")))  # one row each
    percent = F.round(F.col("saved") / F.col("code") * 100, 2)
    return both.select("saved", "code", percent.alias("percent"), (percent >= target_percent).alias("met"))


def batch_manifest(commits: DataFrame) -> DataFrame:
    """sha, category, summary, verification of subjects ``category: what [verified: how]``."""
    pattern = r"^([\w-]+):\s*(.*?)(?:\s*\[verified:\s*(.*?)\])?\s*$"
    part = lambda i: F.regexp_extract("subject", pattern, i)
    return commits.where(F.col("subject").rlike(r"^[\w-]+:")).select(
        "sha", part(1).alias("category"), part(2).alias("summary"), F.nullif(part(3), F.lit("")).alias("verification")
    )


def checkpoints(commits: DataFrame, prefix: str) -> DataFrame:
    """Checkpoint commits that no later revert names."""
    own = commits.where(F.col("subject").startswith(prefix + ":"))
    undone = commits.select(F.regexp_extract("subject", r"^revert: (\w+)", 1).alias("sha")).where("sha <> ''")
    return own.join(undone.distinct(), "sha", "left_anti")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHANGE)
