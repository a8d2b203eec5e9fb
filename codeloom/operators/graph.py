"""Graphs as edge frames: components, reachability, cycles, candidates for removal.

Components: each task first reduces the edges it holds to stars. If one task held all, that is the answer;
otherwise large-star and small-star rounds follow. Cycles: what one task can hold is solved there; a larger graph
is cut by colors, forwards and backwards. Every round is written to the checkpoint folder, so the plan stays short
and a lost executor costs a read, not a recomputation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.checkpoints import written

#: Edges that one task takes.
TASK_EDGES = 1_000_000


def _smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest one that the edges connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (label[a], label[b], a, b):  # the labels' own labels sink too, so paths halve
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            return label


def _numbered(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of edges in rising order, whatever their type, and the edges' ends as positions in them."""
    table = pa.Table.from_batches(batches)
    ends = pa.concat_arrays([c for i in (0, 1) for c in table.column(i).chunks])
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.sort_indices(nodes))
    return nodes, *pc.index_in(ends, value_set=nodes).to_numpy(zero_copy_only=False).reshape(2, -1)


def _to_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node) that connect what a task's edges connect; a node at most once for each full hold."""
    held: list[pa.RecordBatch] = []
    size = 0

    def reduced() -> pa.RecordBatch:
        nodes, a, b = _numbered(held)
        label = _smallest_reached(len(nodes), a, b)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= TASK_EDGES:
            stars = reduced()
            held, size = [stars], 0
            if stars.num_rows >= TASK_EDGES:
                yield stars
                held = []
    if size or held:
        yield reduced()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    joined = both.join(least, "a")
    out = joined.where("b > a" if large else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges(a, b). Edges from a node to itself keep it alone."""
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    tasks = max(1, -(-now.count() // task_edges))
    kind = now.schema["a"].dataType.simpleString()
    now = written(now.coalesce(tasks).mapInArrow(_to_stars, f"a {kind}, b {kind}"), "edges")
    while tasks > 1:
        now = written(_star(_star(now, True), False), "edges")
        crowded = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if crowded.isEmpty() and chained.isEmpty():
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)


def merge_clusters(members: DataFrame) -> DataFrame:
    """members(cluster, path, line) of any number of passes -> cluster, path, line with overlapping clusters joined.

    Clusters are tied through the smallest cluster at each place they share; clusters of one place go. Members and
    joined members are read several times, so they are written: what made them runs once.
    """
    keyed = written(members.select(F.col("cluster").cast("string").alias("cluster"), "path", "line").distinct(), "cluster-members")
    ties = keyed.join(
        keyed.groupBy("path", "line").agg(F.min("cluster").alias("b")), ["path", "line"]
    ).select(F.col("cluster").alias("a"), "b").distinct()
    joined = keyed.join(components(ties), F.col("cluster") == F.col("node")).select(F.col("component").alias("cluster"), "path", "line").distinct()
    joined = written(joined, "cluster-joined")
    large = joined.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return joined.join(large.select("cluster"), "cluster")


def orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Nodes that no edge(src, dst) reaches from another node; roots are not reported."""
    found = nodes.join(edges.where("src <> dst").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return found if roots is None else found.join(roots, "node", "left_anti")


def unreferenced(definitions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Definitions without a reference: candidates, not verdicts."""
    return definitions.join(references.select(key).distinct(), key, "left_anti")


def _knots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, cycle of the strongly connected sets of two nodes or more among a task's edges (src, dst)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    nodes, src, dst = _numbered(held)
    order = np.argsort(src, kind="stable")
    first, dst = np.searchsorted(src[order], np.arange(len(nodes) + 1)), dst[order]
    seen, low, on, knot = np.full(len(nodes), -1), np.zeros(len(nodes), int), np.zeros(len(nodes), bool), np.full(len(nodes), -1)
    clock, stack = 0, []
    for start in range(len(nodes)):
        path = [] if seen[start] >= 0 else [(start, first[start])]
        if path:
            seen[start] = low[start] = clock
            clock, on[start] = clock + 1, True
            stack.append(start)
        while path:
            v, k = path.pop()
            if k < first[v + 1]:
                path.append((v, k + 1))
                w = int(dst[k])
                if seen[w] < 0:
                    seen[w] = low[w] = clock
                    clock, on[w] = clock + 1, True
                    stack.append(w)
                    path.append((w, first[w]))
                elif on[w]:
                    low[v] = min(low[v], seen[w])
                continue
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[v])
            if low[v] == seen[v]:
                cut = len(stack) - 1 - stack[::-1].index(v)
                members, stack = stack[cut:], stack[:cut]
                on[members] = False
                if len(members) > 1:
                    knot[members] = min(members)
    own = np.flatnonzero(knot >= 0)
    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), nodes.take(pa.array(knot[own]))], names=["node", "cycle"])


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without the nodes that have no way in or none out, round after round."""
    while True:
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        nxt = written(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "cycle-edges")
        if nxt.count() == edges.count():
            return nxt
        edges = nxt


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, color) after every node has the smallest color that reaches it along edges(src, dst)."""
    while True:
        step = labels.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node"), "color")
        nxt = labels.unionByName(step).groupBy("node").agg(F.min("color").alias("color"))
        nxt = written(nxt, "cycle-colors")
        if nxt.join(labels.withColumnRenamed("color", "old"), "node", "left").where("old IS NULL OR color < old").isEmpty():
            return nxt
        labels = nxt


def cycles(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, cycle (its smallest node) of every node on a directed cycle of edges(src, dst).

    Nodes without a way in or out lie on no cycle and are trimmed. If one task can hold what stays, it finds the
    strongly connected sets. Otherwise every node takes the smallest node that reaches it as its color; those of a
    color that reach its namesake back are one set, which goes, and the rest is trimmed and colored again. Rows are
    as many as edges, however large a set is.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).distinct()
    now = _trimmed(written(edges.where("src <> dst").select("src", "dst").distinct(), "cycle-edges"))
    parts = []
    while (left := now.count()) > task_edges:
        nodes = now.select(F.col("src").alias("node")).distinct()
        color = _spread(nodes.withColumn("color", F.col("node")), now)
        a, b = (color.select(F.col("node").alias(n), F.col("color").alias(c)) for n, c in (("src", "cs"), ("dst", "cd")))
        own = written(now.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", "cs"), "cycle-own")
        # backwards from the namesake, inside its color
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = own.where("dst = cs").select(F.col("dst").alias("node"), F.col("cs").alias("color")).distinct()
        reached = _spread(roots, back)
        parts.append(reached.select("node", F.col("color").alias("cycle")))
        gone = reached.select("node")
        rest = now.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        now = _trimmed(written(rest.select("src", "dst"), "cycle-edges"))
    if left:
        kind = now.schema["src"].dataType.simpleString()
        parts.append(now.coalesce(1).mapInArrow(_knots, f"node {kind}, cycle {kind}"))
    found = loops.limit(0)
    for part in parts:
        found = found.unionByName(part)
    found = written(found, "cycles")
    return found.unionByName(loops.join(found, "node", "left_anti"))
