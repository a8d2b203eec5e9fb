"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts become sets of five-word shingles (words between ASCII blanks, case kept; a text of fewer words is one
shingle). Equal sets are one class and are joined once, through the smallest doc_id that has them.

Forest. Each class has ``trees`` signatures of ``depth`` MinHash values. A tree is the trie of its sorted
signatures; a level of the trie is a group-by on the prefix. Prefixes are shortened from ``start_depth`` until a
link at the threshold itself is found with probability ``target``: p = 1 - (1 - s**d)**trees. Closer links are
found more often, so no estimate over the table's links, which its close copies would dominate, is asked.

Crowds. Every class of a trie node is tied to the node's smallest class, and the ties' connected components hold
all candidates. A component of ``crowd`` classes or fewer is verified as it is, so a class meets a bounded number
of others. So is a larger one if ties between like signatures alone keep half of it together: it is a group of near
copies, and comparing its pairs costs four times what its cluster's pairs cost. In any other large component, common
passages join classes that are not alike, and all its pairs would grow with the square of the table. There an exact
prefix filter takes over: a class's shingles are put in order of how many
classes of the component have them, rarest first, and two classes with a similarity of ``threshold`` share one of
the first n - ceil(threshold * n) + 1 of theirs. Classes are tied anew through those shingles alone, which lose no
link, and the components of these ties replace the large one: what many texts share comes last in the order and
ties nobody.

Verification. Components are cut into blocks by members and by bytes; a task compares two blocks, or many small
components, with exact shingle sets, and returns one row per class: its number of links and the smallest class it
reaches. Pairs never leave a task, so a group of any size costs rows in proportion to its size times its number
of blocks. All pairs of a component are compared, so the verified recall is at least that of the forest.

Results of ``near_classes``: doc_id, text_id (smallest doc_id with the same shingles), class_id (smallest
doc_id of the connected group), n_links (other classes of texts with a similarity of ``threshold`` or more).

Defined results
* null doc_id: text_id and class_id null, no links. Repeated doc_id: one document; its texts' classes
  under one id are compared through the smallest digest.
* text without words, or null: a class of its own without links (text_id = class_id = doc_id).
* repeated rows: one result row each. Empty table: empty result. Extra columns are ignored, and
  carried by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, hashing


@dataclass(frozen=True)
class NearParams:
    """crowd: classes of a component beyond which its shingles are asked; common: classes from which a shingle is ranked by
    its count; block: classes of a block, block_bytes their
    shingle sets' bytes; broadcast_rows: ids up to which they are sent to the texts instead of the texts to them."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    start_depth: int = 6
    target: float = 0.999
    crowd: int = 64
    common: int = 8
    block: int = 512
    block_bytes: int = 16_000_000
    broadcast_rows: int = 1_000_000
    seed: int = 5


# ---------------------------------------------------------------- sets and signatures


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(hashing.gram_hashes(hashing.hashes_of(hashing.words_of(text or "")), k))


def _own_set(text: str | None, d1: int, params: NearParams) -> np.ndarray | None:
    """The shingle set, or None where it is another text's under a repeated doc_id."""
    s = shingle_set(text, params.words)
    return s if int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) == d1 else None


def _coefficients(params: NearParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(params.seed)
    n = params.trees * params.depth
    odd = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, odd: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, from bits that the minimum does not bias."""
    low = np.full(len(odd), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256, None] ^ flip
        part *= odd
        np.minimum(low, part.min(axis=0), out=low)
    return (hashing.mix64(low) >> np.uint64(48)).astype("<u2")


def signatures(docs: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, d1, d2 (digest of the set), n and sig of every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, flip = _coefficients(params)
        for batch in batches:
            out = {"doc_id": [], "d1": [], "d2": [], "n": [], "sig": []}
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                s = shingle_set(texts[i].as_py(), params.words)
                if not len(s):
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                out["doc_id"].append(ids[i].as_py())
                out["d1"].append(int.from_bytes(d[:8], "little", signed=True))
                out["d2"].append(int.from_bytes(d[8:], "little", signed=True))
                out["n"].append(len(s))
                out["sig"].append(signature(s, odd, flip).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["d1"], pa.int64()), pa.array(out["d2"], pa.int64()),
                 pa.array(out["n"], pa.int64()), pa.array(out["sig"], pa.binary())], names=list(out),
            )

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, d1 long, d2 long, n long, sig binary")


# ---------------------------------------------------------------- forest


def found_chance(s, depth: int, trees: int):
    """Probability that similarity s shares a prefix of that depth in at least one tree."""
    return 1 - (1 - s**depth) ** trees


def forest_ties(reps: DataFrame, depth: int, params: NearParams) -> DataFrame:
    """a, b: each class tied to the smallest class of every trie node it lies in (a > b, distinct)."""
    width = 2 * params.depth

    def prefix(t: int):
        return F.struct(F.lit(t).alias("tree"), F.substring("sig", t * width + 1, 2 * depth).alias("p"))

    nodes = reps.select("node", F.explode(F.array(*[prefix(t) for t in range(params.trees)])).alias("x")).select(
        "node", F.xxhash64("x.tree", "x.p").alias("trie"), F.xxhash64(F.col("x.p"), F.col("x.tree")).alias("trie2")
    )
    heads = (
        nodes.groupBy("trie", "trie2").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    )
    return nodes.join(heads, ["trie", "trie2"]).where("node > b").select(F.col("node").alias("a"), "b").distinct()


def match_depth(params: NearParams) -> int:
    """The longest prefix, ``start_depth`` at most, that finds a link at the threshold with probability ``target``."""
    depth = params.start_depth
    while depth > 1 and found_chance(params.threshold, depth, params.trees) < params.target:
        depth -= 1
    return depth


def adaptive_ties(reps: DataFrame, params: NearParams) -> DataFrame:
    """Ties at the first depth, from ``start_depth`` down, whose recall at the threshold reaches the target."""
    return common.written(forest_ties(reps, match_depth(params), params), "near-ties")


# ---------------------------------------------------------------- components


def _forests(batches: Iterator[pa.RecordBatch], hold: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Star edges (a, b) that connect what a task's edges connect; at most ``hold`` nodes' edges are kept at a time."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def stars() -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[_roots(len(nodes), at.reshape(2, -1).T)]
        return nodes[nodes != root], root[nodes != root]

    fresh = 0
    for batch in batches:
        a, b = (np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate((a, b)))
        fresh += batch.num_rows
        if fresh >= hold:
            (a, b), fresh = stars(), 0
            if len(a) >= hold:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = stars()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(ties: DataFrame, task_edges: int = 1_000_000) -> DataFrame:
    """node, comp (smallest node it reaches) for the nodes of the ties (a, b).

    Each task first reduces about ``task_edges`` ties to stars. What one task held is then done. Otherwise rounds of
    large-star and small-star follow: each ties every neighbour of a node, itself included, to the smallest of them.
    Rows stay about as many as the ties, the number of rounds grows with the logarithm of the longest path, and every
    aggregate is combined before the shuffle.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.unionByName(turned) if large else edges
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        if large:  # written, so that both sides of the join come from plain exchanges and a hub's rows can be split among tasks
            least = common.written(least, "near-least")
        joined = both.join(least, "a")
        if large:  # larger neighbours to the smallest neighbour
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # smaller neighbours and the node itself to the smallest
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = common.written(ties.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "near-edges")
    tasks = max(1, -(-edges.count() // task_edges))
    edges = common.written(edges.coalesce(tasks).mapInArrow(_forests, "a long, b long"), "near-edges")
    nxt = edges
    while tasks > 1:
        nxt = common.written(star(star(edges, True), False), "near-edges")
        # done when every node has one edge and no node is both ends: all are stars
        ends = nxt.select(F.col("a").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("head")).unionByName(
            nxt.select(F.col("b").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("head"))
        )
        if ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("head").alias("head")).where("n > 1 OR n = 1 AND head = 1").isEmpty():
            break
        edges = nxt
    stars = nxt.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def _with_texts(docs: DataFrame, chosen: DataFrame, params: NearParams) -> DataFrame:
    """The rows of ``chosen`` (node, ...; written) beside their texts. Up to ``broadcast_rows`` ids go to the texts, else both move."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("node"), "text")
    return texts.join(F.broadcast(chosen) if chosen.count() <= params.broadcast_rows else chosen, "node")


def _frequent(chosen: DataFrame, shingles: int, params: NearParams) -> DataFrame:
    """comp, x, df of the shingles that ``common`` classes of a component or more have. Tasks send packed counts, not shingles."""
    buckets = max(1, -(-shingles // 4_000_000))

    def packs(held: list) -> Iterator[pa.RecordBatch]:
        found = _summed(np.concatenate(held, axis=1))
        at = (found[1].view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
        for k in np.unique(at):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([found[:, at == k].tobytes()], pa.binary())], names=["bucket", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                s = _own_set(r["text"], r["d1"], params)
                if s is not None:
                    held.append(np.stack([np.full(len(s), r["comp"]), s.view(np.int64), np.ones(len(s), np.int64)]))
                    size += len(s)
                if size >= 1_000_000:
                    yield from packs(held)
                    held, size = [], 0
        if size:
            yield from packs(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _summed(np.concatenate([np.frombuffer(d, np.int64).reshape(3, -1) for d in pdf["data"]], axis=1))
        return pd.DataFrame(dict(zip(("comp", "x", "df"), found[:, found[2] >= params.common], strict=True)))

    return chosen.mapInArrow(count, "bucket int, data binary").groupBy("bucket").applyInPandas(merge, "comp long, x long, df long")


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (comp, x, count) in order of comp and x, the counts of equal ones summed."""
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:2], axis=1) != 0).any(axis=0)])) if rows.shape[1] else np.zeros(0, int)
    return np.stack([*rows[:2, first], np.add.reduceat(rows[2], first)]) if len(first) else rows


def _prefix_length(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-6)) + 1


def _prefixes_by_table(chosen: DataFrame, often: DataFrame, params: NearParams) -> DataFrame:
    """comp, x, node: the rarest shingles of each class. ``often`` has ``broadcast_rows`` rows at most."""
    known = often.orderBy("comp", "x").toArrow()
    sent = chosen.sparkSession.sparkContext.broadcast([known.column(i).to_numpy() for i in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comps, xs, dfs = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                s = _own_set(r["text"], r["d1"], params)
                if s is None:
                    continue
                s = s.view(np.int64)
                lo, hi = np.searchsorted(comps, [r["comp"], r["comp"] + 1])
                df = np.ones(len(s), np.int64)
                if hi > lo:
                    at = np.minimum(np.searchsorted(xs[lo:hi], s), hi - lo - 1)
                    df = np.where(xs[lo:hi][at] == s, dfs[lo:hi][at], 1)
                first = s[np.lexsort((s, df))][: _prefix_length(len(s), params.threshold)]
                columns = [np.full(len(first), r["comp"]), first, np.full(len(first), r["node"])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["comp", "x", "node"])

    return chosen.mapInArrow(run, "comp long, x long, node long")


def _prefixes_by_join(chosen: DataFrame, often: DataFrame, params: NearParams) -> DataFrame:
    """The same where ``often`` is larger: every shingle of a class meets its count in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = _own_set(r["text"], r["d1"], params)
                for at in range(0, 0 if s is None else len(s), 65_536):
                    part = s[at : at + 65_536].view(np.int64)
                    columns = [np.full(len(part), r["comp"]), np.full(len(part), r["node"]), np.full(len(part), _prefix_length(len(s), params.threshold)), part]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["comp", "node", "first", "x"])

    have = chosen.mapInArrow(run, "comp long, node long, first long, x long")
    ranked = have.join(often, ["comp", "x"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy("df", "x"))  # dense: a repeated row counts once
    return ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("first")).select("comp", "x", "node")


def crowd_ties(docs: DataFrame, reps: DataFrame, crowded: DataFrame, params: NearParams) -> DataFrame:
    """a, b: classes of one crowded component (node, comp) that share a shingle of the prefix filter, each tied to the
    shingle's smallest class. Any order of the shingles that is one for all makes the filter exact; that by counts of the
    common ones makes it narrow."""
    members = common.written(crowded.join(reps.select("node", "d1", "n"), "node"), "near-crowd-members")
    chosen = _with_texts(docs, members, params).select("comp", "node", "d1", "text")
    often = common.written(_frequent(chosen, members.agg(F.sum("n")).first()[0] or 0, params), "near-often")
    by = _prefixes_by_table if often.count() <= params.broadcast_rows else _prefixes_by_join
    kept = common.written(by(chosen, often, params), "near-prefixes")
    heads = kept.groupBy("comp", "x").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").drop("last")
    heads = common.written(heads, "near-heads")
    return kept.join(heads, ["comp", "x"]).where("node > b").select(F.col("node").alias("a"), "b").distinct()


def like_ties(ties: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """The ties (a, b) whose signatures agree in as many places as those of links at the threshold do, three deviations less."""
    n = params.trees * params.depth
    least = n * params.threshold - 3 * (n * params.threshold * (1 - params.threshold)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, n) for i in (2, 3))
            own = pa.array((one == other).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(own) for i in (0, 1)], names=["a", "b"])

    sigs = reps.select("node", "sig")
    both = ties.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def mixed_crowds(ties: DataFrame, reps: DataFrame, comps: DataFrame, params: NearParams) -> DataFrame:
    """comp of the large components that no cluster of like ties holds half of."""
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    large = common.written(sizes.where(F.col("m") > params.crowd), "near-large")
    if large.isEmpty():
        return large.select("comp")
    members = common.written(comps.join(large, "comp").select("node", "comp", "m"), "near-large-members")
    own = ties.join(members.select(F.col("node").alias("a")), "a", "left_semi")
    clusters = components(like_ties(own, reps, params)).select("node", F.col("comp").alias("cluster"))
    shares = members.join(clusters, "node").groupBy("comp", "m", "cluster").agg(F.count(F.lit(1)).alias("k"))
    whole = shares.where(F.col("k") * 2 >= F.col("m")).select("comp").distinct()
    return common.written(large.join(whole, "comp", "left_anti").select("comp"), "near-crowds")


def candidate_components(docs: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """node, comp: the components whose pairs are compared."""
    ties = adaptive_ties(reps, params)
    comps = common.written(components(ties), "near-components")
    mixed = mixed_crowds(ties, reps, comps, params)
    if mixed.isEmpty():
        return comps
    crowded = common.written(comps.join(mixed, "comp", "left_semi").select("node", "comp"), "near-crowded")
    finer = components(crowd_ties(docs, reps, crowded, params))
    return common.written(comps.join(mixed, "comp", "left_anti").select("node", "comp").unionByName(finer), "near-components")


# ---------------------------------------------------------------- verification


def link_matrix(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of two lists of sets have a Jaccard similarity of the threshold or more. Exact."""
    nl, nr = len(left), len(right)
    sizes_l = np.array([len(x) for x in left], np.int64)
    sizes_r = np.array([len(x) for x in right], np.int64)
    both = np.zeros((nl, nr), np.float32)
    rows_l, rows_r = np.repeat(np.arange(nl), sizes_l), np.repeat(np.arange(nr), sizes_r)
    all_l, all_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(all_l, all_r)
    if not len(shared):
        return both > 0
    step = max(64, 8_000_000 // (nl + nr))
    for at in range(0, len(shared), step):
        part = shared[at : at + step]
        a, b = np.zeros((nl, len(part)), np.float32), np.zeros((len(part), nr), np.float32)
        for values, owner, put in ((all_l, rows_l, lambda o, p: a.__setitem__((o, p), 1)), (all_r, rows_r, lambda o, p: b.__setitem__((p, o), 1))):
            pos = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[pos] == values
            put(owner[hit], pos[hit])
        both += a @ b
    union = sizes_l[:, None] + sizes_r[None, :] - both
    return both >= threshold * union - 1e-6


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index that each of n reaches over the pairs."""
    root = np.arange(n)
    while len(pairs):
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], before[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 1], before[pairs[:, 0]])
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and roots of one task's group. side: 0 for one block (all pairs), else 1 and 2 (pairs across)."""
    if (side == 0).all():
        links = link_matrix(sets, sets, threshold)
        np.fill_diagonal(links, False)
        count = links.sum(axis=1)
        pairs = np.argwhere(np.triu(links))
    else:
        l, r = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        count, pairs = np.zeros(len(nodes), np.int64), np.zeros((0, 2), np.int64)
        if len(l) and len(r):
            links = link_matrix([sets[i] for i in l], [sets[i] for i in r], threshold)
            count[l], count[r] = links.sum(axis=1), links.sum(axis=0)
            found = np.argwhere(links)
            pairs = np.stack([l[found[:, 0]], r[found[:, 1]]], axis=1)
    order = np.argsort(nodes)
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    return count, nodes[order][_roots(len(nodes), rank[pairs] if len(pairs) else pairs)[rank]]


def verify(docs: DataFrame, reps: DataFrame, comps: DataFrame, params: NearParams) -> DataFrame:
    """node, n_links, root, whole: one row per class and task. whole: the task saw the class's whole component."""
    weighed = comps.join(reps.select("node", "d1", "n"), "node")
    totals = weighed.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), (F.sum("n") * 8).alias("bytes"))
    sized = common.written(weighed.join(totals, "comp"), "near-sized")
    cut = F.greatest(F.ceil(F.col("m") / params.block), F.ceil(F.col("bytes") / params.block_bytes))
    blocks = F.least(cut, F.col("m")).cast("int")
    whole = sized.where(blocks == 1).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * 8).alias("bytes")).first()
    packs = max(1, -(-whole["m"] // (2 * params.block)), -(-(whole["bytes"] or 0) // params.block_bytes))
    placed = sized.select("node", "comp", "d1", blocks.cast("int").alias("nb")).withColumn(
        "blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    )
    tasks = F.when(F.col("nb") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("nb") - 1),
            lambda o: F.struct(
                F.least("blk", o).alias("i"),
                F.greatest("blk", o).alias("j"),
                F.when(F.col("blk") == o, 0).when(F.col("blk") < o, 1).otherwise(2).alias("side"),
            ),
        )
    )
    chosen = _with_texts(docs, common.written(placed.withColumn("tasks", tasks), "near-placed"), params)
    schema = "node long, comp long, whole boolean, i int, j int, side int, s binary"

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            held = 0
            for r in batch.to_pylist():
                s = _own_set(r["text"], r["d1"], params)
                for t in [] if s is None else r["tasks"]:
                    rows.append((r["node"], r["comp"], r["nb"] == 1, t["i"], t["j"], t["side"], s.tobytes()))
                    held += s.nbytes
                    if held > 16_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        names = ["node", "comp", "whole", "i", "j", "side", "s"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    sets = chosen.select("node", "comp", "nb", "tasks", "d1", "text").mapInArrow(to_sets, schema)
    # small components share tasks; a task of a large one has two blocks
    pack = F.when(F.col("whole"), F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp", "i", "j"))
    keyed = sets.withColumn("pack", pack)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "comp", "i", "j"]).sort_values(["comp", "i", "j", "node"])
        cuts = np.flatnonzero((pdf[["comp", "i", "j"]].diff().fillna(1) != 0).any(axis=1).to_numpy())
        nodes, side = pdf["node"].to_numpy(np.int64), pdf["side"].to_numpy()
        sets_ = [np.frombuffer(b, np.uint64) for b in pdf["s"]]
        count, root = np.zeros(len(pdf), np.int64), nodes.copy()
        for lo, hi in zip(cuts, np.append(cuts[1:], len(pdf)), strict=True):
            if hi - lo > 1:
                count[lo:hi], root[lo:hi] = _compare(nodes[lo:hi], sets_[lo:hi], side[lo:hi], params.threshold)
        return pd.DataFrame({"node": nodes, "n_links": count, "root": root, "whole": pdf["whole"].to_numpy(bool)})

    return keyed.groupBy("whole", "pack").applyInPandas(compare, "node long, n_links long, root long, whole boolean")


def near_classes(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, text_id, class_id, n_links for every row of ``docs``."""
    signed = common.written(signatures(docs, params), "near-signatures")
    reps = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = common.written(reps, "near-classes")
    single = reps.dropDuplicates(["node"]) if _repeats(reps) else reps
    comps = candidate_components(docs, single, params)
    seen = common.written(verify(docs, single, comps, params), "near-links")
    across = seen.where("NOT whole AND root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = seen.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    if not across.isEmpty():
        wide = components(across).select("node", F.col("comp").alias("wide"))
        links = links.join(wide, "node", "left").withColumn("root", F.coalesce("wide", "root")).drop("wide")
    texts = reps.join(links, "node", "left").select(
        "d1", "d2", F.col("node").alias("text_id"), F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    known = signed.select("doc_id", "d1", "d2").join(texts, ["d1", "d2"]).select("doc_id", "text_id", "class_id", "n_links")
    bare = docs.where(F.col("doc_id").isNull() | (common.blank_trim(F.coalesce("text", F.lit(""))) == ""))
    rest = bare.select("doc_id", F.col("doc_id").alias("text_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(rest)


def _repeats(reps: DataFrame) -> bool:
    """Whether one doc_id stands for two classes, which only repeated doc_ids bring about."""
    return not reps.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def drop_near_copies(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One document of each near-duplicate group: the one with the group's smallest doc_id. Null doc_ids stay."""
    heads = near_classes(docs, params).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("__head"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(row, F.col("doc_id").alias("__id"))
    kept = rows.where("__id IS NOT NULL").join(heads.distinct(), F.col("__id") == F.col("__head"), "left_semi")
    return kept.select("__row.*").unionByName(rows.where("__id IS NULL").select("__row.*"))
