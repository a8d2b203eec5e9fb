"""Exact and near duplicates: line windows, clusters by digest, similar pairs.

Windows are cut inside the file's row, so only (digest, path, line) meets a shuffle. Clusters are grouped by
digest with partial aggregation. Similar pairs are found in two ways: ``capped_pairs`` reproduces a pair budget
in first-seen order, ``similar_pairs`` covers everything with a length-bucketed, prefix-filtered join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators.comments import strip_c_comments
from codeloom.sources.checkpoints import written

#: What ``tokens`` splits at.
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def windows(files: DataFrame, k: int, mask: bool = False, strip_c: bool = False) -> DataFrame:
    """path, line (first line's number), block (k normalised non-blank lines joined by newlines), h (SHA-1)."""
    source = strip_c_comments(files) if strip_c else files.select("path", text.split_lines(F.col("content")).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), text.normalized(x, mask).alias("norm")))
    rows = source.select("path", F.filter(numbered, lambda x: x["norm"] != "").alias("own"))
    own = F.col("own")
    blocks = F.when(
        F.size("own") >= k,
        F.transform(
            F.sequence(F.lit(1), F.size("own") - (k - 1)),
            lambda i: F.struct(
                F.get(own, i - 1)["line"].alias("line"), F.array_join(F.slice(own["norm"], i, k), "\n").alias("block")
            ),
        ),
    )
    cut = rows.select("path", F.explode(blocks).alias("x")).select("path", "x.line", "x.block")
    return cut.withColumn("h", F.sha1("block"))


def cluster_sizes(blocks: DataFrame) -> DataFrame:
    """h, n, path, line: digests found more than once, with their first place."""
    return blocks.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line")).alias("at")
    ).where("n > 1").select("h", "n", F.col("at.path").alias("path"), F.col("at.line").alias("line"))


def cluster_members(blocks: DataFrame) -> DataFrame:
    """h, path, line of every member of a cluster. Long form: no cluster is gathered in one row."""
    return blocks.select("h", "path", "line").join(cluster_sizes(blocks).select("h"), "h")


def largest_clusters(blocks: DataFrame, n: int = 25) -> DataFrame:
    return cluster_sizes(blocks).orderBy(F.desc("n"), "h").limit(n)


def cross_corpus(left: DataFrame, right: DataFrame) -> DataFrame:
    """h, n_left, n_right of digests found on both sides, both pre-aggregated before the join."""
    a = left.groupBy("h").agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy("h").agg(F.count(F.lit(1)).alias("n_right"))
    return a.join(b, "h")


def first_seen(blocks: DataFrame) -> DataFrame:
    """One window per distinct text: its first in (path, line) order. Partial aggregation, no window over a hot digest."""
    return blocks.groupBy("h").agg(F.min(F.struct("path", "line", "block")).alias("x")).select("h", "x.*")


# ---------------------------------------------------------------- pair budget


def budget_texts(blocks: DataFrame, cap: int) -> DataFrame:
    """path, line, block, h, i: the first-seen texts that a budget of cap pairs can reach, numbered from 0 in (path, line) order.

    Pair (0, j) has number j - 1, so texts after cap + 2 take part in no pair of the budget; with fewer all stay.
    The order-by-limit keeps cap + 2 rows, so the numbering window's one task is bounded by the budget. Places alone
    are sorted; the texts of those that stay are fetched afterwards. Written: pairs read it on both sides.
    """
    places = blocks.groupBy("h").agg(F.min(F.struct("path", "line")).alias("x")).select("x.path", "x.line")
    head = places.orderBy("path", "line").limit(cap + 2)
    head = written(head.withColumn("i", F.row_number().over(Window.orderBy("path", "line")) - 1), "budget")
    # cap + 2 rows: a bound by parameter
    return written(blocks.join(F.broadcast(head), ["path", "line"]).select("path", "line", "block", "h", "i"), "budget-texts")


def capped_pairs(blocks: DataFrame, cap: int, inclusive: bool = True, extra=None) -> DataFrame:
    """i, j and both sides of the first pairs of a double loop over the first-seen texts of ``blocks``.

    The number of pair (i, j) of n texts is i n - i (i + 1) / 2 + (j - i - 1) in closed form. inclusive: the
    loop that stops after exceeding the cap runs cap + 1 pairs. Length rejects come later and so use up budget.
    n is the number of texts within reach: with more of them, text 0 alone fills the budget, whatever n is.
    ``extra`` adds columns to the texts before they are paired.
    """
    head = budget_texts(blocks, cap)
    n = head.count()
    head = head.repartition(max(1, min(32, n // 100)), "i")  # few rows, each costly
    head = extra(head) if extra else head
    a = head.select(*[F.col(c).alias(f"a_{c}") for c in head.columns])
    b = head.select(*[F.col(c).alias(f"b_{c}") for c in head.columns])
    number = F.col("a_i") * n - F.col("a_i") * (F.col("a_i") + 1) / 2 + (F.col("b_i") - F.col("a_i") - 1)
    limit = cap + 1 if inclusive else cap
    # row i has pairs in the budget only if its first pair has; a is thereby bounded, b is the budget's head
    heads = a.where(F.col("a_i") * n - F.col("a_i") * (F.col("a_i") + 1) / 2 < limit)
    return b.join(F.broadcast(heads), F.col("a_i") < F.col("b_i")).where(number < limit)


def close_lengths(la: Column, lb: Column, share: float = 0.4) -> Column:
    return F.abs(la - lb) <= share * F.greatest(la, lb)


def numbered_bigrams(x: Column) -> Column:
    """Bigrams of a token array, each with its occurrence number: a multiset as a set."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.concat_ws("\x1f", F.get(x, i - 1), F.get(x, i)))
    grams = F.when(F.size(x) > 1, F.array_sort(pairs)).otherwise(F.array().cast("array<string>"))
    return text.bind(grams, lambda s: F.transform(s, lambda g, i: F.concat_ws("\x1f", g, i - F.array_position(s, g))))


def dice_of_bigrams(p: Column, q: Column, np: Column, nq: Column) -> Column:
    """Dice of two ``numbered_bigrams``, given the numbers of tokens. Two single tokens compare as a whole elsewhere."""
    ratio = 2 * F.size(F.array_intersect(p, q)) / F.nullif(np - 1 + nq - 1, F.lit(0))
    return F.when((np == 0) & (nq == 0), 1.0).when((np == 0) | (nq == 0), 0.0).otherwise(ratio)


def dice(a: Column, b: Column) -> Column:
    """Bigram Dice of two token arrays, as multisets: 2 sum(min) / (size a - 1 + size b - 1)."""
    found = dice_of_bigrams(numbered_bigrams(a), numbered_bigrams(b), F.size(a), F.size(b))
    return F.coalesce(found, (a == b).cast("double"))


def sequence_ratio(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` plus ratio: the longest-matching-blocks similarity of two strings, Arrow-batched."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("ratio", ratio(F.col(left), F.col(right)))


def near_pairs_difflib(blocks: DataFrame, cap: int = 4000, least: float = 0.85) -> DataFrame:
    """ratio (2 decimals), a_path, a_line, b_path, b_line of the budget's pairs at or above ``least``."""
    pairs = capped_pairs(blocks, cap)
    # the filter stays below the Python node: the ratio is computed for close lengths only
    near = pairs.where(close_lengths(F.length("a_block"), F.length("b_block")))
    scored = sequence_ratio(near, "a_block", "b_block").where(F.col("ratio") >= least)
    return scored.select(F.round("ratio", 2).alias("ratio"), "a_path", "a_line", "b_path", "b_line")


def _measured(texts: DataFrame) -> DataFrame:
    """Tokens and bigrams once per text, not once per pair."""
    return texts.withColumn("t", tokens(F.col("block"))).withColumn("g", numbered_bigrams(F.col("t")))


def scored(pairs: DataFrame) -> DataFrame:
    found = dice_of_bigrams(F.col("a_g"), F.col("b_g"), F.size("a_t"), F.size("b_t"))
    return pairs.withColumn("ratio", F.coalesce(found, (F.col("a_t") == F.col("b_t")).cast("double")))


def tokens(block: Column) -> Column:
    return F.filter(F.split(block, r"\s+"), lambda x: x != "")


def near_pairs_dice(blocks: DataFrame, cap: int = 4000, least: float = 0.85) -> DataFrame:
    """The same by bigram Dice over tokens, without Python; the loop with >= runs cap pairs."""
    pairs = capped_pairs(blocks, cap, inclusive=False, extra=_measured)
    near = pairs.where(close_lengths(F.length("a_block"), F.length("b_block")))
    return scored(near).where(F.col("ratio") >= least).select(
        F.round("ratio", 2).alias("ratio"), "a_path", "a_line", "b_path", "b_line"
    )


#: Counters that all bigrams share when the rare ones are told from the common ones.
COUNTERS = 1 << 18


def _needed(n, least: float):
    """Bigrams that a text of n must have in common with another at least, whatever the other's size; never too many by rounding."""
    return np.ceil(least * n / (2 - least) - 1e-9).astype(int)


def _prefixes(texts: DataFrame, least: float) -> DataFrame:
    """k, id, n, i: the rarest numbered bigrams of each text (hash k, place i of n), as many as must hold one that a similar text has.

    Bigrams are hashed to 64 bits, and their rarity is that of the counter they share: both only decide who meets.
    """

    def hashed(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.xxhash64(F.get(t, i - 1), F.get(t, i)))

    # bound, so that a text is split once and not for each bigram
    grams = texts.select("id", text.bind(tokens(F.col("block")), hashed).alias("g"))
    counted = grams.select(F.explode("g").alias("g")).groupBy(F.pmod("g", F.lit(COUNTERS)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.toArrow()  # a row per counter: a bound by parameter
    sizes = np.zeros(COUNTERS, np.int64)
    sizes[found.column("c").to_numpy()] = found.column("n").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
            g = batch.column(1).values.to_numpy()
            for first in range(0, len(ids), 500):
                out = []
                for at in range(first, min(first + 500, len(ids))):
                    own = np.sort(g[ends[at] : ends[at + 1]])
                    n = len(own)
                    nth = np.arange(n) - np.searchsorted(own, own)
                    k = (own + nth * -7046029254386353131) ^ (nth * 2862933555777941757)
                    rarest = np.lexsort((k, shared.value[own % COUNTERS]))[: n - int(_needed(np.float64(n), least)) + 1]
                    out.append((k[rarest], np.full(len(rarest), ids[at]), np.full(len(rarest), n, np.int32), np.arange(len(rarest), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k", "id", "n", "i"])

    return grams.mapInArrow(run, "k long, id long, n int, i int")


@lru_cache(maxsize=512)
def _bigrams(block: str) -> tuple[list[str], Counter]:
    t = [x for x in _BLANK.split(block) if x]
    return t, Counter(zip(t, t[1:], strict=False))


def _dice(a: str, b: str) -> float:
    """``dice`` of two texts' tokens."""
    (s, p), (t, q) = _bigrams(a), _bigrams(b)
    if len(s) < 2 and len(t) < 2:
        return float(s == t)
    if not s or not t:
        return 0.0
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    return 2 * sum(min(n, large[g]) for g, n in small.items() if g in large) / (len(s) - 1 + len(t) - 1)


def similar_pairs(blocks: DataFrame, least: float = 0.85) -> DataFrame:
    """All pairs of distinct texts with bigram Dice >= least, without a budget.

    Prefix filter: with bigrams in rarest-first order, two texts that are similar enough share one of their first
    n - ceil(least n / (2 - least)) + 1, and where they first do so both have enough of them left. Only those
    meet, as numbers; texts move once to be told apart and once for each pair that met, and are compared as they are.
    """
    texts = written(first_seen(blocks).select(F.monotonically_increasing_id().alias("id"), F.unhex("h").alias("h"), "path", "line", "block"), "near-texts")
    prefix = _prefixes(texts, least)
    a, b = (prefix.select("k", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "i")]) for s in "ab")
    left = F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i"))
    met = a.join(b, "k").where((F.col("a_id") < F.col("b_id")) & (left >= F.lit(least / 2) * (F.col("a_n") + F.col("b_n")) - 1e-9))
    pairs = written(met.select("a_id", "b_id").distinct(), "near-ids")
    ids = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct()
    used = texts.join(ids, "id", "left_semi")
    a, b = (used.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "h", "path", "line", "block")]) for s in "ab")

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_dice(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    compared = pairs.join(a, "a_id").join(b, "b_id").withColumn("ratio", ratio("a_block", "b_block"))
    # a pair's first text is that of the smaller digest
    turned = F.col("a_h") > F.col("b_h")
    side = lambda s, c: F.when(turned, F.col(f"{'b' if s == 'a' else 'a'}_{c}")).otherwise(F.col(f"{s}_{c}")).alias(f"{s}_{c}")
    return compared.where(F.col("ratio") >= least).select("ratio", *[side(s, c) for s in "ab" for c in ("path", "line")])


def report(exact: DataFrame, near: DataFrame, compared: int) -> DataFrame:
    """One row: exact_clusters, near_pairs, compared, in the report's order."""
    by_cluster = exact.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("members"))
    clusters = by_cluster.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.size("members")).alias("k"), "h", "members"))), lambda x: x["members"]
        ).alias("exact_clusters")
    )
    pair = F.struct(
        (-F.col("ratio")).alias("k"), F.struct(F.col("a_path").alias("path"), F.col("a_line").alias("line")).alias("a"),
        F.struct(F.col("b_path").alias("path"), F.col("b_line").alias("line")).alias("b"),
    )
    pairs = near.agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct((-x["k"]).alias("ratio"), x["a"].alias("a"), x["b"].alias("b"))).alias("near_pairs")
    )
    return clusters.crossJoin(pairs).withColumn("compared", F.lit(compared))  # one row each



def cluster_members_by(files: DataFrame, mark: str, k: int = 5) -> DataFrame:
    """h, path, line of clusters within one version; paths begin with the version and ``mark``."""
    blocks = windows(files, k).withColumn("version", F.get(F.split("path", mark), F.lit(0)))
    own = blocks.groupBy("h", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "version")
    return blocks.join(own, ["h", "version"]).select("h", "path", "line")
