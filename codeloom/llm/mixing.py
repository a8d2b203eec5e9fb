"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share a word budget by weight, at most ``max_repeats`` times what each
has; what a full source cannot take is shared again by weight among the rest.
The budget's words are given to sources as seats, by highest quotients votes / (2 seats + 1).
Documents are dealt to shards by a seeded hash; shards hold about
``shard_words`` words each, so their number follows the input and none
grows. In each shard the sources' documents are laid end to end in seeded
order and cut into blocks of ``block_words``. A source's words are handed to its shards in turn: each gets the
number of blocks whose words, the short last block counted by its own, bring the source's sum nearest to
what is due so far, so a source strays from its words by half a block whatever the number of shards. The
quota takes every block of the source the same number of times, and the remainder goes to the blocks with the
smallest seeded hashes. Nothing depends on the order or the partitioning of the input.

Defined results
* null or empty text, size 0: taken 0.
* null source: a source of its own, after all others.
* null doc_id: dealt by its text like any other row.
* equal rows are interchangeable; the multiset of results is the same in every run.
* empty table: empty result. Extra columns are ignored by ``mix`` and carried by ``mix_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class MixParams:
    """weights repeat along the sources in code point order; total is the budget as a share of all words;
    max_sources bounds what the driver gathers: one row per source (an error beyond it, never a cut)."""

    weights: tuple = (5.0, 2.0, 1.0)
    total: float = 1.5
    max_repeats: int = 2
    block_words: int = 64
    shard_words: int = 2_000_000
    seed: int = 17
    max_sources: int = 1_000_000


def word_count(text: Column) -> Column:
    return F.size(common.blank_words(text)).cast("long")


def share_targets(sizes: list[float], weights: list[float], total: float, max_repeats: float) -> list[float]:
    """Water filling: targets by weight, none above max_repeats times its size."""
    targets = [0.0] * len(sizes)
    open_, left = {i for i in range(len(sizes)) if sizes[i] > 0}, float(total)
    while open_:
        all_weight = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / all_weight >= max_repeats * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / all_weight
            break
        for i in sorted(full):
            targets[i] = float(max_repeats * sizes[i])
            left -= targets[i]
        open_ -= full
    return targets


def apportion(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: every seat goes to the highest votes / (2 got + 1); a party at its cap gets no more.

    The divisor is found by bisection; the last few seats are given one by one.
    """
    votes, caps = votes.astype(float), caps.astype(np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.ceil(votes / divisor - 0.5).clip(0).astype(np.int64), caps)

    low, high = votes.sum() / (4.0 * seats + 4.0 * len(votes)), 4.0 * votes.max()
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while (need := seats - int(got.sum())) > 0:
        quotient = np.where((got < caps) & (votes > 0), votes / (2 * got + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:need]
        got[best[quotient[best] > 0]] += 1
    return got


def source_targets(sized: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """source, source_size, target, due (its words as an integer): one row per source."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(params.max_sources + 1).collect()
    if len(totals) > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources; raise max_sources")
    # UTF-8 bytes sort as code points
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [float(r["n"] or 0) for r in totals]
    weights = [params.weights[i % len(params.weights)] for i in range(len(totals))]
    targets = share_targets(sizes, weights, params.total * sum(sizes), params.max_repeats)
    caps = np.array(sizes, dtype=np.int64) * params.max_repeats
    due = apportion(np.array(targets, dtype=float), int(round(sum(targets))), caps) if totals else []
    rows = [(r["source"], int(s), t, int(d)) for r, s, t, d in zip(totals, sizes, targets, due, strict=True)]
    return spark.createDataFrame(rows, "source string, source_size long, target double, due long")


def nearest_blocks(words: int, want: float, block: int, repeats: int) -> tuple[int, int]:
    """Number of blocks, and their words, nearest to ``want`` words of a run that may be taken ``repeats`` times."""
    blocks, full = -(-words // block), words // block
    if not words or want <= 0:
        return 0, 0
    if want >= repeats * words:
        return repeats * blocks, repeats * words
    every, rest = int(want // words), want % words
    low = min(int(rest // block), full)
    high = min(low + 1, blocks)
    of = lambda n: min(n * block, words)
    extra = low if rest - of(low) <= of(high) - rest else high
    return every * blocks + extra, every * words + of(extra)


def shard_quotas(pdf: pd.DataFrame, params: MixParams) -> pd.DataFrame:
    """shard, src, quota: blocks of each source and shard. pdf holds whole sources: src, shard, words, source_size, due."""
    pdf = pdf.sort_values(["src", "shard"])
    quota, last, given = [], None, 0
    for src, words, size, due in zip(*(pdf[c].tolist() for c in ("src", "words", "source_size", "due")), strict=True):
        if src != last:
            last, seen, given = src, 0, 0
        seen += words
        n, took = nearest_blocks(words, seen * due / max(size, 1) - given, params.block_words, params.max_repeats)
        given += took
        quota.append(n)
    return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "src": pdf["src"].to_numpy(), "quota": np.array(quota, np.int64)})


def _hash64(values: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 over int64 values, seeded."""
    x = values.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, taken, shard, quota, spans for every row.

    ``spans`` is an array of (from, to, times): word ranges of the document and how often the mix takes them.
    """
    sized = common.written(
        docs.select(
            "doc_id", common.text_key(F.col("text")).alias("row_key"), "source", word_count(F.col("text")).alias("size")
        ),
        "mix-sizes",
    )
    targets = source_targets(sized, params)
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // params.shard_words))
    known = targets.withColumn("src", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    small = targets.count() <= 10_000  # checked size: about 1 MB at most
    joined = sized.join(
        F.broadcast(known) if small else known, sized["source"].eqNullSafe(known["source"])
    ).select(sized["*"], known["src"], known["source_size"], known["target"], known["due"])
    order = F.xxhash64(F.lit(params.seed), F.coalesce("doc_id", F.lit(-1)), "row_key")
    dealt = joined.select(
        "*",
        order.alias("order"),
        F.pmod(F.xxhash64(F.lit(params.seed + 1), "order"), F.lit(shards)).cast("long").alias("shard"),
    )
    held = dealt.groupBy("src", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("due").alias("due"))
    # whole sources: a row per shard of each
    quotas = held.groupBy(F.pmod("src", F.lit(max(64, shards)))).applyInPandas(
        lambda pdf: shard_quotas(pdf, params), "shard long, src long, quota long"
    )
    schema = (
        "doc_id long, row_key long, source string, size long, shard long, source_size long, target double, "
        "quota long, taken long, spans array<struct<from:long,to:long,times:long>>"
    )

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return mix_shard(pdf, own, params)

    return dealt.drop("due").groupBy("shard").cogroup(quotas.groupBy("shard")).applyInPandas(run, schema)


def mix_shard(pdf: pd.DataFrame, own: pd.DataFrame, params: MixParams) -> pd.DataFrame:
    """One shard: draw its sources' quotas of blocks, cut them back to documents. own: src, quota."""
    pdf = pdf.sort_values(["src", "order", "row_key", "size"], kind="stable").reset_index(drop=True)
    block = params.block_words
    size = pdf["size"].to_numpy(np.int64)
    src, first = np.unique(pdf["src"].to_numpy(np.int64), return_index=True)
    bounds = np.append(first, len(pdf))
    words = np.add.reduceat(size, first)
    blocks = -(-words // block)
    quotas = own.set_index("src")["quota"].loc[src].to_numpy(np.int64)
    shard = int(pdf["shard"].iloc[0])
    quota_of, taken, spans = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), []
    for s, lo, hi, w, nb, q in zip(src, bounds[:-1], bounds[1:], words, blocks, quotas, strict=True):
        count = draw(int(w), int(nb), int(q), block, _hash64(np.array([s, shard]), params.seed).sum())
        end = np.cumsum(size[lo:hi])
        for i, (b, e) in enumerate(zip(end - size[lo:hi], end, strict=True)):
            own = cut_spans(int(b), int(e), count, block)
            spans.append(own)
            taken[lo + i] = sum((x["to"] - x["from"]) * x["times"] for x in own)
        quota_of[lo:hi] = q
    out = pdf[["doc_id", "row_key", "source", "size", "shard", "source_size", "target"]].copy()
    out["quota"], out["taken"], out["spans"] = quota_of, taken, spans
    return out


def draw(words: int, blocks: int, quota: int, block: int, seed: np.uint64) -> np.ndarray:
    """How often each block is taken. The short last block comes last, so drawn blocks are of equal size."""
    if not blocks:
        return np.zeros(0, np.int64)
    every, extra = divmod(quota, blocks)
    count = np.full(blocks, every, np.int64)
    full = words // block
    rank = np.argsort(_hash64(np.arange(full, dtype=np.uint64) + seed, 1), kind="stable")
    count[np.append(rank, np.arange(full, blocks))[:extra]] += 1
    return count


def cut_spans(begin: int, end: int, count: np.ndarray, block: int) -> list[dict]:
    """Word ranges of a document at [begin, end) of its source's run, equal neighbours joined; untaken ones left out."""
    if end <= begin:
        return []
    k0, k1 = begin // block, -(-end // block)
    own = count[k0:k1]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
    return [
        {
            "from": int(max(begin, (k0 + i) * block) - begin),
            "to": int(min(end, (k0 + j) * block) - begin),
            "times": int(own[i]),
        }
        for i, j in zip(edges[:-1], edges[1:], strict=True)
        if own[i]
    ]


def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: pass p of a document holds its words that are taken p times or more.

    A document taken whole keeps its text as it is; one taken in part has its taken words, joined by single
    spaces. A document of which nothing is taken has no row; one without words is passed on once, as it has
    no words to weigh.
    """
    taken = mix(docs, params).select(
        F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key"), F.col("size").alias("__size"), "spans"
    ).dropDuplicates(["__doc", "__key"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(row, F.col("doc_id").alias("__id"), common.text_key(F.col("text")).alias("__tk"))
    joined = rows.join(taken, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__tk") == F.col("__key")))
    passes = joined.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.lit(params.max_repeats))))
    parts = passes.withColumn("__parts", F.filter("spans", lambda s: s["times"] >= F.col("__pass")))
    parts = parts.where((F.size("__parts") > 0) | ((F.col("__size") == 0) & (F.col("__pass") == 1)))
    words = common.blank_words(F.col("__row.text"))
    taken_words = F.aggregate("__parts", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    cut = common.bind(
        words,
        lambda w: F.array_join(
            F.flatten(F.transform("__parts", lambda s: F.slice(w, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))),
            " ",
        ),
    )
    text = F.when(taken_words == F.col("__size"), F.col("__row.text")).otherwise(cut)
    done = parts.select("__row", text.alias("__text"))
    out = []
    for c, kind in docs.dtypes:
        if c == "text":
            out.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            whole = F.col("__text").eqNullSafe(F.col("__row.text"))
            out.append(F.when(whole, F.col("__row.n_chars")).otherwise(F.length("__text").cast(kind)).alias("n_chars"))
        else:
            out.append(F.col(f"__row.`{c}`").alias(c))
    return done.select(*out)
