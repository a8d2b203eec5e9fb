"""Quality rules whose cutoffs carry a guarantee [native].

Each rule rejects a document whose statistic exceeds a cutoff. Cutoffs are not
guessed: on labelled good documents, per stratum (language), the number of
false rejections at each candidate cutoff is counted, and an exact binomial
test decides whether the false-rejection rate is proven to be at most
``alpha / rules``. Candidates are tested from the most lenient to the
strictest and the walk stops at the first failure (fixed-sequence testing), so
only one test per stratum and rule spends error budget; ``delta`` is split
over all such chains (Bonferroni). With probability ``1 - delta`` no stratum
loses more than ``alpha`` of its good documents to the learned rules.

Defined results
* null or empty text: no words, all counts 0, base_failed true, kept false.
* null lang: a stratum of its own ("").
* a stratum with too few labels certifies nothing; the learned rules then
  reject nothing there. The same holds with an empty labels table.
* labels that repeat a doc_id: the document counts as good if every non-null
  label says so, once. Null doc_id: measured and judged, never a holdout.
* repeated rows: judged one by one. Empty table: empty result.
* extra columns are ignored by ``measure``; ``filter_documents`` returns the
  input's columns unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a repeated window.
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

RATIO_GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)
LENGTH_GRID = (60.0, 50.0, 40.0, 35.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0)


@dataclass(frozen=True)
class RuleParams:
    """alpha: false rejections allowed per stratum; delta: chance that the promise fails anywhere;
    broadcast_rows: most cutoff rows that are broadcast, by a check of their number (more meet in a shuffle join)."""

    alpha: float = 0.02
    delta: float = 0.1
    broadcast_rows: int = 10_000
    grids: dict = field(
        default_factory=lambda: {
            "symbol_ratio": RATIO_GRID,
            "dup_line_ratio": RATIO_GRID,
            "repeat_ratio": RATIO_GRID,
            "mean_word_chars": LENGTH_GRID,
        }
    )


def _covered_by_repeats(words: Column, n: Column) -> Column:
    """Words inside windows of five that occur twice or more. Sorted by content, equal windows are neighbours."""
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.concat_ws(" ", F.slice(words, i + 1, WINDOW)))
    ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(s: Column) -> Column:
        flagged = F.transform(
            s,
            lambda x, k: F.when(
                F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)),
                x["i"],
            ),
        )
        return F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))

    return F.aggregate(
        common.bind(ranked, starts),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum")
        ),
        lambda acc: acc["sum"],
    )


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed.

    One narrow pass without a shuffle. Windows are first compared by hash within their text; only texts
    with a repeated hash pay for the exact comparison, which settles the count.
    """
    cols = [F.col(c) for c in keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.split(text, "\n", -1), lambda x: common.blank_trim(x) != "")
    base = docs.select(*cols, text.alias("__text"), common.blank_words(text).alias("__words"), worded.alias("__lines"))
    n = F.size("__words")
    words = F.col("__words")
    hashes = F.when(
        n > WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + d) for d in range(WINDOW)]),
        ),
    )
    hashed = base.withColumn("__hashes", hashes)
    repeat = F.when(
        F.coalesce(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.lit(False)),
        _covered_by_repeats(words, n),
    ).otherwise(F.lit(0))
    counted = hashed.select(
        *cols,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        repeat.cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def statistics() -> dict[str, Column]:
    some = lambda c: F.greatest(F.col(c), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / some("word_chars"),
        "dup_line_ratio": F.col("n_dup_lines") / some("n_lines"),
        "repeat_ratio": F.col("n_repeat_words") / some("n_words"),
        "mean_word_chars": F.col("word_chars") / some("n_words"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), term by term in log space. k above the mean is answered with 0.0 (no proof there)."""
    odds = log(p) - log(1 - p)
    first = n.cast("double") * log(1 - p)
    step = lambda acc, j: F.struct(
        (acc["t"] + F.log((n - j + 1) / j) + odds).alias("t"), acc["s"].alias("s")
    )
    add = lambda s, t: F.greatest(s, t) + F.log1p(F.exp(-F.abs(s - t)))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))

    def fold(acc: Column, j: Column) -> Column:
        nxt = step(acc, j)
        return F.struct(nxt["t"].alias("t"), add(acc["s"], nxt["t"]).alias("s"))

    total = F.aggregate(terms, F.struct(first.alias("t"), first.alias("s")), fold, lambda acc: acc["s"])
    return F.when(k > n * p, F.lit(0.0)).otherwise(total)


def calibrate(measured: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """One row per certified stratum: ``stratum`` and, per rule, the strictest proven cutoff or null.

    ``measured`` needs doc_id, lang and the columns of ``measure``. Every stratum with a label is tested.
    """
    good = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("q"))
        .where(F.col("doc_id").isNotNull() & F.col("q").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("q").alias("q"))
        .where(F.col("q") == 1)
        .select("doc_id")
    )
    stats = statistics()
    held = measured.where(~F.col("base_failed")).select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *[c.alias(r) for r, c in stats.items()]
    )
    cells = [(r, i, c) for r, grid in params.grids.items() for i, c in enumerate(sorted(grid, reverse=True))]
    counts = (
        held.join(good, "doc_id", "left_semi")
        .groupBy("stratum")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(F.when(F.col(r) > c, 1)).alias(f"k_{r}_{i}") for r, i, c in cells],
        )
    )
    counts = common.written(counts, "quality-counts")
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{i}").alias("k")
                )
                for r, i, c in cells
            ]
        )
    )
    tested = counts.select("stratum", "n", rows.alias("x")).select("stratum", "n", "x.*")
    chains = max(1, counts.count()) * len(params.grids)
    limit = log(params.delta / chains)
    proven = tested.withColumn("ok", log_binomial_cdf(F.col("k"), F.col("n"), params.alpha / len(params.grids)) <= limit)
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    certified = proven.withColumn("all_ok", F.min("ok").over(walk)).where("all_ok")
    return certified.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in params.grids]
    )


def judge(measured: DataFrame, cutoffs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """``measured`` plus kept. ``cutoffs`` is read twice: few rows are broadcast, more are joined by a shuffle."""
    table = cutoffs.select(F.col("stratum").alias("__stratum"), *[F.col(f"max_{r}").alias(f"__max_{r}") for r in params.grids])
    exceeds = F.lit(False)
    for r, stat in statistics().items():
        exceeds = exceeds | F.coalesce(stat > F.col(f"__max_{r}"), F.lit(False))
    few = cutoffs.limit(params.broadcast_rows + 1).count() <= params.broadcast_rows
    joined = measured.join(F.broadcast(table) if few else table, F.coalesce(F.col("lang"), F.lit("")) == F.col("__stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~exceeds).drop(*table.columns)


def quality_verdicts(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """doc_id, lang, the measures, base_failed and kept for every row of ``docs``."""
    measured = common.written(measure(docs, ["doc_id", "lang"]), "quality-measures")
    return judge(measured, common.written(calibrate(measured, labels, params), "quality-cutoffs"), params)


def filter_documents(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they came.

    Rows are written once beside their measures: the verdict then reads columns, where a filter over the
    measures' expressions would be pushed below them and evaluate each many times.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(whole, F.col("doc_id"), F.col("lang"), F.col("text"))
    measured = common.written(measure(rows, ["__row", "doc_id", "lang"]), "quality-measures")
    cutoffs = common.written(calibrate(measured.drop("__row"), labels, params), "quality-cutoffs")
    return judge(measured, cutoffs, params).where("kept").select("__row.*")
