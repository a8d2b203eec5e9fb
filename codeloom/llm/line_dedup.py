"""Line dedup over levelled sorted runs [native].

State is a log-structured set of line keys: each run is a table bucketed and
sorted by a 128-bit key hash. Documents arrive in batches. A batch's keys are
merge-joined against every live run (bucketed, so the runs are never shuffled
or re-sorted); keys found there, or held by an earlier document of the batch,
lose their lines. Keys that no run holds become a new run of level 0. When a
level has gathered ``fanout`` runs, they are compacted into one run of the
next level, so a key is rewritten once per level and the number of live runs
is at most ``fanout`` times the number of levels.

A store outlives a call: ``RunStore.open(spark, folder)`` takes up what an earlier session left there, and
``dedup_documents(docs, store=...)`` drops the lines that documents of earlier calls hold, then adds its own. The
store's list of runs is written last, under a new number each time, so a job that breaks off leaves the list before
it whole. A call without a store makes one for itself and removes it, also where it fails.

A key is the line without the blanks [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; only keys of
``min_chars`` code points or more take part. Batches are ranges of doc_id in rising order, so the
owner of a key is the smallest doc_id that holds it.

Defined results
* null or empty text: one empty line, nothing dropped.
* null doc_id: such rows neither own keys nor lose lines.
* a repeated doc_id is one document: its rows share ownership and keep their lines.
* a line that repeats inside its owner is kept there each time.
* empty table: empty result. Extra columns are ignored by ``line_drops`` and carried by ``dedup_documents``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY = ["h1", "h2"]


@dataclass(frozen=True)
class LineParams:
    min_chars: int = 10
    batches: int = 4
    fanout: int = 2


@dataclass
class RunStore:
    """The live runs, by level. Tables lie in ``folder``; their names are unique to the store."""

    spark: SparkSession
    fanout: int
    buckets: int
    folder: str = ""
    levels: list[list[str]] = field(default_factory=list)
    serial: int = 0
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)
    _replaced: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.folder = (self.folder or common.fresh_path(self.spark, "line-store")).rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, params: LineParams = LineParams()) -> RunStore:
        """The store in ``folder``, or an empty one there. Its latest list of runs counts."""
        store = cls(spark, params.fanout, int(spark.conf.get("spark.sql.shuffle.partitions")), folder)
        lists = store._lists()
        if lists:
            found = json.loads(spark.read.text(lists[-1], wholetext=True).first()[0])
            store.levels, store.serial, store.tag, store.buckets = (found[k] for k in ("levels", "serial", "tag", "buckets"))
            for name in store.live():
                store._register(name)
        return store

    def live(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _lists(self) -> list[str]:
        """Paths of the lists of runs, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs-*.json")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(x.getPath().toString() for x in found)

    def _register(self, name: str) -> None:
        """Tell the catalog of a run that an earlier session wrote."""
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{c} BIGINT" for c in KEY)
            keys = ", ".join(KEY)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.folder}/{name}'"
            )

    def save(self) -> None:
        """Write the list of runs, then delete the lists and the runs that it replaces."""
        old, kept = self._lists(), set(self.live())
        state = json.dumps({"levels": self.levels, "serial": self.serial, "tag": self.tag, "buckets": self.buckets})
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs-{self.serial:012d}-{uuid.uuid4().hex}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(state.encode()))
        finally:
            out.close()
        for x in old:
            common.delete(self.spark, x)
        for name in self._replaced:
            if name not in kept:
                self._drop(name)
        self._replaced.clear()

    def _write(self, keys: DataFrame) -> str:
        self.serial += 1
        name = f"line_run_{self.tag}_{self.serial}"
        (
            keys.select(*KEY)
            .repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self.folder}/{name}")
            .format("parquet")
            .mode("overwrite")
            .saveAsTable(name)
        )
        return name

    def add(self, keys: DataFrame) -> None:
        """A new run of level 0; full levels are compacted upwards. ``keys`` are in no live run."""
        self._put(0, self._write(keys))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs = [self.spark.table(t).select(*KEY) for t in self.levels[level]]
            name = self._write(reduce(DataFrame.unionByName, runs))
            old, self.levels[level] = self.levels[level], []
            self._replaced += old  # dropped when the list of runs no longer names them
            self._put(level + 1, name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.delete(self.spark, f"{self.folder}/{name}")

    def mark(self, keys: DataFrame) -> DataFrame:
        """``keys`` plus ``known``: whether any live run holds the key. One merge join per run."""
        marked = keys.withColumn("known", F.lit(False))
        for name in self.live():
            run = self.spark.table(name).select(*KEY, F.lit(True).alias("__hit")).hint("merge")
            marked = marked.join(run, KEY, "left").withColumn(
                "known", F.col("known") | F.coalesce("__hit", F.lit(False))
            ).drop("__hit")
        return marked

    def close(self) -> None:
        """Delete the store and all its runs."""
        for t in [*self.live(), *self._replaced]:
            self._drop(t)
        self.levels, self._replaced = [], []
        common.delete(self.spark, self.folder)


def line_key(line: Column) -> Column:
    return common.ascii_lower(common.blank_trim(line))


def keyed_lines(docs: DataFrame, params: LineParams) -> DataFrame:
    """doc_id, tk (text digest), line_no, h1, h2 of every line whose key takes part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", common.text_key(text).alias("tk"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")
    )
    keyed = lines.select("doc_id", "tk", "line_no", line_key(F.col("line")).alias("k")).where(
        F.length("k") >= params.min_chars
    )
    return keyed.select(
        "doc_id", "tk", "line_no", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), F.col("k")).alias("h2")
    )


def line_drops(docs: DataFrame, params: LineParams = LineParams(), store: RunStore | None = None) -> DataFrame:
    """doc_id, tk, line_no of every line to drop. With a store, also lines that it knows from earlier calls."""
    spark = docs.sparkSession
    own = RunStore(spark, params.fanout, int(spark.conf.get("spark.sql.shuffle.partitions"))) if store is None else None
    try:
        return _drops(docs, params, own or store, store is not None)
    finally:
        if own is not None:
            own.close()


def _drops(docs: DataFrame, params: LineParams, store: RunStore, stays: bool) -> DataFrame:
    cuts = _cuts(docs, params.batches)
    batch_of = sum(((F.col("doc_id") >= c).cast("int") for c in cuts), F.lit(0))
    path = common.fresh_path(docs.sparkSession, "line-keys")
    keyed = keyed_lines(docs, params)
    keyed.withColumn("batch", batch_of).write.partitionBy("batch").parquet(path)  # a batch reads its own folder alone
    lines = docs.sparkSession.read.schema(keyed.schema.add("batch", "integer")).parquet(path)
    drops = []
    for k in range(len(cuts) + 1):
        batch = lines.where(F.col("batch") == k)
        owners = batch.groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        marked = common.written(store.mark(owners), "line-owners")
        lost = marked.where(F.col("known") | (F.col("owner") < F.col("last")))
        here = batch.join(lost, KEY).where(F.col("known") | (F.col("doc_id") != F.col("owner")))
        drops.append(common.written(here.select("doc_id", "tk", "line_no"), "line-drops"))
        if stays or k < len(cuts):
            store.add(marked.where(~F.col("known")))
    if stays:
        store.save()
    return reduce(DataFrame.unionByName, drops)


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Rising doc_ids that split the documents into about equal batches. A fixed number of values reaches the driver."""
    if batches < 2:
        return []
    shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
    found = docs.select(F.percentile_approx("doc_id", shares, F.lit(1000)).alias("q"))
    return sorted(set(found.first()[0] or []))


def _kept(docs: DataFrame, payload: Column, params: LineParams, store: RunStore | None = None) -> DataFrame:
    """payload, n_lines, n_dropped and the text that stays, for every row of ``docs``."""
    drops = line_drops(docs, params, store).groupBy("doc_id", "tk").agg(F.collect_set("line_no").alias("gone"))
    drops = drops.select(F.col("doc_id").alias("__doc"), F.col("tk").alias("__tk"), "gone")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(payload.alias("__row"), F.col("doc_id").alias("__id"), text.alias("__text"))
    joined = rows.join(
        drops, (F.col("__id") == F.col("__doc")) & (common.text_key(F.col("__text")) == F.col("__tk")), "left"
    )
    lines = F.split("__text", "\n", -1)
    staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text_left = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(
        common.bind(lines, lambda l: F.array_join(F.transform(staying, lambda i: F.get(l, i)), "\n"))
    )
    return joined.select(
        "__row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        text_left.alias("kept_text"),
    )


def deduped(docs: DataFrame, params: LineParams = LineParams(), store: RunStore | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of ``docs``."""
    kept = _kept(docs.select("doc_id", "text"), F.col("doc_id"), params, store)
    return kept.withColumnRenamed("__row", "doc_id")


def dedup_documents(docs: DataFrame, params: LineParams = LineParams(), store: RunStore | None = None) -> DataFrame:
    """``docs`` with the staying text and n_chars to match; a null text stays null. Other columns as they came."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    row = F.struct(
        *[F.col(f"`{c}`") for c in rest],
        F.col("text").isNull().alias("__null_text"),
        *([F.col("n_chars")] if "n_chars" in docs.columns else []),
    )
    kept = _kept(docs, row, params, store)
    text = F.when(~F.col("__row.__null_text"), F.col("kept_text"))
    out = {c: F.col(f"__row.`{c}`") for c in rest}
    out["text"] = text
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("__row.n_chars"))
    return kept.select(*[out[c].alias(c) for c in docs.columns])
