"""Incremental forms: the same operators over a stream of file versions.

The measured toolkit is batch only; these are the batch operators behind a stream, without operators of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import lines


def inventory_stream(files: DataFrame) -> DataFrame:
    """Line counts of files(path, ext, content) as they arrive: a narrow map, so no state is kept."""
    return lines.inventory(files)


def upsert_stream(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch as a Parquet increment; readers take the last row per path by batch (see ``report.last_per_key``)."""

    def put(batch: DataFrame, epoch: int) -> None:
        from pyspark.sql import functions as F

        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return counts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
