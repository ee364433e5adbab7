"""New files of a landing folder into a stored table, each file once, late versions included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyforge.sources.store import Snapshots


def ingest_available(spark: SparkSession, landing: str, schema: str, store: Snapshots, name: str, key: Sequence[str], version: str, checkpoint: str) -> StreamingQuery:
    """Upserts all files that arrived since the last run; a row counts when its version is not below the stored one's.

    A file stream with the available-now trigger: the checkpoint remembers the files,
    so that a run after a failure repeats at most the batch that failed, and an upsert
    repeated gives the same table. A batch rewrites only the buckets its keys fall into.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.change(name, batch, key, newest)

    def newest(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new if old is None else new.unionByName(old, allowMissingColumns=True)
        best = rows.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("_tf_v"), *[F.col(c) for c in rows.columns])).alias("r"))
        return best.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def receipts_per_window(events: DataFrame, time: str, key: str, amount: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, key, records, total) per time window; rows later than the watermark are left out of a stream's result."""
    w = F.window(F.col(time), window)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), F.col(key)) if events.isStreaming else events.groupBy(w.alias("w"), F.col(key))
    return grouped.agg(F.count(F.lit(1)).alias("records"), F.sum(amount).alias("total")).select(F.col("w.start").alias("start"), key, "records", "total")
