"""Streaming time series: tumbling buckets, deduplication and expiry, equal to their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import FUNCTIONS, bucket
from ..plans.schema import EXPIRES


def tumbling(samples: DataFrame, function: str, width_ms: int, watermark: str | None = None) -> DataFrame:
    """(key, ts of the bucket, value) of a stream (key, ts, value).

    Without a watermark any lateness is accepted and state is kept for every bucket; a watermark bounds state
    and drops samples later than it.
    """
    rows = samples
    if watermark:
        rows = rows.withColumn("_event", F.timestamp_millis("ts")).withWatermark("_event", watermark)
        start = F.window("_event", f"{width_ms} milliseconds")
        made = rows.groupBy("key", start.alias("w")).agg(FUNCTIONS[function](F.col("value"), F.col("ts")).alias("value"))
        return made.select("key", F.unix_millis("w.start").alias("ts"), "value")
    return rows.groupBy("key", bucket(F.col("ts"), width_ms).alias("ts")).agg(FUNCTIONS[function](F.col("value"), F.col("ts")).alias("value"))


def due(state: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Row expiry: (rows whose deadline is past, the rest)."""
    past = F.coalesce(F.col(EXPIRES) < now, F.lit(False))
    return state.filter(past), state.filter(~past)


def sweep(ticks: DataFrame, state: Callable[[], DataFrame], delete: Callable[[DataFrame, int], None], checkpoint: str):
    """Expiry as a streaming job: each tick hands the rows that are due to ``delete``."""

    def batch(_: DataFrame, number: int) -> None:
        gone, _rest = due(state(), F.current_timestamp())
        if not gone.isEmpty():
            delete(gone, number)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def upsert_batches(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of changes applied to state batch by batch; ``apply`` must be idempotent by batch number."""
    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
