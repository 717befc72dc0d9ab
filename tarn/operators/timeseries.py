"""Time series: samples (key, ts, value) with epoch-millisecond times, series (key, retention_ms, labels).

Buckets start at multiples of their width from the epoch (floor, also before it); empty buckets give no
row. Late samples are accepted; a repeated time keeps the last value; retention counts back from the
newest sample of a series.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregations by name; spreads of fewer than two samples are 0. An unknown name is an average.
FUNCTIONS = {
    "avg": lambda v, t: F.avg(v),
    "sum": lambda v, t: F.sum(v),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "count": lambda v, t: F.count(v).cast("double"),
    "first": lambda v, t: F.min_by(v, t),
    "last": lambda v, t: F.max_by(v, t),
    "range": lambda v, t: F.max(v) - F.min(v),
    "std.p": lambda v, t: F.stddev_pop(v),
    "std.s": lambda v, t: F.coalesce(F.stddev_samp(v), F.lit(0.0)),
    "var.p": lambda v, t: F.var_pop(v),
    "var.s": lambda v, t: F.coalesce(F.var_samp(v), F.lit(0.0)),
}


def bucket(ts: Column, width_ms: int) -> Column:
    if width_ms < 1:
        raise ValueError("a bucket is at least a millisecond wide")
    return ts - F.pmod(ts, F.lit(width_ms).cast("long"))


def last_wins(samples: DataFrame, order: str | None = None) -> DataFrame:
    """One sample a (key, ts): the one that arrived last, by an order column if there is one."""
    if order:
        return samples.groupBy("key", "ts").agg(F.max_by("value", order).alias("value"))
    marked = samples.withColumn("_at", F.monotonically_increasing_id())
    return marked.groupBy("key", "ts").agg(F.max_by("value", "_at").alias("value"))


def add(samples: DataFrame, new: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """TSADD and TSMADD: insert or overwrite, then drop what retention no longer covers."""
    both = samples.select("key", "ts", "value", F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_at")).unionByName(new.select("key", "ts", "value", F.lit(1).alias("_new"), F.monotonically_increasing_id().alias("_at")))
    kept = both.groupBy("key", "ts").agg(F.max_by("value", F.struct("_new", "_at")).alias("value"))
    return retain(kept, series) if series is not None else kept


def retain(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Samples no older than their series' retention before its newest sample; 0 or none keeps all."""
    newest = samples.groupBy("key").agg(F.max("ts").alias("_newest"))
    cut = newest.join(series.select("key", "retention_ms"), "key").filter("retention_ms > 0").select("key", (F.col("_newest") - F.col("retention_ms")).alias("_cut"))
    return samples.join(cut, "key", "left").filter(F.col("_cut").isNull() | (F.col("ts") >= F.col("_cut"))).select("key", "ts", "value")


def between(samples: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Both ends included; None is open."""
    if start is not None:
        samples = samples.filter(F.col("ts") >= start)
    return samples if end is None else samples.filter(F.col("ts") <= end)


def aggregate(samples: DataFrame, function: str, width_ms: int) -> DataFrame:
    """(key, ts of the bucket, value); partial aggregation before the one shuffle."""
    make = FUNCTIONS.get(function.lower(), FUNCTIONS["avg"])
    return samples.groupBy("key", bucket(F.col("ts"), width_ms).alias("ts")).agg(make(F.col("value"), F.col("ts")).alias("value"))


def first_n(samples: DataFrame, n: int) -> DataFrame:
    """The first n rows of each series."""
    w = Window.partitionBy("key").orderBy("ts")
    return samples.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def range_(samples: DataFrame, key: str | None = None, start: int | None = None, end: int | None = None, function: str | None = None, width_ms: int | None = None, count: int | None = None) -> DataFrame:
    """TSRANGE: a time range, aggregated if asked, then the first ``count`` rows by time."""
    out = between(samples.filter(F.col("key") == key) if key is not None else samples, start, end)
    if function:
        out = aggregate(out, function, width_ms)
    return first_n(out, count) if count is not None else out


def with_labels(series: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Series whose labels match every pair."""
    for name, value in labels.items():
        series = series.filter(F.try_element_at("labels", F.lit(name)) == value)
    return series


def multi_range(samples: DataFrame, series: DataFrame, labels: Mapping[str, str], **how) -> DataFrame:
    """TSMRANGE: the range of every series whose labels match."""
    keys = with_labels(series, labels).select("key").distinct()
    return range_(samples.join(keys, "key", "left_semi"), **how)


def latest(samples: DataFrame) -> DataFrame:
    """TSGET of every series."""
    return samples.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def info(samples: DataFrame, series: DataFrame) -> DataFrame:
    """TSINFO of every series: count, first and last time, retention and labels."""
    facts = samples.groupBy("key").agg(F.count(F.lit(1)).alias("total_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return series.join(facts, "key", "left").select("key", F.coalesce("total_samples", F.lit(0)).alias("total_samples"), "first_ts", "last_ts", "retention_ms", "labels")
