"""Strings: (key, value BINARY, expires_at); a key is live while its deadline, if any, is not past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLS = ["key", "value", "expires_at"]


def live(state: DataFrame, now: Column) -> DataFrame:
    return state.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def put(state: DataFrame, delta: DataFrame, mode: str = "", keep_ttl: bool = False) -> DataFrame:
    """SET, SETNX, SETEX, MSET: delta (key, value[, expires_at]); the last row of a key wins; mode NX or XX."""
    if "expires_at" not in delta.columns:
        delta = delta.withColumn("expires_at", F.lit(None).cast("timestamp"))
    new = delta.withColumn("_at", F.monotonically_increasing_id()).groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), "_at").alias("_n")).select("key", "_n.value", "_n.expires_at")
    if mode == "NX":
        return state.select(*COLS).unionByName(new.join(state, "key", "left_anti"))
    if mode == "XX":
        new = new.join(state.select("key"), "key", "left_semi")
    if keep_ttl:
        new = new.drop("expires_at").join(state.select("key", "expires_at"), "key", "left").select(*COLS)
    return state.select(*COLS).join(new, "key", "left_anti").unionByName(new)


def put_all_new(state: DataFrame, delta: DataFrame) -> tuple[bool, DataFrame]:
    """MSETNX: all or nothing."""
    if not state.join(delta.select("key"), "key", "left_semi").isEmpty():
        return False, state
    return True, put(state, delta)


def get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """MGET of rows (pos, key): values in the order asked, NULL for absent keys."""
    return keys.join(state.select("key", "value"), "key", "left").orderBy("pos")


def delete_if_equal(state: DataFrame, key: str, value: bytes) -> DataFrame:
    return state.filter(~((F.col("key") == key) & (F.col("value") == F.lit(value))))


def append(state: DataFrame, delta: DataFrame) -> DataFrame:
    """APPEND of rows (key, value), in arrival order."""
    parts = delta.withColumn("_at", F.monotonically_increasing_id()).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_p"))
    tail = F.aggregate("_p", F.lit(b""), lambda s, x: F.concat(s, x["value"]))
    both = state.join(parts.select("key", tail.alias("_tail")), "key", "full")
    return both.select("key", F.concat(F.coalesce("value", F.lit(b"")), F.coalesce("_tail", F.lit(b""))).alias("value"), "expires_at")


def increment(state: DataFrame, delta: DataFrame, kind: str = "bigint") -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY and INCRBYFLOAT in bulk: summed deltas (key, by); overflow and text raise."""
    by = delta.groupBy("key").agg(F.sum(F.col("by").cast(kind)).alias("_by"))
    both = state.join(by, "key", "full")
    now = F.coalesce(F.col("value").cast("string").cast(kind), F.lit(0).cast(kind))
    made = F.when(F.col("_by").isNotNull(), (now + F.col("_by")).cast("string").cast("binary")).otherwise(F.col("value"))
    return both.select("key", made.alias("value"), "expires_at")


def length(state: DataFrame) -> DataFrame:
    return state.select("key", F.coalesce(F.octet_length("value"), F.lit(0)).alias("n"))
