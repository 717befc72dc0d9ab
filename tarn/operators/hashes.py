"""Hashes: (key, field, value, expires_at); a field is live while its deadline, if any, is not past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLS = ["key", "field", "value", "expires_at"]


def live(state: DataFrame, now: Column) -> DataFrame:
    return state.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def put(state: DataFrame, delta: DataFrame, only_new: bool = False) -> DataFrame:
    """HSET, HMSET and HSETNX: the delta's last value of a field wins; writing clears a deadline."""
    new = delta.withColumn("_at", F.monotonically_increasing_id()).groupBy("key", "field").agg((F.min_by if only_new else F.max_by)("value", "_at").alias("value")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    if only_new:
        return state.select(*COLS).unionByName(new.join(state, ["key", "field"], "left_anti").select(*COLS))
    return state.select(*COLS).join(new, ["key", "field"], "left_anti").unionByName(new.select(*COLS))


def get(state: DataFrame, asked: DataFrame) -> DataFrame:
    """HGET and HMGET of rows (key, field); absent fields have a NULL value."""
    return asked.join(state.select("key", "field", "value"), ["key", "field"], "left")


def delete(state: DataFrame, fields: DataFrame) -> DataFrame:
    return state.join(fields.select("key", "field"), ["key", "field"], "left_anti")


def as_map(state: DataFrame) -> DataFrame:
    """HGETALL as one map a key; HKEYS and HVALS are its keys and values."""
    return state.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def length(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def increment(state: DataFrame, delta: DataFrame, kind: str = "bigint") -> DataFrame:
    """HINCRBY and HINCRBYFLOAT in bulk: values plus summed deltas (key, field, by); absent counts as 0."""
    by = delta.groupBy("key", "field").agg(F.sum(F.col("by").cast(kind)).alias("_by"))
    both = state.join(by, ["key", "field"], "full")
    value = F.col("value").cast("string").cast(kind)
    made = F.when(F.col("_by").isNotNull(), (F.coalesce(value, F.lit(0).cast(kind)) + F.col("_by")).cast("string")).otherwise(F.col("value").cast("string"))
    return both.select("key", "field", made.cast(state.schema["value"].dataType).alias("value"), "expires_at")


def value_length(state: DataFrame) -> DataFrame:
    """HSTRLEN."""
    return state.select("key", "field", F.octet_length("value").alias("n"))


def sample(state: DataFrame, key: str, n: int = 1, seed: int = 0) -> DataFrame:
    """HRANDFIELD: n fields in a hash order; a negative n draws with replacement."""
    mine = state.filter(F.col("key") == key).select("field", "value")
    if n >= 0:
        return mine.orderBy(F.xxhash64("field", F.lit(seed)), "field").limit(n)
    rows = mine.orderBy("field").withColumn("_all", F.lit(0))
    size = rows.count()
    if not size:
        return mine
    from pyspark.sql import Window

    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_all").orderBy("field")) - 1)
    draws = mine.sparkSession.range(-n).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size))).alias("_i"))
    return draws.join(numbered, "_i").select("field", "value")


def _guard(deadline: Column, condition: str) -> Column:
    old = F.col("expires_at")
    return {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (deadline > old), "LT": old.isNull() | (deadline < old)}[condition.upper()]


def expire(state: DataFrame, key: str, fields: Sequence[str], deadline: Column, condition: str = "") -> DataFrame:
    """HEXPIRE and its forms: a deadline on fields, under NX, XX, GT or LT."""
    hit = (F.col("key") == key) & F.col("field").isin(*fields) & _guard(deadline, condition)
    return state.withColumn("expires_at", F.when(hit, deadline).otherwise(F.col("expires_at")))


def persist(state: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    hit = (F.col("key") == key) & F.col("field").isin(*fields)
    return state.withColumn("expires_at", F.when(~hit, F.col("expires_at")))


def ttl(state: DataFrame, now: Column, unit: str = "s") -> DataFrame:
    """HTTL and HPTTL: what remains, or -1 without a deadline (absent fields are for the caller: -2)."""
    left = F.unix_millis("expires_at") - F.unix_millis(now)
    left = left if unit == "ms" else F.floor((left + 500) / 1000)
    return state.select("key", "field", F.when(F.col("expires_at").isNull(), F.lit(-1)).otherwise(left).cast("long").alias("ttl"))
