"""The keyspace: one row a key of any type (key, type, expires_at), over the typed state tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob


def keyspace(states: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct keys of all state tables with their type; a deadline where the table has one."""
    parts = []
    for kind, df in states.items():
        deadline = F.max("expires_at") if kind == "string" and "expires_at" in df.columns else F.lit(None).cast("timestamp")
        parts.append(df.groupBy("key").agg(deadline.alias("expires_at")).select("key", F.lit(kind).alias("type"), "expires_at"))
    return reduce(DataFrame.unionByName, parts)


def live(keys: DataFrame, now: Column) -> DataFrame:
    return keys.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def matching(keys: DataFrame, pattern: str, hidden: str = "_t:") -> DataFrame:
    """KEYS: a glob over the keys, without the engine's own."""
    return keys.filter(glob(F.col("key"), pattern) & ~F.col("key").startswith(hidden))


def exists(keys: DataFrame, asked: Sequence[str]) -> int:
    """EXISTS and TOUCH: how many of the asked keys exist, repeats counted."""
    rows = keys.sparkSession.createDataFrame([(k,) for k in asked], "key string")
    return rows.join(keys.select("key"), "key", "left_semi").count()


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("key"), "key", "left_anti")


def rename(state: DataFrame, old: str, new: str) -> DataFrame:
    """RENAME: the target is replaced if the source exists."""
    there = state.filter(F.col("key") == old).select(F.lit(new).alias("_new")).distinct()
    kept = state.filter(F.col("key") != old).join(there, F.col("key") == F.col("_new"), "left_anti")
    return kept.unionByName(state.filter(F.col("key") == old).withColumn("key", F.lit(new)).select(*state.columns))


def copy(state: DataFrame, source: str, dest: str, replace: bool = False) -> DataFrame:
    """COPY: nothing happens if the target exists, unless it is to be replaced."""
    copied = state.filter(F.col("key") == source).withColumn("key", F.lit(dest)).select(*state.columns)
    if replace:
        return state.filter(F.col("key") != dest).unionByName(copied)
    return state.unionByName(copied.join(state.filter(F.col("key") == dest).select("key"), "key", "left_anti"))


def random_key(keys: DataFrame, seed: int | None = None) -> DataFrame:
    return keys.orderBy(F.rand(seed)).limit(1)


def ttl(keys: DataFrame, now: Column, unit: str = "s") -> DataFrame:
    """TTL and PTTL: what remains, -1 without a deadline."""
    left = F.unix_millis("expires_at") - F.unix_millis(now)
    left = left if unit == "ms" else F.floor((left + 500) / 1000)
    return keys.select("key", F.when(F.col("expires_at").isNull(), F.lit(-1)).otherwise(left).cast("long").alias("ttl"))


def expire(state: DataFrame, key: str, deadline: Column | None) -> DataFrame:
    """EXPIRE and its forms; no deadline is PERSIST."""
    value = F.lit(None).cast("timestamp") if deadline is None else deadline
    return state.withColumn("expires_at", F.when(F.col("key") == key, value).otherwise(F.col("expires_at")))
