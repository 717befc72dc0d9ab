"""Sets: (key, member)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(state: DataFrame, delta: DataFrame) -> DataFrame:
    return state.select("key", "member").unionByName(delta.select("key", "member")).distinct()


def remove(state: DataFrame, members: DataFrame) -> DataFrame:
    return state.join(members.select("key", "member"), ["key", "member"], "left_anti")


def are_members(state: DataFrame, asked: DataFrame) -> DataFrame:
    """SISMEMBER and SMISMEMBER of rows (key, member): ``is_member``."""
    have = state.select("key", "member").distinct().withColumn("_in", F.lit(True))
    return asked.join(have, ["key", "member"], "left").withColumn("is_member", F.coalesce("_in", F.lit(False))).drop("_in")


def cardinality(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def union(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.filter(F.col("key").isin(*keys)).select("member").distinct()


def intersect(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of all keys, in one aggregation; a missing key empties the result."""
    found = state.filter(F.col("key").isin(*keys)).groupBy("member").agg(F.countDistinct("key").alias("_n"))
    return found.filter(F.col("_n") == len(set(keys))).select("member")


def difference(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    mine = state.filter(F.col("key") == keys[0]).select("member").distinct()
    return mine.join(state.filter(F.col("key").isin(*keys[1:])).select("member"), "member", "left_anti") if len(keys) > 1 else mine


def intersect_count(state: DataFrame, keys: Sequence[str], limit: int = 0) -> int:
    found = intersect(state, keys)
    return (found.limit(limit) if limit else found).count()


def move(state: DataFrame, source: str, dest: str, member: str) -> DataFrame:
    """SMOVE: nothing changes if the source lacks the member."""
    moved = state.filter((F.col("key") == source) & (F.col("member") == member)).select(F.lit(dest).alias("key"), "member")
    return state.filter(~((F.col("key") == source) & (F.col("member") == member))).unionByName(moved).distinct()


def pop(state: DataFrame, key: str, n: int = 1, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SPOP: (popped, rest). The draw is a hash order, so that both parts agree when recomputed."""
    mine = state.filter(F.col("key") == key)
    popped = mine.orderBy(F.xxhash64("member", F.lit(0 if seed is None else seed)), "member").limit(n)
    return popped, remove(state, popped)


def sample(state: DataFrame, key: str, n: int = 1) -> DataFrame:
    """SRANDMEMBER: the first members in order; a negative count gives as many, a zero one."""
    return state.filter(F.col("key") == key).orderBy("member").limit(abs(n) or 1)


def store(result: DataFrame, state: DataFrame, dest: str) -> DataFrame:
    return state.filter(F.col("key") != dest).unionByName(result.select(F.lit(dest).alias("key"), "member"))


def scan(rows: DataFrame, column: str, cursor: str | None = None, pattern: str | None = None, count: int = 10) -> DataFrame:
    """SCAN, HSCAN, SSCAN and ZSCAN: keyset pages in column order; the last value is the next cursor."""
    from ..functions.text import glob

    col = F.col(column)
    if cursor is not None:
        rows = rows.filter(col > cursor)
    if pattern is not None:
        rows = rows.filter(glob(col, pattern))
    return rows.orderBy(col).limit(count)
