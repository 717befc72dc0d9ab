"""Lists: (key, pos, value), ordered by pos within a key; positions may have gaps and be negative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLS = ["key", "pos", "value"]


def indexed(state: DataFrame, from_end: bool = False) -> DataFrame:
    """Adds ``i``, the 0-based place from the head or the tail."""
    order = F.col("pos").desc() if from_end else F.col("pos").asc()
    return state.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(order)) - 1)


def push(state: DataFrame, delta: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """LPUSH, RPUSH and their X forms; delta (key, seq, value) is pushed in order of seq."""
    ends = state.groupBy("key").agg((F.min("pos") if left else F.max("pos")).alias("_end"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    new = delta.withColumn("_n", nth).join(ends, "key", "inner" if only_existing else "left")
    end = F.coalesce("_end", F.lit(1 if left else -1).cast("long"))
    placed = new.select("key", (end - F.col("_n") if left else end + F.col("_n")).cast("long").alias("pos"), "value")
    return state.select(*COLS).unionByName(placed)


def length(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _between(state: DataFrame, start: int, stop: int) -> DataFrame:
    """Adds ``i`` and ``_in``: whether the place is in the inclusive range, whose ends may be negative."""
    out = indexed(state)
    n = F.count(F.lit(1)).over(Window.partitionBy("key")) if start < 0 or stop < 0 else None
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.lit(stop) if stop >= 0 else n + stop
    return out.withColumn("_a", a).withColumn("_b", b).withColumn("_in", F.col("i").between(F.col("_a"), F.col("_b")))


def slice_(state: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE: (key, i, value)."""
    return _between(state, start, stop).filter("_in").select("key", "i", "value")


def trim(state: DataFrame, start: int, stop: int) -> DataFrame:
    """LTRIM."""
    return _between(state, start, stop).filter("_in").select(*COLS)


def at(state: DataFrame, index: int) -> DataFrame:
    """LINDEX: (key, value); keys shorter than that are absent."""
    marked = indexed(state, index < 0)
    return marked.filter(F.col("i") == (index if index >= 0 else -index - 1)).select("key", "value")


def set_at(state: DataFrame, key: str, index: int, value) -> DataFrame:
    """LSET."""
    hit = (F.col("key") == key) & (F.col("i") == (index if index >= 0 else -index - 1))
    return indexed(state, index < 0).select("key", "pos", F.when(hit, F.lit(value)).otherwise(F.col("value")).alias("value"))


def insert(state: DataFrame, key: str, pivot, value, before: bool = True) -> DataFrame:
    """LINSERT next to the first pivot; without one nothing changes. Only this key is renumbered."""
    mine = indexed(state.filter(F.col("key") == key)).select("key", (F.col("i") * 2).cast("long").alias("pos"), "value")
    first = mine.filter(F.col("value") == F.lit(pivot)).agg(F.min("pos").alias("p")).filter("p is not null")
    new = first.select(F.lit(key).alias("key"), (F.col("p") + (-1 if before else 1)).alias("pos"), F.lit(value).alias("value"))
    return state.filter(F.col("key") != key).select(*COLS).unionByName(mine).unionByName(new)


def remove(state: DataFrame, key: str, value, n: int = 0) -> DataFrame:
    """LREM: the first n matches, the last ones if n is negative, all if 0."""
    hit = (F.col("key") == key) & (F.col("value") == F.lit(value))
    if n == 0:
        return state.filter(~hit)
    order = F.col("pos").asc() if n > 0 else F.col("pos").desc()
    nth = F.row_number().over(Window.partitionBy("key", "value").orderBy(order))
    return state.withColumn("_n", nth).filter(~(hit & (F.col("_n") <= abs(n)))).select(*COLS)


def positions(state: DataFrame, key: str, value, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """LPOS: places of matches from the rank-th on, counted from the end if rank is negative."""
    mine = state.filter(F.col("key") == key)
    if rank == 0:
        raise ValueError("a rank is not 0")
    marked = indexed(mine).withColumn("_from", F.row_number().over(Window.partitionBy("key").orderBy(F.col("pos").desc() if rank < 0 else F.col("pos").asc())))
    if maxlen:
        marked = marked.filter(F.col("_from") <= maxlen)
    hits = marked.filter(F.col("value") == F.lit(value)).withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("_from"))).filter(F.col("_n") >= abs(rank))
    if count != 0:
        hits = hits.filter(F.col("_n") < abs(rank) + (1 if count is None else count))
    return hits.select("i")


def pop(state: DataFrame, n: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """LPOP and RPOP of every key given: (popped with i, rest)."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("pos").asc() if left else F.col("pos").desc()))
    marked = state.withColumn("_n", nth)  # the filter is on the row number itself, which limits each group early
    return marked.filter(F.col("_n") <= n).select("key", (F.col("_n") - 1).alias("i"), "value"), marked.filter(F.col("_n") > n).select(*COLS)


def pop_first(state: DataFrame, keys: Sequence[str], n: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """LMPOP: pop from the first of the keys that is not empty."""
    order = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    first = state.filter(F.col("key").isin(*keys)).agg(F.min_by("key", F.element_at(order, F.col("key"))).alias("_key"))
    marked = indexed(state, not left).join(F.broadcast(first), F.col("key") == F.col("_key"), "left")
    gone = F.col("_key").isNotNull() & (F.col("i") < n)
    return marked.filter(gone).select("key", "i", "value"), marked.filter(~gone).select(*COLS)


def move(state: DataFrame, source: str, dest: str, from_left: bool = True, to_left: bool = True) -> DataFrame:
    """LMOVE and RPOPLPUSH; an empty source changes nothing."""
    popped, rest = pop(state.filter(F.col("key") == source), 1, from_left)
    others = state.filter(F.col("key") != source).select(*COLS).unionByName(rest)
    return push(others, popped.select(F.lit(dest).alias("key"), F.lit(0).alias("seq"), "value"), to_left)
