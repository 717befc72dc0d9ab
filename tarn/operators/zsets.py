"""Sorted sets: (key, member, score), in the total order of score and then member."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(descending: bool = False) -> list[Column]:
    names = [F.col("score"), F.col("member")]
    return [c.desc() if descending else c.asc() for c in names]


#: Members from which on a key is ranked by parts.
LARGE = 1_000_000


def ranked(zset: DataFrame, descending: bool = False) -> DataFrame:
    """ZRANK and ZREVRANK of every member: 0-based ``rank`` in its key.

    A key of more than ``LARGE`` members is cut at quantiles of its scores into parts that are ranked on their own
    and offset by the sizes of the parts before; only members of one score are never parted.
    """
    counts = zset.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > LARGE)
    hot = [(r["key"], -(-2 * r["_size"] // LARGE)) for r in counts.collect()]  # at most rows / LARGE keys
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*_order(descending)))
    if not hot:
        return zset.withColumn("rank", nth("key") - 1)
    most = max(n for _, n in hot)
    some = zset.filter(F.col("key").isin(*[k for k, _ in hot]))
    cuts = F.broadcast(some.groupBy("key").agg(F.percentile_approx("score", [i / most for i in range(1, most)], 10 * most).alias("_cuts")))
    behind = F.size(F.filter("_cuts", lambda c: c > F.col("score") if descending else c < F.col("score")))
    parted = zset.join(cuts, "key", "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(behind)).drop("_cuts")
    sizes = parted.filter(F.col("key").isin(*[k for k, _ in hot])).groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("key", "_part", F.coalesce(before, F.lit(0)).alias("_before")))
    placed = parted.withColumn("_nth", nth("key", "_part")).join(offsets, ["key", "_part"], "left")
    return placed.select(*zset.columns, (F.col("_nth") - 1 + F.coalesce("_before", F.lit(0))).alias("rank"))


def add(state: DataFrame, delta: DataFrame, mode: str = "", compare: str = "") -> DataFrame:
    """ZADD: last score of the delta wins; mode NX or XX, compare GT or LT."""
    new = delta.withColumn("_at", F.monotonically_increasing_id()).groupBy("key", "member").agg(F.max_by("score", "_at").alias("new"))
    both = state.withColumnRenamed("score", "old").join(new, ["key", "member"], "full")
    old, got = F.col("old"), F.col("new")
    value = F.coalesce(got, old)
    if compare == "GT":
        value = F.greatest(old, got)
    elif compare == "LT":
        value = F.least(old, got)
    if mode == "NX":
        value = F.coalesce(old, got)
    out = both.filter(old.isNotNull()) if mode == "XX" else both
    return out.select("key", "member", value.alias("score"))


def increment(state: DataFrame, delta: DataFrame) -> DataFrame:
    """ZINCRBY in bulk: scores plus the sums of deltas (key, member, score)."""
    return state.unionByName(delta).groupBy("key", "member").agg(F.sum("score").alias("score"))


def remove(state: DataFrame, members: DataFrame) -> DataFrame:
    return state.join(members.select("key", "member"), ["key", "member"], "left_anti")


def score_bound(text: str) -> tuple[float, bool]:
    """(value, included) of ``1.5``, ``(1.5``, ``-inf`` or ``+inf``."""
    open_ = text.startswith("(")
    return float(text[1:] if open_ else text), not open_


def by_score(zset: DataFrame, low: str, high: str) -> DataFrame:
    """ZRANGEBYSCORE and ZCOUNT: a filter that reaches the scan."""
    (a, with_a), (b, with_b) = score_bound(low), score_bound(high)
    score = F.col("score")
    if a != float("-inf"):
        zset = zset.filter(score >= a if with_a else score > a)
    if b != float("inf"):
        zset = zset.filter(score <= b if with_b else score < b)
    return zset


def by_lex(zset: DataFrame, low: str, high: str) -> DataFrame:
    """ZRANGEBYLEX: ``[a``, ``(a``, ``-`` and ``+``."""
    for text, least in ((low, True), (high, False)):
        if text in ("-", "+"):
            if (text == "-") != least:
                return zset.filter(F.lit(False))
            continue
        if text[:1] not in ("[", "("):
            raise ValueError("a bound starts with [ or (")
        value, m = text[1:], F.col("member")
        zset = zset.filter((m >= value if text[0] == "[" else m > value) if least else (m <= value if text[0] == "[" else m < value))
    return zset


def by_rank(zset: DataFrame, start: int, stop: int, descending: bool = False) -> DataFrame:
    """ZRANGE by rank, both ends included; negative ranks count from the end."""
    out = ranked(zset, descending)
    if start < 0 or stop < 0:
        n = F.count(F.lit(1)).over(Window.partitionBy("key"))
        out = out.withColumn("_n", n)
        a = F.lit(start) if start >= 0 else F.greatest(F.col("_n") + start, F.lit(0))
        b = F.lit(stop) if stop >= 0 else F.col("_n") + stop
        return out.filter(F.col("rank").between(a, b)).drop("_n")
    return out.filter(F.col("rank").between(start, stop))


def page(zset: DataFrame, offset: int = 0, count: int | None = None, descending: bool = False) -> DataFrame:
    """LIMIT of each key's members in order."""
    out = ranked(zset, descending).filter(F.col("rank") >= offset)
    return out if count is None or count < 0 else out.filter(F.col("rank") < offset + count)


def pop(state: DataFrame, n: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN and ZPOPMAX: (popped, rest)."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(*_order(highest)))
    marked = state.withColumn("_n", nth)  # the filter is on the row number itself, which limits each group early
    cols = ["key", "member", "score"]
    return marked.filter(F.col("_n") <= n).select(*cols), marked.filter(F.col("_n") > n).select(*cols)


def pop_first(state: DataFrame, keys: Sequence[str], n: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZMPOP: pop from the first of the keys that has members."""
    order = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    first = state.filter(F.col("key").isin(*keys)).agg(F.min_by("key", F.element_at(order, F.col("key"))).alias("_key"))
    mine = state.join(F.broadcast(first), F.col("key") == F.col("_key"), "left_semi")
    popped, _ = pop(mine, n, highest)
    return popped, remove(state, popped)


def _weighted(state: DataFrame, keys: Sequence[str], weights: Sequence[float] | None) -> DataFrame:
    by: Mapping[str, float] = dict(zip(keys, weights or [1.0] * len(keys)))
    table = F.create_map(*[F.lit(x) for k, w in by.items() for x in (k, float(w))])
    return state.filter(F.col("key").isin(*by)).select("key", "member", (F.col("score") * F.element_at(table, F.col("key"))).alias("score"))


_MERGE = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def union(state: DataFrame, keys: Sequence[str], weights: Sequence[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """ZUNION: (member, score), one partial aggregation."""
    return _weighted(state, keys, weights).groupBy("member").agg(_MERGE[aggregate.upper()]("score").alias("score"))


def intersect(state: DataFrame, keys: Sequence[str], weights: Sequence[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """ZINTER: members of all keys; a key without members empties the result."""
    found = _weighted(state, keys, weights).groupBy("member").agg(_MERGE[aggregate.upper()]("score").alias("score"), F.count(F.lit(1)).alias("_n"))
    return found.filter(F.col("_n") == len(set(keys))).drop("_n")


def difference(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ZDIFF: the first key's members that no other key has, with their scores."""
    mine = state.filter(F.col("key") == keys[0]).select("member", "score")
    if len(keys) == 1:
        return mine
    return mine.join(state.filter(F.col("key").isin(*keys[1:])).select("member"), "member", "left_anti")


def intersect_count(state: DataFrame, keys: Sequence[str], limit: int = 0) -> int:
    """ZINTERCARD: counting stops at the limit, if there is one."""
    found = intersect(state, keys)
    return (found.limit(limit) if limit else found).count()


def store(result: DataFrame, state: DataFrame, dest: str) -> DataFrame:
    """The STORE forms: the result replaces the destination key."""
    return state.filter(F.col("key") != dest).unionByName(result.select(F.lit(dest).alias("key"), "member", "score"))


def remove_by_rank(state: DataFrame, start: int, stop: int) -> DataFrame:
    return remove(state, by_rank(state, start, stop))


def remove_by_score(state: DataFrame, low: str, high: str) -> DataFrame:
    return remove(state, by_score(state, low, high))


def remove_by_lex(state: DataFrame, low: str, high: str) -> DataFrame:
    return remove(state, by_lex(state, low, high))

