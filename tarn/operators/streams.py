"""Append-only streams in batch form: entries (key, ms, seq, fields), groups' pending lists
(key, grp, consumer, ms, seq, delivered_ms, deliveries). Ids order by ms and then seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ["ms", "seq"]


def parse_id(text: str, end: bool = False) -> tuple[int, int]:
    """``ms-seq``; a bare ms means its first or last entry; ``-`` and ``+`` are the ends."""
    if text == "-":
        return 0, 0
    if text == "+":
        return (1 << 63) - 1, (1 << 63) - 1
    ms, dash, seq = text.partition("-")
    return int(ms), int(seq) if dash else ((1 << 63) - 1 if end else 0)


def after(ms: int, seq: int, included: bool = False) -> Column:
    """A condition on ids; written on the columns so that a scan can use it."""
    same = F.col("seq") >= seq if included else F.col("seq") > seq
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & same)


def before(ms: int, seq: int, included: bool = True) -> Column:
    same = F.col("seq") <= seq if included else F.col("seq") < seq
    return (F.col("ms") < ms) | ((F.col("ms") == ms) & same)


def append(state: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """XADD with automatic ids for rows (key, arrival, fields): one batch, ids above each stream's last."""
    last = state.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("_last"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("arrival"))
    ahead = F.coalesce(F.col("_last.ms"), F.lit(-1)) >= now_ms
    placed = new.withColumn("_n", nth).join(last, "key", "left").select("key", F.when(ahead, F.col("_last.ms")).otherwise(F.lit(now_ms)).cast("long").alias("ms"), F.when(ahead, F.col("_last.seq") + F.col("_n")).otherwise(F.col("_n") - 1).cast("long").alias("seq"), "fields")
    return state.select("key", "ms", "seq", "fields").unionByName(placed)


def length(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _first(rows: DataFrame, count: int | None, descending: bool = False) -> DataFrame:
    if count is None:
        return rows
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ID]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("_n") <= count).drop("_n")


def range_(state: DataFrame, start: str = "-", end: str = "+", count: int | None = None, descending: bool = False) -> DataFrame:
    """XRANGE and XREVRANGE of each stream; both ends included."""
    rows = state
    if start != "-":
        rows = rows.filter(after(*parse_id(start), included=True))
    if end != "+":
        rows = rows.filter(before(*parse_id(end, True)))
    return _first(rows, count, descending)


def read(state: DataFrame, last: str, count: int | None = None) -> DataFrame:
    """XREAD: entries after an id, the first ones of each stream."""
    return _first(state.filter(after(*parse_id(last))), count)


def trim(state: DataFrame, maxlen: int) -> DataFrame:
    """XTRIM MAXLEN: the newest entries of each stream."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.col("ms").desc(), F.col("seq").desc()))
    return state.withColumn("_n", newest).filter(F.col("_n") <= maxlen).drop("_n")


def delete(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("key", *ID), ["key", *ID], "left_anti")


def group_read(state: DataFrame, pending: DataFrame, key: str, group: str, consumer: str, last: tuple[int, int], count: int | None, now_ms: int, no_ack: bool = False) -> tuple[DataFrame, DataFrame]:
    """XREADGROUP of new entries: (delivered, pending with them added)."""
    rows = _first(state.filter((F.col("key") == key) & after(*last)), count)
    if no_ack:
        return rows, pending
    held = rows.select("key", F.lit(group).alias("grp"), F.lit(consumer).alias("consumer"), *ID, F.lit(now_ms).cast("long").alias("delivered_ms"), F.lit(1).cast("long").alias("deliveries"))
    return rows, pending.unionByName(held)


def acknowledge(pending: DataFrame, acks: DataFrame) -> DataFrame:
    """XACK of rows (key, grp, ms, seq)."""
    return pending.join(acks.select("key", "grp", *ID), ["key", "grp", *ID], "left_anti")


def pending_summary(pending: DataFrame) -> DataFrame:
    """XPENDING: count, least and greatest id, and the count of each consumer, by group."""
    by = pending.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ID)).alias("lo"), F.max(F.struct(*ID)).alias("hi"))
    return by.groupBy("key", "grp").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("consumer", "n"))).alias("consumers"))


def pending_range(pending: DataFrame, start: str = "-", end: str = "+", count: int | None = None, consumer: str | None = None) -> DataFrame:
    rows = range_(pending, start, end)
    rows = rows if consumer is None else rows.filter(F.col("consumer") == consumer)
    return _first(rows, count)


def claim(pending: DataFrame, ids: DataFrame, consumer: str, min_idle_ms: int, now_ms: int) -> DataFrame:
    """XCLAIM: entries idle long enough change owner and count another delivery."""
    asked = ids.select("key", "grp", *ID).withColumn("_asked", F.lit(True))
    marked = pending.join(asked, ["key", "grp", *ID], "left")
    hit = F.col("_asked").isNotNull() & (F.lit(now_ms) - F.col("delivered_ms") >= min_idle_ms)
    return marked.select("key", "grp", F.when(hit, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"), *ID, F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("delivered_ms")).alias("delivered_ms"), F.when(hit, F.col("deliveries") + 1).otherwise(F.col("deliveries")).alias("deliveries"))


def auto_claim(pending: DataFrame, state: DataFrame, key: str, group: str, consumer: str, min_idle_ms: int, now_ms: int, start: str = "0-0", count: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """XAUTOCLAIM: (pending after, claimed entries, ids whose entries are gone), from a cursor on."""
    mine = pending.filter((F.col("key") == key) & (F.col("grp") == group) & after(*parse_id(start), included=True) & (F.lit(now_ms) - F.col("delivered_ms") >= min_idle_ms))
    picked = _first(mine, count)
    there = picked.join(state.select("key", *ID), ["key", *ID], "left_semi")
    gone = picked.join(state.select("key", *ID), ["key", *ID], "left_anti").select("key", *ID)
    after_gone = pending.join(gone.withColumn("grp", F.lit(group)), ["key", "grp", *ID], "left_anti")
    return claim(after_gone, there, consumer, min_idle_ms, now_ms), state.join(there.select("key", *ID), ["key", *ID], "left_semi"), gone


def info(state: DataFrame) -> DataFrame:
    """XINFO STREAM: length, first and last id."""
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct(*ID)).alias("first_id"), F.max(F.struct(*ID)).alias("last_id"))
