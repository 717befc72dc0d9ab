"""Live queries: differences of results, and filters kept up to date from a change feed.

A change feed has rows (pk, op, at, row): op is insert, update or delete, ``at`` orders changes of a key and
``row`` is the new row as JSON (null for deletes).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.vectors import search
from ..plans.spec import QuerySpec


def incremental(spec: QuerySpec) -> bool:
    """Whether a query can be kept up to date row by row: one table, no ranking, paging or aggregation."""
    return not (spec.joins or spec.near or spec.limit is not None or spec.offset or spec.aggregates or spec.group_by)


def dependencies(spec: QuerySpec) -> set[str]:
    """Tables whose changes call for running the query again."""
    from ..plans.spec import Member

    return {spec.table, *(j.table for j in spec.joins), *(m.table for m in (*spec.where, *spec.policy) if isinstance(m, Member))}


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(op, key, columns of the new or, for deletes, the old row): one full join on the key."""
    cols = [c for c in after.columns if c != key]
    mark = lambda df, side: df.select(F.col(f"`{key}`").alias("_k"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias(side))
    both = mark(before, "_old").join(mark(after, "_new"), "_k", "full")
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    row = F.coalesce("_new", "_old")
    return both.withColumn("op", op).filter("op is not null").select("op", F.col("_k").alias(key), *[row[c].alias(c) for c in cols])


def latest_changes(feed: DataFrame) -> DataFrame:
    """The last change of each key in a batch; what an overflowing queue coalesces to."""
    return feed.groupBy("pk").agg(F.max_by(F.struct("op", "at", "row"), "at").alias("c")).select("pk", "c.op", "c.at", "c.row")


def apply_changes(state: DataFrame, feed: DataFrame, key: str = "pk") -> DataFrame:
    """State (pk, row) after a batch of changes."""
    last = latest_changes(feed)
    return state.join(last, key, "left_anti").unionByName(last.filter("op != 'delete'").select("pk", "row"))


def filter_events(feed: DataFrame, keep: Column, update_mode: str = "append") -> DataFrame:
    """Events (pk, event, row) of a filtered live query over a streaming change feed.

    State holds, for each key, the fingerprint of the row last seen inside the filter; a row that enters,
    changes in or leaves it gives insert, update or delete. ``keep`` is a condition on the feed's columns.
    """
    marked = feed.select("pk", "at", "row", ((F.col("op") != "delete") & F.coalesce(keep, F.lit(False))).alias("inside"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for row, inside in zip(rows["row"], rows["inside"]):
            if inside and held is None:
                out.append((key[0], "insert", row))
            elif inside and held != row:
                out.append((key[0], "update", row))
            elif not inside and held is not None:
                out.append((key[0], "delete", held))
            held = row if inside else None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame(out, columns=["pk", "event", "row"])

    return marked.groupBy("pk").applyInPandasWithState(step, "pk string, event string, row string", "row string", update_mode, "NoTimeout")


def run_on_change(feed: DataFrame, query: Callable[[], DataFrame], key: str, emit: Callable[[DataFrame, int], None], checkpoint: str):
    """A live query that cannot be kept incrementally: each micro-batch runs it again and emits the difference.

    Results pass through a versioned table beside the checkpoint, so a restarted query goes on from the last.
    """
    spark = feed.sparkSession
    path = f"{checkpoint}-results"

    def batch(changes: DataFrame, number: int) -> None:
        if changes.isEmpty():
            return
        after = query()
        now = f"{path}/v={number:010d}"
        after.write.mode("overwrite").parquet(now)
        held = spark.read.parquet(now)
        older = [v for v in _versions(spark, path) if v < number]
        before = spark.read.schema(held.schema).parquet(f"{path}/v={older[-1]:010d}") if older else held.limit(0)
        emit(diff(before, held, key), number)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def near_on_change(feed: DataFrame, vectors: Callable[[], DataFrame], query: Sequence[float], k: int, emit: Callable[[DataFrame, int], None], checkpoint: str, threshold: float | None = None):
    """A live vector subscription: each micro-batch of changes searches again and emits what entered, left or moved."""
    return run_on_change(feed, lambda: search(vectors(), query, k, threshold).select("key", F.round("similarity", 6).alias("similarity")), "key", emit, checkpoint)


def _versions(spark, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def to_feed(rows: DataFrame, key: str, op: str, at: Column) -> DataFrame:
    """Rows as changes of a feed."""
    return rows.select(F.col(f"`{key}`").cast("string").alias("pk"), F.lit(op).alias("op"), at.alias("at"), F.to_json(F.struct("*")).alias("row"))


def parse_row(text: str | None) -> dict | None:
    return json.loads(text) if text is not None else None
