"""Approximate distinct counts: mergeable sketches of 2^14 registers, one a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS_LOG2 = 14


def add(elements: DataFrame) -> DataFrame:
    """PFADD of rows (key, element): (key, sketch); partial sketches before the shuffle."""
    return elements.groupBy("key").agg(F.hll_sketch_agg(F.col("element").cast("string"), F.lit(REGISTERS_LOG2)).alias("sketch"))


def merge(sketches: DataFrame, dest: str | None = None) -> DataFrame:
    """PFMERGE: all sketches into one, or the sketches of each key where no destination is given."""
    if dest is None:
        return sketches.groupBy("key").agg(F.hll_union_agg("sketch").alias("sketch"))
    return sketches.agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit(dest).alias("key"), "sketch")


def count(sketches: DataFrame) -> DataFrame:
    """PFCOUNT of each key."""
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))


def count_union(sketches: DataFrame) -> DataFrame:
    """PFCOUNT of several keys: one estimate of their union."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
