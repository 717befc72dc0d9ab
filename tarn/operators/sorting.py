"""SORT: elements ordered by themselves or by outside keys, with values looked up by pattern.

A pattern such as ``weight:*`` names a string key with the element in place of the star, and
``user:*->name`` a field of a hash; ``#`` is the element itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lookup(rows: DataFrame, pattern: str, name: str, strings: DataFrame | None, hashes: DataFrame | None) -> DataFrame:
    """Adds the looked-up value as a column, by one left join; NULL if there is none."""
    if pattern == "#":
        return rows.withColumn(name, F.col("element").cast("string"))
    head, arrow, field = pattern.partition("->")
    before, star, after = head.partition("*")
    key = F.concat(F.lit(before), F.col("element").cast("string"), F.lit(after)) if star else F.lit(head)
    if arrow:
        table = hashes.filter(F.col("field") == field).select(F.col("key").alias("_k"), F.col("value").cast("string").alias(name))
    else:
        table = strings.select(F.col("key").alias("_k"), F.col("value").cast("string").alias(name))
    return rows.join(table, key == F.col("_k"), "left").drop("_k")


def sort_elements(elements: DataFrame, by: str | None = None, get: Sequence[str] = (), alpha: bool = False, descending: bool = False, offset: int = 0, count: int | None = None, strings: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Rows (element[, pos]) sorted; ``get`` adds columns g0, g1, ..; a pattern without a star keeps the order."""
    rows = elements
    weight: Column
    if by and "*" in by:
        rows = _lookup(rows, by, "_w", strings, hashes)
        weight = F.col("_w")
    else:
        weight = F.col("element").cast("string")
    for i, pattern in enumerate(get):
        rows = _lookup(rows, pattern, f"g{i}", strings, hashes)
    if by and "*" not in by:
        order = [F.col("pos")] if "pos" in rows.columns else []
    else:
        key = weight if alpha else F.coalesce(weight.cast("double"), F.lit(0.0))
        order = [key.desc() if descending else key.asc(), F.col("element").desc() if descending else F.col("element").asc()]
    if order:
        rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    if count is not None:
        rows = rows.limit(count)
    return rows.drop("_w")
