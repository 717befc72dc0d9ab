"""Values as columns: typed casts in and out, defaults, time-ordered ids, row numbers at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def uuid7(now: Column | None = None) -> Column:
    """A time-ordered UUID: milliseconds, version 7, random tail."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(now if now is not None else F.current_timestamp()))), 12, "0")
    tail = F.uuid()
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(tail, 16, 3), F.substring(tail, 19, 18))


def default_value(text: str, now: Column | None = None) -> Column:
    """A column default: ``uuid()``, ``gen_random_uuid()``, ``now()`` or a literal."""
    word = text.lower()
    if word in ("uuid()", "gen_random_uuid()"):
        return uuid7(now)
    if word in ("now()", "*"):
        return F.unix_millis(now if now is not None else F.current_timestamp()).cast("string")
    return F.lit(text)


def cast_in(col: Column, kind: str, dims: int | None = None) -> Column:
    """Text to a declared type; NULL where it does not parse."""
    if kind == "INT":
        return col.try_cast("bigint")
    if kind == "FLOAT":
        return col.try_cast("double")
    if kind == "BOOL":
        word = F.lower(col)
        return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)
    if kind == "TIMESTAMP":
        ms = F.when(col == "*", F.unix_millis(F.current_timestamp())).otherwise(col.try_cast("bigint"))
        return F.coalesce(F.timestamp_millis(ms), col.try_cast("timestamp"))
    if kind == "UUID":
        word = F.lower(col)
        return F.when(word.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), word)
    if kind == "VECTOR":
        numbers = F.filter(F.split(F.regexp_replace(col, r"[\[\]]", " "), r"[\s,]+"), lambda x: x != "")
        made = F.transform(numbers, lambda x: x.try_cast("float"))
        return F.when((F.size(made) == dims) & ~F.exists(made, lambda x: x.isNull()), made)
    if kind == "JSON":
        return F.when(F.is_valid_json(col) if hasattr(F, "is_valid_json") else F.try_parse_json(col).isNotNull(), col)
    if kind == "ARRAY":
        return F.when(F.schema_of_variant(F.try_parse_json(col)).startswith("ARRAY"), col)
    return col


def cast_out(col: Column, kind: T.DataType) -> Column:
    """A value as text at the edge: NULL is empty, whole doubles print as integers, timestamps as epoch ms."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
        made = F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        made = F.unix_millis(col.cast("timestamp")).cast("string")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        made = F.to_json(col)
    else:
        made = col.cast("string")
    return F.coalesce(made, F.lit(""))


def number_rows(df: DataFrame, name: str, first: int = 1) -> DataFrame:
    """Consecutive numbers in the rows' present order, without gathering them in one task.

    One pass counts rows by partition; the counts, as many as there are partitions, give each its offset.
    """
    if df.isEmpty():
        return df.withColumn(name, F.lit(None).cast("long"))
    marked = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    at, offsets = first - 1, []
    for row in marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        offsets += [F.lit(row["_part"]), F.lit(at)]
        at += row["n"]
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return marked.withColumn(name, within + F.element_at(F.create_map(*offsets), F.col("_part"))).drop("_part", "_at")
