"""Messages and key events: delivery to exact and pattern subscriptions, as joins that also stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob, glob_regex


PREFIX = 16


def subscriptions(spark: SparkSession, exact: list[tuple[str, str]] = (), patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """A table (subscriber, kind, pattern, regex) from (subscriber, channel) and (subscriber, glob) pairs."""
    rows = [(s, "exact", c, None) for s, c in exact] + [(s, "pattern", p, glob_regex(p)) for s, p in patterns]
    return spark.createDataFrame(rows, "subscriber string, kind string, pattern string, regex string")


def deliver(messages: DataFrame, subs: DataFrame, channel: str = "channel") -> DataFrame:
    """Each message once for every matching subscription: exact ones by an equi-join on the channel, patterns by one on
    what they begin with up to a wildcard (at most ``PREFIX`` characters), before their regex is tried."""
    exact = subs.filter("kind = 'exact'").select("subscriber", F.col("pattern").alias(channel)).withColumn("pattern", F.lit(None).cast("string"))
    begins = F.substring(F.regexp_extract("pattern", r"^[^*?\[\\]*", 0), 1, PREFIX)
    globs = subs.filter("kind = 'pattern'").select("subscriber", "pattern", "regex", begins.alias("_begins"))
    sizes = sorted(r[0] for r in globs.select(F.length("_begins")).distinct().collect())  # PREFIX + 1 numbers at most
    c = F.col(f"`{channel}`")
    tried = F.array_compact(F.array(*[F.when(F.length(c) >= n, F.substring(c, 1, n)) for n in sizes])) if sizes else F.array().cast("array<string>")
    by_name = messages.join(exact, channel).select("subscriber", "pattern", *messages.columns)
    met = messages.withColumn("_begins", F.explode(tried)).join(globs, "_begins")
    by_glob = met.filter(F.expr(f"`{channel}` rlike regex")).select("subscriber", "pattern", *messages.columns)
    return by_name.unionByName(by_glob)


def receivers(messages: DataFrame, subs: DataFrame, channel: str = "channel") -> DataFrame:
    """PUBLISH replies: how many subscriptions each message reached; message rows need an ``id``."""
    got = deliver(messages, subs, channel).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return messages.join(got, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("receivers"))


def channels(subs: DataFrame, pattern: str | None = None) -> DataFrame:
    """PUBSUB CHANNELS and NUMSUB: exact channels with their subscriber counts."""
    rows = subs.filter("kind = 'exact'")
    if pattern is not None:
        rows = rows.filter(glob(F.col("pattern"), pattern))
    return rows.groupBy(F.col("pattern").alias("channel")).agg(F.count(F.lit(1)).alias("subscribers"))


def pattern_count(subs: DataFrame) -> int:
    """PUBSUB NUMPAT."""
    return subs.filter("kind = 'pattern'").select("pattern").distinct().count()


def key_events(events: DataFrame, patterns: list[str]) -> DataFrame:
    """KSUB: (pattern, key, op) for every event (key, op) and pattern that match; works on streams."""
    hits: Column = F.array_compact(F.array(*[F.when(glob(F.col("key"), p), F.lit(p)) for p in patterns]))
    return events.withColumn("pattern", F.explode(hits)).select("pattern", "key", "op")


def coalesced(events: DataFrame) -> DataFrame:
    """The last operation of each key: what a full queue keeps; events (key, op, at)."""
    return events.groupBy("key").agg(F.max_by("op", "at").alias("op"), F.max("at").alias("at"))
