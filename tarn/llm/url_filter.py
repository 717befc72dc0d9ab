"""Temporal URL filter: dated list entries, as-of joined with captures, in DataFrame functions only.

A list changes over time: an ``add`` puts a pattern on a list from a date on, a ``drop`` takes it off.
The rows of one (list, pattern) become validity intervals [from, to) with one window over the list; a
capture is held against the entries whose interval covers its fetch time. Patterns are a host (matching
the host and its subdomains) or a host with a path prefix of whole segments, so a capture has as many
lookup keys as it has host suffixes and path prefixes (no deeper than the list's deepest pattern, which bounds
the keys of very long URLs and loses none), and the as-of join is an equi-join on the key with
an interval condition. The interval side is broadcast only when its counted rows are within
``BROADCAST_ROWS``; else both sides shuffle by key, where adaptive execution splits hot hosts, and only the
matches go on to their captures. Matches are counted with partial aggregation, so a hot host makes no hot task.

Defined results: patterns and actions have no letter case; a null or unparsable URL or a null fetch time is kept
with no match; rows of one pattern and date collapse to one, ``drop`` winning; repeated captures give a row each
time they appear, with its own count; ``best_pattern`` is the longest, then the greatest as a string; an empty
list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BROADCAST_ROWS = 200_000
FOREVER = "9999-12-31"


def validity(entries: DataFrame) -> DataFrame:
    """entries(list, pattern, action, day) as intervals (list, pattern, valid_from, valid_to)."""
    told = entries.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull()).select("list", F.lower("pattern").alias("pattern"), "day", F.lower("action").alias("action"))
    one = told.groupBy("list", "pattern", "day").agg(F.max(F.when(F.col("action") == "drop", 1).otherwise(0)).alias("off"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    ahead = one.withColumn("valid_to", F.coalesce(F.lead("day").over(w), F.to_date(F.lit(FOREVER))))
    return ahead.filter("off = 0").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def steps_of(url: Column) -> Column:
    """The non-empty steps of the path."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def keys_of(url: Column, labels: int, steps: int) -> Column:
    """Lookup keys: the host's suffixes of up to ``labels`` labels, and the host with path prefixes of up to ``steps`` steps."""
    host, parts, path = host_of(url), F.split(host_of(url), r"\."), steps_of(url)
    n, m = F.size(parts), F.least(F.size(path), F.lit(steps))
    suffixes = F.transform(F.sequence(F.greatest(n - labels + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    prefixes = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes)))


def judge_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """captures(key, url, fetched_on) with n_entries, lists, best_pattern and blocked as of the fetch day."""
    spans = validity(entries)
    host = F.split("pattern", "/")
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split(host[0], r"\."))).alias("labels"), F.max(F.size(host) - 1).alias("steps")).first()
    few = size["n"] <= BROADCAST_ROWS
    rows = captures.select(F.col(key).alias("k"), "url", "fetched_on", F.monotonically_increasing_id().alias("capture"))
    rows = rows if few else stage(rows, "captures")  # read twice, so the numbers must stand
    keys = keys_of(F.col("url"), size["labels"] or 0, size["steps"] or 0) if size["n"] else F.array().cast("array<string>")
    on = (F.col("c.pattern") == F.col("s.pattern")) & (F.col("c.fetched_on") >= F.col("s.valid_from")) & (F.col("c.fetched_on") < F.col("s.valid_to"))
    found = [F.count("s.pattern").alias("n"), F.array_sort(F.collect_set("s.list")).alias("l"), F.max(F.when(F.col("s.pattern").isNotNull(), F.struct(F.length("s.pattern").alias("n"), F.col("s.pattern").alias("p")))).alias("b")]
    if few:
        looked = rows.select("capture", "k", "url", "fetched_on", F.explode_outer(keys).alias("pattern"))
        met = looked.alias("c").join(F.broadcast(spans).alias("s"), on, "left")
        out = met.groupBy("c.capture", "c.k", "c.url", "c.fetched_on").agg(*found)
    else:
        looked = rows.select("capture", "fetched_on", F.explode(keys).alias("pattern"))
        met = looked.alias("c").join(spans.alias("s"), on).groupBy("c.capture").agg(*found)
        out = rows.join(met, "capture", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(F.col("k").alias(key), "url", host_of(F.col("url")).alias("host"), "fetched_on", n.alias("n_entries"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("lists"), F.col("b.p").alias("best_pattern"), (n > 0).alias("blocked"))


#: Dated entries that the registered query applies besides those it makes from ``pages``: (list, pattern, action, day).
ENTRIES = [
    ("spam", "spam-farm.example.org", "add", "2024-02-01"),
    ("spam", "spam-farm.example.org", "drop", "2024-05-15"),
    ("spam", "spam-farm.example.org", "add", "2024-08-01"),
    ("spam", "cheap-pills.example.com", "add", "2024-01-10"),
    ("spam", "cheap-pills.example.com", "add", "2024-03-10"),
    ("spam", "www.cheap-pills.example.com", "add", "2024-06-01"),
    ("legal", "example.net", "add", "2024-11-01"),
    ("legal", "ththtion.example.net/es", "add", "2024-04-01"),
    ("legal", "thther.example.org/en", "add", "2024-04-01"),
    ("legal", "thther.example.org/en", "drop", "2024-04-01"),
    ("legal", "blog.ththan.example.net/en", "add", "2024-02-20"),
    ("legal", "blog.ththan.example.net/en", "drop", "2024-09-01"),
    ("adult", "therin.example.net/en/770", "add", "2023-12-01"),
    ("adult", "m.therou.example.com", "add", "2024-07-01"),
]


def entries_table(spark, pages: DataFrame) -> DataFrame:
    """A dated list as large as the table asks for: ``ENTRIES``, and a quarter of the hosts and paths of ``pages``.

    The MD5 of a pattern decides: its first digit whether the pattern is listed (0 to 3), dropped again (0, 1) and
    listed once more (0); the next ones on which days.
    """
    rows = spark.createDataFrame(ENTRIES, "list string, pattern string, action string, day string").withColumn("day", F.to_date("day"))
    url = F.col("url")
    seen = pages.select(host_of(url).alias("host"), F.array_join(steps_of(url), "/").alias("path")).filter("host != ''").distinct()
    paths = seen.filter("path != ''").select(F.lit("spam").alias("list"), F.concat("host", F.lit("/"), "path").alias("pattern"))
    told = paths.unionByName(seen.select(F.lit("legal").alias("list"), F.col("host").alias("pattern")).distinct()).withColumn("x", F.md5(F.encode("pattern", "UTF-8")))
    hexed = lambda at: F.conv(F.substring("x", at, 2), 16, 10).cast("int")
    on = F.date_add(F.to_date(F.lit("2024-01-01")), hexed(2))
    off = F.date_add(on, hexed(4) + 1)
    dated = lambda least, action, day: F.when(F.substring("x", 1, 1) <= least, F.struct(F.lit(action).alias("action"), day.alias("day")))
    events = F.array_compact(F.array(dated("3", "add", on), dated("1", "drop", off), dated("0", "add", F.date_add(off, 30))))
    return rows.unionByName(told.select("list", "pattern", F.explode(events).alias("e")).select("list", "pattern", "e.action", "e.day"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: day number page_id mod 366 of 2024."""
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched_on"))


ORACLE_SQL = (
    "WITH e(list, pattern, action, day) AS (VALUES "
    + ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in ENTRIES)
    + r"""),
c AS (SELECT page_id, url, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
  trim(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g'), '/') AS path,
  CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on FROM pages),
told AS (SELECT list, pattern, md5(pattern) AS x FROM (
  SELECT DISTINCT 'spam' AS list, host || '/' || path AS pattern FROM c WHERE host <> '' AND path <> ''
  UNION ALL SELECT DISTINCT 'legal', host FROM c WHERE host <> '')),
dated AS (SELECT list, pattern, substr(x, 1, 1) AS d, CAST(DATE '2024-01-01' + CAST('0x' || substr(x, 2, 2) AS INTEGER) AS DATE) AS first,
  CAST(DATE '2024-01-01' + CAST('0x' || substr(x, 2, 2) AS INTEGER) + CAST('0x' || substr(x, 4, 2) AS INTEGER) + 1 AS DATE) AS off FROM told),
ev AS (SELECT * FROM e UNION ALL SELECT list, pattern, 'add', first FROM dated WHERE d <= '3'
  UNION ALL SELECT list, pattern, 'drop', off FROM dated WHERE d <= '1'
  UNION ALL SELECT list, pattern, 'add', CAST(off + 30 AS DATE) FROM dated WHERE d <= '0'),
one AS (SELECT list, pattern, day, max(CASE WHEN action = 'drop' THEN 1 ELSE 0 END) AS off FROM ev GROUP BY ALL),
iv AS (SELECT list, pattern, off, day AS valid_from,
  coalesce(lead(day) OVER (PARTITION BY list, pattern ORDER BY day), DATE '9999-12-31') AS valid_to FROM one),
m AS (SELECT c.page_id, iv.list, iv.pattern FROM c JOIN iv ON iv.off = 0 AND c.fetched_on >= iv.valid_from AND c.fetched_on < iv.valid_to
  AND (CASE WHEN strpos(iv.pattern, '/') = 0 THEN c.host = iv.pattern OR ends_with(c.host, '.' || iv.pattern)
       ELSE starts_with(c.host || '/' || c.path || '/', iv.pattern || '/') END)),
g AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max(struct_pack(n := length(pattern), p := pattern)).p AS best FROM m GROUP BY page_id)
SELECT c.page_id, c.url, c.host, c.fetched_on, coalesce(g.n, 0) AS n_entries, coalesce(g.lists, '') AS lists, g.best AS best_pattern, g.n IS NOT NULL AS blocked
FROM c LEFT JOIN g USING (page_id)
"""
)
