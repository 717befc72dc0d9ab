"""The query catalogue: one entry an operator, each with its DuckDB counterpart where SQL has one.

Every query runs over its whole tables. Doubles that come from sums are rounded on both sides, since the
order of addition differs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, geo
from .functions.text import byte_range, lcs_length, lcs_text
from .operators import geo as geo_ops
from .operators import hashes, hll, lists, policies, sets, sorting, streams, tables, timeseries, vectors, zsets
from .plans.builder import query as build
from .plans.compile import compile_query
from .plans.dialect import from_params, parse_select, parse_where
from .plans.schema import EXPIRES, parse_table
from .session import ensure_checkpoint_dir
from .streaming import feeds, live, windows

Make = Callable[[SparkSession, "Tables"], DataFrame]
_MADE: dict[str, tuple[Make, str | None]] = {}


class Tables(Mapping):
    """The Parquet tables of a directory by name, and frames derived from them."""

    def __init__(self, spark: SparkSession, path: str, **derived: DataFrame):
        self.spark, self.path, self.derived = spark, path, derived

    def __getitem__(self, name: str) -> DataFrame:
        return self.derived[name] if name in self.derived else self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __contains__(self, name: object) -> bool:
        return name in self.derived or name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

    def __iter__(self) -> Iterator[str]:
        return iter(self.derived)

    def __len__(self) -> int:
        return len(self.derived)

    def plus(self, **derived: DataFrame) -> Tables:
        return Tables(self.spark, self.path, **self.derived, **derived)


def _add(name: str, sql: str | None = None):
    def keep(make: Make) -> Make:
        _MADE[name] = (make, sql)
        return make

    return keep


def _dialect(name: str, text: str, sql: str, derive: Callable[[Tables], Tables] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def make(spark: SparkSession, t: Tables) -> DataFrame:
        out = compile_query(parse_select(text), derive(t) if derive else t)
        return finish(out) if finish else out

    _MADE[name] = (make, sql)


def _round(*cols: str, digits: int = 4) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(c, digits) for c in cols})


def _millis(name: str = "ts"):
    return F.unix_millis(F.col(name).cast("timestamp"))


# --- projection and predicates -------------------------------------------------------------------------

_dialect("q01_select_project_alias", "c_custkey, c_name AS name FROM customer", "SELECT c_custkey, c_name AS name FROM customer")
_dialect("q02_where_range_and", "o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000")
_dialect("q03_where_or_precedence", "o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = F OR o_orderstatus = O AND o_totalprice > 300000", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 300000")


def _nulls(t: Tables) -> Tables:
    """Orders with NULL in place of status F."""
    return t.plus(holes=t["orders"].withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("F"))))


_HOLES = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders)"
_dialect("q04_where_ne_null", "o_orderkey FROM holes WHERE o_orderstatus != O", f"SELECT o_orderkey FROM {_HOLES} WHERE o_orderstatus IS DISTINCT FROM 'O'", _nulls)
_dialect("q05_where_in", "n_nationkey, n_name FROM nation WHERE n_nationkey IN ( 1 2 3 )", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 2, 3)")
_dialect("q06_where_not_in", "o_orderkey FROM holes WHERE o_orderstatus NOT IN ( O )", f"SELECT o_orderkey FROM {_HOLES} WHERE o_orderstatus NOT IN ('O')", _nulls)
_dialect("q07_where_like", "p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'r_d %'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'r_d %'")
_dialect("q08_where_ilike", "c_custkey FROM customer WHERE c_mktsegment ILIKE 'mach%'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'mach%'")
_dialect("q09_where_is_null", "o_orderkey FROM holes WHERE o_orderstatus IS NULL", f"SELECT o_orderkey FROM {_HOLES} WHERE o_orderstatus IS NULL", _nulls)
_dialect("q10_where_is_not_null", "o_orderkey, o_orderstatus FROM holes WHERE o_orderstatus IS NOT NULL", f"SELECT o_orderkey, o_orderstatus FROM {_HOLES} WHERE o_orderstatus IS NOT NULL", _nulls)
_dialect("q11_json_path_eq", "event_id FROM events WHERE props.k = 69", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 69")
_dialect("q12_json_path_range", "event_id FROM events WHERE props.k >= 20 AND props.k < 40", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 20 AND 39")


def _docs(t: Tables) -> Tables:
    """Events with nested JSON, absent keys and JSON nulls by remainder."""
    k = F.pmod("event_id", F.lit(4))
    meta = F.when(k == 0, F.concat(F.lit('{"a":{"n":'), F.col("event_id").cast("string"), F.lit("}}"))).when(k == 1, F.lit('{"a":{"n":null}}')).when(k == 2, F.lit('{"a":"none"}')).otherwise(F.lit("{}"))
    tags = F.concat(F.lit('["'), F.col("event_type"), F.lit('","all"]'))
    return t.plus(docs=t["events"].select("event_id", "event_type", meta.alias("meta"), tags.alias("tags"), F.array("event_type", F.lit("all")).alias("labels")))


_dialect("q13_json_is_valid", "event_id FROM docs WHERE meta.a.n IS VALID", "SELECT event_id FROM events WHERE event_id % 4 = 0", _docs)
_dialect("q14_json_is_not_valid", "event_id FROM docs WHERE meta.a.n IS NOT VALID", "SELECT event_id FROM events WHERE event_id % 4 <> 0", _docs)
_dialect("q14b_json_ne_skips_absent", "event_id FROM docs WHERE meta.a.n != 4", "SELECT event_id FROM events WHERE event_id % 4 = 0 AND event_id <> 4", _docs)
_dialect("q15_array_contains", "event_id FROM docs WHERE tags CONTAINS click", "SELECT event_id FROM events WHERE list_contains(['all', event_type], 'click')", _docs)
_dialect("q15b_array_index", "event_id FROM docs WHERE tags.0 = view AND labels CONTAINS all", "SELECT event_id FROM events WHERE event_type = 'view'", _docs)

# --- joins ---------------------------------------------------------------------------------------------

_dialect("q16_join_inner", "o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
_dialect("q17_join_left", "c.c_custkey, n.n_name FROM customer c LEFT JOIN few n ON c.c_nationkey = n.n_nationkey", "SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n ON c.c_nationkey = n.n_nationkey", lambda t: t.plus(few=t["nation"].filter("n_nationkey < 10")))
_dialect(
    "q18_join_multi",
    "o.o_orderkey, n.n_name, r.r_name AS region FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice >= 250000",
    "SELECT o.o_orderkey, n.n_name, r.r_name AS region FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice >= 250000",
)
_dialect("q19_join_filter_right", "o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000 AND o.o_orderstatus = F", "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000 AND o.o_orderstatus = 'F'")


@_add("q19b_url_params", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 480000 ORDER BY o.o_orderkey LIMIT 20")
def _(spark, t):
    params = {"select": "orders.o_orderkey,c.c_name", "join": "customer:c:o_custkey:c_custkey", "where": "orders.o_totalprice > 480000", "order": "orders.o_orderkey:asc", "limit": "20"}
    return compile_query(from_params("orders", params), t)


def _policy(using: str, table: str, columns: list[str], claims: dict[str, str] | None = None, derive=None) -> Make:
    def make(spark: SparkSession, t: Tables) -> DataFrame:
        t = derive(t) if derive else t
        return policies.admitted(t[table].select(*columns), table, [policies.Policy(table, ("read",), using)], claims or {}, t)

    return make


_BIG = "(SELECT * FROM orders WHERE o_totalprice > 450000)"
_big = lambda t: t.plus(big=t["orders"].filter("o_totalprice > 450000"))
_MADE["q20_semi_membership"] = (_policy("c_custkey IN (SELECT o_custkey FROM big)", "customer", ["c_custkey", "c_name"], derive=_big), f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_BIG})")
_MADE["q21_anti_membership"] = (_policy("c_custkey NOT IN (SELECT o_custkey FROM big)", "customer", ["c_custkey", "c_name"], derive=_big), f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {_BIG})")

# --- aggregation ---------------------------------------------------------------------------------------

_AGG = "count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_tax) AS high"
_TAGG = "COUNT(*) AS n, SUM(l_quantity) AS qty, AVG(l_extendedprice) AS price, MIN(l_discount) AS low, MAX(l_tax) AS high"
_dialect("q22_agg_global", f"{_TAGG} FROM lineitem", f"SELECT {_AGG} FROM lineitem", finish=_round("qty", "price"))
_dialect("q23_agg_empty_zero", "COUNT(*) AS n, SUM(l_quantity) AS qty, AVG(l_quantity) AS mean, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem WHERE l_quantity < 0", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS high")
_dialect("q24_group_by", f"l_returnflag, l_linestatus, {_TAGG} FROM lineitem GROUP BY l_returnflag, l_linestatus", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY ALL", finish=_round("qty", "price"))
_dialect("q25_group_having", "o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_dialect("q26_group_order_limit", "o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 25", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25", finish=_round("total", digits=2))
_dialect("q26b_count_distinct", "c_mktsegment, COUNT(DISTINCT c_nationkey) AS nations, COUNT(c_acctbal) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(c_acctbal) AS n FROM customer GROUP BY c_mktsegment")
_dialect("q26c_join_group", "n.n_name, COUNT(*) AS orders, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING orders > 100 ORDER BY n.n_name", "SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 100", finish=_round("total", digits=2))
_dialect("q26d_group_distinct", "c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_dialect("q27_order_limit_offset", "o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
_dialect("q28_topk_desc", "o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


@_add("q28b_builder", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice < 200000 AND o_orderpriority <> '5-LOW' GROUP BY o_orderpriority HAVING count(*) > 1")
def _(spark, t):
    return build(t, "orders").select("o_orderpriority, COUNT(*) AS n").in_("o_orderstatus", ["F", "O"]).lt("o_totalprice", 200000).neq("o_orderpriority", "5-LOW").group("o_orderpriority").having("n", "gt", 1).df()


# --- time series ---------------------------------------------------------------------------------------


def _samples(t: Tables) -> DataFrame:
    return t["events"].select(F.col("user_id").cast("string").alias("key"), _millis().alias("ts"), "value")


def _series(t: Tables) -> DataFrame:
    by = t["events"].groupBy(F.col("user_id").cast("string").alias("key")).agg(F.min("event_type").alias("kind"))
    return by.select("key", F.lit(86_400_000).cast("long").alias("retention_ms"), F.create_map(F.lit("kind"), F.col("kind"), F.lit("src"), F.lit("events")).alias("labels"))


_DAY = 86_400_000
_S = "(SELECT CAST(user_id AS VARCHAR) AS key, (epoch_us(ts) // 1000) AS ts, value FROM events)"
_DUCK = {"avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(value) AS DOUBLE)", "first": "arg_min(value, ts)", "last": "arg_max(value, ts)", "range": "max(value) - min(value)", "std.p": "stddev_pop(value)", "std.s": "coalesce(stddev_samp(value), 0)", "var.p": "var_pop(value)", "var.s": "coalesce(var_samp(value), 0)"}


def _bucketed(function: str) -> Make:
    return lambda spark, t: timeseries.aggregate(_samples(t), function, _DAY).withColumn("value", F.round("value", 8))


for _i, (_f, _sql) in enumerate(_DUCK.items()):
    _MADE[f"q{29 + _i}_ts_bucket_{_f.replace('.', '')}"] = (_bucketed(_f), f"SELECT key, (ts // {_DAY}) * {_DAY} AS ts, round({_sql}, 8) AS value FROM {_S} GROUP BY 1, 2")


@_add("q41_ts_range_count", f"SELECT key, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS n FROM (SELECT key, (ts // 3600000) * 3600000 AS ts, max(value) AS value FROM {_S} WHERE ts BETWEEN 1704412800000 AND 1705017600000 GROUP BY 1, 2)) WHERE n <= 5")
def _(spark, t):
    return timeseries.range_(_samples(t), start=1704412800000, end=1705017600000, function="max", width_ms=3_600_000, count=5)


@_add("q42_ts_mrange_labels", f"SELECT s.key, (s.ts // {_DAY}) * {_DAY} AS ts, round(sum(s.value), 4) AS value FROM {_S} s JOIN (SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY 1 HAVING min(event_type) = 'click') k USING (key) GROUP BY 1, 2")
def _(spark, t):
    return timeseries.multi_range(_samples(t), _series(t), {"kind": "click", "src": "events"}, function="sum", width_ms=_DAY).withColumn("value", F.round("value", 4))


@_add("q43_ts_get_latest", f"SELECT key, max(ts) AS ts, arg_max(value, ts) AS value FROM {_S} GROUP BY key")
def _(spark, t):
    return timeseries.latest(_samples(t))


@_add("q44_ts_info", f"SELECT key, count(*) AS total_samples, min(ts) AS first_ts, max(ts) AS last_ts, CAST({_DAY} AS BIGINT) AS retention_ms FROM {_S} GROUP BY key")
def _(spark, t):
    return timeseries.info(_samples(t), _series(t)).drop("labels")


@_add("q45_ts_last_wins", "SELECT CAST(user_id AS VARCHAR) AS key, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(spark, t):
    rows = t["events"].select(F.col("user_id").cast("string").alias("key"), timeseries.bucket(_millis(), 3_600_000).alias("ts"), "value", "event_id")
    return timeseries.last_wins(rows, "event_id")


@_add("q46_ts_retention", f"SELECT s.key, s.ts, s.value FROM {_S} s JOIN (SELECT key, max(ts) AS m FROM {_S} GROUP BY key) k USING (key) WHERE s.ts >= k.m - {_DAY}")
def _(spark, t):
    return timeseries.retain(_samples(t), _series(t))


# --- vectors -------------------------------------------------------------------------------------------

_PROBE = [round(((i * 37) % 19 - 9) / 9.0, 4) for i in range(64)]
_VEC = "[" + ", ".join(map(str, _PROBE)) + "]::DOUBLE[]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_VEC})"


def _vectors(t: Tables) -> DataFrame:
    return t["embeddings"].select(F.col("vec_id").alias("key"), "embedding", F.to_json(F.struct(F.col("label").cast("string").alias("label"))).alias("metadata"))


@_add("q47_vector_topk", f"SELECT vec_id AS key, round({_COS}, 6) AS similarity FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(spark, t):
    return vectors.search(_vectors(t), _PROBE, 10).select("key", F.round("similarity", 6).alias("similarity"))


@_add("q48_vector_threshold", f"SELECT vec_id AS key, round({_COS}, 6) AS similarity FROM embeddings WHERE {_COS} >= 0.1")
def _(spark, t):
    return vectors.search(_vectors(t), _PROBE, None, threshold=0.1).select("key", F.round("similarity", 6).alias("similarity"))


@_add("q49_vector_filtered", f"SELECT vec_id AS key, round({_COS}, 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY {_COS} DESC, vec_id LIMIT 5")
def _(spark, t):
    return vectors.search(_vectors(t), _PROBE, 5, where=("label", "3")).select("key", F.round("similarity", 6).alias("similarity"))


_dialect(
    "q50_vector_near_join",
    f"e.vec_id, n.n_name, _similarity FROM embeddings e JOIN nation n ON e.label = n.n_nationkey WHERE e.label < 5 NEAR e.embedding '{_PROBE}' K 8 THRESHOLD 0.01",
    f"SELECT e.vec_id, n.n_name, round(e.s, 6) AS _similarity FROM (SELECT vec_id, label, {_COS} AS s FROM embeddings WHERE label < 5 ORDER BY s DESC, vec_id LIMIT 8) e JOIN nation n ON e.label = n.n_nationkey WHERE e.s >= 0.01",
    finish=_round("_similarity", digits=6),
)


@_add("q50b_vector_search_many", "SELECT query, key, similarity, rank FROM (SELECT q.vec_id AS query, v.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def _(spark, t):
    rows = t["embeddings"]
    found = vectors.search_many(rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query"), rows.withColumnRenamed("vec_id", "key"), 5)
    return found.select("query", "key", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


# --- geo -----------------------------------------------------------------------------------------------


def _places(t: Tables) -> DataFrame:
    """A place for each customer, from its key."""
    lon = (F.pmod(F.col("c_custkey") * 7919, F.lit(36000)) / 100.0) - 180.0
    lat = (F.pmod(F.col("c_custkey") * 104729, F.lit(17000)) / 100.0) - 85.0
    return t["customer"].select(F.lit("c").alias("key"), F.col("c_custkey").cast("string").alias("member"), lon.alias("lon"), lat.alias("lat"))


_P = "(SELECT CAST(c_custkey AS VARCHAR) AS member, ((c_custkey * 7919) % 36000) / 100.0 - 180.0 AS lon, ((c_custkey * 104729) % 17000) / 100.0 - 85.0 AS lat FROM customer)"


def _haversine(lon: str, lat: str, lon0: str = "15.0", lat0: str = "37.5") -> str:
    return f"2 * 6372797.560856 * asin(sqrt(least(1.0, sin((radians({lat0}) - radians({lat})) / 2) ** 2 + cos(radians({lat})) * cos(radians({lat0})) * sin((radians({lon0}) - radians({lon})) / 2) ** 2)))"


_H = _haversine("lon", "lat")


@_add("q51_geo_dist", f"SELECT member, round({_H}, 3) AS metres FROM {_P}")
def _(spark, t):
    return _places(t).select("member", F.round(geo.distance(F.col("lon"), F.col("lat"), 15.0, 37.5), 3).alias("metres"))


@_add("q52_geo_radius", f"SELECT member, round({_H} / 1000, 4) AS distance FROM {_P} WHERE {_H} <= 2000000")
def _(spark, t):
    return geo_ops.search(_places(t), 15.0, 37.5, radius=2000, unit="km").select("member", F.round("distance", 4).alias("distance"))


@_add("q53_geo_box", f"SELECT member FROM {_P} WHERE {_haversine('lon', 'lat', '15.0', 'lat')} <= 1500000 AND {_haversine('lon', 'lat', 'lon', '37.5')} <= 1000000")
def _(spark, t):
    return geo_ops.search(_places(t), 15.0, 37.5, box=(3000, 2000), unit="km").select("member")


@_add("q54_geo_topk", f"SELECT member, round({_H} / 1609.34, 4) AS distance FROM {_P} ORDER BY {_H}, member LIMIT 10")
def _(spark, t):
    return geo_ops.search(_places(t), 15.0, 37.5, radius=20000, unit="mi", count=10).select("member", F.round("distance", 4).alias("distance"))


@_add("q55_geohash")
def _(spark, t):
    stored = geo_ops.add(spark.createDataFrame([], "key string, member string, score double"), _places(t))
    return geo_ops.positions(stored).select("member", F.col("score").cast("long").alias("cell"), "geohash", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@_add("q55b_geo_pairs", f"SELECT a.member AS a, b.member AS b, round({_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 4) AS distance FROM {_P} a JOIN {_P} b ON CAST(b.member AS BIGINT) = CAST(a.member AS BIGINT) + 1")
def _(spark, t):
    p = _places(t)
    pairs = p.select("key", F.col("member").alias("a"), (F.col("member").cast("long") + 1).cast("string").alias("b"))
    return geo_ops.pair_distance(p, pairs, "km").filter("distance is not null").select("a", "b", F.round("distance", 4).alias("distance"))


# --- sorted sets, sets, sketches -----------------------------------------------------------------------


def _zset(t: Tables) -> DataFrame:
    return t["events"].groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).agg(F.round(F.sum("value"), 4).alias("score"))


_Z = "(SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, round(sum(value), 4) AS score FROM events GROUP BY 1, 2)"
_RANK = "row_number() OVER (PARTITION BY key ORDER BY score, member) - 1"
_REV = "row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1"


@_add("q56_zset_rank", f"SELECT key, member, score, {_RANK} AS rank, {_REV} AS rev FROM {_Z}")
def _(spark, t):
    up = zsets.ranked(_zset(t)).withColumn("rank", F.col("rank").cast("long"))
    return zsets.ranked(up.withColumnRenamed("rank", "up"), True).select("key", "member", "score", F.col("up").alias("rank"), F.col("rank").cast("long").alias("rev"))


@_add("q57_zset_range_score", f"SELECT * FROM {_Z} WHERE score > 100 AND score <= 400")
def _(spark, t):
    return zsets.by_score(_zset(t), "(100", "400")


@_add("q57b_zset_range_lex", f"SELECT * FROM {_Z} WHERE member >= '12' AND member < '40'")
def _(spark, t):
    return zsets.by_lex(_zset(t), "[12", "(40")


@_add("q58_zset_range_rank", f"SELECT key, member, score, rank FROM (SELECT *, {_RANK} AS rank, count(*) OVER (PARTITION BY key) AS n FROM {_Z}) WHERE rank >= 3 AND rank <= n - 5")
def _(spark, t):
    return zsets.by_rank(_zset(t), 3, -5).withColumn("rank", F.col("rank").cast("long"))


@_add("q59_zunion_weighted", f"SELECT member, round(sum(CASE key WHEN 'click' THEN score * 2 ELSE score * 0.5 END), 3) AS score FROM {_Z} WHERE key IN ('click', 'view') GROUP BY member")
def _(spark, t):
    return zsets.union(_zset(t), ["click", "view"], [2.0, 0.5]).withColumn("score", F.round("score", 3))


@_add("q60_zinter", f"SELECT member, max(score) AS score FROM {_Z} WHERE key IN ('click', 'purchase', 'error') GROUP BY member HAVING count(*) = 3")
def _(spark, t):
    return zsets.intersect(_zset(t), ["click", "purchase", "error"], aggregate="MAX")


_LOW = f"(SELECT * FROM {_Z} WHERE score < 400)"


@_add("q61_zdiff", f"SELECT member, score FROM {_LOW} WHERE key = 'click' AND member NOT IN (SELECT member FROM {_LOW} WHERE key = 'view')")
def _(spark, t):
    return zsets.difference(zsets.by_score(_zset(t), "-inf", "(400"), ["click", "view"])


@_add("q62_zpop", f"SELECT key, member, score FROM (SELECT *, {_RANK} AS rank FROM {_Z}) WHERE rank < 3")
def _(spark, t):
    return zsets.pop(_zset(t), 3)[0]


@_add("q62b_zremrange", f"SELECT key, member, score FROM (SELECT *, {_RANK} AS rank FROM {_Z}) WHERE rank > 9 AND NOT score BETWEEN 300 AND 350")
def _(spark, t):
    return zsets.remove_by_score(zsets.remove_by_rank(_zset(t), 0, 9), "300", "350")


def _set(t: Tables) -> DataFrame:
    return t["events"].filter("value > 40").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).distinct()


_E = "(SELECT DISTINCT event_type AS key, CAST(user_id AS VARCHAR) AS member FROM events WHERE value > 40)"


@_add("q63_set_union", f"SELECT DISTINCT member FROM {_E} WHERE key IN ('click', 'view')")
def _(spark, t):
    return sets.union(_set(t), ["click", "view"])


@_add("q64_set_inter", f"SELECT member FROM {_E} WHERE key IN ('click', 'view') GROUP BY member HAVING count(DISTINCT key) = 2")
def _(spark, t):
    return sets.intersect(_set(t), ["click", "view"])


@_add("q65_set_diff", f"SELECT member FROM {_E} WHERE key = 'click' AND member NOT IN (SELECT member FROM {_E} WHERE key = 'view')")
def _(spark, t):
    return sets.difference(_set(t), ["click", "view"])


@_add("q66_set_intercard", f"SELECT count(*) AS n FROM (SELECT member FROM {_E} WHERE key IN ('click', 'view') GROUP BY member HAVING count(DISTINCT key) = 2)")
def _(spark, t):
    return sets.intersect(_set(t), ["click", "view"]).agg(F.count(F.lit(1)).alias("n"))


@_add("q66b_set_cardinality", f"SELECT key, count(*) AS n FROM {_E} GROUP BY key")
def _(spark, t):
    return sets.cardinality(_set(t))


def _elements(t: Tables) -> DataFrame:
    return t["events"].select(F.col("event_type").alias("key"), F.col("user_id").alias("element"))


@_add("q67_hll_count")
def _(spark, t):
    return hll.count(hll.add(_elements(t)))


@_add("q68_hll_merge")
def _(spark, t):
    return hll.count_union(hll.add(_elements(t)))


@_add("q69_sort_by_external", "SELECT n.n_nationkey AS element, n.n_name AS g0 FROM nation n ORDER BY n.n_regionkey DESC, n.n_nationkey DESC LIMIT 12")
def _(spark, t):
    n = t["nation"]
    strings = n.select(F.concat(F.lit("w:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    table = n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("name").alias("field"), F.col("n_name").alias("value"))
    return sorting.sort_elements(n.select(F.col("n_nationkey").alias("element")), by="w:*", get=["n:*->name"], descending=True, count=12, strings=strings, hashes=table)


# --- lists, hashes, strings, bits ----------------------------------------------------------------------


def _list(t: Tables) -> DataFrame:
    return t["events"].select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("value"))


_L = "(SELECT CAST(user_id AS VARCHAR) AS key, event_id AS pos, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@_add("q70_list_slice", f"SELECT key, i, value FROM {_L} WHERE i >= 2 AND i <= n - 4")
def _(spark, t):
    return lists.slice_(_list(t), 2, -4).withColumn("i", F.col("i").cast("long"))


@_add("q70b_list_pop", f"SELECT key, n - 1 - i AS i, value FROM {_L} WHERE i >= n - 2")
def _(spark, t):
    return lists.pop(_list(t), 2, left=False)[0].withColumn("i", F.col("i").cast("long"))


@_add("q71_list_lpos", f"SELECT i FROM {_L} WHERE key = '7' AND value = 'click' ORDER BY i LIMIT 3 OFFSET 1")
def _(spark, t):
    return lists.positions(_list(t), "7", "click", rank=2, count=3).withColumn("i", F.col("i").cast("long"))


@_add("q71b_list_lrem", "SELECT key, pos, value FROM (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS pos, event_type AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE NOT (key = '7' AND value = 'view' AND r <= 2)")
def _(spark, t):
    return lists.remove(_list(t), "7", "view", -2)


def _hash(t: Tables) -> DataFrame:
    return t["events"].groupBy(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("field")).agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("expires_at", F.lit(None).cast("timestamp"))


@_add("q72_hash_getall", "SELECT CAST(user_id AS VARCHAR) AS key, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS fields FROM (SELECT user_id, event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, t):
    return hashes.as_map(_hash(t)).select("key", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


@_add("q73_hash_incr", "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS field, CAST(count(*) + sum(CASE WHEN value > 30 THEN 2 ELSE 0 END) AS VARCHAR) AS value FROM events GROUP BY 1, 2")
def _(spark, t):
    by = t["events"].filter("value > 30").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("field"), F.lit(2).alias("by"))
    return hashes.increment(_hash(t), by).drop("expires_at")


@_add("q74_string_getrange", "SELECT p_partkey, p_name[3:6] AS part, p_name[-4:-2] AS tail, strlen(p_name) AS n FROM part")
def _(spark, t):
    b = F.col("p_name").cast("binary")
    return t["part"].select("p_partkey", byte_range(b, 2, 5).cast("string").alias("part"), byte_range(b, -4, -2).cast("string").alias("tail"), F.octet_length(b).cast("long").alias("n"))


_BITS = "list_reduce(list_transform(string_split(hex(encode({0})), ''), lambda h: length(replace(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789ABCDEF', h)], '0', ''))), lambda x, y: x + y)"


@_add("q75_bitcount", f"SELECT p_partkey, CAST({_BITS.format('p_name')} AS BIGINT) AS ones FROM part")
def _(spark, t):
    return t["part"].select("p_partkey", bits.bit_count(F.col("p_name").cast("binary")).alias("ones"))


# --- statements ----------------------------------------------------------------------------------------

_ORDERS = parse_table("orders o_orderkey INT PRIMARY KEY, o_custkey INT REFERENCES customer(c_custkey) ON DELETE CASCADE, o_orderstatus STR, o_totalprice FLOAT")
_CUSTOMER = parse_table("customer c_custkey INT PRIMARY KEY, c_name STR UNIQUE, c_acctbal FLOAT")
_LINES = parse_table("lines l_id INT PRIMARY KEY, l_orderkey INT REFERENCES orders(o_orderkey) ON DELETE SET NULL, l_quantity FLOAT")
_SCHEMAS = {"orders": _ORDERS, "customer": _CUSTOMER, "lines": _LINES}


def _states(t: Tables) -> dict[str, DataFrame]:
    never = F.lit(None).cast("timestamp").alias(EXPIRES)
    return {
        "orders": t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", never),
        "customer": t["customer"].select("c_custkey", "c_name", "c_acctbal", never),
        "lines": t["lineitem"].groupBy("l_orderkey").agg(F.sum("l_quantity").alias("l_quantity")).select(F.col("l_orderkey").alias("l_id"), "l_orderkey", "l_quantity", never),
    }


@_add("q76_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_name, -1.0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 10000000, 'new ' || c_name, -1.0 FROM customer WHERE c_custkey % 100 = 0")
def _(spark, t):
    c = t["customer"]
    old = c.filter("c_custkey % 10 = 0").select("c_custkey", "c_name", F.lit(-1.0).alias("c_acctbal"))
    new = c.filter("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.concat(F.lit("new "), F.col("c_name")).alias("c_name"), F.lit(-1.0).alias("c_acctbal"))
    return tables.upsert(_CUSTOMER, _states(t)["customer"], old.unionByName(new)).state.drop(EXPIRES)


@_add("q77_update_where", "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 AND (o_orderstatus = 'F' OR o_orderstatus = 'P') THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def _(spark, t):
    s = _states(t)
    return tables.update(_ORDERS, s["orders"], {"o_orderstatus": "X"}, parse_where("o_totalprice > 300000 AND o_orderstatus = F OR o_orderstatus = P"), s, _SCHEMAS).state.drop(EXPIRES)


@_add("q78_delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, t):
    states, _gone = tables.delete("customer", parse_where("c_acctbal < 0"), _states(t), _SCHEMAS)
    return states["orders"].select("o_orderkey", "o_custkey")


@_add("q79_set_null", "SELECT l_orderkey AS l_id, CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) THEN l_orderkey END AS l_orderkey FROM lineitem GROUP BY lineitem.l_orderkey")
def _(spark, t):
    states, _gone = tables.delete("orders", parse_where("o_totalprice > 400000"), _states(t), _SCHEMAS)
    return states["lines"].select("l_id", "l_orderkey")


_TICKETS = parse_table("tickets id INT PRIMARY KEY, grp STR, serial INT SEQUENCE PARTITION BY grp")


@_add("q80_sequence_partition", "SELECT grp, min(serial) AS first, max(serial) AS final, count(DISTINCT serial) AS n FROM (SELECT event_type AS grp, row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 100 AS serial FROM events) GROUP BY grp")
def _(spark, t):
    kinds = t["events"].select("event_type").distinct()
    held = tables.empty(spark, _TICKETS).unionByName(kinds.select((F.abs(F.xxhash64("event_type"))).alias("id"), F.col("event_type").alias("grp"), F.lit(100).cast("long").alias("serial"), F.lit(None).cast("timestamp").alias(EXPIRES)))
    batch = t["events"].select((F.col("event_id") + 1).alias("id"), F.col("event_type").alias("grp"))
    made = tables.insert(_TICKETS, held, batch)
    return made.rows.groupBy("grp").agg(F.min("serial").alias("first"), F.max("serial").alias("final"), F.countDistinct("serial").alias("n"))


@_add("q81_ttl_live", "SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) + (event_id % 7) * 86400000 >= 1706000000000 OR event_id % 7 = 0")
def _(spark, t):
    deadline = F.when(F.col("event_id") % 7 != 0, F.timestamp_millis(_millis() + (F.col("event_id") % 7) * _DAY))
    return tables.visible(t["events"].select("event_id", deadline.alias(EXPIRES)), F.timestamp_millis(F.lit(1706000000000)))


_NAMES = parse_table("names c_custkey INT PRIMARY KEY, c_name STR UNIQUE, c_nationkey INT REFERENCES nation(n_nationkey)")


def _batch(t: Tables) -> DataFrame:
    """Customers whose names repeat by remainder and whose nations may not exist."""
    return t["customer"].select("c_custkey", F.concat(F.lit("n"), (F.col("c_custkey") % 1000).cast("string")).alias("c_name"), (F.col("c_nationkey") + F.lit(3)).alias("c_nationkey"))


def _violations(spark, t: Tables) -> DataFrame:
    rows = tables.prepare(_NAMES, _batch(t), tables.empty(spark, _NAMES))
    return tables.violations(_NAMES, rows, tables.empty(spark, _NAMES), {"nation": t["nation"]})


@_add("q82_unique_violations", "SELECT 'c_name' AS \"column\", 'n' || CAST(c_custkey % 1000 AS VARCHAR) AS value FROM customer GROUP BY ALL HAVING count(*) > 1")
def _(spark, t):
    return _violations(spark, t).filter("kind = 'unique'").select("column", "value")


@_add("q83_fk_violations", "SELECT 'c_nationkey' AS \"column\", CAST(c_nationkey + 3 AS VARCHAR) AS value FROM customer WHERE c_nationkey + 3 NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, t):
    return _violations(spark, t).filter("kind = 'foreign_key'").select("column", "value")


# --- streams, live queries, feeds ----------------------------------------------------------------------


def _stream(t: Tables) -> DataFrame:
    return t["events"].select(F.col("event_type").alias("key"), _millis().alias("ms"), F.col("event_id").alias("seq"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("fields"))


_ST = "(SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq, CAST(user_id AS VARCHAR) AS usr FROM events)"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("key", "ms", "seq", F.col("fields")["user"].alias("usr"))


@_add("q84_stream_range", f"SELECT key, ms, seq, usr FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM {_ST} WHERE ms >= 1704412800000 AND ms <= 1705017600000) WHERE n <= 50")
def _(spark, t):
    return _flat(streams.range_(_stream(t), "1704412800000", "1705017600000", 50))


@_add("q84b_stream_read", f"SELECT key, ms, seq, usr FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM {_ST} WHERE ms > 1705017600000) WHERE n <= 10")
def _(spark, t):
    return _flat(streams.read(_stream(t), "1705017600000-99999999", 10))


@_add("q85_stream_trim", f"SELECT key, ms, seq, usr FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS n FROM {_ST}) WHERE n <= 100")
def _(spark, t):
    return _flat(streams.trim(_stream(t), 100))


def _pending(t: Tables) -> DataFrame:
    return _stream(t).select("key", F.lit("g").alias("grp"), F.concat(F.lit("c"), (F.col("seq") % 3).cast("string")).alias("consumer"), "ms", "seq", F.col("ms").alias("delivered_ms"), F.lit(1).cast("long").alias("deliveries"))


@_add("q86_pending_summary", f"SELECT key, sum(n) AS n, min(lo) AS lo, max(hi) AS hi, string_agg(consumer || ':' || n, ',' ORDER BY consumer) AS consumers FROM (SELECT key, 'c' || CAST(seq % 3 AS VARCHAR) AS consumer, count(*) AS n, min(ms) AS lo, max(ms) AS hi FROM {_ST} GROUP BY 1, 2) GROUP BY key")
def _(spark, t):
    s = streams.pending_summary(_pending(t))
    return s.select("key", "n", F.col("lo.ms").alias("lo"), F.col("hi.ms").alias("hi"), F.array_join(F.transform("consumers", lambda c: F.concat(c["consumer"], F.lit(":"), c["n"].cast("string"))), ",").alias("consumers"))


@_add("q87_autoclaim", f"SELECT key, ms, seq, CASE WHEN n <= 40 THEN 'new' ELSE 'c' || CAST(seq % 3 AS VARCHAR) END AS consumer, CASE WHEN n <= 40 THEN 2 ELSE 1 END AS deliveries FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY key <> 'click', ms > 1705000000000, ms, seq) + CASE WHEN key <> 'click' OR ms > 1705000000000 THEN 1000000 ELSE 0 END AS n FROM {_ST})")
def _(spark, t):
    after, _entries, _gone = streams.auto_claim(_pending(t), _stream(t), "click", "g", "new", 1_000_000, 1705001000000, count=40)
    return after.select("key", "ms", "seq", "consumer", "deliveries")


_LIVE = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderkey % 13 = 0"


@_add("q88_live_diff", f"WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 250000 OR o_orderkey % 3 = 0), b AS ({_LIVE}) SELECT CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def _(spark, t):
    o = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = o.filter("o_totalprice < 250000 OR o_orderkey % 3 = 0").drop("o_totalprice")
    after = o.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    new = o.filter("o_orderkey % 13 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    return live.diff(before, after.unionByName(new), "o_orderkey")


@_add("q89_key_events_glob", "SELECT p AS pattern, 'user:' || CAST(user_id AS VARCHAR) AS key, event_type AS op FROM events, (SELECT unnest(['user:1*', 'user:[2-3]?', 'user:7']) AS p) WHERE (p = 'user:1*' AND CAST(user_id AS VARCHAR) LIKE '1%') OR (p = 'user:[2-3]?' AND regexp_full_match(CAST(user_id AS VARCHAR), '[2-3].')) OR (p = 'user:7' AND user_id = 7)")
def _(spark, t):
    events = t["events"].select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("op"))
    return feeds.key_events(events, ["user:1*", "user:[2-3]?", "user:7"])


@_add("q89b_publish_receivers", "SELECT event_id AS id, (CASE WHEN event_type = 'click' THEN 2 ELSE 0 END) + (CASE WHEN event_type LIKE '%i%' THEN 1 ELSE 0 END) AS receivers FROM events")
def _(spark, t):
    subs = feeds.subscriptions(spark, [("a", "click"), ("b", "click")], [("c", "*i*")])
    return feeds.receivers(t["events"].select(F.col("event_id").alias("id"), F.col("event_type").alias("channel")), subs)


@_add("q90_stream_tumbling", "SELECT event_type AS key, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS ts, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, t):
    rows = t["events"].select(F.col("event_type").alias("key"), _millis().alias("ts"), "value")
    return timeseries.aggregate(rows, "sum", 3_600_000).withColumn("value", F.round("value", 4))


@_add("q90b_structured_streaming", "SELECT event_type AS key, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS ts, round(max(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, t):
    """The same buckets by Structured Streaming over the events files, run until nothing is left."""
    path = f"{t.path}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        rows = source.parquet(path)
    else:  # a stream reads directories: the one file of the table's directory
        rows = source.option("pathGlobFilter", "events.parquet").parquet(t.path)
    made = windows.tumbling(rows.select(F.col("event_type").alias("key"), _millis().alias("ts"), "value"), "max", 3_600_000)
    out = f"{ensure_checkpoint_dir(spark)}/tarn-streams/{uuid.uuid4().hex}"
    keep = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/rows")
    made.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/progress").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


@_add("q91_policy_owner", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77 AND o_totalprice > 100000")
def _(spark, t):
    make = _policy("o_custkey = auth.uid() AND o_totalprice > 100000", "orders", ["o_orderkey", "o_custkey", "o_totalprice"], {"uid": "77"})
    return make(spark, t).drop("o_totalprice")


_MADE["q92_policy_membership"] = (
    _policy("o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = auth.nation)", "orders", ["o_orderkey", "o_custkey"], {"nation": "4"}),
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)",
)


@_add("q93_udf_lcs")
def _(spark, t):
    return t["part"].select("p_partkey", lcs_length("p_name", "p_type").alias("n"), lcs_text("p_name", F.lower("p_type")).alias("common"))


@_add("q94_bitop", "SELECT p_partkey, strlen(p_name) * 8 - CAST(" + _BITS.format("p_name") + " AS BIGINT) AS zeros, CAST(" + _BITS.format("p_name") + " AS BIGINT) AS same FROM part")
def _(spark, t):
    b, flipped = F.col("b"), F.col("flipped")
    named = t["part"].select("p_partkey", F.col("p_name").cast("binary").alias("b")).withColumn("flipped", bits.bit_op("NOT", [b]))
    return named.select("p_partkey", bits.bit_count(flipped).alias("zeros"), bits.bit_count(bits.bit_op("AND", [b, bits.bit_op("XOR", [flipped, bits.bit_op("OR", [b, flipped])])])).alias("same"))


def _bound(make: Make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(spark, Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(make) for name, (make, _) in _MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _MADE.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation: two joins, grouped aggregates, HAVING and ORDER BY, from the dialect."""
    return queries()["q26c_join_group"](spark, sf_dir)


from . import queries_state  # noqa: E402, F401  # registers its queries in the same catalogue
