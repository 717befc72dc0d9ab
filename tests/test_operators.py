import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import bits, geo
from tarn.functions.text import byte_range, glob, lcs, lcs_length, lcs_matches, lcs_text, write_range
from tarn.functions.values import number_rows
from tarn.operators import ann, hashes, hll, keys, lists, sets, sorting, streams, strings, timeseries, vectors, zsets
from tarn.operators import geo as geo_ops


def ints(spark, values, schema):
    return spark.createDataFrame(values, schema)


# --- time series ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tide(spark):
    """A height every 7 minutes: n * n at minute 7 n."""
    return spark.createDataFrame([("tide", 7 * 60_000 * n, float(n * n)) for n in range(12)], "key string, ts long, value double")


def test_range_and_buckets(spark, tide):
    assert [r["value"] for r in timeseries.range_(tide, "tide", 20 * 60_000, 36 * 60_000).orderBy("ts").collect()] == [9.0, 16.0, 25.0]
    quarter = 15 * 60_000
    by = {}
    for n in range(12):
        by.setdefault(7 * 60_000 * n // quarter * quarter, []).append(float(n * n))
    for name, fn in (("avg", lambda x: sum(x) / len(x)), ("max", max), ("sum", sum)):
        assert {r["ts"]: r["value"] for r in timeseries.aggregate(tide, name, quarter).collect()} == {k: fn(v) for k, v in by.items()}
    assert timeseries.range_(tide, count=5).count() == 5
    before = spark.createDataFrame([("k", -1, 1.0)], tide.schema)
    assert timeseries.aggregate(before, "sum", 1000).first()["ts"] == -1000
    assert timeseries.aggregate(before, "std.s", 1000).first()["value"] == 0.0
    assert timeseries.aggregate(before, "nonsense", 1000).first()["value"] == 1.0


def test_last_wins_and_retention(spark, tide):
    again = spark.createDataFrame([("tide", 7 * 60_000 * 4, -5.0)], tide.schema)
    assert {r["ts"]: r["value"] for r in timeseries.add(tide, again).collect()} == {7 * 60_000 * n: -5.0 if n == 4 else float(n * n) for n in range(12)}
    hour = spark.createDataFrame([("tide", 3_600_000, {"bay": "north"})], "key string, retention_ms long, labels map<string,string>")
    newest = 7 * 60_000 * 11
    assert sorted(r["ts"] for r in timeseries.add(tide.limit(0), tide, hour).collect()) == [7 * 60_000 * n for n in range(12) if 7 * 60_000 * n >= newest - 3_600_000]


def test_labels(spark, tide):
    """Series of two bays and three gauges; labels choose among them."""
    names = [(bay, gauge) for bay in ("north", "south") for gauge in ("height", "salt", "wind")]
    series = spark.createDataFrame([(f"{b}/{g}", 0, {"bay": b, "gauge": g}) for b, g in names], "key string, retention_ms long, labels map<string,string>")
    rows = spark.createDataFrame([(f"{b}/{g}", 60_000, i + 0.25) for i, (b, g) in enumerate(names)], tide.schema)
    for label, value in (("bay", "south"), ("gauge", "salt")):
        want = {i + 0.25 for i, (b, g) in enumerate(names) if {"bay": b, "gauge": g}[label] == value}
        assert {r["value"] for r in timeseries.multi_range(rows, series, {label: value}).collect()} == want
    assert timeseries.info(rows, series).count() == 6


# --- vectors and geo -----------------------------------------------------------------------------------


def test_vector_filters_come_first(spark):
    # rays of a half circle, their colour by turns; the nearest of a colour need not be among the nearest of all
    rows = [(f"ray{i:02d}", [math.cos(math.pi * i / 40), math.sin(math.pi * i / 40), 0.5], '{"colour":"%s"}' % ("red" if i >= 30 else "blue")) for i in range(41)]
    v = spark.createDataFrame(rows, "key string, embedding array<float>, metadata string")
    assert [r["key"] for r in vectors.search(v, [1, 0, 0.5], 2, where=("colour", "red")).collect()] == ["ray30", "ray31"]
    assert [r["key"] for r in vectors.search(v, [1, 0, 0.5], 2).collect()] == ["ray00", "ray01"] and vectors.search(v, [0, 0, 0], 3).count() == 0
    new = spark.createDataFrame([("ray40", [0.0, 0.0, 2.0], "{}")], v.schema)
    assert vectors.upsert(v, new).filter("key = 'ray40'").first()["embedding"] == [0.0, 0.0, 2.0]


def test_search_many_equals_one_by_one(spark):
    random.seed(3)
    v = spark.createDataFrame([(i, [random.gauss(0, 1) for _ in range(5)]) for i in range(60)], "key long, embedding array<float>")
    q = v.filter("key % 20 = 0").withColumnRenamed("key", "query")
    many = {(r["query"], r["rank"]): r["key"] for r in vectors.search_many(q, v, 4).collect()}
    for row in q.collect():
        one = [r["key"] for r in vectors.search(v, row["embedding"], 4).collect()]
        assert [many[row["query"], i + 1] for i in range(4)] == one


def test_geo(spark):
    pts = spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669), ("s", "Agrigento", 13.5833, 37.3167)], "key string, member string, lon double, lat double")
    empty = spark.createDataFrame([], "key string, member string, score double")
    z = geo_ops.add(empty, pts)
    placed = geo_ops.positions(z)
    got = {r["member"]: r for r in placed.collect()}
    assert got["Palermo"]["score"] == 3479099956230698 and got["Catania"]["score"] == 3479447370796909
    assert got["Palermo"]["geohash"] == "sqc8b49rny0" and got["Catania"]["geohash"] == "sqdtr74hyu0"
    assert abs(got["Palermo"]["lon"] - 13.361389) < 1e-5
    pairs = spark.createDataFrame([("s", "Palermo", "Catania"), ("s", "Palermo", "Nowhere")], "key string, a string, b string")
    d = {r["b"]: r["distance"] for r in geo_ops.pair_distance(placed, pairs, "km").collect()}
    assert 166.2 < d["Catania"] < 166.4 and d["Nowhere"] is None
    found = geo_ops.search(placed, 15, 37, radius=200, unit="km", count=2)
    assert [r["member"] for r in found.collect()] == ["Catania", "Agrigento"]
    assert {r["member"] for r in geo_ops.search(placed, 15, 37, box=(400, 400), unit="km").collect()} == {"Palermo", "Catania", "Agrigento"}
    assert geo_ops.search_member(placed, "Palermo", radius=1, unit="km").count() == 1
    assert geo_ops.store(found, "d", True).count() == 2
    with pytest.raises(Exception, match="invalid longitude"):
        geo_ops.add(empty, spark.createDataFrame([("s", "x", 200.0, 0.0)], pts.schema)).collect()


def test_geo_bounds_never_lose_a_point(spark):
    random.seed(5)
    pts = spark.createDataFrame([("k", str(i), random.uniform(-180, 180), random.uniform(-85, 85)) for i in range(400)], "key string, member string, lon double, lat double").cache()
    for _ in range(6):
        lon, lat, r = random.uniform(-180, 180), random.uniform(-85, 85), random.choice([1e5, 2e6, 9e6])
        slow = {x["member"] for x in pts.filter(geo.distance(lon, lat, F.col("lon"), F.col("lat")) <= r).collect()}
        assert {x["member"] for x in geo_ops.search(pts, lon, lat, radius=r).collect()} == slow


# --- sorted sets and sets ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def z(spark):
    return spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 2.0), ("b", "y", 5.0), ("b", "w", 1.0)], "key string, member string, score double")


def members(df):
    return {r["member"]: r["score"] for r in df.collect()}


def test_zsets(spark, z):
    assert [r["member"] for r in zsets.ranked(z.filter("key='a'"), True).orderBy("rank").collect()] == ["z", "y", "x"]
    assert members(zsets.union(z, ["a", "b"], [2, 1])) == {"x": 2, "y": 9, "z": 4, "w": 1}
    assert members(zsets.intersect(z, ["a", "b"], aggregate="MIN")) == {"y": 2}
    assert members(zsets.intersect(z, ["a", "none"])) == {}
    assert members(zsets.difference(z, ["a", "b"])) == {"x": 1, "z": 2}
    assert zsets.intersect_count(z, ["a", "b"], 5) == 1
    popped, rest = zsets.pop(z, 1)
    assert {(r["key"], r["member"]) for r in popped.collect()} == {("a", "x"), ("b", "w")} and rest.count() == 3
    first, rest = zsets.pop_first(z, ["none", "b", "a"], 1, True)
    assert [(r["key"], r["member"]) for r in first.collect()] == [("b", "y")] and rest.count() == 4
    assert zsets.by_score(z, "(1", "+inf").count() == 3 and zsets.by_lex(z, "[x", "(z").count() == 3 and zsets.by_lex(z, "+", "-").count() == 0
    assert zsets.by_rank(z, -2, -1).count() == 4 and zsets.page(z, 1, 1).count() == 2
    d = spark.createDataFrame([("a", "x", 0.5), ("a", "n", 9.0)], z.schema)
    assert members(zsets.add(z.filter("key='a'"), d, compare="GT")) == {"x": 1, "y": 2, "z": 2, "n": 9}
    assert members(zsets.add(z.filter("key='a'"), d, "XX")) == {"x": 0.5, "y": 2, "z": 2}
    assert members(zsets.add(z.filter("key='a'"), d, "NX")) == {"x": 1, "y": 2, "z": 2, "n": 9}
    assert members(zsets.increment(z.filter("key='a'"), d))["x"] == 1.5
    assert zsets.store(zsets.union(z, ["a"]), z, "b").filter("key='b'").count() == 3
    assert zsets.remove_by_rank(z, 0, 0).count() == 3 and zsets.remove_by_lex(z, "[y", "[y").count() == 3


def test_sets(spark):
    s = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3")], "key string, member string")
    pick = lambda df: {r["member"] for r in df.collect()}
    assert pick(sets.union(s, ["a", "b"])) == {"1", "2", "3"} and pick(sets.intersect(s, ["a", "b"])) == {"2"}
    assert pick(sets.intersect(s, ["a", "none"])) == set() and pick(sets.difference(s, ["a", "b"])) == {"1"} and pick(sets.difference(s, ["a"])) == {"1", "2"}
    moved = sets.move(s, "a", "b", "1")
    assert pick(moved.filter("key='b'")) == {"1", "2", "3"} and sets.move(s, "a", "b", "9").count() == 4
    popped, rest = sets.pop(s, "a", 1)
    assert popped.count() == 1 and rest.count() == 3 and sets.sample(s, "a", 0).count() == 1
    asked = spark.createDataFrame([("a", "1"), ("a", "9")], s.schema)
    assert {r["member"]: r["is_member"] for r in sets.are_members(s, asked).collect()} == {"1": True, "9": False}
    assert sets.add(s, asked).count() == 5 and sets.remove(s, asked).count() == 3
    assert [r["member"] for r in sets.scan(s.filter("key='b'"), "member", "2").collect()] == ["3"]


def test_hll(spark):
    e = spark.range(1000).select(F.lit("a").alias("key"), F.concat(F.lit("element:"), "id").alias("element"))
    assert abs(hll.count(hll.add(e)).first()["estimate"] - 1000) < 50
    two = hll.add(spark.range(500).select(F.lit("a").alias("key"), F.concat(F.lit("a:"), "id").alias("element"))).unionByName(hll.add(spark.range(500).select(F.lit("b").alias("key"), F.concat(F.lit("b:"), "id").alias("element"))))
    assert abs(hll.count(hll.merge(two, "d")).first()["estimate"] - 1000) < 50 and abs(hll.count_union(two).first()["estimate"] - 1000) < 50


# --- lists, hashes, strings, keys ----------------------------------------------------------------------


def values(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


def test_lists_against_python(spark):
    random.seed(1)
    ref = list("abcabcab")
    st = spark.createDataFrame([("k", i, v) for i, v in enumerate(ref)], "key string, pos long, value string")
    for a in range(-9, 9, 3):
        for b in range(-9, 9, 4):
            n = len(ref)
            lo, hi = max(a + n if a < 0 else a, 0), b + n if b < 0 else b
            assert [r["value"] for r in lists.slice_(st, a, b).orderBy("i").collect()] == ref[lo : hi + 1 if hi >= 0 else 0]
    assert values(lists.remove(st, "k", "a", 2)) == list("bcbcab") and values(lists.remove(st, "k", "a", -1)) == list("abcabcb") and values(lists.remove(st, "k", "a")) == list("bcbcb")
    assert values(lists.insert(st, "k", "c", "X")) == list("abXcabcab") and values(lists.insert(st, "k", "c", "X", False)) == list("abcXabcab") and values(lists.insert(st, "k", "?", "X")) == ref
    new = spark.createDataFrame([("k", 0, "1"), ("k", 1, "2"), ("n", 0, "3")], "key string, seq int, value string")
    assert values(lists.push(st, new, True).filter("key='k'"))[:2] == ["2", "1"] and values(lists.push(st, new).filter("key='k'"))[-2:] == ["1", "2"]
    assert lists.push(st, new, only_existing=True).filter("key='n'").count() == 0
    popped, rest = lists.pop(st, 2, False)
    assert [r["value"] for r in popped.orderBy("i").collect()] == ["b", "a"] and values(rest) == ref[:-2]
    assert [r["i"] for r in lists.positions(st, "k", "a", count=0).orderBy("i").collect()] == [0, 3, 6]
    assert [r["i"] for r in lists.positions(st, "k", "a", rank=-1).collect()] == [6] and [r["i"] for r in lists.positions(st, "k", "a", rank=2).collect()] == [3]
    assert lists.at(st, -1).first()["value"] == "b" and values(lists.set_at(st, "k", -1, "Z"))[-1] == "Z" and values(lists.trim(st, 1, -2)) == ref[1:-1]
    both = lists.move(st, "k", "d", False, True)
    assert values(both.filter("key='d'")) == ["b"] and both.filter("key='k'").count() == 7
    gone, left = lists.pop_first(st, ["none", "k"], 3)
    assert [r["value"] for r in gone.orderBy("i").collect()] == ["a", "b", "c"] and left.count() == 5
    assert lists.length(st).first()["n"] == 8


def test_hashes(spark):
    h = spark.createDataFrame([("k", "a", "1", None), ("k", "b", "2", None)], "key string, field string, value string, expires_at timestamp")
    new = spark.createDataFrame([("k", "a", "9"), ("k", "c", "3")], "key string, field string, value string")
    get = lambda df: {r["field"]: r["value"] for r in df.collect()}
    assert get(hashes.put(h, new)) == {"a": "9", "b": "2", "c": "3"} and get(hashes.put(h, new, True)) == {"a": "1", "b": "2", "c": "3"}
    by = spark.createDataFrame([("k", "a", "5"), ("k", "z", "7")], "key string, field string, by string")
    assert get(hashes.increment(h, by)) == {"a": "6", "b": "2", "z": "7"}
    assert get(hashes.get(h, spark.createDataFrame([("k", "a"), ("k", "?")], "key string, field string"))) == {"a": "1", "?": None}
    assert hashes.as_map(h).first()["fields"] == {"a": "1", "b": "2"} and hashes.length(h).first()["n"] == 2
    at = F.timestamp_seconds(F.lit(100))
    e = hashes.expire(h, "k", ["a"], at)
    assert {r["field"]: r["ttl"] for r in hashes.ttl(e, F.timestamp_seconds(F.lit(90))).collect()} == {"a": 10, "b": -1}
    assert hashes.live(e, F.timestamp_seconds(F.lit(101))).count() == 1 and hashes.live(e, at).count() == 2
    assert hashes.expire(e, "k", ["a"], F.timestamp_seconds(F.lit(50)), "GT").filter("field='a'").first()["expires_at"].timestamp() == 100
    assert hashes.persist(e, "k", ["a"]).filter("expires_at is not null").count() == 0
    assert hashes.sample(h, "k", -5).count() == 5 and hashes.sample(h, "k", 5).count() == 2


def test_strings(spark):
    s = spark.createDataFrame([("a", b"hello", None)], "key string, value binary, expires_at timestamp")
    one = spark.createDataFrame([("a", b"x"), ("b", b"y")], "key string, value binary")
    get = lambda df: {r["key"]: bytes(r["value"]) for r in df.collect()}
    assert get(strings.put(s, one)) == {"a": b"x", "b": b"y"} and get(strings.put(s, one, "NX")) == {"a": b"hello", "b": b"y"} and get(strings.put(s, one, "XX")) == {"a": b"x"}
    assert strings.put_all_new(s, one)[0] is False and strings.put_all_new(s, one.filter("key='b'"))[0] is True
    assert get(strings.append(s, one)) == {"a": b"hellox", "b": b"y"}
    n = strings.increment(spark.createDataFrame([("c", b"41", None)], s.schema), spark.createDataFrame([("c", "1"), ("d", "-2")], "key string, by string"))
    assert get(n) == {"c": b"42", "d": b"-2"}
    with pytest.raises(Exception):
        strings.increment(s, spark.createDataFrame([("a", "1")], "key string, by string")).collect()
    asked = spark.createDataFrame([(0, "z"), (1, "a")], "pos int, key string")
    assert [r["value"] and bytes(r["value"]) for r in strings.get(s, asked).collect()] == [None, b"hello"]


@pytest.mark.parametrize("a,b", [(0, 2), (-3, -1), (2, 99), (3, 1), (-99, 1), (0, -1), (5, 9)])
def test_byte_range(spark, a, b):
    v = b"hello"
    n = len(v)
    lo, hi = max(a + n if a < 0 else a, 0), min(b + n if b < 0 else b, n - 1)
    row = spark.createDataFrame([(v,)], "v binary").select(byte_range(F.col("v"), a, b).alias("r")).first()
    assert bytes(row["r"]) == (v[lo : hi + 1] if lo <= hi else b"")


def test_write_range_and_bits(spark):
    df = spark.createDataFrame([(b"foobar",)], "v binary")
    one = lambda c: df.select(c.alias("r")).first()["r"]
    v = F.col("v")
    assert bytes(one(write_range(v, 3, b"XY"))) == b"fooXYr" and bytes(one(write_range(v, 8, b"z"))) == b"foobar\0\0z"
    assert one(bits.bit_count(v)) == 26 and one(bits.bit_count(v, 0, 0)) == 4 and one(bits.bit_count(v, 1, 1)) == 6 and one(bits.bit_count(v, 5, 30, "BIT")) == 17
    assert one(bits.get_bit(v, 1)) == 1 and one(bits.get_bit(v, 999)) == 0
    assert bytes(one(bits.set_bit(F.lit(b""), 7, 1))) == b"\x01"
    assert one(bits.bit_position(v, 1)) == 1 and one(bits.bit_position(F.lit(b"\xff"), 0)) == 8 and one(bits.bit_position(F.lit(b"\xff"), 0, 0, -1)) == -1
    assert bytes(one(bits.bit_op("AND", [F.lit(b"abc"), F.lit(b"ab")]))) == b"ab\0" and bytes(one(bits.bit_op("NOT", [F.lit(b"\x0f")]))) == b"\xf0"
    assert one(bits.field_get(F.lit(b"\xff\x80"), "i8", 0)) == -1 and one(bits.field_get(F.lit(b"\xff\x80"), "u4", 6)) == 14
    assert int(one(bits.field_fit(F.lit(257), "u8"))) == 1 and int(one(bits.field_fit(F.lit(257), "u8", "SAT"))) == 255 and one(bits.field_fit(F.lit(257), "u8", "FAIL")) is None
    assert int(one(bits.field_fit(F.lit(128), "i8"))) == -128
    assert bytes(one(bits.field_set(F.lit(b"\0\0"), "i8", 4, F.lit(-1)))) == b"\x0f\xf0"


def test_bit_op_by_words(spark):
    rng = random.Random(94)
    pairs = [(None, b"\xff\x00\x01"), (b"", b""), (b"\x80" + b"\0" * 7, b"\xff" * 16), (rng.randbytes(9001), rng.randbytes(8999))]
    pairs += [(rng.randbytes(i), rng.randbytes(j)) for i, j in [(7, 8), (8, 8), (9, 16), (0, 17), (33, 1)]]
    v, w = F.col("v"), F.col("w")
    ops = {"AND": lambda x, y: x & y, "OR": lambda x, y: x | y, "XOR": lambda x, y: x ^ y}
    made = [bits.bit_op(k, [v, w]).alias(k) for k in ops] + [bits.bit_op("NOT", [v]).alias("NOT"), bits.bit_op("XOR", [v, w, v]).alias("three"), bits.bit_count(v).alias("n")]
    for r in spark.createDataFrame(pairs, "v binary, w binary").select("v", "w", *made).collect():
        a, b = bytes(r["v"] or b""), bytes(r["w"])
        size = max(len(a), len(b))
        pad = lambda x: x.ljust(size, b"\0")
        for k, f in ops.items():
            assert bytes(r[k]) == bytes(f(x, y) for x, y in zip(pad(a), pad(b))), (k, a, b)
        assert bytes(r["NOT"]) == bytes(255 - x for x in a) and bytes(r["three"]) == pad(b) and r["n"] == sum(x.bit_count() for x in a)


def test_bit_op_computes_operands_once(spark):
    chain = F.col("v")
    for _ in range(5):
        chain = bits.bit_op("XOR", [chain, F.col("w")])
    df = spark.createDataFrame([(b"ab", b"abc")], "v binary, w binary").select(chain.alias("r"))
    assert bytes(df.first()["r"]) == b"\0\0c"
    assert df._jdf.queryExecution().optimizedPlan().apply(0).expressions().toString().count("coalesce(v#") == 1


def test_text(spark):
    assert lcs("ohmytext", "mynewtext") == "mytext" and lcs_matches("ohmytext", "mynewtext") == [(4, 7, 5, 8, 4), (2, 3, 0, 1, 2)] and len(lcs_matches("ohmytext", "mynewtext", 4)) == 1
    df = spark.createDataFrame([("ohmytext", "mynewtext"), (None, "x"), ("", "x")], "a string, b string")
    assert [tuple(r) for r in df.select(lcs_length("a", "b"), lcs_text("a", "b")).collect()] == [(6, "mytext"), (None, None), (0, "")]
    keys_ = spark.createDataFrame([("user:1",), ("user:22",), ("usex",), ("u[1]",)], "key string")
    hit = lambda p: {r["key"] for r in keys_.filter(glob(F.col("key"), p)).collect()}
    assert hit("user:*") == {"user:1", "user:22"} and hit("user:?") == {"user:1"} and hit("use[rx]*") == {"user:1", "user:22", "usex"} and hit("u\\[1\\]") == {"u[1]"} and hit("usex") == {"usex"} and hit("use[^r]") == {"usex"}


def test_number_rows(spark):
    df = number_rows(spark.range(0, 1000, 1, 7), "n", 5)
    assert sorted(r["n"] for r in df.collect()) == list(range(5, 1005)) and df.filter("n != id + 5").count() == 0


def test_keys(spark):
    st = {"string": spark.createDataFrame([("a", b"1", None)], "key string, value binary, expires_at timestamp"), "set": spark.createDataFrame([("b", "x"), ("_t:u", "y")], "key string, member string")}
    k = keys.keyspace(st)
    assert {(r["key"], r["type"]) for r in keys.matching(k, "*").collect()} == {("a", "string"), ("b", "set")}
    assert keys.exists(k, ["a", "a", "zz"]) == 2
    s = st["set"]
    assert {r["key"] for r in keys.rename(s, "b", "c").collect()} == {"c", "_t:u"} and {r["key"] for r in keys.rename(s, "none", "b").collect()} == {"b", "_t:u"}
    assert keys.copy(s, "b", "_t:u").count() == 2 and keys.copy(s, "b", "_t:u", True).filter("key='_t:u'").first()["member"] == "x"
    e = keys.expire(st["string"], "a", F.timestamp_seconds(F.lit(50)))
    assert keys.ttl(e, F.timestamp_seconds(F.lit(20))).first()["ttl"] == 30 and keys.live(e, F.timestamp_seconds(F.lit(51))).count() == 0
    assert keys.ttl(keys.expire(e, "a", None), F.current_timestamp()).first()["ttl"] == -1 and keys.random_key(k, 1).count() == 1 and keys.delete(s, k).count() == 0


def test_sort(spark):
    strings_ = spark.createDataFrame([("weight:1", "30"), ("weight:2", "10"), ("weight:3", "20")], "key string, value string")
    users = spark.createDataFrame([("user:1", "name", "Ada"), ("user:2", "name", "Linus"), ("user:3", "name", "Grace")], "key string, field string, value string")
    ids = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "element long, pos int")
    got = sorting.sort_elements(ids, by="weight:*", get=["#", "user:*->name"], strings=strings_, hashes=users).collect()
    assert [(r["g0"], r["g1"]) for r in got] == [("2", "Linus"), ("3", "Grace"), ("1", "Ada")]
    assert [r["element"] for r in sorting.sort_elements(ids, by="nosort", offset=1, count=1).collect()] == [2]
    words = spark.createDataFrame([("b",), ("a",)], "element string")
    assert [r["element"] for r in sorting.sort_elements(words, alpha=True, descending=True).collect()] == ["b", "a"]


def test_streams(spark):
    st = spark.createDataFrame([("s", i, 0, {"i": str(i)}) for i in range(1, 7)], "key string, ms long, seq long, fields map<string,string>")
    ids = lambda df: sorted((r["ms"], r["seq"]) for r in df.collect())
    assert ids(streams.range_(st, "2", "4-0")) == [(2, 0), (3, 0), (4, 0)] and ids(streams.range_(st, count=2, descending=True)) == [(5, 0), (6, 0)]
    assert ids(streams.read(st, "4-0")) == [(5, 0), (6, 0)] and ids(streams.trim(st, 2)) == [(5, 0), (6, 0)]
    new = spark.createDataFrame([("s", 0, {"a": "b"}), ("s", 1, {"a": "c"}), ("t", 0, {})], "key string, arrival int, fields map<string,string>")
    assert ids(streams.append(st, new, 6))[-3:] == [(6, 0), (6, 1), (6, 2)] and ids(streams.append(st, new, 99))[-2:] == [(99, 0), (99, 1)]
    pend = spark.createDataFrame([], "key string, grp string, consumer string, ms long, seq long, delivered_ms long, deliveries long")
    got, pend = streams.group_read(st, pend, "s", "g", "c1", (0, 0), 3, 1000)
    assert ids(got) == [(1, 0), (2, 0), (3, 0)]
    row = streams.pending_summary(pend).first()
    assert (row["n"], row["lo"]["ms"], row["hi"]["ms"], row["consumers"][0]["n"]) == (3, 1, 3, 3)
    acked = streams.acknowledge(pend, pend.filter("ms = 1"))
    assert ids(acked) == [(2, 0), (3, 0)] and streams.pending_range(acked, consumer="c2").count() == 0
    claimed = streams.claim(acked, acked.filter("ms = 2"), "c2", 500, 1600)
    assert {r["ms"]: (r["consumer"], r["deliveries"]) for r in claimed.collect()} == {2: ("c2", 2), 3: ("c1", 1)}
    assert streams.claim(acked, acked, "c2", 5000, 1600).filter("consumer = 'c2'").count() == 0
    after, entries, gone = streams.auto_claim(acked, streams.delete(st, st.filter("ms = 3")), "s", "g", "c3", 0, 2000)
    assert ids(entries) == [(2, 0)] and ids(gone) == [(3, 0)] and [r["consumer"] for r in after.collect()] == ["c3"]
    assert streams.info(st).first()["length"] == 6


def test_ann_recall_and_exact_way_out(spark):
    rng = random.Random(3)
    centre = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in centre[i % 20]]) for i in range(1500)] + [(9000, [0.0] * 12), (9001, None), (9002, [1.0])]
    v = spark.createDataFrame(rows, "key long, embedding array<float>")
    asked = v.filter("key % 50 = 0 and key < 9000").withColumnRenamed("key", "query")
    c = ann.fit(v)
    lists = ann.index(v, c)
    assert lists.count() == 1500 and len(c) == 39
    exact = vectors.search_many(asked, v.filter("key < 9000"), 10)
    assert ann.recall(ann.search(lists, c, asked, 10, 8), exact) >= 0.9
    whole = {(r["query"], r["rank"]): r["similarity"] for r in ann.search(lists, c, asked, 10, len(c)).collect()}
    assert all(abs(whole[r["query"], r["rank"]] - r["similarity"]) < 1e-5 for r in exact.collect())
    none = v.limit(0)
    assert ann.fit(none).size == 0 and ann.index(none, c).count() == 0 and ann.search(lists, c, none.withColumnRenamed("key", "query"), 3, 4).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_hot_keys_rank_by_parts(spark, monkeypatch, descending):
    rng = random.Random(4)
    rows = [("hot", f"m{i:04d}", float(rng.choice([0, 1, 2, 3.5, rng.randint(4, 400)]))) for i in range(900)] + [("cold", f"m{i}", float(i % 3)) for i in range(9)]
    z = spark.createDataFrame(rows, "key string, member string, score double").repartition(5)
    want = {(r["key"], r["member"]): r["rank"] for r in zsets.ranked(z, descending).collect()}
    monkeypatch.setattr(zsets, "LARGE", 50)
    parted = zsets.ranked(z, descending)
    assert parted.columns == ["key", "member", "score", "rank"] and {(r["key"], r["member"]): r["rank"] for r in parted.collect()} == want
    order = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[1]), reverse=descending)
    assert all(want["hot", m] == i for i, (_, m, _) in enumerate(order))
    top = zsets.by_rank(z, 0, 9, descending).filter("key = 'hot'").collect()
    assert sorted(r["member"] for r in top) == sorted(m for _, m, _ in order[:10])
