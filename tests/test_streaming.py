import time
import json

import pytest
from pyspark.sql import functions as F

from tarn.operators.timeseries import aggregate
from tarn.plans.dialect import parse_select
from tarn.sources.edge import chunks, page, statements, text_rows
from tarn.sources.snapshots import ChangeLog, Snapshots, dump, restore
from tarn.streaming import feeds, live, queues, windows


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [r.asDict() for r in df.sparkSession.table(name).collect()]


def feed(spark, tmp_path, rows, schema, name="in", files=1):
    path = str(tmp_path / name)
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_incremental_events_equal_a_fresh_query(spark, tmp_path):
    rows = [("1", "insert", 1, '{"v":5}'), ("1", "update", 2, '{"v":9}'), ("2", "insert", 1, '{"v":1}'), ("2", "update", 2, '{"v":7}'), ("1", "update", 3, '{"v":2}'), ("3", "insert", 4, '{"v":8}'), ("3", "delete", 5, None), ("2", "update", 6, '{"v":7}')]
    schema = ChangeLog.SCHEMA
    stream = feed(spark, tmp_path, rows, schema)
    keep = F.get_json_object("row", "$.v").cast("int") >= 5
    got = drain(live.filter_events(stream, keep), "live_filter")
    by = {}
    for r in got:
        by.setdefault(r["pk"], []).append(r["event"])
    assert by == {"1": ["insert", "update", "delete"], "2": ["insert"], "3": ["insert", "delete"]}
    state = {}
    for r in got:
        state.pop(r["pk"], None) if r["event"] == "delete" else state.__setitem__(r["pk"], r["row"])
    batch = spark.createDataFrame(rows, schema)
    fresh = live.apply_changes(spark.createDataFrame([], "pk string, row string"), batch).filter(keep)
    assert state == {r["pk"]: r["row"] for r in fresh.collect()}


def test_diff_and_gates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "w"), (3, None)], "id long, v string")
    assert sorted((r["op"], r["id"], r["v"]) for r in live.diff(a, b, "id").collect()) == [("insert", 4, "w"), ("update", 2, "z")]
    assert live.incremental(parse_select("* FROM t WHERE a = 1")) and not live.incremental(parse_select("COUNT(*) FROM t"))
    assert live.dependencies(parse_select("* FROM t JOIN u x ON t.a = x.b")) == {"t", "u"}


def test_queries_run_again_on_change(spark, tmp_path):
    rows = [("1", "insert", 1, "{}")]
    stream = feed(spark, tmp_path, rows, ChangeLog.SCHEMA)
    seen = []
    q = live.run_on_change(stream, lambda: spark.createDataFrame([(1, "a")], "id long, v string"), "id", lambda d, n: seen.extend(d.collect()), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["op"], r["id"]) for r in seen] == [("insert", 1)]


def test_vector_subscription(spark, tmp_path):
    """The two nearest change when the vectors do; each change is told once."""
    schema = "key string, embedding array<float>, metadata string"
    frames = [[("a", [1.0, 0.0], None), ("b", [0.9, 0.1], None), ("c", [0.0, 1.0], None)], [("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None), ("d", [0.95, 0.05], None), ("c", [0.0, 1.0], None)]]
    now, seen = [0], []
    stream = feed(spark, tmp_path, [("a", "insert", 1, "{}")], ChangeLog.SCHEMA)
    start = lambda: live.near_on_change(stream, lambda: spark.createDataFrame(frames[now[0]], schema), [1, 0], 2, lambda d, n: seen.append({(r["op"], r["key"]) for r in d.collect()}), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    start()
    now[0] = 1
    spark.createDataFrame([("d", "insert", 2, "{}")], ChangeLog.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    assert seen == [{("insert", "a"), ("insert", "b")}, {("delete", "b"), ("insert", "d")}]


def test_blocking_pops(spark, tmp_path):
    schema = "key string, at long, kind string, side string, value string, client string, timeout_ms long"
    rows = [("q", 1, "pop", "left", None, "c1", 0), ("q", 2, "pop", "left", None, "c2", 5), ("q", 10, "push", "right", "a", None, None), ("q", 11, "push", "right", "b", None, None), ("q", 12, "pop", "right", None, "c3", 0)]
    got = drain(queues.blocking_pops(feed(spark, tmp_path, rows, schema)), "pops")
    assert {r["client"]: r["value"] for r in got} == {"c1": "a", "c2": None, "c3": "b"}


def test_waiting_pops_time_out_by_the_clock(spark, tmp_path):
    """No further command comes; the clock alone ends one wait, the other goes on."""
    schema = "key string, at long, kind string, side string, value string, client string, timeout_ms long"
    now = int(time.time() * 1000)
    rows = [("q", now, "pop", "left", None, "c1", 300), ("q", now, "pop", "left", None, "c2", 600_000)]
    made = queues.blocking_pops(feed(spark, tmp_path, rows, schema), wall_clock=True)
    seen = []
    q = made.writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(150):
            if seen:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert [(r["client"], r["value"]) for r in seen] == [("c1", None)]


def test_consumer_group(spark, tmp_path):
    schema = "key string, at long, kind string, consumer string, ms long, seq long, min_idle long"
    rows = [("s", 1, "add", None, 1, 0, 0), ("s", 2, "add", None, 2, 0, 0), ("s", 3, "read", "a", 0, 0, 0), ("s", 4, "ack", None, 1, 0, 0), ("s", 100, "claim", "b", 0, 0, 50)]
    got = drain(queues.consumer_group(feed(spark, tmp_path, rows, schema)), "groups")
    assert [(r["event"], r["consumer"], r["ms"], r["deliveries"]) for r in got] == [("delivered", "a", 1, 1), ("delivered", "a", 2, 1), ("acked", "a", 1, 1), ("claimed", "b", 2, 2)]


def test_streaming_buckets_equal_batch(spark, tmp_path):
    rows = [("k", t * 700, float(t)) for t in range(40)]
    schema = "key string, ts long, value double"
    stream = feed(spark, tmp_path, rows, schema)
    got = drain(windows.tumbling(stream, "avg", 5000), "buckets", "complete")
    assert sorted((r["ts"], r["value"]) for r in got) == sorted((r["ts"], r["value"]) for r in aggregate(spark.createDataFrame(rows, schema), "avg", 5000).collect())
    marked = drain(windows.tumbling(stream, "max", 5000, "1 second"), "marked", "update")
    assert max(r["value"] for r in marked) == 39.0


def test_feeds(spark, tmp_path):
    subs = feeds.subscriptions(spark, [("a", "news")], [("b", "n?ws"), ("c", "x*")])
    msgs = spark.createDataFrame([(1, "news", "hi"), (2, "other", "yo")], "id long, channel string, body string")
    assert sorted((r["subscriber"], r["id"]) for r in feeds.deliver(msgs, subs).collect()) == [("a", 1), ("b", 1)]
    assert {r["id"]: r["receivers"] for r in feeds.receivers(msgs, subs).collect()} == {1: 2, 2: 0}
    assert feeds.channels(subs, "n*").first()["subscribers"] == 1 and feeds.pattern_count(subs) == 2
    events = feed(spark, tmp_path, [("user:1", "set"), ("x", "del")], "key string, op string")
    assert [(r["pattern"], r["key"], r["op"]) for r in drain(feeds.key_events(events, ["user:*", "zz"]), "kev")] == [("user:*", "user:1", "set")]


def test_snapshots_and_log(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "snap"))
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    first = s.save("t", df)
    second = s.save("t", first.unionByName(spark.createDataFrame([(2, "b")], df.schema)))
    assert second.count() == 2 and s.versions("t") == [1, 2] and s.load("t", 1).count() == 1 and s.load("t").count() == 2
    s.save("t", s.load("t"))
    assert s.versions("t") == [2, 3] and list(s.load_all()) == ["t"]
    with pytest.raises(FileNotFoundError):
        s.load("none")
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("1", "insert", 1, "x"), ("2", "insert", 2, "y")], ChangeLog.SCHEMA))
    log.append(spark.createDataFrame([("1", "delete", 3, None), ("2", "update", 4, "z")], ChangeLog.SCHEMA))
    assert [(r["pk"], r["row"]) for r in log.replay().collect()] == [("2", "z")] and log.read(2).count() == 2
    assert len(drain(log.stream(), "log")) == 4
    assert restore(dump(df), "id long, v string").collect() == df.collect()


def test_edge(spark):
    t = {"u": spark.createDataFrame([(1, "a", 2.0), (2, None, 2.5)], "id long, v string, f double")}
    rows, span = page(t, "u", {"order": "id:desc", "limit": "1"})
    assert span == "0-0/2" and rows.first()["id"] == 2
    assert [tuple(r) for r in text_rows(t["u"]).collect()] == [("1", "a", "2"), ("2", "", "2.5")]
    assert json.loads("".join(chunks(t["u"], 10))) == [{"id": 1, "v": "a", "f": 2.0}, {"id": 2, "v": None, "f": 2.5}]
    assert json.loads("".join(chunks(t["u"].limit(0)))) == []
    assert statements("-- c\nA 'x;y';\nB;") == ["A 'x;y'", "B"] and statements("A\n# no\nB") == ["A", "B"]


def test_expiry(spark):
    from tarn.plans.schema import EXPIRES

    df = spark.range(3).select("id", F.when(F.col("id") > 0, F.timestamp_seconds(F.col("id") * 100)).alias(EXPIRES))
    gone, rest = windows.due(df, F.timestamp_seconds(F.lit(150)))
    assert [r["id"] for r in gone.collect()] == [1] and rest.count() == 2
