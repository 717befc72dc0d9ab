import math

import pytest

from tarn.plans.builder import query
from tarn.plans.compile import compile_query
from tarn.plans.dialect import parse_select
from tarn.plans.spec import DialectError


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "users": spark.createDataFrame([(1, "Alice", 30, True), (2, "Bob", 25, True), (3, "Carol", 35, False), (4, "Dave", 28, True)], "id long, name string, age long, active boolean"),
        "teams": spark.createDataFrame([(1, "Engineering"), (2, "Design")], "id long, name string"),
        "members": spark.createDataFrame([(1, "alice", 1), (2, "bob", 1), (3, "carol", 2)], "id long, username string, team_id long"),
        "strays": spark.createDataFrame([(1, "alice", 1), (2, "bob", 9)], "id long, username string, team_id long"),
        "events": spark.createDataFrame([(1, "msg", '{"reactions":{"count":10},"flagged":true}'), (2, "msg", '{"reactions":{"count":3}}'), (3, "msg", "{}"), (4, "msg", '{"reactions":{"count":0}}'), (5, "msg", '{"reactions":"none"}'), (6, "bad", "not json"), (7, "null", None)], "id long, kind string, meta string"),
        "posts": spark.createDataFrame([(1, "a", '["red","blue"]'), (2, "b", '["green"]'), (3, "c", "[]")], "id long, name string, tags string"),
        "messages": spark.createDataFrame([(1, "general", [1.0, 0.0]), (2, "general", [0.95, 0.05]), (3, "random", [0.0, 1.0])], "id long, channel string, embedding array<float>"),
        "targets": spark.createDataFrame([(1, "other", [1.0, 0.0]), (2, "target", [0.8, 0.2]), (3, "target", [0.0, 1.0])], "id long, channel string, embedding array<float>"),
        "scores": spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id long, name string, val long"),
        "nulls": spark.createDataFrame([(1, None, None), (2, "x", 1.5), (3, "y", 2.5)], "id long, name string, x double"),
    }


def run(tables, text):
    return [tuple(r) for r in compile_query(parse_select(text), tables).collect()]


def test_like_groups(tables):
    assert run(tables, "name FROM users WHERE name ILIKE %ali% OR name LIKE D_ve ORDER BY id") == [("Alice",), ("Dave",)]
    assert run(tables, "id FROM users WHERE age LIKE 3%") == []


def test_aggregates(tables):
    df = compile_query(parse_select("SUM(age), MIN(age), MAX(age) FROM users"), tables)
    assert df.columns == ["sum(age)", "min(age)", "max(age)"] and tuple(df.first()) == (118.0, 25.0, 35.0)
    assert run(tables, "COUNT(*), SUM(val), AVG(val), MIN(val), MAX(val) FROM scores") == [(3, 60.0, 20.0, 10.0, 30.0)]
    assert run(tables, "COUNT(*) FROM scores WHERE val > 15") == [(2,)]
    assert run(tables, "COUNT(x) AS n, SUM(x) FROM nulls WHERE id > 99") == [(0, 0.0)]
    assert run(tables, "COUNT(x) AS n FROM nulls") == [(2,)]


def test_joins(tables):
    rows = run(tables, "m.username, t.name FROM members m JOIN teams t ON m.team_id = t.id ORDER BY m.id")
    assert [r[1] for r in rows].count("Engineering") == 2 and len(rows) == 3
    assert run(tables, "team_id, COUNT(*) AS member_count FROM members GROUP BY team_id HAVING member_count > 1") == [(1, 2)]
    assert run(tables, "s.username, t.name FROM strays s LEFT JOIN teams t ON s.team_id = t.id ORDER BY s.id") == [("alice", "Engineering"), ("bob", None)]
    df = compile_query(parse_select("* FROM members m JOIN teams t ON m.team_id = t.id WHERE t.name = Design"), tables)
    assert "t.name" in df.columns and df.count() == 1


def test_json_paths(tables):
    assert run(tables, "id FROM events WHERE meta.reactions.count > 5") == [(1,)]
    assert sorted(run(tables, "id FROM events WHERE meta.reactions.count IS VALID")) == [(1,), (2,), (4,)]
    assert run(tables, "id FROM events WHERE meta.reactions.count = 0") == [(4,)]
    assert run(tables, "id FROM events WHERE meta.nope.count != 4") == []
    assert sorted(run(tables, "id FROM events WHERE meta.reactions.count NOT IN ( 10 )")) == [(2,), (4,)]
    assert run(tables, "id FROM events WHERE meta.reactions = none") == [(5,)]
    assert run(tables, "id FROM events WHERE meta.flagged = true") == [(1,)]
    assert run(tables, "id FROM posts WHERE tags CONTAINS blue") == [(1,)]
    assert run(tables, "id FROM posts WHERE tags.0 = red") == [(1,)]


def test_nulls(tables):
    assert sorted(run(tables, "id FROM nulls WHERE name != x")) == [(1,), (3,)]
    assert run(tables, "id FROM nulls WHERE name NOT IN ( x )") == [(3,)]
    assert run(tables, "id FROM nulls WHERE name IS NULL") == [(1,)]
    assert [r[0] for r in run(tables, "id FROM nulls ORDER BY x")] == [1, 2, 3]
    assert [r[0] for r in run(tables, "id FROM nulls ORDER BY x DESC")] == [3, 2, 1]


def test_near(tables):
    rows = run(tables, "id, _similarity FROM messages WHERE channel = general NEAR embedding [1,0] K 5 THRESHOLD 0.9")
    assert [r[0] for r in rows] == [1, 2] and math.isclose(rows[0][1], 1.0)
    assert [r[0] for r in run(tables, "id FROM targets WHERE channel = target NEAR embedding [1,0] K 1")] == [2]
    assert run(tables, "id FROM messages NEAR embedding [0,0] K 2") == []


def test_errors(tables):
    for text in ("nope FROM users", "* FROM nowhere", "* FROM users WHERE nope = 1", "* FROM users WHERE age > old", "name, COUNT(*) FROM users GROUP BY age", "* FROM users HAVING n > 1", "* FROM users NEAR name [1] K 1"):
        with pytest.raises(DialectError):
            compile_query(parse_select(text), tables)


def test_builder_equals_dialect(tables):
    a = query(tables, "users").select("id, name").gt("age", 26).eq("active", True).order("age", False).limit(2).df().collect()
    b = compile_query(parse_select("id, name FROM users WHERE age > 26 AND active = true ORDER BY age DESC LIMIT 2"), tables).collect()
    assert a == b and [r["id"] for r in a] == [1, 4]
    q = query(tables, "users")
    assert q.in_("id", [1, 3]).count() == 2 and q.not_in("id", [1]).count() == 3 and q.like("name", "A%").single()["id"] == 1
    assert q.eq("id", 99).maybe_single() is None
    with pytest.raises(DialectError):
        q.single()
    assert query(tables, "members").select("t.name, COUNT(*) AS n").left_join("teams", "t", "team_id", "id").group("t.name").having("n", "gt", 1).df().count() == 1
    assert q.any_of(("name", "eq", "Bob"), ("age", "gt", 34)).count() == 2


def test_filters_reach_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "u")
    tables["users"].write.parquet(path)
    df = compile_query(parse_select("name FROM users WHERE age > 26 AND name = Dave"), {"users": spark.read.parquet(path)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,26)" in plan and "EqualTo(name,Dave)" in plan and "active" not in plan


def test_policy(tables):
    from tarn.operators.policies import Policies, admitted, denied

    p = Policies()
    p.grant("members", ["read"], "team_id IN (SELECT id FROM teams WHERE name = auth.team)")
    got = admitted(tables["members"], "members", p.of("members", "read"), {"team": "Design"}, tables)
    assert [r["id"] for r in got.collect()] == [3]
    assert admitted(tables["members"], "members", p.of("members", "read"), {}, tables).count() == 0
    assert admitted(tables["members"], "members", p.of("members", "write"), {}, tables).count() == 0
    p.grant("members", ["write"], "team_id NOT IN (SELECT id FROM teams WHERE name = Nobody)")
    assert admitted(tables["members"], "members", p.of("members", "write"), {}, tables).count() == 3
    assert denied(tables["members"], "members", p.of("members", "read"), {"team": "Design"}, tables, "id").count() == 2
    p.revoke("members", ["read"])
    assert not p.of("members", "read") and p.of("members", "write")
    with pytest.raises(ValueError):
        p.grant("members", ["admin"], "id = 1")
