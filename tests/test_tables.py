import pytest
from pyspark.sql import functions as F

from tarn.operators import tables as ops
from tarn.plans.dialect import parse_where
from tarn.plans.schema import EXPIRES, parse_table
from tarn.plans.spec import DialectError

USERS = parse_table("users id INT PRIMARY KEY, name STR NOT NULL, email STR UNIQUE, age INT DEFAULT 18")
POSTS = parse_table("posts id INT PRIMARY KEY, author INT REFERENCES users(id) ON DELETE CASCADE, title STR")
LIKES = parse_table("likes id INT PRIMARY KEY, post INT REFERENCES posts(id) ON DELETE SET NULL")
AUDIT = parse_table("audit id INT PRIMARY KEY, usr INT REFERENCES users(id)")
SCHEMAS = {t.name: t for t in (USERS, POSTS, LIKES)}


def users(spark, *rows):
    return ops.insert(USERS, ops.empty(spark, USERS), spark.createDataFrame(rows or [("Ann", "a@x"), ("Bob", "b@x")], "name string, email string")).state


def test_insert_numbers_and_defaults(spark):
    got = users(spark).orderBy("id").collect()
    assert [(r["id"], r["name"], r["age"]) for r in got] == [(1, "Ann", 18), (2, "Bob", 18)]
    more = ops.insert(USERS, users(spark), spark.createDataFrame([("Cid", "7")], "name string, age string"))
    assert more.rows.collect()[0]["id"] == 3 and more.rows.collect()[0]["age"] == 7


@pytest.mark.parametrize(
    "rows, schema, kind",
    [
        ([("x", "a@x")], "name string, email string", "unique"),
        ([("x", "n@x"), ("y", "n@x")], "name string, email string", "unique"),
        ([(1, "x")], "id long, name string", "primary_key"),
        ([(None, "z@x")], "name string, email string", "not_null"),
        ([("x", "old")], "name string, age string", "type"),
    ],
)
def test_violations(spark, rows, schema, kind):
    with pytest.raises(ops.ConstraintError) as e:
        ops.insert(USERS, users(spark), spark.createDataFrame(rows, schema))
    assert kind in {k for k, _, _ in e.value.violations}


def test_unknown_column_and_reference(spark):
    with pytest.raises(DialectError):
        ops.insert(USERS, users(spark), spark.createDataFrame([(1,)], "nope long"))
    with pytest.raises(ops.ConstraintError):
        ops.insert(POSTS, ops.empty(spark, POSTS), spark.createDataFrame([(9, "t")], "author long, title string"), {"users": users(spark)}, SCHEMAS)


def test_upsert(spark):
    state = users(spark)
    c = ops.upsert(USERS, state, spark.createDataFrame([("Ann2", "a@x"), ("New", "n@x")], "name string, email string"), ("email",))
    got = {r["email"]: (r["id"], r["name"]) for r in c.state.collect()}
    assert got == {"a@x": (1, "Ann2"), "b@x": (2, "Bob"), "n@x": (3, "New")} and c.rows.count() == 2


def test_update(spark):
    c = ops.update(USERS, users(spark), {"age": "40"}, parse_where("name = Ann"))
    assert {r["name"]: r["age"] for r in c.state.collect()} == {"Ann": 40, "Bob": 18} and c.rows.count() == 1
    with pytest.raises(ops.ConstraintError):
        ops.update(USERS, users(spark), {"email": "a@x"}, parse_where("name = Bob"))
    with pytest.raises(ops.ConstraintError):
        ops.update(USERS, users(spark), {"age": "old"}, parse_where("name = Bob"))


def test_delete_follows_references(spark):
    u = users(spark)
    posts = ops.insert(POSTS, ops.empty(spark, POSTS), spark.createDataFrame([(1, "p"), (2, "q")], "author long, title string"), {"users": u}, SCHEMAS).state
    likes = ops.insert(LIKES, ops.empty(spark, LIKES), spark.createDataFrame([(1,), (2,)], "post long"), {"posts": posts}, SCHEMAS).state
    states, gone = ops.delete("users", parse_where("name = Ann"), {"users": u, "posts": posts, "likes": likes}, SCHEMAS)
    assert [r["name"] for r in gone.collect()] == ["Ann"] and states["users"].count() == 1
    assert [r["title"] for r in states["posts"].collect()] == ["q"]
    assert sorted((r["id"], r["post"]) for r in states["likes"].collect()) == [(1, None), (2, 2)]
    audit = ops.insert(AUDIT, ops.empty(spark, AUDIT), spark.createDataFrame([(1,)], "usr long"), {"users": u}, {"users": USERS, "audit": AUDIT}).state
    with pytest.raises(ops.ConstraintError):
        ops.delete("users", parse_where("name = Ann"), {"users": u, "audit": audit}, {"users": USERS, "audit": AUDIT})


def test_sequences(spark):
    t = parse_table("tickets id INT PRIMARY KEY, w STR, serial INT SEQUENCE PARTITION BY w, title STR")
    s = ops.insert(t, ops.empty(spark, t), spark.createDataFrame([("w1", "a"), ("w1", "b"), ("w2", "c")], "w string, title string").coalesce(1)).state
    assert {r["title"]: r["serial"] for r in s.collect()} == {"a": 1, "b": 2, "c": 1}
    s = ops.insert(t, s, spark.createDataFrame([("w1", 10, "d")], "w string, serial long, title string")).state
    s = ops.insert(t, s, spark.createDataFrame([("w1", "e")], "w string, title string")).state
    assert {r["title"]: r["serial"] for r in s.collect()}["e"] == 11
    with pytest.raises(ops.ConstraintError):
        ops.insert(t, s, spark.createDataFrame([("w1", 2, "f")], "w string, serial long, title string"))


def test_deadlines(spark):
    t = parse_table("pres user_id STR PRIMARY KEY, room STR WITH TTL 60")
    now = F.timestamp_seconds(F.lit(1000))
    s = ops.insert(t, ops.empty(spark, t), spark.createDataFrame([("a", "x")], "user_id string, room string"), now=now).state
    assert ops.visible(s, F.timestamp_seconds(F.lit(1060))).count() == 1
    later = F.timestamp_seconds(F.lit(1061))
    assert ops.visible(s, later).count() == 0
    s = ops.insert(t, s, spark.createDataFrame([("a", "y")], "user_id string, room string"), now=later).state
    assert [r["room"] for r in ops.visible(s, later).collect()] == ["y"] and s.count() == 1 and EXPIRES in s.columns


def test_alter(spark):
    t, s = ops.add_column(USERS, users(spark), "role STR DEFAULT guest")
    assert {r["role"] for r in s.collect()} == {"guest"} and t.column("role")
    with pytest.raises(ops.ConstraintError):
        ops.add_column(USERS, users(spark), "role STR NOT NULL")
    t, s = ops.drop_column(USERS, users(spark), "age")
    assert "age" not in s.columns
    with pytest.raises(DialectError):
        ops.drop_column(USERS, users(spark), "id")


def test_uuid_keys_and_types(spark):
    t = parse_table("x id UUID PRIMARY KEY, at TIMESTAMP, ok BOOL, v VECTOR(2), doc JSON, tags ARRAY, f FLOAT")
    b = spark.createDataFrame([("1700000000000", "1", "[1,2]", '{"a":1}', "[1]", "2.5")], "at string, ok string, v string, doc string, tags string, f string")
    r = ops.insert(t, ops.empty(spark, t), b).rows.collect()[0]
    assert r["id"][14] == "7" and len(r["id"]) == 36 and r["ok"] is True and r["v"] == [1.0, 2.0] and r["f"] == 2.5
    for bad in ({"v": "[1]"}, {"tags": "{}"}, {"doc": "{"}, {"ok": "maybe"}, {"at": "soon"}):
        with pytest.raises(ops.ConstraintError):
            ops.insert(t, ops.empty(spark, t), spark.createDataFrame([tuple(bad.values())], f"{next(iter(bad))} string"))
