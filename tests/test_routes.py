import pytest

from tarn.database import Database
from tarn.plans.spec import DialectError
from tarn.sources import routes


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.execute("TCREATE boats id INT PRIMARY KEY, name STR UNIQUE, length FLOAT, port STR")
    return d


def ask(db, method, path, params=None, body=None, claims=None):
    status, got = routes.request(db, method, path, params, body, claims)
    return status, [tuple(r) for r in got.collect()] if hasattr(got, "collect") else got


def test_tables_by_requests(db):
    assert ask(db, "POST", "/v1/tables", body={"name": "crews", "columns": ["id INT PRIMARY KEY", "boat INT REFERENCES boats(id)"]})[0] == 201
    status, made = ask(db, "POST", "/v1/tables/boats", body=[{"name": "tern", "length": 9.5, "port": "b"}, {"name": "gull", "length": 6}])
    assert status == 201 and made == [(1, "tern", 9.5, "b"), (2, "gull", 6.0, None)]
    assert ask(db, "POST", "/v1/tables/boats", body={"name": "tern"})[0] == 409
    assert ask(db, "GET", "/v1/tables/boats", {"select": "name", "where": "length > 5", "order": "length:desc", "limit": "5"}) == (200, [("tern",), ("gull",)])
    assert ask(db, "GET", "/v1/tables/boats/2") == (200, [(2, "gull", 6.0, None)]) and ask(db, "GET", "/v1/tables/boats/count") == (200, 2)
    assert ask(db, "PATCH", "/v1/tables/boats/2", body={"port": "c"}) == (200, [(2, "gull", 6.0, "c")])
    assert ask(db, "PATCH", "/v1/tables/boats", body={"port": "c"})[0] == 400 and ask(db, "GET", "/v1/tables/none")[0] == 404
    assert ask(db, "DELETE", "/v1/tables/boats", {"where": "length < 7"}) == (200, [(2, "gull", 6.0, "c")])
    assert ask(db, "GET", "/v1/tables")[1] == ["boats", "crews"] and ask(db, "GET", "/v1/other")[0] == 404


def test_claims_bind_requests(db):
    db.execute("GRANT read, write ON boats WHERE port = auth.port")
    mine = {"port": "a"}
    assert ask(db, "POST", "/v1/tables/boats", body={"name": "kite", "port": "a"}, claims=mine)[0] == 201
    assert ask(db, "POST", "/v1/tables/boats", body={"name": "swan", "port": "b"}, claims=mine)[0] == 403
    assert ask(db, "PATCH", "/v1/tables/boats/1", body={"port": "b"}, claims=mine)[0] == 403
    assert ask(db, "DELETE", "/v1/tables/boats/1", claims={"port": "b"})[0] == 403
    assert ask(db, "GET", "/v1/tables/boats", {"select": "name"}, claims=mine) == (200, [("kite",)])


def test_keys_series_and_vectors(db):
    assert ask(db, "PUT", "/v1/kv/wind", body={"value": "west"})[1] == "OK" and ask(db, "GET", "/v1/kv/wind")[1] == "west"
    assert ask(db, "POST", "/v1/kv/trips/incr", body={"by": 4})[1] == 4 and ask(db, "GET", "/v1/kv/none")[0] == 404
    ask(db, "POST", "/v1/kv/log/list", body=["out", "in"])
    ask(db, "POST", "/v1/kv/rig/hash", body={"sails": 2})
    ask(db, "POST", "/v1/kv/race/zset", body={"tern": 3, "gull": 1})
    assert ask(db, "GET", "/v1/kv/log/list")[1] == ["out", "in"] and ask(db, "GET", "/v1/kv/rig/hash")[1] == {"sails": "2"}
    assert "tern" in str(ask(db, "GET", "/v1/kv/race/zset")[1]) and sorted(ask(db, "GET", "/v1/keys", {"pattern": "r*"})[1]) == ["race", "rig"]
    assert ask(db, "GET", "/v1/dbsize")[1] == 5 and ask(db, "GET", "/v1/ping")[1] == "PONG" and ask(db, "POST", "/v1/exec", body={"command": "STRLEN wind"})[1] == 4
    ask(db, "POST", "/v1/ts/depth", body={"ts": 1000, "value": 7.5})
    assert "7.5" in str(ask(db, "GET", "/v1/ts/depth")[1]) and "7.5" in str(ask(db, "GET", "/v1/ts/depth/latest")[1])
    ask(db, "POST", "/v1/vectors/n", body={"vector": [0, 1]})
    ask(db, "POST", "/v1/vectors/e", body={"vector": [1, 0], "metadata": {"kind": "x"}})
    assert ask(db, "POST", "/v1/vectors/search", body={"vector": [1, 0.1], "k": 1})[1][0][0] == "e" and ask(db, "GET", "/v1/vectors")[1] == 2


def test_migrations(db):
    files = {"001": "TCREATE quays id INT PRIMARY KEY, name STR;\nTINSERT quays name north;", "002": "TALTER quays ADD depth INT DEFAULT 4"}
    assert ask(db, "POST", "/v1/migrations/plan", body={"files": files})[1] == [("001", "pending"), ("002", "pending")]
    assert ask(db, "POST", "/v1/migrations/apply", body={"files": files})[1] == ["001", "002"] and db.execute("TGET quays 1").first()["depth"] == 4
    assert routes.apply(db, files) == []
    changed = files | {"002": files["002"] + " ", "003": "TINSERT none a b"}
    assert [s for _, s in routes.plan(db, changed)] == ["applied", "changed", "pending"]
    with pytest.raises(DialectError):
        routes.apply(db, changed)
    assert routes.repair(db, changed) == ["002"]
    with pytest.raises(DialectError):
        routes.apply(db, changed)
    assert routes.plan(db, changed)[2] == ("003", "failed") and routes.repair(db, changed) == ["003"] and routes.plan(db, changed)[2] == ("003", "pending")


def test_fluent_writes(db):
    boats = db.table("boats")
    assert [r["id"] for r in boats.insert({"name": "wren", "length": 4}, {"name": "coot", "length": 5, "port": "q"}).collect()] == [1, 2]
    assert [r["port"] for r in db.table("boats").eq("name", "wren").update(port="z").collect()] == ["z"]
    assert [r["name"] for r in db.table("boats").gt("length", 3).order("name").run().collect()] == ["coot", "wren"]
    assert [r["id"] for r in db.table("boats").lt("length", 5).delete().collect()] == [1] and db.table("boats").count() == 1
    with pytest.raises(DialectError):
        db.table("boats").delete()
    assert db.table("boats").create_index("port.x", "STR") == "OK" and db.table("boats").drop_index("port.x") == "OK"
