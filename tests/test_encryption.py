import pytest
from pyspark.sql import functions as F

from tarn.operators import encryption as e
from tarn.plans.dialect import parse_select
from tarn.plans.schema import parse_table
from tarn.plans.spec import DialectError

T = parse_table("secrets id INT PRIMARY KEY, token STR ENCRYPTED, email STR ENCRYPTED SEARCHABLE, n INT ENCRYPTED")


def test_seal_find_rotate(spark):
    ring = e.Keyring({"k1": b"one"})
    df = spark.createDataFrame([(1, "t", "a@x", 7), (2, None, "b@x", None)], "id long, token string, email string, n long")
    sealed = e.seal_rows(T, df, ring).cache()
    raw = {r["id"]: r for r in sealed.collect()}
    assert raw[1]["token"].startswith("k1:") and "a@x" not in raw[1]["email"] and raw[2]["token"] is None
    assert sorted(map(tuple, e.open_rows(T, sealed, ring).collect())) == sorted(map(tuple, df.collect()))
    assert [tuple(r) for r in e.open_rows(T, sealed, None).orderBy("id").collect()] == [(1, None, None, None), (2, None, None, None)]
    assert [r["id"] for r in e.find(T, sealed, "email", "a@x", ring).collect()] == [1]
    with pytest.raises(DialectError):
        e.find(T, sealed, "token", "t", ring)
    newer = ring.rotated("k2", b"two")
    again = e.rewrap(T, sealed, newer)
    assert again.filter(F.col("token").startswith("k2:")).count() == 1
    assert sorted(map(tuple, e.open_rows(T, again, newer).collect())) == sorted(map(tuple, df.collect()))
    assert e.open_rows(T, again, ring).filter("email is not null").count() == 0 and e.find(T, again, "email", "b@x", newer).count() == 1


def test_guard():
    e.guard(parse_select("* FROM secrets WHERE email = a@x AND id > 1 AND token IS NULL"), T)
    for bad in ("* FROM secrets WHERE token = t", "* FROM secrets WHERE email LIKE a%", "* FROM secrets ORDER BY token", "email, COUNT(*) FROM secrets GROUP BY email", "* FROM secrets s JOIN u x ON s.token = x.t"):
        with pytest.raises(DialectError):
            e.guard(parse_select(bad), T)
    with pytest.raises(ValueError):
        e.Keyring({})


def test_blind_index_is_an_hmac(spark):
    import hashlib
    import hmac

    ring = e.Keyring({"k": b"key"})
    got = spark.createDataFrame([("é a@x",), (None,)], "v string").select(ring.blind(F.col("v")).alias("b")).collect()
    assert got[0]["b"] == hmac.new(ring.index_key, "é a@x".encode(), hashlib.sha256).hexdigest() == ring.blind_value("é a@x") and got[1]["b"] is None


def test_stored_columns_are_sealed_and_rewrapped(spark, tmp_path):
    from tarn.database import Database

    path = str(tmp_path / "db")
    db = Database(spark, path)
    db.execute("TCREATE letters id INT PRIMARY KEY, body STR ENCRYPTED SEARCHABLE, place STR")
    db.execute("TINSERT letters body hello place here")
    with pytest.raises(ValueError):
        db.commit()
    assert db.execute("ENC INIT k1 one") == "OK" and db.execute("ENC STATUS") == {"keys": 1, "newest": "k1"}
    db.commit()
    stored = lambda: db.store.load("table-letters").first()["body"]
    assert stored().startswith("k1:") and "hello" not in stored()
    assert Database.open(spark, path).execute("TGET letters 1").first()["body"] is None
    assert Database.open(spark, path, ring=db.ring).execute("TGET letters 1").first()["body"] == "hello"
    db.execute("ENC ROTATE k2 two")
    db.execute("ENC REWRAP")
    assert stored().startswith("k2:") and db.execute("ENC LIST") == ["k1", "k2"] and db.execute("ENC RETIRE k1") == "OK"
    assert Database.open(spark, path, ring=db.ring).execute("TGET letters 1").first()["body"] == "hello"
    for bad in ("ENC RETIRE k2", "ENC INIT k3 x", "ENC NONE"):
        with pytest.raises(DialectError):
            db.execute(bad)
