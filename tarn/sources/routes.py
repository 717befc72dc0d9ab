"""Requests by method and path, answered by a database: tables, time series, vectors, keys, commands, migrations.

``request`` gives (status, answer). Answers are DataFrames where they are rows, so that ``edge.chunks`` streams
them, and plain values elsewhere. Bodies are decoded JSON. Errors are statuses: 404 for what is not there, 403 for
what policies refuse, 409 for broken constraints, 400 for the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any
from urllib.parse import unquote

from ..operators.tables import ConstraintError
from ..plans.dialect import from_params, tokenize
from ..plans.spec import DialectError
from . import edge

LEDGER = "migrations"


def request(db, method: str, path: str, params: Mapping[str, str] | None = None, body: Any = None, claims: Mapping[str, str] | None = None) -> tuple[int, Any]:
    steps = [unquote(s) for s in path.strip("/").split("/")]
    if steps[0] != "v1" or len(steps) < 2:
        return 404, "no such route"
    kinds = {"tables": _tables, "ts": _series, "vectors": _vectors, "kv": _values, "migrations": _migrations}
    try:
        if steps[1] in kinds:
            got = kinds[steps[1]](db, method.upper(), steps[2:], dict(params or {}), body, claims)
        else:
            got = _others(db, method.upper(), steps[1:], dict(params or {}), body, claims)
    except PermissionError as e:
        return 403, str(e)
    except ConstraintError as e:
        return 409, str(e)
    except (DialectError, ValueError, KeyError, TypeError) as e:
        return 400, str(e)
    if got is None:
        return 404, "not found"
    return (201 if method.upper() == "POST" and steps[1] == "tables" else 200), got


def _text(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list, bool)) else str(value)


def _tables(db, method, rest, params, body, claims):
    if not rest:
        if method == "POST":
            return db.execute("TCREATE " + body["statement"]) if "statement" in body else db.execute(f"TCREATE {body['name']} {', '.join(body['columns'])}")
        return db.execute("TLIST")
    name = rest[0]
    if name not in db.schemas:
        return None
    key = db.schemas[name].key.name
    if rest[1:] == ["schema"]:
        return db.execute(["TSCHEMA", name])
    where = {"where": f"{key} = {rest[1]}"} if len(rest) > 1 and rest[1] != "count" else {}
    if rest[1:] == ["count"] or method == "GET":
        spec = from_params(name, params | where)
        if rest[1:] == ["count"]:
            return db.select_spec(spec, claims).count()
        return db.select_spec(spec, claims)
    if method == "POST":
        rows = body if isinstance(body, list) else [body]
        columns = list(dict.fromkeys(c for r in rows for c in r))
        batch = db.spark.createDataFrame([tuple(_text(r.get(c)) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))
        return db.insert(name, batch, claims)
    spec = from_params(name, params | where)
    if not spec.where:
        raise DialectError(f"{method} needs a condition")
    if method == "PATCH":
        return db.update(name, {k: _text(v) for k, v in body.items()}, spec.where, claims)
    if method == "DELETE":
        return db.delete(name, spec.where, claims)
    return None


def _series(db, method, rest, params, body, claims):
    span = [params.get("from", "-"), params.get("to", "+")]
    if not rest:
        return db.execute(["TSMRANGE", *span, "FILTER", *params["filter"].split(",")])
    if method == "POST":
        return db.execute(["TSADD", rest[0], str(body.get("ts", "*")), str(body["value"])])
    verb = rest[1] if len(rest) > 1 else ""
    return db.execute({"info": ["TSINFO", rest[0]], "latest": ["TSGET", rest[0]]}.get(verb, ["TSRANGE", rest[0], *span]))


def _vectors(db, method, rest, params, body, claims):
    if not rest:
        return db.execute(["VCARD"])
    if rest == ["search"]:
        v = [str(x) for x in body["vector"]]
        extra = ["FILTER", *map(str, body["filter"])] if body.get("filter") else []
        return db.execute(["VSEARCH", str(len(v)), *v, "K", str(body.get("k", 10)), *extra])
    if method == "POST":
        v = [str(x) for x in body["vector"]]
        extra = ["META", json.dumps(body["metadata"])] if body.get("metadata") else []
        return db.execute(["VSET", rest[0], str(len(v)), *v, *extra])
    return db.execute(["DEL" if method == "DELETE" else "VGET", rest[0]])


def _values(db, method, rest, params, body, claims):
    if len(rest) == 1:
        if method == "PUT":
            extra = ["EX", str(body["ttl"])] if isinstance(body, dict) and body.get("ttl") else []
            return db.execute(["SET", rest[0], _text(body["value"] if isinstance(body, dict) else body), *extra])
        return db.execute(["DEL" if method == "DELETE" else "GET", rest[0]])
    key, verb = rest[0], rest[1]
    reads = {"hash": ["HGETALL", key], "list": ["LRANGE", key, "0", "-1"], "set": ["SMEMBERS", key], "zset": ["ZRANGE", key, "0", "-1", "WITHSCORES"]}
    if verb in ("incr", "decr"):
        return db.execute([f"{verb.upper()}BY", key, str((body or {}).get("by", 1))])
    if method == "GET":
        return db.execute(reads[verb]) if verb in reads else None
    if verb == "hash":
        return db.execute(["HSET", key, *[_text(x) for pair in body.items() for x in pair]])
    if verb == "list":
        return db.execute(["RPUSH", key, *map(_text, body)])
    if verb == "set":
        return db.execute(["SADD", key, *map(_text, body)])
    if verb == "zset":
        return db.execute(["ZADD", key, *[_text(x) for member, score in body.items() for x in (score, member)]])
    return None


def _others(db, method, rest, params, body, claims):
    if rest == ["keys"]:
        return db.execute(["KEYS", params.get("pattern", "*")])
    if rest == ["dbsize"]:
        return db.execute("DBSIZE")
    if rest == ["ping"]:
        return db.execute("PING")
    if rest == ["exec"] and method == "POST":
        command = body["command"] if isinstance(body, dict) else body
        return db.execute(tokenize(command) if isinstance(command, str) else command, claims)
    return None


# --- migrations ----------------------------------------------------------------------------------------


def _ledger(db) -> dict[str, tuple[str, str]]:
    """Applied migrations: name to (hash of its text, state)."""
    if LEDGER not in db.schemas:
        db.execute(f"TCREATE {LEDGER} name STR PRIMARY KEY, hash STR, state STR")
    return {r["name"]: (r["hash"], r["state"]) for r in db.execute(f"TSELECT name, hash, state FROM {LEDGER}").collect()}


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plan(db, files: Mapping[str, str]) -> list[tuple[str, str]]:
    """(name, state) of each file in order of names: applied, changed since, failed or pending."""
    done = _ledger(db)
    state = lambda n: "pending" if n not in done else "failed" if done[n][1] == "failed" else "applied" if done[n][0] == _hash(files[n]) else "changed"
    return [(n, state(n)) for n in sorted(files)]


def apply(db, files: Mapping[str, str]) -> list[str]:
    """Run pending files in order, each as one unit; a file that was changed after it ran, or failed, stops all."""
    ran = []
    for name, state in plan(db, files):
        if state in ("changed", "failed"):
            raise DialectError(f"migration {name} is {state}")
        if state == "pending":
            try:
                db.pipeline(edge.statements(files[name]))
            except Exception:
                db.execute(["TUPSERT", LEDGER, "name", name, "hash", _hash(files[name]), "state", "failed"])
                raise
            db.execute(["TUPSERT", LEDGER, "name", name, "hash", _hash(files[name]), "state", "applied"])
            ran.append(name)
    return ran


def repair(db, files: Mapping[str, str]) -> list[str]:
    """Take changed files as applied as they are now, and failed ones as pending again."""
    mended = []
    for name, state in plan(db, files):
        if state == "changed":
            db.execute(["TUPSERT", LEDGER, "name", name, "hash", _hash(files[name]), "state", "applied"])
        elif state == "failed":
            db.execute(["TDELETE", "FROM", LEDGER, "WHERE", "name", "=", name])
        else:
            continue
        mended.append(name)
    return mended


def _migrations(db, method, rest, params, body, claims):
    if not rest:
        return sorted(_ledger(db))
    verbs = {"plan": plan, "apply": apply, "repair": repair}
    return verbs[rest[0]](db, body["files"]) if rest[0] in verbs else None
