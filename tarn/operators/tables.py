"""Rows of declared tables: insert, upsert, update and delete as functions from frames to frames.

A statement works on a whole batch and gives the table's new state and the rows it touched; nothing is
changed in place. Constraint checks are aggregations and semi or anti joins over the batch, so a load of
any size is checked as one query. Checks run in this order: unknown columns, defaults, sequences, NOT NULL,
types, references, UNIQUE, primary key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import cast_in, default_value, number_rows
from ..plans.compile import Scope, table_scope
from ..plans.predicates import group_test
from ..plans.schema import EXPIRES, Table
from ..plans.spec import AnyOf, DialectError

#: Levels that a cascade follows.
DEPTH = 16


class ConstraintError(ValueError):
    """A batch that breaks constraints; ``violations`` names each."""

    def __init__(self, violations: list[tuple[str, str, str]]):
        super().__init__("; ".join(f"{k} {c}: {v}" for k, c, v in violations))
        self.violations = violations


@dataclass(frozen=True)
class Change:
    """The table's state after a statement, and the rows that it returns."""

    state: DataFrame
    rows: DataFrame


def live(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows whose deadline, if any, is not past."""
    if EXPIRES not in df.columns:
        return df
    return df.filter(F.col(EXPIRES).isNull() | (F.col(EXPIRES) >= (now if now is not None else F.current_timestamp())))


def visible(df: DataFrame, now: Column | None = None) -> DataFrame:
    return live(df, now).drop(EXPIRES)


def empty(spark, table: Table) -> DataFrame:
    return spark.createDataFrame([], table.struct())


def _typed(table: Table, batch: DataFrame, name: str) -> Column:
    """A batch column in its declared type; texts are parsed, NULL where they do not."""
    c, kind = table.column(name), batch.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return cast_in(col, c.kind, c.dims)
    if c.kind == "TIMESTAMP" and isinstance(kind, T.IntegralType):
        return F.timestamp_millis(col)
    return col.cast(c.spark)


def prepare(table: Table, batch: DataFrame, state: DataFrame, ttl_seconds: int | None = None, now: Column | None = None) -> DataFrame:
    """The batch with every declared column typed, defaults and numbers filled in, plus ``_bad`` with parse failures."""
    unknown = [c for c in batch.columns if c not in {x.name for x in table.columns}]
    if unknown:
        raise DialectError(f"{table.name} has no column {unknown[0]!r}")
    given, made, bad = set(batch.columns), [], []
    for c in table.columns:
        if c.name in given:
            col = _typed(table, batch, c.name)
            bad.append(F.when(F.col(f"`{c.name}`").isNotNull() & col.isNull(), F.lit(c.name)))
            if c.default is not None:
                col = F.coalesce(col, cast_in(default_value(c.default, now), c.kind, c.dims))
        elif c.default is not None:
            col = cast_in(default_value(c.default, now), c.kind, c.dims)
        elif c.primary_key and c.kind == "UUID":
            col = default_value("uuid()", now)
        else:
            col = F.lit(None).cast(c.spark)
        made.append(col.cast(c.spark).alias(c.name))
    seconds = ttl_seconds if ttl_seconds is not None else table.ttl_seconds
    clock = now if now is not None else F.current_timestamp()
    deadline = F.timestamp_add("SECOND", F.lit(seconds), clock) if seconds else F.lit(None).cast("timestamp")
    rows = batch.select(*made, deadline.alias(EXPIRES), F.array_compact(F.array(*bad)).alias("_bad") if bad else F.array().cast("array<string>").alias("_bad"))
    key = table.key
    if key.kind == "INT":
        rows = _number_keys(rows, key.name, state)
    for c in table.columns:
        if c.sequence_by:
            rows = _number_sequence(rows, c.name, c.sequence_by, state)
    return rows


def _number_keys(rows: DataFrame, key: str, state: DataFrame) -> DataFrame:
    """Missing integer keys count on from the greatest key of the state and the batch."""
    missing = rows.filter(F.col(key).isNull())
    if missing.isEmpty():
        return rows
    top = state.select(F.col(key)).unionByName(rows.select(F.col(key))).agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    order = rows.columns
    numbered = number_rows(missing, "_n", int(top) + 1).withColumn(key, F.col("_n").cast("bigint")).select(*order)
    return rows.filter(F.col(key).isNotNull()).unionByName(numbered)


def _number_sequence(rows: DataFrame, name: str, by: str, state: DataFrame) -> DataFrame:
    """Missing numbers count on within each partition value, from the greatest there is, explicit ones included."""
    order = rows.columns
    used = state.select(by, name).unionByName(rows.select(by, name)).groupBy(F.col(by).alias("_by")).agg(F.coalesce(F.max(name), F.lit(0)).alias("_top"))
    missing = rows.filter(F.col(name).isNull()).withColumn("_at", F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy(by).orderBy("_at"))
    filled = missing.withColumn("_n", nth).join(used, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, (F.col("_top") + F.col("_n")).cast("bigint")).select(*order)
    return rows.filter(F.col(name).isNotNull()).unionByName(filled)


def violations(table: Table, rows: DataFrame, state: DataFrame, others: Mapping[str, DataFrame] | None = None, tables: Mapping[str, Table] | None = None, touched: set[str] | None = None) -> DataFrame:
    """(kind, column, value) of every broken constraint of prepared rows; ``state`` must hold live rows only.

    With ``touched``, only constraints on those columns are checked: an update can break no others.
    """
    mine = lambda *names: touched is None or any(n in touched for n in names)
    others, tables = others or {}, tables or {}
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if not isinstance(rows.schema[c].dataType, T.ArrayType) else F.to_json(F.col(f"`{c}`"))
    found = []
    add = lambda df, kind, c, value: found.append(df.select(F.lit(kind).alias("kind"), F.lit(c).alias("column"), value.alias("value")))
    for c in table.columns:
        if mine(c.name) and c.not_null and not (c.primary_key and c.kind in ("INT", "UUID")):
            add(rows.filter(F.col(f"`{c.name}`").isNull()), "not_null", c.name, F.lit(""))
    if "_bad" in rows.columns:
        found.append(rows.select(F.lit("type").alias("kind"), F.explode("_bad").alias("column"), F.lit("").alias("value")))
    for c in table.columns:
        if c.references and mine(c.name):
            target = others.get(c.references.table)
            if target is None:
                raise DialectError(f"no table {c.references.table!r}")
            column = c.references.column or (tables[c.references.table].key.name if c.references.table in tables else "id")
            keys = target.select(F.col(f"`{column}`").cast(c.spark).alias("_k"))
            if c.references.table == table.name:
                keys = keys.unionByName(rows.select(F.col(f"`{column}`").cast(c.spark).alias("_k")))
            add(rows.filter(F.col(f"`{c.name}`").isNotNull()).join(keys, F.col(f"`{c.name}`") == F.col("_k"), "left_anti"), "foreign_key", c.name, text(c.name))
    uniques = [((c.name,), "primary_key" if c.primary_key else "unique") for c in table.columns if c.unique or c.primary_key]
    uniques += [((c.sequence_by, c.name), "unique") for c in table.columns if c.sequence_by]
    for names, kind in uniques:
        if not mine(*names):
            continue
        cols = [F.col(f"`{n}`") for n in names]
        have = rows.filter(cols[-1].isNotNull())
        twice = have.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        held = state.select(*[F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)])
        on = [F.col(f"`{n}`").eqNullSafe(F.col(f"_{i}")) for i, n in enumerate(names)]
        cond = on[0] if len(on) == 1 else on[0] & on[1]
        value = F.concat_ws(",", *[c.cast("string") for c in cols])
        add(twice, kind, names[-1], value)
        add(have.join(held, cond, "left_semi"), kind, names[-1], value)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def check(broken: DataFrame, show: int = 20) -> None:
    """Raise if there are violations; at most ``show`` are named."""
    rows = broken.limit(show).collect()
    if rows:
        raise ConstraintError([(r["kind"], r["column"], r["value"]) for r in rows])


def insert(table: Table, state: DataFrame, batch: DataFrame, others: Mapping[str, DataFrame] | None = None, tables: Mapping[str, Table] | None = None, ttl_seconds: int | None = None, now: Column | None = None) -> Change:
    """Append a batch after its checks; expired rows hold no values."""
    current = live(state, now)
    rows = prepare(table, batch, state, ttl_seconds, now)
    check(violations(table, rows, current, others, tables))
    rows = rows.drop("_bad")
    key = table.key.name
    # an expired row with the key of a new one gives way
    kept = state.join(rows.select(F.col(key)), key, "left_anti")
    return Change(kept.unionByName(rows), rows.drop(EXPIRES))


def upsert(table: Table, state: DataFrame, batch: DataFrame, conflict: tuple[str, ...] = (), others: Mapping[str, DataFrame] | None = None, tables: Mapping[str, Table] | None = None, ttl_seconds: int | None = None, now: Column | None = None) -> Change:
    """Insert rows or update those that have their conflict columns' values (default: the key).

    An update changes the columns given; a row without its conflict values is inserted.
    """
    on = list(conflict or (table.key.name,))
    missing = [c for c in on if c not in batch.columns]
    if missing and missing != [table.key.name]:
        raise DialectError(f"the conflict column {missing[0]!r} is not given")
    current = live(state, now)
    if missing:
        return insert(table, state, batch, others, tables, ttl_seconds, now)
    typed = batch.select(*[_typed(table, batch, c).alias(c) for c in batch.columns])
    held = current.select(*[F.col(f"`{c}`").alias(f"_old_{c}") for c in current.columns])
    match = None
    for c in on:
        one = F.col(f"`{c}`") == F.col(f"`_old_{c}`")
        match = one if match is None else match & one
    met = typed.join(held, match, "inner")
    seconds = ttl_seconds if ttl_seconds is not None else table.ttl_seconds
    deadline = F.timestamp_add("SECOND", F.lit(seconds), now if now is not None else F.current_timestamp()) if seconds else F.col(f"`_old_{EXPIRES}`")
    updated = met.select(*[(F.col(f"`{c.name}`") if c.name in batch.columns else F.col(f"`_old_{c.name}`")).alias(c.name) for c in table.columns], deadline.alias(EXPIRES))
    fresh = batch.join(current.select(*[F.col(f"`{c}`").alias(f"_k_{c}") for c in on]), _equal(table, batch, on), "left_anti")
    kept = current.join(updated.select(table.key.name), table.key.name, "left_anti")
    check(violations(table, updated, kept, others, tables))
    base = kept.unionByName(updated)
    if fresh.isEmpty():
        return Change(base, updated.drop(EXPIRES))
    added = insert(table, base, fresh, others, tables, ttl_seconds, now)
    return Change(added.state, updated.drop(EXPIRES).unionByName(added.rows))


def _equal(table: Table, batch: DataFrame, on: list[str]) -> Column:
    out = None
    for c in on:
        one = _typed(table, batch, c) == F.col(f"`_k_{c}`")
        out = one if out is None else out & one
    return out


def matching(df: DataFrame, name: str, where: tuple[AnyOf, ...]) -> Column:
    """The condition of a statement's WHERE; unknown columns are errors."""
    scope: Scope = table_scope(df, name)
    out = F.lit(True)
    for g in where:
        out = out & F.coalesce(group_test(g, scope.resolve), F.lit(False))
    return out


def update(table: Table, state: DataFrame, values: Mapping[str, str | None], where: tuple[AnyOf, ...], others: Mapping[str, DataFrame] | None = None, tables: Mapping[str, Table] | None = None, ttl_seconds: int | None = None, now: Column | None = None) -> Change:
    """Set columns of the live rows that match; checked like an insert."""
    hit = matching(state, table.name, where) & (F.col(EXPIRES).isNull() | (F.col(EXPIRES) >= (now if now is not None else F.current_timestamp())))
    changed = state.filter(hit)
    for name, text in values.items():
        c = table.column(name)
        col = F.lit(None).cast(c.spark) if text is None else cast_in(F.lit(str(text)), c.kind, c.dims).cast(c.spark)
        changed = changed.withColumn(name, col)
    bad = [F.when(cast_in(F.lit(str(v)), table.column(k).kind, table.column(k).dims).isNull(), F.lit(k)) for k, v in values.items() if v is not None]
    if ttl_seconds:
        changed = changed.withColumn(EXPIRES, F.timestamp_add("SECOND", F.lit(ttl_seconds), now if now is not None else F.current_timestamp()))
    rest = state.filter(~hit)
    rows = changed.withColumn("_bad", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))
    check(violations(table, rows, live(rest, now), others, tables, set(values)))
    return Change(rest.unionByName(changed), changed.drop(EXPIRES))


def delete(name: str, where: tuple[AnyOf, ...], states: Mapping[str, DataFrame], tables: Mapping[str, Table], now: Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete matching rows and follow references to them: (changed states, deleted rows of the table).

    RESTRICT anywhere on the way fails the whole statement; SET NULL clears the column; CASCADE goes on, to
    ``DEPTH`` levels. References of a table to itself are followed too.
    """
    states = dict(states)
    gone = live(states[name], now).filter(matching(states[name], name, where))
    result = gone.drop(EXPIRES)
    todo: list[tuple[str, DataFrame, int]] = [(name, gone, 0)]
    removed: dict[str, DataFrame] = {}
    cleared: dict[str, list[tuple[str, DataFrame]]] = {}
    while todo:
        parent, rows, depth = todo.pop(0)
        key = tables[parent].key.name
        removed[parent] = rows if parent not in removed else removed[parent].unionByName(rows).dropDuplicates([key])
        for child, t in tables.items():
            for c in t.columns:
                r = c.references
                if not r or r.table != parent:
                    continue
                keys = rows.select(F.col(f"`{r.column or key}`").cast(c.spark).alias("_k"))
                own = live(states[child], now)
                if child in removed:
                    own = own.join(removed[child].select(t.key.name), t.key.name, "left_anti")
                hit = own.join(keys, F.col(f"`{c.name}`") == F.col("_k"), "left_semi")
                if r.on_delete == "SET NULL":
                    cleared.setdefault(child, []).append((c.name, keys))
                elif not hit.isEmpty():
                    if r.on_delete == "RESTRICT":
                        raise ConstraintError([("restrict", f"{child}.{c.name}", "rows refer to deleted rows")])
                    if depth >= DEPTH:
                        raise ConstraintError([("depth", child, "the cascade is too deep")])
                    todo.append((child, hit, depth + 1))
    for table, pairs in cleared.items():
        t = tables[table]
        for column, keys in pairs:
            if t.column(column).not_null:
                raise ConstraintError([("not_null", f"{table}.{column}", "")])
            marked = states[table].join(keys.distinct().withColumn("_hit", F.lit(True)), F.col(f"`{column}`") == F.col("_k"), "left")
            states[table] = marked.withColumn(column, F.when(F.col("_hit").isNull(), F.col(f"`{column}`"))).select(*states[table].columns)
    for table, rows in removed.items():
        key = tables[table].key.name
        states[table] = states[table].join(rows.select(key), key, "left_anti")
    return states, result


def add_column(table: Table, state: DataFrame, text: str) -> tuple[Table, DataFrame]:
    """TALTER ADD: existing rows get the default; NOT NULL needs one where there are rows."""
    from dataclasses import replace

    from ..plans.schema import parse_column

    c = parse_column(text)
    if c.primary_key:
        raise DialectError("a key cannot be added")
    if c.not_null and c.default is None and not state.isEmpty():
        raise ConstraintError([("not_null", c.name, "no default for existing rows")])
    value = cast_in(default_value(c.default), c.kind, c.dims).cast(c.spark) if c.default is not None else F.lit(None).cast(c.spark)
    made = replace(table, columns=(*table.columns, c))
    return made, state.withColumn(c.name, value).select(*[x.name for x in made.columns], EXPIRES)


def drop_column(table: Table, state: DataFrame, name: str) -> tuple[Table, DataFrame]:
    from dataclasses import replace

    if table.column(name).primary_key:
        raise DialectError("the key cannot be dropped")
    return replace(table, columns=tuple(c for c in table.columns if c.name != name), paths=tuple(p for p in table.paths if p[0].split(".")[0] != name)), state.drop(name)
