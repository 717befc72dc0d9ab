"""QuerySpec to DataFrame: policy, filter, nearest, join, aggregate, having, sort, page, project.

Everything is a lazy DataFrame transformation, so filters and column choices reach the scan and Catalyst
picks joins. Qualified names resolve as in SQL; unknown names are errors.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import cosine
from .predicates import column_test, group_test, json_text
from .spec import Aggregate, AnyOf, DialectError, Member, QuerySpec, Test

SIMILARITY = "_similarity"


class Scope:
    """Names that a query can use: (qualifier, column) to the physical column of the working frame."""

    def __init__(self):
        self.entries: list[tuple[str, str, str, T.DataType]] = []

    def add(self, qualifier: str, schema: T.StructType, physical) -> None:
        self.entries += [(qualifier, f.name, physical(f.name), f.dataType) for f in schema]

    def find(self, name: str) -> tuple[str, T.DataType] | None:
        head, dot, tail = name.partition(".")
        exact = [e for e in self.entries if e[1] == name]
        if dot:
            exact = [e for e in self.entries if e[0] == head and e[1] == tail] or exact
        if not exact:
            return None
        if len(exact) > 1 and len({e[0] for e in exact}) > 1:
            exact = exact[:1]  # the base table's column, then joined tables in order
        return exact[0][2], exact[0][3]

    def place(self, name: str) -> tuple[str, T.DataType, tuple[str, ...]]:
        """The physical column of a name, or the text column and JSON path that it starts with."""
        if got := self.find(name):
            return *got, ()
        steps = name.split(".")
        for n in (2, 1):
            if len(steps) > n and (got := self.find(".".join(steps[:n]))):
                return *got, tuple(steps[n:])
        raise DialectError(f"unknown column {name!r}")

    def resolve(self, name: str) -> tuple[Column, T.DataType, tuple[str, ...]]:
        column, kind, path = self.place(name)
        return F.col(f"`{column}`"), kind, path


def apply_members(df: DataFrame, members: list[Member], scope: Scope, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Membership as semi and anti joins: an empty list denies all, an empty negated list admits all."""
    for i, m in enumerate(members):
        col, kind, path = scope.resolve(m.field)
        if path:
            raise DialectError(f"{m.field!r} is not a column")
        other = tables[m.table]
        inner = Scope()
        inner.add(m.table, other.schema, lambda c: c)
        for group in m.where:
            other = other.filter(group_test(group, inner.resolve))
        name = f"_member_{i}"
        keys = other.select(F.col(f"`{m.column}`").cast(kind).alias(name)).filter(F.col(name).isNotNull())
        if m.negated:
            df = df.filter(col.isNotNull()).join(keys, col == F.col(name), "left_anti")
        else:
            df = df.join(keys, col == F.col(name), "left_semi")
    return df


def restrict(df: DataFrame, groups: tuple[AnyOf | Member, ...], scope: Scope, tables: Mapping[str, DataFrame]) -> DataFrame:
    for g in groups:
        if isinstance(g, AnyOf):
            df = df.filter(group_test(g, scope.resolve))
    return apply_members(df, [g for g in groups if isinstance(g, Member)], scope, tables)


def aggregate(a: Aggregate, scope: Scope) -> Column:
    """Empty input gives 0, also for SUM, AVG, MIN and MAX; text is not averaged or compared as numbers."""
    if a.column is None:
        return F.count(F.lit(1)).alias(a.name)
    col, kind, path = scope.resolve(a.column)
    if path:
        raise DialectError(f"{a.column!r} is not a column")
    if a.function == "COUNT":
        return (F.countDistinct(col) if a.distinct else F.count(col)).alias(a.name)
    if not isinstance(kind, T.NumericType):
        col = col.try_cast("double") if isinstance(kind, T.StringType) else F.unix_millis(col.cast("timestamp")).cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else col.cast("double")
    col = col.cast("double")
    made = {"SUM": F.sum_distinct if a.distinct else F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[a.function](col)
    return F.coalesce(made, F.lit(0.0)).alias(a.name)


def nearest(df: DataFrame, spec: QuerySpec, scope: Scope) -> DataFrame:
    """Exact top k by cosine, best first, ties by the first column."""
    near = spec.near
    col, kind, path = scope.resolve(near.field)
    if path or not isinstance(kind, T.ArrayType):
        raise DialectError(f"{near.field!r} is not a vector column")
    norm = sum(x * x for x in near.vector) ** 0.5
    if not norm:
        return df.withColumn(SIMILARITY, F.lit(0.0)).limit(0)
    scored = df.filter(F.size(col) == len(near.vector)).withColumn(SIMILARITY, cosine(col, near.vector))
    if near.threshold is not None:
        scored = scored.filter(F.col(SIMILARITY) >= near.threshold)
    return scored.orderBy(F.col(SIMILARITY).desc(), *[F.col(f"`{c}`").asc() for c, t in scored.dtypes[:1]]).limit(near.k)


def compile_query(spec: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The DataFrame of a query over named tables."""
    for name in (spec.table, *(j.table for j in spec.joins)):
        if name not in tables:
            raise DialectError(f"no table {name!r}")
    base, alias = tables[spec.table], spec.alias or spec.table
    scope = Scope()
    if spec.joins:
        names = [alias, *(j.alias for j in spec.joins)]
        if len(set(names)) < len(names):
            raise DialectError("tables of a join need different aliases")
        base = base.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in base.columns])
        scope.add(alias, tables[spec.table].schema, lambda c: f"{alias}.{c}")
    else:
        scope.add(alias, base.schema, lambda c: c)
    df = restrict(base, spec.policy, scope, tables)
    # conditions on the base table go below the join, the rest above
    own, later, base = [], [], {e[2] for e in scope.entries}
    full = scope
    if spec.joins:
        full = Scope()
        full.entries = list(scope.entries)
        for j in spec.joins:
            full.add(j.alias, tables[j.table].schema, lambda c, j=j: f"{j.alias}.{c}")
    for g in spec.where:
        fields = [t.field for t in g.tests] if isinstance(g, AnyOf) else [g.field]
        mine = all(full.place(f)[0] in base for f in fields)
        (own if mine else later).append(g)
    df = restrict(df, tuple(own), scope, tables)
    if spec.near:
        df = nearest(df, spec, scope)
        full.entries.append((alias, SIMILARITY, SIMILARITY, T.DoubleType()))
    for j in spec.joins:
        right = tables[j.table]
        right = right.select(*[F.col(f"`{c}`").alias(f"{j.alias}.{c}") for c in right.columns])
        a, b = (j.left, j.right) if j.right.startswith(f"{j.alias}.") else (j.right, j.left) if j.left.startswith(f"{j.alias}.") else (j.left, f"{j.alias}.{j.right}")
        (x, kx, px), (y, ky, py) = full.resolve(a), full.resolve(b)
        if px or py:
            raise DialectError(f"cannot join on {a!r} and {b!r}")
        if kx != ky and not (isinstance(kx, T.NumericType) and isinstance(ky, T.NumericType)):
            x, y = x.cast("string"), y.cast("string")
        df = df.join(right, x == y, "left" if j.outer else "inner")
    df = restrict(df, tuple(later), full, tables)
    return _finish(df, spec, full)


def _finish(df: DataFrame, spec: QuerySpec, scope: Scope) -> DataFrame:
    grouped = bool(spec.group_by or spec.aggregates)
    if grouped:
        keys = []
        for name in spec.group_by:
            col, _, path = scope.resolve(name)
            if path:
                raise DialectError(f"cannot group by {name!r}")
            shown = next((i.name for i in spec.columns if i.expr == name or i.expr.rpartition(".")[2] == name.rpartition(".")[2]), name.rpartition(".")[2])
            keys.append((name, col.alias(shown), shown))
        for i in spec.columns:
            if not any(i.name == s for _, _, s in keys):
                raise DialectError(f"{i.expr!r} is neither grouped nor aggregated")
        made = [aggregate(a, scope) for a in spec.aggregates]
        groups = df.groupBy(*[k for _, k, _ in keys])
        df = groups.agg(*made) if made else df.select(*[k for _, k, _ in keys]).distinct()
        out = Scope()
        out.add("", df.schema, lambda c: c)
        out.entries += [("", name, shown, df.schema[shown].dataType) for name, _, shown in keys if name != shown]
        scope = out
        lower = {c.lower(): c for c in df.columns}
        for t in spec.having:
            name = lower.get(t.field.lower())
            if name is None:
                raise DialectError(f"HAVING: no output column {t.field!r}")
            df = df.filter(column_test(Test(name, t.op, t.value), scope.resolve))
    elif spec.having:
        raise DialectError("HAVING needs GROUP BY or an aggregate")
    if spec.order_by:
        order = []
        aliases = {i.alias: i.expr for i in spec.columns if i.alias} if not grouped else {}
        for name, up in spec.order_by:
            col, _, path = scope.resolve(aliases.get(name, name))
            col = json_text(col, path) if path else col
            order.append(col.asc_nulls_first() if up else col.desc_nulls_last())
        df = df.orderBy(*order)
    elif spec.near and not grouped:
        df = df.orderBy(F.col(SIMILARITY).desc())
    if spec.offset:
        df = df.offset(spec.offset)
    if spec.limit is not None:
        df = df.limit(spec.limit)
    if grouped:
        order = [i.name for i in spec.items] if spec.items else []
        rest = [c for c in df.columns if c not in order]
        return df.select(*[f"`{c}`" for c in ([*order] if spec.columns or not spec.group_by else [*rest, *order])])
    if not spec.columns:
        return df
    out = []
    for i in spec.columns:
        col, _, path = scope.resolve(i.expr)
        out.append((json_text(col, path) if path else col).alias(i.name))
    return df.select(*out)


def table_scope(df: DataFrame, name: str) -> Scope:
    out = Scope()
    out.add(name, df.schema, lambda c: c)
    return out
