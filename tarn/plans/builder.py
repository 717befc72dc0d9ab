"""A fluent query builder over the same representation as the dialect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row

from .compile import compile_query
from .dialect import operator, parse_where, select_items
from .spec import AnyOf, DialectError, Join, Near, QuerySpec, Test

_WORDS = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "like": "LIKE", "ilike": "ILIKE", "contains": "CONTAINS"}


def _text(value: Any) -> str:
    return "true" if value is True else "false" if value is False else str(value)


class Query:
    """An immutable query; every verb returns a new one."""

    def __init__(self, tables: Mapping[str, DataFrame], spec: QuerySpec):
        self.tables, self.spec = tables, spec

    def _with(self, **changes) -> Query:
        return type(self)(self.tables, replace(self.spec, **changes))

    def select(self, columns: str = "*") -> Query:
        return self._with(items=select_items(columns))

    def alias(self, name: str) -> Query:
        return self._with(alias=name)

    def where(self, field: str, op: str | None = None, value: Any = None) -> Query:
        """``where("a", ">", 1)`` or conditions as text."""
        if op is None:
            return self._with(where=self.spec.where + parse_where(field))
        return self._test(Test(field, operator(_WORDS.get(op, op)), _text(value)))

    def any_of(self, *tests: tuple[str, str, Any]) -> Query:
        group = AnyOf(tuple(Test(f, operator(_WORDS.get(o, o)), _text(v)) for f, o, v in tests))
        return self._with(where=(*self.spec.where, group))

    def _test(self, test: Test) -> Query:
        return self._with(where=(*self.spec.where, AnyOf((test,))))

    def eq(self, field: str, value: Any) -> Query:
        return self._test(Test(field, "=", _text(value)))

    def neq(self, field: str, value: Any) -> Query:
        return self._test(Test(field, "!=", _text(value)))

    def gt(self, field: str, value: Any) -> Query:
        return self._test(Test(field, ">", _text(value)))

    def gte(self, field: str, value: Any) -> Query:
        return self._test(Test(field, ">=", _text(value)))

    def lt(self, field: str, value: Any) -> Query:
        return self._test(Test(field, "<", _text(value)))

    def lte(self, field: str, value: Any) -> Query:
        return self._test(Test(field, "<=", _text(value)))

    def like(self, field: str, pattern: str) -> Query:
        return self._test(Test(field, "LIKE", pattern))

    def ilike(self, field: str, pattern: str) -> Query:
        return self._test(Test(field, "ILIKE", pattern))

    def in_(self, field: str, values: Sequence[Any]) -> Query:
        return self._test(Test(field, "IN", tuple(map(_text, values))))

    def not_in(self, field: str, values: Sequence[Any]) -> Query:
        return self._test(Test(field, "NOT IN", tuple(map(_text, values))))

    def is_null(self, field: str) -> Query:
        return self._test(Test(field, "IS NULL"))

    def is_not_null(self, field: str) -> Query:
        return self._test(Test(field, "IS NOT NULL"))

    def is_valid(self, field: str) -> Query:
        return self._test(Test(field, "IS VALID"))

    def is_not_valid(self, field: str) -> Query:
        return self._test(Test(field, "IS NOT VALID"))

    def contains(self, field: str, value: Any) -> Query:
        return self._test(Test(field, "CONTAINS", _text(value)))

    def order(self, field: str, ascending: bool = True) -> Query:
        return self._with(order_by=(*self.spec.order_by, (field, ascending)))

    order_by = order

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def join(self, table: str, alias: str, left: str, right: str) -> Query:
        return self._with(joins=(*self.spec.joins, Join(table, alias, left, right)))

    def left_join(self, table: str, alias: str, left: str, right: str) -> Query:
        return self._with(joins=(*self.spec.joins, Join(table, alias, left, right, True)))

    def group(self, *columns: str) -> Query:
        return self._with(group_by=(*self.spec.group_by, *columns))

    group_by = group

    def having(self, field: str, op: str, value: Any) -> Query:
        return self._with(having=(*self.spec.having, Test(field, operator(_WORDS.get(op, op)), _text(value))))

    def near(self, field: str, vector: Sequence[float], k: int, threshold: float | None = None) -> Query:
        return self._with(near=Near(field, tuple(map(float, vector)), k, threshold))

    def df(self) -> DataFrame:
        return compile_query(self.spec, self.tables)

    def count(self) -> int:
        """The exact number of matching rows, without paging."""
        return compile_query(replace(self.spec, limit=None, offset=0, order_by=()), self.tables).count()

    def maybe_single(self) -> Row | None:
        """The only row, or nothing; more than one is an error."""
        rows = self.df().limit(2).collect()
        if len(rows) > 1:
            raise DialectError("the query has more than one row")
        return rows[0] if rows else None

    def single(self) -> Row:
        row = self.maybe_single()
        if row is None:
            raise DialectError("the query has no row")
        return row


class TableQuery(Query):
    """A query of a database's table with the verbs that write to it; conditions choose the rows."""

    def __init__(self, db, spec: QuerySpec):
        super().__init__(db.visible(), spec)
        self.db = db

    def _with(self, **changes) -> TableQuery:
        return TableQuery(self.db, replace(self.spec, **changes))

    def df(self) -> DataFrame:
        return self.db.select_spec(self.spec)

    run = df

    def similar(self, field: str, vector: Sequence[float], k: int, threshold: float | None = None) -> DataFrame:
        """The k rows most similar to a vector."""
        return self.near(field, vector, k, threshold).df()

    def insert(self, *rows: Mapping[str, Any]) -> DataFrame:
        """Insert rows; the inserted ones come back."""
        columns = list(dict.fromkeys(c for r in rows for c in r))
        data = [tuple(None if r.get(c) is None else _text(r[c]) for c in columns) for r in rows]
        return self.db.insert(self.spec.table, self.db.spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in columns)))

    def update(self, **values: Any) -> DataFrame:
        """Set columns of the rows that match; without a condition nothing is done."""
        return self.db.update(self.spec.table, {k: None if v is None else _text(v) for k, v in values.items()}, self._conditions())

    def delete(self) -> DataFrame:
        """Delete the rows that match; without a condition nothing is done."""
        return self.db.delete(self.spec.table, self._conditions())

    def _conditions(self) -> tuple:
        if not self.spec.where:
            raise DialectError("a write needs a condition")
        return self.spec.where

    def create_index(self, path: str, kind: str) -> str:
        return self.db.execute(["TINDEX", self.spec.table, path, kind])

    def drop_index(self, path: str) -> str:
        return self.db.execute(["TDROPINDEX", self.spec.table, path])


def query(tables: Mapping[str, DataFrame], table: str) -> Query:
    return Query(tables, QuerySpec(table))
