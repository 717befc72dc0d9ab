"""The one query representation: what the token dialect, the builder and HTTP-style parameters produce."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Comparison operators of the dialect.
COMPARISONS = ("=", "!=", ">", "<", ">=", "<=", "LIKE", "ILIKE")
LISTS = ("IN", "NOT IN")
TESTS = ("IS NULL", "IS NOT NULL", "IS VALID", "IS NOT VALID")
OPERATORS = (*COMPARISONS, *LISTS, *TESTS, "CONTAINS")
FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")


class DialectError(ValueError):
    """A query that the dialect does not accept."""


@dataclass(frozen=True)
class Test:
    """``field op value``; value is a string, a tuple of strings for lists, nothing for tests."""

    field: str
    op: str
    value: str | tuple[str, ...] | None = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise DialectError(f"unknown operator {self.op!r}")
        if self.op in LISTS and not self.value:
            raise DialectError(f"{self.op} needs at least one value")


@dataclass(frozen=True)
class AnyOf:
    """An OR group; a WHERE clause is a conjunction of these."""

    tests: tuple[Test, ...]


@dataclass(frozen=True)
class Member:
    """Membership of a column in another table's column; what row policies compile to."""

    field: str
    table: str
    column: str
    where: tuple[AnyOf, ...] = ()
    negated: bool = False


@dataclass(frozen=True)
class Item:
    """A projected column."""

    expr: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.expr.rpartition(".")[2]


@dataclass(frozen=True)
class Aggregate:
    """COUNT(*), COUNT(c), COUNT(DISTINCT c), SUM(c), AVG(c), MIN(c) or MAX(c)."""

    function: str
    column: str | None = None
    alias: str | None = None
    distinct: bool = False

    @property
    def name(self) -> str:
        inner = self.column or "*"
        return self.alias or f"{self.function.lower()}({'distinct ' * self.distinct}{inner.lower()})"


@dataclass(frozen=True)
class Join:
    table: str
    alias: str
    left: str
    right: str
    outer: bool = False


@dataclass(frozen=True)
class Near:
    """The k rows most similar to a vector, after filters."""

    field: str
    vector: tuple[float, ...]
    k: int
    threshold: float | None = None

    def __post_init__(self):
        if self.k < 1:
            raise DialectError("NEAR K must be greater than zero")


@dataclass(frozen=True)
class QuerySpec:
    table: str
    alias: str | None = None
    items: tuple[Item | Aggregate, ...] = ()
    joins: tuple[Join, ...] = ()
    where: tuple[AnyOf | Member, ...] = ()
    group_by: tuple[str, ...] = ()
    having: tuple[Test, ...] = ()
    near: Near | None = None
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    #: Policies that apply to the base table before anything else.
    policy: tuple[AnyOf | Member, ...] = field(default=())

    @property
    def columns(self) -> list[Item]:
        return [x for x in self.items if isinstance(x, Item)]

    @property
    def aggregates(self) -> list[Aggregate]:
        return [x for x in self.items if isinstance(x, Aggregate)]
