"""Declared tables: columns, constraints, defaults and deadlines, from definition text or code."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .spec import DialectError

#: Type names and their other spellings.
TYPES = {
    "STR": "STR TEXT VARCHAR STRING",
    "INT": "INT INTEGER BIGINT",
    "FLOAT": "FLOAT REAL DOUBLE",
    "BOOL": "BOOL BOOLEAN",
    "TIMESTAMP": "TIMESTAMP DATETIME",
    "UUID": "UUID",
    "JSON": "JSON JSONB",
    "ARRAY": "ARRAY",
}
_NAMES = {word: name for name, words in TYPES.items() for word in words.split()}
SPARK = {"STR": T.StringType(), "INT": T.LongType(), "FLOAT": T.DoubleType(), "BOOL": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "UUID": T.StringType(), "VECTOR": T.ArrayType(T.FloatType()), "JSON": T.StringType(), "ARRAY": T.StringType()}
ACTIONS = ("RESTRICT", "CASCADE", "SET NULL")
EXPIRES = "_expires_at"


@dataclass(frozen=True)
class Reference:
    table: str
    column: str | None = None
    on_delete: str = "RESTRICT"


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    dims: int | None = None
    primary_key: bool = False
    unique: bool = False
    not_null: bool = False
    default: str | None = None
    sequence_by: str | None = None
    references: Reference | None = None
    encrypted: bool = False
    searchable: bool = False

    @property
    def spark(self) -> T.DataType:
        return SPARK[self.kind]

    def describe(self) -> str:
        out = [self.name, f"VECTOR({self.dims})" if self.kind == "VECTOR" else self.kind]
        out += ["PRIMARY KEY"] * self.primary_key + ["UNIQUE"] * self.unique + ["NOT NULL"] * (self.not_null and not self.primary_key)
        if self.default is not None:
            out.append(f"DEFAULT {self.default}")
        if self.sequence_by:
            out.append(f"SEQUENCE PARTITION BY {self.sequence_by}")
        if self.references:
            r = self.references
            out.append(f"REFERENCES {r.table}({r.column or 'id'}) ON DELETE {r.on_delete}")
        out += ["ENCRYPTED"] * self.encrypted + ["SEARCHABLE"] * self.searchable
        return " ".join(out)


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    ttl_seconds: int | None = None
    #: Declared JSON paths: (column.path, type).
    paths: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise DialectError("a column is declared twice")
        keys = [c for c in self.columns if c.primary_key]
        if len(keys) > 1:
            raise DialectError("a table has one primary key")
        if not keys:
            object.__setattr__(self, "columns", (Column("id", "INT", primary_key=True, not_null=True), *self.columns))

    @property
    def key(self) -> Column:
        return next(c for c in self.columns if c.primary_key)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise DialectError(f"{self.name} has no column {name!r}")

    def struct(self) -> T.StructType:
        """The stored schema; the row deadline is a hidden last column."""
        return T.StructType([*[T.StructField(c.name, c.spark, True, {"declared": c.describe()}) for c in self.columns], T.StructField(EXPIRES, T.TimestampType())])


def parse_type(word: str) -> tuple[str, int | None]:
    m = re.fullmatch(r"VECTOR\((\d+)\)", word.upper())
    if m:
        if int(m.group(1)) < 1:
            raise DialectError("a vector has at least one dimension")
        return "VECTOR", int(m.group(1))
    if word.upper() not in _NAMES:
        raise DialectError(f"unknown type {word!r}")
    return _NAMES[word.upper()], None


def parse_column(text: str) -> Column:
    """``name TYPE [constraints]``."""
    words = re.findall(r"'[^']*'|\"[^\"]*\"|\w+\([^)]*\)|\S+", text.strip())
    if len(words) < 2:
        raise DialectError(f"cannot read the column {text!r}")
    kind, dims = parse_type(words[1])
    how: dict = {}
    upper = [w.upper() for w in words]
    i = 2
    while i < len(words):
        two = " ".join(upper[i : i + 2])
        if two == "PRIMARY KEY":
            how |= {"primary_key": True, "not_null": True}
            i += 2
        elif two == "NOT NULL":
            how["not_null"] = True
            i += 2
        elif upper[i] in ("NULL", "UNIQUE", "ENCRYPTED", "SEARCHABLE"):
            if upper[i] != "NULL":
                how[upper[i].lower()] = True
            i += 1
        elif upper[i] == "DEFAULT" and i + 1 < len(words):
            how["default"] = words[i + 1].strip("'\"")
            i += 2
        elif " ".join(upper[i : i + 3]) == "SEQUENCE PARTITION BY" and i + 3 < len(words):
            how["sequence_by"] = words[i + 3]
            i += 4
        elif upper[i] == "REFERENCES" and i + 1 < len(words):
            m = re.fullmatch(r"(\w+)(?:\((\w+)\))?", words[i + 1])
            if not m:
                raise DialectError(f"cannot read the reference {words[i + 1]!r}")
            i += 2
            action = "RESTRICT"
            if upper[i : i + 2] == ["ON", "DELETE"]:
                action = next((a for a in ACTIONS if upper[i + 2 : i + 2 + len(a.split())] == a.split()), "")
                if not action:
                    raise DialectError("ON DELETE needs RESTRICT, CASCADE or SET NULL")
                i += 2 + len(action.split())
            how["references"] = Reference(m.group(1), m.group(2), action)
        else:
            raise DialectError(f"unknown constraint {words[i]!r}")
    if how.get("searchable") and not how.get("encrypted"):
        raise DialectError("SEARCHABLE needs ENCRYPTED")
    if how.get("encrypted") and how.get("default") is not None:
        raise DialectError("an encrypted column has no DEFAULT")
    if how.get("sequence_by") and kind != "INT":
        raise DialectError("a sequence is an INT")
    return Column(words[0], kind, dims, **how)


def parse_table(text: str) -> Table:
    """``name column, column, .. [WITH TTL seconds]``; brackets around the columns are allowed."""
    name, _, rest = text.strip().partition(" ")
    ttl = None
    if m := re.search(r"\s+WITH\s+TTL\s+(\d+)\s*$", rest, re.I):
        ttl, rest = int(m.group(1)), rest[: m.start()]
    rest = rest.strip()
    if rest.startswith("(") and rest.endswith(")"):
        rest = rest[1:-1]
    columns = tuple(parse_column(p) for p in re.split(r",(?![^(]*\))", rest) if p.strip())
    if not columns:
        raise DialectError("a table needs columns")
    return Table(name, columns, ttl)
