"""Dialect conditions as typed Spark columns.

NULL rules: ``!=`` holds for NULL, ``NOT IN`` and every other comparison do not. A JSON path that is
absent, JSON null, an object or an array matches no comparison. Comparisons of JSON scalars are numeric
where both sides are numbers, else textual.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import AnyOf, DialectError, Test

#: Gives a column and its type for a name, and the JSON path below it (empty if the name is a column).
Resolve = Callable[[str], tuple[Column, T.DataType, tuple[str, ...]]]


def number(text: str) -> float | int | None:
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return None


def literal(text: str, kind: T.DataType) -> Column:
    """A value token as a literal of the column's type."""
    if isinstance(kind, T.BooleanType):
        return F.lit(text.lower() in ("true", "1"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = F.timestamp_millis(F.lit(int(text))) if re.fullmatch(r"-?\d+", text) else F.to_timestamp(F.lit(text))
        return at.cast(kind)
    if isinstance(kind, T.DateType):
        return F.to_date(F.lit(text))
    if isinstance(kind, T.NumericType):
        value = number(text)
        if value is None:
            raise DialectError(f"{text!r} is not a number")
        return F.lit(value)
    if isinstance(kind, T.BinaryType):
        return F.lit(text.encode())
    return F.lit(text)


def like(col: Column, kind: T.DataType, pattern: str, fold: bool) -> Column:
    """``%`` and ``_`` are wildcards and nothing escapes them; only text columns match."""
    if not isinstance(kind, T.StringType):
        return F.lit(False)
    pattern = pattern.replace("\\", "\\\\")
    return col.ilike(pattern) if fold else col.like(pattern)


_COMPARE = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def json_value(parsed: Column, path: tuple[str, ...]) -> Column:
    """The variant at a path of a parsed JSON text; a numeric step also indexes arrays; NULL if absent or JSON null."""
    ways = [""]
    for step in path:
        key = "['" + step.replace("'", "") + "']"
        ways = [w + k for w in ways for k in ([key, f"[{int(step)}]"] if step.isdigit() else [key])]
    got = [F.try_variant_get(parsed, "$" + w, "variant") for w in ways]
    value = F.coalesce(*got) if len(got) > 1 else got[0]
    return F.when(~F.is_variant_null(value), value)


def json_scalar(parsed: Column, path: tuple[str, ...]) -> Column:
    """Text of the scalar at a path; NULL for anything else."""
    value = json_value(parsed, path)
    return F.when(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(value, "$", "string"))


def json_text(col: Column, path: tuple[str, ...]) -> Column:
    """Text of whatever is at a path of a JSON text."""
    return F.element_at(F.transform(F.array(F.try_parse_json(col)), lambda p: F.try_variant_get(json_value(p, path), "$", "string")), 1)


def loose(col: Column, op: str, text: str) -> Column:
    """Compare a text column with a token: as numbers if both are, else as text."""
    if op in ("LIKE", "ILIKE"):
        return like(col, T.StringType(), text, op == "ILIKE")
    compare = (lambda a, b: a != b) if op == "!=" else _COMPARE[op]
    plain = compare(col, F.lit(text))
    value = number(text)
    if value is None:
        return plain
    numeric = col.try_cast("double")
    return F.when(numeric.isNotNull(), compare(numeric, F.lit(float(value)))).otherwise(plain)


def json_elements(col: Column) -> Column:
    """The elements of a JSON array text, as text."""
    return F.transform(F.try_variant_get(F.try_parse_json(col), "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))


def _json_test(col: Column, path: tuple[str, ...], test: Test) -> Column:
    """A condition on a JSON path; the text is parsed once a row and bound, whatever the condition reads of it."""
    return F.coalesce(F.exists(F.array(F.try_parse_json(col)), lambda p: _parsed_test(p, path, test)), F.lit(False))


def _parsed_test(parsed: Column, path: tuple[str, ...], test: Test) -> Column:
    if test.op in ("IS VALID", "IS NOT NULL"):
        return json_value(parsed, path).isNotNull()
    if test.op in ("IS NOT VALID", "IS NULL"):
        return json_value(parsed, path).isNull()
    if test.op == "CONTAINS":
        items = F.transform(F.try_variant_get(json_value(parsed, path), "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
        return F.array_contains(items, test.value)
    if test.op == "IN":
        found = lambda x: reduce(lambda a, b: a | b, [loose(x, "=", v) for v in test.value])
    elif test.op == "NOT IN":
        found = lambda x: reduce(lambda a, b: a & b, [loose(x, "!=", v) for v in test.value])
    else:
        found = lambda x: loose(x, test.op, test.value)
    return F.exists(F.array(json_scalar(parsed, path)), lambda x: x.isNotNull() & F.coalesce(found(x), F.lit(False)))


def column_test(test: Test, resolve: Resolve) -> Column:
    """One condition; true or false, never NULL, so that negations and policies are safe."""
    col, kind, path = resolve(test.field)
    if path:
        return _json_test(col, path, test)
    if test.op in ("IS NULL", "IS NOT VALID"):
        return col.isNull()
    if test.op in ("IS NOT NULL", "IS VALID"):
        return col.isNotNull()
    if test.op == "CONTAINS":
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_contains(col, literal(test.value, kind.elementType)), F.lit(False))
        return F.coalesce(F.array_contains(json_elements(col), test.value), F.lit(False))
    if test.op in ("IN", "NOT IN"):
        found = col.isin(*[literal(v, kind) for v in test.value])
        return F.coalesce(found if test.op == "IN" else ~found, F.lit(False))
    if test.op in ("LIKE", "ILIKE"):
        return F.coalesce(like(col, kind, test.value, test.op == "ILIKE"), F.lit(False))
    if test.op == "!=":
        return ~col.eqNullSafe(literal(test.value, kind))
    if isinstance(kind, T.BooleanType) and test.op != "=":
        return F.lit(False)
    # a bare comparison, so that it can be pushed to the scan; NULL acts as false in a filter
    return _COMPARE[test.op](col, literal(test.value, kind))


def group_test(group: AnyOf, resolve: Resolve) -> Column:
    return reduce(lambda a, b: a | b, [column_test(t, resolve) for t in group.tests])


def all_tests(groups: tuple[AnyOf, ...], resolve: Resolve) -> Column:
    return reduce(lambda a, b: a & b, [group_test(g, resolve) for g in groups], F.lit(True))
