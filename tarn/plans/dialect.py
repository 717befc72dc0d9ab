"""The token dialect: SELECT-like queries and statements as lists of tokens, or as text.

``AND`` joins OR groups, so ``a OR b AND c`` means ``(a OR b) AND c``; there are no parentheses around
conditions. Clauses after FROM may come in any order. Values are tokens: quote what has blanks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from .spec import COMPARISONS, FUNCTIONS, Aggregate, AnyOf, DialectError, Item, Join, Member, Near, QuerySpec, Test

CLAUSES = ("JOIN", "LEFT", "WHERE", "GROUP", "HAVING", "NEAR", "ORDER", "LIMIT", "OFFSET")
_TEXT = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(!=|<>|>=|<=|=|>|<)|([(),])|((?:->|!(?!=)|[^\s"'(),=<>!])+(?:\([^()]*\))?))""")
_CALL = re.compile(r"(\w+)\s*\(\s*(DISTINCT\s+)?([^()]*?)\s*\)$", re.I)


def tokenize(text: str) -> list[str]:
    """Split text into tokens; quotes keep blanks, operators and brackets stand alone.

    A call such as ``COUNT(*)`` stays one token.
    """
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] == "[" and (end := text.find("]", at)) > 0:
            out.append(text[at : end + 1])
            at = end + 1
            continue
        call = re.compile(r"\w+\([^()'\"]*\)").match(text, at)
        if call and call.group().split("(")[0].upper() in (*FUNCTIONS, "VECTOR", "AUTH.UID"):
            out.append(call.group())
            at = call.end()
            continue
        m = _TEXT.match(text, at)
        if not m:
            raise DialectError(f"cannot read the query at {text[at:at + 20]!r}")
        quoted = m.group(1) if m.group(1) is not None else m.group(2)
        out.append(re.sub(r"\\(.)", r"\1", quoted) if quoted is not None else next(g for g in m.groups()[2:] if g))
        at = m.end()
    return out


class Tokens:
    """A cursor over tokens with one-token look-ahead."""

    def __init__(self, tokens: Sequence[str]):
        self.tokens, self.at = [t for t in tokens], 0

    def __bool__(self) -> bool:
        return self.at < len(self.tokens)

    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tokens[at].upper() if at < len(self.tokens) else ""

    def take(self, what: str = "a value") -> str:
        if not self:
            raise DialectError(f"the query ends where {what} is needed")
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, *words: str) -> bool:
        """Pass the words if they come next."""
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        got = self.take(word)
        if got.upper() != word:
            raise DialectError(f"expected {word}, found {got!r}")

    def until(self, *words: str) -> list[str]:
        out = []
        while self and self.peek() not in words:
            out.append(self.take())
        return out


def operator(token: str) -> str:
    op = "!=" if token == "<>" else token.upper()
    if op not in COMPARISONS:
        raise DialectError(f"unknown operator {token!r}")
    return op


def value_list(t: Tokens) -> tuple[str, ...]:
    """``( a b c )`` or ``( a, b, c )``; brackets may touch the values."""
    text = t.take("(")
    if not text.startswith("("):
        raise DialectError("a list starts with (")
    values, text = [], text[1:]
    while True:
        closed = text.endswith(")")
        values += [v for v in (text[:-1] if closed else text).split(",") if v]
        if closed:
            break
        text = t.take(")")
        if text.upper() == "SELECT":
            raise DialectError("subqueries are not allowed in a list")
    if not values:
        raise DialectError("a list needs at least one value")
    return tuple(values)


def condition(t: Tokens) -> Test:
    name = t.take("a column")
    if t.peek() == "NOT" and t.peek(1) == "IN":
        t.skip("NOT", "IN")
        return Test(name, "NOT IN", value_list(t))
    if t.skip("IN"):
        return Test(name, "IN", value_list(t))
    if t.skip("IS"):
        words = "IS NOT " if t.skip("NOT") else "IS "
        kind = t.take("NULL or VALID").upper()
        if kind not in ("NULL", "VALID"):
            raise DialectError(f"IS {kind} is not known")
        return Test(name, words + kind)
    if t.skip("CONTAINS"):
        return Test(name, "CONTAINS", t.take())
    return Test(name, operator(t.take("an operator")), t.take())


def conditions(t: Tokens) -> tuple[AnyOf, ...]:
    """OR groups joined by AND."""
    groups = []
    while True:
        tests = [condition(t)]
        while t.skip("OR"):
            tests.append(condition(t))
        groups.append(AnyOf(tuple(tests)))
        if not t.skip("AND"):
            return tuple(groups)


def parse_where(text: str | Sequence[str]) -> tuple[AnyOf, ...]:
    t = Tokens(tokenize(text) if isinstance(text, str) else text)
    out = conditions(t) if t else ()
    if t:
        raise DialectError(f"unexpected {t.take()!r} after the conditions")
    return out


def select_items(tokens: Sequence[str] | str) -> tuple[Item | Aggregate, ...]:
    """The select list: columns and aggregates, with ``AS name`` or a bare name; ``*`` wins over columns."""
    text = tokens if isinstance(tokens, str) else " ".join(tokens)
    parts = [p.strip() for p in re.split(r",(?![^(]*\))", text) if p.strip()]
    if not parts:
        raise DialectError("a column list is needed")
    out: list[Item | Aggregate] = []
    star = False
    for part in parts:
        m = re.match(r"(.+?\)|\S+)(?:\s+AS\s+(\S+)|\s+(\S+))?$", part, re.I | re.S)
        if not m:
            raise DialectError(f"cannot read {part!r} in the column list")
        expr, alias = m.group(1).strip(), m.group(2) or m.group(3)
        call = _CALL.match(expr)
        if call:
            name, column = call.group(1).upper(), call.group(3)
            if name not in FUNCTIONS:
                raise DialectError(f"unknown aggregate {call.group(1)!r}")
            if column in ("", "*") and (name != "COUNT" or call.group(2)):
                raise DialectError(f"{name} needs a column")
            out.append(Aggregate(name, None if column in ("", "*") else column, alias, bool(call.group(2))))
        elif expr == "*":
            star = True
        else:
            out.append(Item(expr, alias))
    if star:
        out = [x for x in out if isinstance(x, Aggregate)]
    return tuple(out)


def vector(token: str) -> tuple[float, ...]:
    try:
        out = tuple(float(x) for x in re.split(r"[\s,]+", token.strip().strip("[]").strip()) if x)
    except ValueError:
        raise DialectError(f"{token!r} is not a vector") from None
    if not out:
        raise DialectError("a vector needs at least one number")
    return out


def count(token: str, what: str) -> int:
    if not token.isdigit():
        raise DialectError(f"{what} needs a whole number")
    return int(token)


def _names(t: Tokens, what: str) -> tuple[str, ...]:
    out = tuple(c for token in t.until(*CLAUSES) for c in token.split(",") if c)
    if not out:
        raise DialectError(f"{what} needs at least one column")
    return out


def parse_select(query: str | Sequence[str]) -> QuerySpec:
    """``[SELECT] columns FROM table [alias] clauses``."""
    t = Tokens(tokenize(query) if isinstance(query, str) else query)
    t.skip("TSELECT") or t.skip("SELECT")
    items = select_items(t.until("FROM"))
    t.need("FROM")
    table = t.take("a table")
    alias = t.take() if t and t.peek() not in CLAUSES else None
    joins, where, group, having, order = [], [], (), [], []
    near = limit = None
    offset = 0
    while t:
        word = t.take().upper()
        if word in ("JOIN", "LEFT"):
            if word == "LEFT":
                t.need("JOIN")
            right = t.take("a table")
            name = t.take("an alias")
            if name.upper() == "ON":
                name, t.at = right, t.at - 1
            t.need("ON")
            a = t.take("a column")
            t.need("=")
            joins.append(Join(right, name, a, t.take("a column"), word == "LEFT"))
        elif word == "WHERE":
            where += conditions(t)
        elif word == "GROUP":
            t.need("BY")
            group = _names(t, "GROUP BY")
        elif word == "HAVING":
            while True:
                having.append(Test(t.take("a column"), operator(t.take("an operator")), t.take()))
                if not t.skip("AND"):
                    break
        elif word == "NEAR":
            name, at = t.take("a column"), t.take("a vector")
            t.need("K")
            k = count(t.take("K"), "K")
            bound = None
            if t.skip("THRESHOLD"):
                try:
                    bound = float(t.take("a threshold"))
                except ValueError:
                    raise DialectError("THRESHOLD needs a number") from None
            near = Near(name, vector(at), k, bound)
        elif word == "ORDER":
            t.need("BY")
            order = []
            for part in " ".join(t.until(*CLAUSES)).split(","):
                name, *way = part.split()
                if len(way) > 1 or way and way[0].upper() not in ("ASC", "DESC"):
                    raise DialectError(f"cannot order by {part!r}")
                order.append((name, not way or way[0].upper() == "ASC"))
        elif word == "LIMIT":
            limit = count(t.take("a number"), "LIMIT")
        elif word == "OFFSET":
            offset = count(t.take("a number"), "OFFSET")
        else:
            raise DialectError(f"unexpected {word!r}")
    return QuerySpec(table, alias, items, tuple(joins), tuple(where), group, tuple(having), near, tuple(order), limit, offset)


def from_params(table: str, params: dict[str, str]) -> QuerySpec:
    """A query from URL-style parameters: select, where, join, group, having, near, order, limit, offset.

    ``join`` is ``[left:]table:alias:left_column:right_column`` and ``near`` is ``column:vector:k[:threshold]``;
    both also take the dialect's own clauses.
    """
    text = [params.get("select") or "*", "FROM", table]
    for join in filter(None, (params.get("join") or "").split(";")):
        parts = join.split(":")
        if len(parts) < 4:
            text.append(join)
        else:
            outer = parts[0].lower() == "left"
            name, alias, a, b = parts[-4:]
            text.append(f"{'LEFT ' * outer}JOIN {name} {alias} ON {a} = {b}")
    if near := params.get("near"):
        head, _, rest = near.partition(":")
        if rest:
            vec, *more = re.match(r"(\[[^\]]*\]|[^:]*):(\d+)(?::(.+))?$", rest).groups()
            near = f"{head} '{vec}' K {more[0]}" + (f" THRESHOLD {more[1]}" if more[1] else "")
        text.append("NEAR " + near)
    for key, word in (("where", "WHERE"), ("group", "GROUP BY"), ("having", "HAVING"), ("order", "ORDER BY"), ("limit", "LIMIT"), ("offset", "OFFSET")):
        if value := params.get(key):
            text.append(f"{word} {value.replace(':', ' ') if key == 'order' else value}")
    return parse_select(" ".join(text))


def parse_policy(text: str, claims: dict[str, str] | None = None) -> tuple[AnyOf | Member, ...]:
    """A row policy: conditions that may use ``auth.uid()``, ``auth.<claim>`` and ``[NOT] IN (SELECT c FROM t [WHERE ..])``.

    Claims are filled in here; a missing claim equals nothing.
    """
    claims = claims or {}
    text = re.sub(r"auth\.uid\(\)", "auth.uid", text, flags=re.I)
    out: list[AnyOf | Member] = []
    for part in re.split(r"\s+AND\s+(?![^(]*\))", text.strip(), flags=re.I):
        m = re.match(r"(\S+)\s+(NOT\s+)?IN\s*\(\s*SELECT\s+(\S+)\s+FROM\s+(\S+?)(?:\s+WHERE\s+(.*?))?\s*\)\s*$", part, re.I | re.S)
        if m:
            inner = parse_policy(m.group(5), claims) if m.group(5) else ()
            out.append(Member(m.group(1), m.group(4), m.group(3), tuple(x for x in inner if isinstance(x, AnyOf)), bool(m.group(2))))
        else:
            out += [AnyOf(tuple(_claimed(x, claims) for x in group.tests)) for group in parse_where(part)]
    return tuple(out)


def _claimed(test: Test, claims: dict[str, str]) -> Test:
    if isinstance(test.value, str) and test.value.lower().startswith("auth."):
        value = claims.get(test.value[5:])
        return Test(test.field, test.op, value) if value is not None else Test(test.field, "IN", ("\0no such claim",))
    return test
