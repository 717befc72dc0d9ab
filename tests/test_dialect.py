import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.plans.dialect import from_params, parse_policy, parse_select, parse_where, tokenize
from tarn.plans.schema import parse_table
from tarn.plans.spec import Aggregate, AnyOf, DialectError, Item, Member, Test


def test_or_binds_tighter_than_and():
    spec = parse_select("* FROM t WHERE a = 1 OR b = 2 AND c = 3")
    assert spec.where == (AnyOf((Test("a", "=", "1"), Test("b", "=", "2"))), AnyOf((Test("c", "=", "3"),)))


def test_every_clause_in_any_order():
    spec = parse_select("a, COUNT(*) AS n, SUM(x) total FROM t u LEFT JOIN v w ON u.id = w.tid LIMIT 5 WHERE a IN ( 1 2 ) GROUP BY a HAVING n > 1 ORDER BY n DESC OFFSET 2")
    assert spec.items == (Item("a"), Aggregate("COUNT", None, "n"), Aggregate("SUM", "x", "total"))
    assert (spec.alias, spec.limit, spec.offset, spec.order_by, spec.group_by) == ("u", 5, 2, (("n", False),), ("a",))
    assert spec.joins[0].outer and spec.having == (Test("n", ">", "1"),)
    assert spec.where[0].tests[0] == Test("a", "IN", ("1", "2"))


def test_default_aggregate_name_is_the_lower_case_call():
    assert parse_select("COUNT(*), SUM(Val) FROM t").aggregates[1].name == "sum(val)"


def test_lists_take_commas_and_touching_brackets():
    for text in ("a IN (1,2)", "a IN ( 1, 2 )", "a IN (1 2)"):
        assert parse_where(text)[0].tests[0].value == ("1", "2"), text
    assert parse_where(["a", "IN", "(1", "2)"])[0].tests[0].value == ("1", "2")


@pytest.mark.parametrize("text", ["", "a", "a FROM", "* FROM t WHERE", "* FROM t WHERE a ~ 1", "* FROM t LIMIT x", "* FROM t GROUP BY", "* FROM t NEAR v [1] K 0", "* FROM t WHERE a IN ( )", "* FROM t WHERE a IN ( SELECT b )", "MEDIAN(a) FROM t", "* FROM t ORDER BY a SIDEWAYS", "* FROM t NONSENSE x y"])
def test_bad_queries_are_dialect_errors(text):
    with pytest.raises(DialectError):
        parse_select(text)


def test_quotes_and_operators():
    assert tokenize("a>='x y' AND b!=\"z\\\"\"") == ["a", ">=", "x y", "AND", "b", "!=", 'z"']


def test_near_and_params():
    spec = from_params("m", {"select": "id,body", "where": "channel = general", "near": "embedding:[1,0]:5:0.9", "order": "id:desc", "limit": "3"})
    assert spec.near.vector == (1.0, 0.0) and spec.near.k == 5 and spec.near.threshold == 0.9 and spec.order_by == (("id", False),)


def test_policies_fill_claims():
    got = parse_policy("owner = auth.uid() AND team NOT IN (SELECT team FROM members WHERE user = auth.uid())", {"uid": "7"})
    assert got[0] == AnyOf((Test("owner", "=", "7"),))
    assert isinstance(got[1], Member) and got[1].negated and got[1].where[0].tests[0].value == "7"
    missing = parse_policy("owner = auth.role")
    assert missing[0].tests[0].op == "IN"


def test_tables():
    t = parse_table("users id INT PRIMARY KEY, name STR NOT NULL, ref INT REFERENCES teams(id) ON DELETE SET NULL, v VECTOR(3), n INT SEQUENCE PARTITION BY name, at TIMESTAMP DEFAULT now() WITH TTL 60")
    assert t.ttl_seconds == 60 and t.key.name == "id" and t.column("ref").references.on_delete == "SET NULL" and t.column("v").dims == 3
    assert parse_table("x name STR").key.name == "id"
    for bad in ("t a DECIMAL", "t a INT PRIMARY KEY, b INT PRIMARY KEY", "t a STR SEARCHABLE", "t a STR ENCRYPTED DEFAULT x", "t a INT, a INT", "t a STR SEQUENCE PARTITION BY b"):
        with pytest.raises(DialectError):
            parse_table(bad)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["*", "a", "FROM", "t", "WHERE", "=", "IN", "(", ")", "1", "AND", "OR", "NOT", "IS", "NULL", "VALID", "GROUP", "BY", "COUNT(*)", "HAVING", "ORDER", "LIMIT", "NEAR", "K", "JOIN", "ON", "LEFT", ","]), max_size=14))
def test_any_tokens_parse_or_are_dialect_errors(tokens):
    try:
        parse_select(tokens)
    except DialectError:
        pass


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_parses_or_is_a_dialect_error(text):
    try:
        parse_select(text)
    except DialectError:
        pass
