"""The grammar, and the split of predicates over aliases."""

import pytest

from riverlog.errors import PlanError, QuerySyntaxError
from riverlog.plans import ql
from riverlog.plans.plan import AsOf, Merge, Scan, compile_query, describe
from riverlog.plans.ql import BoolExpr, Comparison, Join, Query, Select, Truncate


def plan(text):
    return compile_query(ql.parse(text))


def test_selects_nest_to_the_right():
    assert ql.parse("from dev a;") == Query(("dev",), Select("a"))
    assert ql.parse("from * /a as x, /b;").select == Select("/a", "x", Join("merge", Select("/b")))
    got = ql.parse("from d a precedes b as y precedes immediate c by less than 5 milliseconds;").select
    assert got == Select("a", None, Join("precedes", Select("b", "y", Join("precedes", Select("c"), True, 5_000_000))))
    got = ql.parse("from d a succeeds b, c by less than 2 minutes;").select
    assert got.join == Join("succeeds", Select("b", None, Join("merge", Select("c"))), False, 120 * 10**9)


@pytest.mark.parametrize("unit, ns", [("nanoseconds", 1), ("microseconds", 1000), ("milliseconds", 10**6), ("seconds", 10**9), ("minutes", 60 * 10**9)])
def test_units(unit, ns):
    assert ql.parse(f"from d a precedes b by less than 3 {unit};").select.join.within == 3 * ns


def test_producers_times_and_paging():
    q = ql.parse("explain from d1, d-2, 7 between 10 and '1970-01-01T00:00:01.000000002' a desc limit 10 offset 5 limit 3;")
    assert (q.explain, q.producers, q.between, q.desc, q.limit, q.offset) == (True, ("d1", "d-2", "7"), (10, 10**9 + 2), True, 3, 5)
    assert ql.parse("from d between '2024-01-05' and '2024-01-05T02:00:00+01:00' a;").between == (1_704_412_800 * 10**9, (1_704_412_800 + 3600) * 10**9)
    assert ql.parse("from * a offset 2 limit 1;") == Query(None, Select("a"), limit=1, offset=2)


def test_expressions():
    q = ql.parse(r"from d a where a.x = -1.5 and a.y ~* 'it\'s \\S' or (a.z != true or a.w <= 7);")
    first, second = q.where.items
    assert q.where.kind == "or"
    assert first == BoolExpr("and", (Comparison("a.x", "=", -1.5), Comparison("a.y", "~*", "it's \\S")))
    assert second == BoolExpr("group", (BoolExpr("or", (Comparison("a.z", "!=", True), Comparison("a.w", "<=", 7))),))
    assert ql.parse("from d a where a.x = 1 where a.y = 2;").where.kind == "and"
    assert ql.parse("from d a where a.cov[3].x > 1e0.5;" if False else "from d a where a.cov[3].x > .5;").where == Comparison("a.cov[3].x", ">", 0.5)


def test_truncate():
    assert ql.parse("truncate dev /a now;") == Truncate("dev", "/a", None)
    assert ql.parse("truncate dev /a 123;") == Truncate("dev", "/a", 123)
    assert ql.parse("truncate dev /a '1970-01-02';") == Truncate("dev", "/a", 86_400 * 10**9)


@pytest.mark.parametrize(
    "text",
    ["from d a", "", ";", "from a;", "from d a where;", "from d a where a.x;", "from d a where a.x = -1;", 'from d a where a.x = "s";', "from d a limit -1;", "from d a precedes;", "from d a precedes b by less than 3 hours;", "from d a, ;", "from d a; from d b;", "truncate d;", "from d between 'x' and 'y' a;", "from d a where (a.x = 1;", "from d a where a.x = 1 where;", "select 1;"],
)
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        ql.parse(text)


def test_missing_semicolon_says_so():
    with pytest.raises(QuerySyntaxError, match="queries must be terminated with a semicolon"):
        ql.parse("from d a")


def test_plans():
    assert plan("from d a, b, c;").root == Merge((Scan("a", "a"), Scan("b", "b"), Scan("c", "c")))
    assert plan("from d a precedes b;").root == AsOf(Scan("a", "a"), Scan("b", "b"), False, 0)
    assert plan("from d a succeeds immediate b by less than 1 seconds;").root == AsOf(Scan("b", "b"), Scan("a", "a"), True, 10**9)
    got = plan("from d a precedes b, c by less than 1 seconds;").root
    assert isinstance(got.right, Merge) and got.within == 0 or got.within == 10**9
    text = describe(plan("from d a as x, b where x.u = 1 or b.v = 2 limit 3;"))
    assert text.splitlines() == ["limit 3", "merge", "  scan a as x where x.u = 1", "  scan b as b where b.v = 2"]


def test_where_goes_to_each_alias():
    root = plan("from d a, b where a.x = 1 or b.y = 2 or a.z = 3;").root
    a, b = root.items
    assert a.predicate == BoolExpr("or", (Comparison("a.x", "=", 1), Comparison("a.z", "=", 3))) and b.predicate == Comparison("b.y", "=", 2)
    twice = plan("from d a, a where a.x = 1;").root
    assert twice.items[0].predicate == twice.items[1].predicate == Comparison("a.x", "=", 1)


@pytest.mark.parametrize(
    "text, error",
    [
        ("from d a, b where a.x = 1 and b.x = 2;", "more than one alias"),
        ("from d a, b where (a.x = 1 or b.x = 2);", "more than one alias"),
        ("from d a where foo = 10;", "field foo must be qualified with a dot"),
        ("from d a where b.foo = 10;", "unresolved table alias: b"),
        ("from d a as x, b as x;", "conflicting alias"),
        ("from d a neighbors b by less than 1 seconds;", "not implemented"),
    ],
)
def test_plan_errors(text, error):
    with pytest.raises(PlanError, match=error):
        plan(text)


def test_longest_alias_wins_in_topics_with_dots():
    root = plan("from d a.b, a where a.b.c = 1 or a.x = 2;").root
    assert [s.predicate for s in root.items] == [Comparison("a.b.c", "=", 1), Comparison("a.x", "=", 2)]
