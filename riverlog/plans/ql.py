"""The query language: text to syntax tree, by recursive descent.

    statement := ("truncate" producer topic ("now" | time) | query) ";"
    query     := ["explain"] "from" ("*" | producer {"," producer}) ["between" time "and" time]
                 select {"where" or} ["desc"] {("limit" | "offset") integer}
    select    := topic ["as" alias] ["," select | ("precedes" | "succeeds" | "neighbors") ["immediate"] select
                 ["by" "less" "than" integer unit]]
    or        := and {"or" and};  and := term {"and" term};  term := "(" or ")" | field operator literal

Selects nest to the right, and a constraint belongs to the innermost join before it. Words may contain ``/ . -`` and may
end in array positions like ``[3]``. Strings have single quotes. Integers carry no sign, floats may. Several ``where`` clauses all hold. A producer may also be
an integer, as ids often are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from ..errors import QuerySyntaxError

UNITS = {"nanoseconds": 1, "microseconds": 1_000, "milliseconds": 1_000_000, "seconds": 10**9, "minutes": 60 * 10**9}
JOINS = ("precedes", "succeeds", "neighbors")
_TOKEN = re.compile(
    r"""\s*(?:(?P<float>[-+]?\d*\.\d+(?:[eE][-+]?\d+)?)|(?P<integer>\d+)|(?P<word>[a-zA-Z_/.][\w/.-]*(?:\[\d+\][\w/.-]*)*)
    |(?P<string>'(?:\\.|[^'\\])*')|(?P<op>!=|<=|>=|~\*|[=<>~])|(?P<mark>[,();*]))""",
    re.VERBOSE | re.ASCII,
)


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: str | int | float | bool


@dataclass(frozen=True)
class BoolExpr:
    """``kind`` is "and" or "or"."""

    kind: str
    items: tuple


@dataclass(frozen=True)
class Select:
    topic: str
    alias: str | None = None
    join: Join | None = None


@dataclass(frozen=True)
class Join:
    """``kind``: "merge" or one of ``JOINS``; ``within``: nanoseconds, 0 for no bound."""

    kind: str
    right: Select
    immediate: bool = False
    within: int = 0


@dataclass(frozen=True)
class Query:
    producers: tuple[str, ...] | None  # None: all
    select: Select
    between: tuple[int, int] | None = None
    where: BoolExpr | Comparison | None = None
    desc: bool = False
    limit: int | None = None
    offset: int | None = None
    explain: bool = False


@dataclass(frozen=True)
class Truncate:
    producer: str
    topic: str
    time: int | None  # None: now


@dataclass
class _Tokens:
    text: str
    items: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self):
        pos, text = 0, self.text.rstrip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise QuerySyntaxError(f"unexpected character {text[pos:].lstrip()[:1]!r} at {pos}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, kind: str, *values: str) -> str:
        got, value = self.peek()
        if got != kind or values and value not in values:
            raise QuerySyntaxError(f"expected {' or '.join(values) or kind}, found {value or 'the end'!r}")
        self.at += 1
        return value

    def skip(self, kind: str, *values: str) -> str | None:
        got, value = self.peek()
        if got == kind and value in values:
            self.at += 1
            return value
        return None


def nanoseconds(text: str) -> int:
    """An ISO-8601 date or time as nanoseconds since 1970, UTC where it has no zone."""
    m = re.fullmatch(r"(.*?:\d\d)[.,](\d{1,9})(.*)", text)
    try:
        when = datetime.fromisoformat(m[1] + m[3] if m else text)
    except ValueError as e:
        raise QuerySyntaxError(f"failed to parse timestamp: {text!r}") from e
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    whole = (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // (when.resolution)
    return whole * 1000 + (int(m[2].ljust(9, "0")) if m else 0)


def _time(t: _Tokens) -> int:
    if t.peek()[0] == "integer":
        return int(t.take("integer"))
    return nanoseconds(_unquoted(t.take("string")))


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1] if m[1] in "\\'\"" else m[0]), text[1:-1], flags=re.DOTALL)


def _literal(t: _Tokens):
    kind, value = t.peek()
    if kind == "string":
        t.at += 1
        return _unquoted(value)
    if kind == "integer":
        t.at += 1
        return int(value)
    if kind == "float":
        t.at += 1
        return float(value)
    return t.take("word", "true", "false") == "true"


def _term(t: _Tokens):
    if t.skip("mark", "("):
        inner = _or(t)
        t.take("mark", ")")
        return BoolExpr("group", (inner,))
    name = t.take("word")
    return Comparison(name, t.take("op"), _literal(t))


def _list(t: _Tokens, kind: str, one):
    items = [one(t)]
    while t.skip("word", kind):
        items.append(one(t))
    return BoolExpr(kind, tuple(items)) if len(items) > 1 else items[0]


def _or(t: _Tokens):
    return _list(t, "or", lambda t: _list(t, "and", _term))


def _select(t: _Tokens) -> Select:
    topic = t.take("word")
    alias = t.take("word") if t.skip("word", "as") else None
    if t.skip("mark", ","):
        return Select(topic, alias, Join("merge", _select(t)))
    if kind := t.skip("word", *JOINS):
        immediate = bool(t.skip("word", "immediate"))
        right, within = _select(t), 0
        if t.skip("word", "by"):
            t.take("word", "less")
            t.take("word", "than")
            within = int(t.take("integer"))
            within *= UNITS[t.take("word", *UNITS)]
        return Select(topic, alias, Join(kind, right, immediate, within))
    return Select(topic, alias)


def parse(text: str) -> Query | Truncate:
    """The statement in ``text``."""
    if not text.rstrip().endswith(";"):
        raise QuerySyntaxError("queries must be terminated with a semicolon")
    t = _Tokens(text)
    if t.skip("word", "truncate"):
        out: Query | Truncate = Truncate(_producer(t), t.take("word"), None if t.skip("word", "now") else _time(t))
    else:
        out = _query(t)
    t.take("mark", ";")
    if t.peek()[0] != "end":
        raise QuerySyntaxError(f"unexpected {t.peek()[1]!r} after the statement")
    return out


def _producer(t: _Tokens) -> str:
    return t.take("integer" if t.peek()[0] == "integer" else "word")


def _query(t: _Tokens) -> Query:
    explain = bool(t.skip("word", "explain"))
    t.take("word", "from")
    producers = None
    if not t.skip("mark", "*"):
        names = [_producer(t)]
        while t.skip("mark", ","):
            names.append(_producer(t))
        producers = tuple(names)
    between = None
    if t.skip("word", "between"):
        start = _time(t)
        t.take("word", "and")
        between = (start, _time(t))
    select, where = _select(t), []
    while t.skip("word", "where"):
        where.append(_or(t))
    desc, paging = bool(t.skip("word", "desc")), {}
    while word := t.skip("word", "limit", "offset"):
        paging[word] = int(t.take("integer"))
    condition = None if not where else where[0] if len(where) == 1 else BoolExpr("and", tuple(BoolExpr("group", (w,)) for w in where))
    return Query(producers, select, between, condition, desc, paging.get("limit"), paging.get("offset"), explain)
