"""Syntax tree to logical plan: aliases, and the split of ``where`` into one predicate for each alias."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import PlanError
from .ql import BoolExpr, Comparison, Query, Select


@dataclass(frozen=True)
class Scan:
    topic: str
    alias: str
    predicate: BoolExpr | Comparison | None = None


@dataclass(frozen=True)
class Merge:
    items: tuple


@dataclass(frozen=True)
class AsOf:
    """Each right row follows the last left row; ``left`` comes first in time for "precedes", and was the right one for "succeeds"."""

    left: object
    right: object
    immediate: bool
    within: int


@dataclass(frozen=True)
class Plan:
    root: object
    query: Query

    def scans(self) -> list[Scan]:
        return list(_scans(self.root))


def _scans(node):
    if isinstance(node, Scan):
        yield node
    else:
        for child in node.items if isinstance(node, Merge) else (node.left, node.right):
            yield from _scans(child)


def _selects(s: Select):
    yield s
    if s.join:
        yield from _selects(s.join.right)


def owner(name: str, aliases: list[str]) -> tuple[str, str]:
    """(alias, field) of a qualified name; the longest alias that fits counts, as topics may have dots."""
    fits = [a for a in aliases if name.startswith(f"{a}.")]
    if fits:
        alias = max(fits, key=len)
        return alias, name[len(alias) + 1 :]
    if "." not in name:
        raise PlanError(f"field {name} must be qualified with a dot")
    raise PlanError(f"unresolved table alias: {name.split('.')[0]}")


def _comparisons(e):
    if isinstance(e, Comparison):
        yield e
    else:
        for x in e.items:
            yield from _comparisons(x)


def _one_alias(e, aliases: list[str]) -> str:
    found: list[str] = []
    unknown = None
    for c in _comparisons(e):
        if "." not in c.field:
            raise PlanError(f"field {c.field} must be qualified with a dot")
        try:
            alias = owner(c.field, aliases)[0]
        except PlanError as err:
            alias, unknown = c.field.split(".")[0], err
        if alias not in found:
            found.append(alias)
    if len(found) > 1:
        raise PlanError(f"expression subtree references more than one alias: {', '.join(found)}")
    if unknown:
        raise unknown
    return found[0]


def split_where(where, aliases: list[str]) -> dict[str, object]:
    """One predicate for each alias. The branches of a top-level ``or`` each belong to one alias and restrict that alias alone;
    branches of the same alias are joined by ``or``. Anything else that spans aliases is an error."""
    out: dict[str, object] = {}
    for branch in where.items if isinstance(where, BoolExpr) and where.kind == "or" else (where,):
        alias = _one_alias(branch, aliases)
        out[alias] = BoolExpr("or", (out[alias], branch)) if alias in out else branch
    return out


def compile_query(query: Query) -> Plan:
    """The logical plan; raises PlanError as described in ``split_where``."""
    topics: dict[str, str] = {}
    for s in _selects(query.select):
        name = s.alias or s.topic
        if topics.setdefault(name, s.topic) != s.topic:
            raise PlanError(f"conflicting alias: {name} stands for {topics[name]} and {s.topic}")
    where = split_where(query.where, list(topics)) if query.where is not None else {}

    def build(s: Select):
        scan = Scan(s.topic, s.alias or s.topic, where.get(s.alias or s.topic))
        if not s.join:
            return scan
        right = build(s.join.right)
        if s.join.kind == "merge":
            return Merge((scan, *(right.items if isinstance(right, Merge) else (right,))))
        if s.join.kind == "succeeds":
            return AsOf(right, scan, s.join.immediate, s.join.within)
        if s.join.kind == "precedes":
            return AsOf(scan, right, s.join.immediate, s.join.within)
        raise PlanError(f"{s.join.kind} is not implemented in the query language; see operators.asof.neighbor_pairs")

    return Plan(build(query.select), query)


def describe(plan: Plan) -> str:
    """One line for each node of the plan."""
    lines: list[str] = []

    def show(node, depth):
        if isinstance(node, Scan):
            lines.append(f"{'  ' * depth}scan {node.topic} as {node.alias}" + (f" where {text(node.predicate)}" if node.predicate else ""))
        elif isinstance(node, Merge):
            lines.append(f"{'  ' * depth}merge")
            for x in node.items:
                show(x, depth + 1)
        else:
            lines.append(f"{'  ' * depth}as-of{' immediate' * node.immediate}" + f" within {node.within} ns" * bool(node.within))
            show(node.left, depth + 1)
            show(node.right, depth + 1)

    q = plan.query
    if q.limit is not None:
        lines.append(f"limit {q.limit}")
    if q.offset is not None:
        lines.append(f"offset {q.offset}")
    show(plan.root, 0)
    return "\n".join(lines)


def text(e) -> str:
    if isinstance(e, Comparison):
        return f"{e.field} {e.op} {e.value!r}"
    if e.kind == "group":
        return f"({text(e.items[0])})"
    return f" {e.kind} ".join(text(x) for x in e.items)
