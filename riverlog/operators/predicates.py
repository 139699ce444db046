"""Predicates of the query language as typed columns: what a field's type doesn't allow is an error before anything runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldNotFoundError, FieldTypeError
from ..plans.ql import BoolExpr, Comparison

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_FLOATS = (T.FloatType, T.DoubleType)
_ORDER = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def resolve(schema: T.StructType, name: str, root: Column, shown: str | None = None) -> tuple[Column, T.DataType]:
    """The column and type of a dotted field with array positions, ``a.b[2].c``, below ``root``."""
    kind: T.DataType = schema
    col = root
    for part in name.split("."):
        m = re.fullmatch(r"([^\[\]]+)((?:\[\d+\])*)", part)
        if not m or not isinstance(kind, T.StructType) or m[1] not in kind.names:
            raise FieldNotFoundError(f"field {shown or name} not found")
        col, kind = col.getField(m[1]), kind[m[1]].dataType
        for k in re.findall(r"\d+", m[2]):
            if not isinstance(kind, T.ArrayType):
                raise FieldNotFoundError(f"field {shown or name} not found")
            col, kind = F.get(col, F.lit(int(k))), kind.elementType
    return col, kind


def compare(col: Column, kind: T.DataType, op: str, value, shown: str) -> Column:
    """One comparison. On floats, NaN is neither equal to nor greater than anything, as IEEE has it."""
    wrong = FieldTypeError(f"operator {op} with {value!r} does not apply to field {shown} of type {kind.simpleString()}")
    if isinstance(kind, T.BooleanType):
        if op not in ("=", "!=") or not isinstance(value, bool):
            raise wrong
        return col == F.lit(value) if op == "=" else col != F.lit(value)
    if isinstance(value, bool):
        raise wrong
    if isinstance(kind, T.StringType):
        if not isinstance(value, str):
            raise wrong
        if op in ("~", "~*"):
            return col.rlike(value if op == "~" else f"(?i){value}")
        return getattr(col, _ORDER[op])(F.lit(value))
    if op not in _ORDER or isinstance(value, str):
        raise wrong
    if isinstance(kind, _INTEGERS):
        if not isinstance(value, int):
            raise wrong
        return getattr(col, _ORDER[op])(F.lit(value))
    if isinstance(kind, _FLOATS):
        out = getattr(col, _ORDER[op])(F.lit(float(value)))
        return out & ~F.isnan(col) if op in ("=", ">", ">=") else out
    raise wrong


def column(expr, schema: T.StructType, alias: str, root: Column) -> Column:
    """The predicate of one alias over a payload struct ``root`` of type ``schema``."""
    if isinstance(expr, Comparison):
        col, kind = resolve(schema, expr.field[len(alias) + 1 :], root, expr.field)
        return compare(col, kind, expr.op, expr.value, expr.field)
    assert isinstance(expr, BoolExpr)
    parts = [column(x, schema, alias, root) for x in expr.items]
    out = parts[0]
    for p in parts[1:]:
        out = out | p if expr.kind == "or" else out & p
    return out


def filtered(frame: DataFrame, expr, alias: str, payload: str = "data") -> DataFrame:
    """``frame`` where the predicate holds on its payload struct."""
    return frame.where(column(expr, frame.schema[payload].dataType, alias, F.col(payload)))
