"""Flattened names of payload fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Fixed arrays shorter than this have a name for each element.
LONGEST_ARRAY = 10


@dataclass(frozen=True)
class Field:
    name: str
    kind: T.DataType


def flatten(schema: T.StructType, sizes: dict[str, int] | None = None, prefix: str = "") -> list[Field]:
    """Leaf fields by dotted name, in the order of the schema. Elements of a fixed array of under ``LONGEST_ARRAY`` elements are
    ``name[i]``; other arrays have none. A fixed size comes from ``sizes`` (by dotted name) or the field's metadata."""
    out: list[Field] = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += _leaves(name, f.dataType, (sizes or {}).get(name, (f.metadata or {}).get("fixed_size", 0)), sizes)
    return out


def _leaves(name: str, kind: T.DataType, size: int, sizes) -> list[Field]:
    if isinstance(kind, T.StructType):
        return flatten(kind, sizes, f"{name}.")
    if isinstance(kind, T.ArrayType):
        return [x for k in range(size) for x in _leaves(f"{name}[{k}]", kind.elementType, 0, sizes)] if 0 < size < LONGEST_ARRAY else []
    return [Field(name, kind)]
