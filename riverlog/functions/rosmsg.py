"""ROS message definitions: text to Spark types, and decoding of ros1 bytes.

A definition is the fields of a message, then, after lines of ``=``, those of the types it uses (``MSG: package/Name``). Constants
are dropped. Names without a package are looked up in the message's own package, then anywhere; ``Header`` is that of std_msgs.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import RiverlogError

#: ros1 primitives: struct format and Spark type. Unsigned types get the next wider one; uint64 wraps beyond 2**63.
PRIMITIVES: dict[str, tuple[str, T.DataType]] = {
    "bool": ("?", T.BooleanType()), "int8": ("b", T.ByteType()), "uint8": ("B", T.ShortType()), "int16": ("h", T.ShortType()), "uint16": ("H", T.IntegerType()),
    "int32": ("i", T.IntegerType()), "uint32": ("I", T.LongType()), "int64": ("q", T.LongType()), "uint64": ("Q", T.LongType()), "float32": ("f", T.FloatType()),
    "float64": ("d", T.DoubleType()), "char": ("B", T.ShortType()), "byte": ("B", T.ShortType()), "time": ("II", T.LongType()), "duration": ("II", T.LongType()),
    "string": ("", T.StringType()), "wstring": ("", T.StringType()),
}


class DefinitionError(RiverlogError):
    """A definition that can't be parsed or resolved."""


@dataclass(frozen=True)
class MsgField:
    """``size``: of a fixed array, 0 for a variable one, None for no array. ``record``: the fields of a nested message."""

    name: str
    base: str
    size: int | None = None
    record: tuple[MsgField, ...] | None = None
    bound: int | None = None
    default: str | None = None


@dataclass
class _Section:
    name: str
    lines: list[str] = field(default_factory=list)


_LINE = re.compile(r"(?P<type>[\w/]+)(?P<limit><=\d+)?(?P<array>\[(?:<=)?\d*\])?\s+(?P<name>[A-Za-z]\w*)\s*(?P<rest>.*)")


def _sections(text: str) -> list[_Section]:
    out = [_Section("")]
    for raw in text.splitlines():
        line = raw.strip()
        if re.fullmatch(r"={3,}", line):
            out.append(_Section("?"))
        elif out[-1].name == "?" and (m := re.fullmatch(r"MSG:\s*(\S+)", line)):
            out[-1].name = m[1]
        elif line and not line.startswith("#"):
            out[-1].lines.append(line)
    return out


def parse(definition: str, package: str = "", ros2: bool = False) -> tuple[MsgField, ...]:
    """The fields of a message definition, nested ones resolved. ros2: bounds and default values are allowed."""
    sections = _sections(definition)
    known = {s.name: s.lines for s in sections[1:]}

    def find(base: str, own: str) -> str:
        if base == "Header" and "std_msgs/Header" in known:
            return "std_msgs/Header"
        tries = [base, base.replace("/msg/", "/"), f"{own}/{base}", f"{own}/msg/{base}"]
        tries += [k for k in known if k.split("/")[-1] == base.split("/")[-1]] if "/" not in base else [k for k in known if k.replace("/msg/", "/") == base.replace("/msg/", "/")]
        for t in tries:
            if t in known:
                return t
        raise DefinitionError(f"type {base} is not defined")

    def fields(lines: list[str], own: str, above: tuple[str, ...]) -> tuple[MsgField, ...]:
        out = []
        for line in lines:
            m = _LINE.fullmatch(line)
            if not m:
                raise DefinitionError(f"can't read {line!r}")
            rest = m["rest"]
            if m["type"].endswith("string") and rest.startswith("=") or re.match(r"=", rest):
                continue  # a constant
            rest = re.sub(r"\s*#.*", "", rest).strip()
            if rest and not ros2:
                raise DefinitionError(f"can't read {line!r}")
            array = m["array"]
            bounded = array is not None and "<=" in array
            if (bounded or m["limit"]) and not ros2:
                raise DefinitionError(f"bounds are for ROS 2: {line!r}")
            size = None if array is None else 0 if bounded else int(array[1:-1] or 0)
            bound = int(array[3:-1]) if bounded else int(m["limit"][2:]) if m["limit"] else None
            record = None
            if m["type"] not in PRIMITIVES:
                name = find(m["type"], own)
                if name in above:
                    raise DefinitionError(f"{name} contains itself")
                record = fields(known[name], name.split("/")[0], (*above, name))
            out.append(MsgField(m["name"], m["type"], size, record, bound, rest or None))
        return tuple(out)

    return fields(sections[0].lines, package, ())


def spark_type(fields: tuple[MsgField, ...]) -> T.StructType:
    """The payload type; fixed array sizes are in the metadata, where ``schema.flatten`` finds them."""
    out = T.StructType()
    for f in fields:
        kind: T.DataType = spark_type(f.record) if f.record is not None else PRIMITIVES[f.base][1]
        if f.size is not None:
            kind = T.BinaryType() if f.base in ("uint8", "byte", "char") and f.record is None else T.ArrayType(kind)
        out.add(f.name, kind, True, {"fixed_size": f.size} if f.size else None)
    return out


class Decoder:
    """Decodes ros1 bytes into tuples of ``fields``. wanted: dotted names of fields to read, at any depth; a record's name stands for all of
    it, and names inside arrays of records for each of their elements. The bytes of other fields are passed over, and they are null."""

    def __init__(self, fields: tuple[MsgField, ...], wanted: set[str] | None = None):
        self.count, self.steps = len(fields), _steps(fields, wanted)

    def __call__(self, data: bytes) -> tuple:
        return _walk(self.steps, self.count, data, 0)[0]


def _steps(fields: tuple[MsgField, ...], wanted: set[str] | None) -> list[tuple]:
    """(place, reader, passer) up to the last field that is read; one of the two is None."""
    heads = {w.split(".")[0] for w in wanted or ()}
    if unknown := heads - {f.name for f in fields}:
        raise DefinitionError(f"no such field: {', '.join(sorted(unknown))}")
    out = []
    for k, f in enumerate(fields):
        below = {w[len(f.name) + 1 :] for w in wanted or () if w.startswith(f.name + ".")}
        if wanted is None or f.name in wanted:
            out.append((k, lambda data, at, f=f: _read(f, data, at), None))
        elif not below:
            out.append((k, None, _passer(f)))
        elif f.record is None:
            raise DefinitionError(f"{f.name} has no fields")
        else:
            out.append((k, _part(f, _steps(f.record, below)), None))
    while out and out[-1][1] is None:
        out.pop()
    return out


def _walk(steps: list[tuple], count: int, data: bytes, at: int) -> tuple[tuple, int]:
    out = [None] * count
    for k, read, pass_over in steps:
        if read is None:
            at = pass_over(data, at)
        else:
            out[k], at = read(data, at)
    return tuple(out), at


def _part(f: MsgField, steps: list[tuple]):
    """A reader of some fields of a record, or of each record of an array."""
    rest = [_passer(g) for g in f.record[steps[-1][0] + 1 :]]

    def one(data: bytes, at: int):
        value, at = _walk(steps, len(f.record), data, at)
        for pass_over in rest:
            at = pass_over(data, at)
        return value, at

    def many(data: bytes, at: int):
        n, at = _length(f, data, at)
        out = []
        for _ in range(n):
            value, at = one(data, at)
            out.append(value)
        return out, at

    return one if f.size is None else many


def _length(f: MsgField, data: bytes, at: int) -> tuple[int, int]:
    """The elements of an array, and where they start."""
    return (f.size, at) if f.size else (struct.unpack_from("<I", data, at)[0], at + 4)


def _element_width(f: MsgField) -> int | None:
    """The bytes of a value, of one element in arrays; None where values differ."""
    if f.record is not None:
        widths = [_width(g) for g in f.record]
        return None if None in widths else sum(widths)
    code = PRIMITIVES[f.base][0]
    return struct.calcsize(f"<{code}") if code else None


def _width(f: MsgField) -> int | None:
    one = _element_width(f)
    return None if one is None or f.size == 0 else one * (f.size or 1)


def _passer(f: MsgField):
    """From the start of a field's bytes to their end. Values of a fixed width take no look at the bytes."""
    one, whole = _element_width(f), _width(f)
    if whole is not None:
        return lambda data, at: at + whole
    inner = [_passer(g) for g in f.record or ()]

    def element(data: bytes, at: int) -> int:
        if f.record is None:
            return at + 4 + struct.unpack_from("<I", data, at)[0]
        for pass_over in inner:
            at = pass_over(data, at)
        return at

    def array(data: bytes, at: int) -> int:
        n, at = _length(f, data, at)
        if one is not None:
            return at + n * one
        for _ in range(n):
            at = element(data, at)
        return at

    return element if f.size is None else array


def _read(f: MsgField, data: bytes, at: int):
    if f.size is None:
        return _one(f, data, at)
    n, at = _length(f, data, at)
    if f.record is None and f.base in ("uint8", "byte", "char"):
        if at + n > len(data):
            raise RiverlogError("the message is too short")
        return data[at : at + n], at + n
    code = PRIMITIVES[f.base][0] if f.record is None else ""
    if len(code) == 1:
        values = struct.unpack_from(f"<{n}{code}", data, at)
        return [_signed(f.base, v) for v in values], at + n * struct.calcsize(f"<{code}")
    out = []
    for _ in range(n):
        value, at = _one(f, data, at)
        out.append(value)
    return out, at


def _signed(base: str, value):
    return value - (1 << 64) if base == "uint64" and value >= 1 << 63 else value


def _one(f: MsgField, data: bytes, at: int):
    if f.record is not None:
        out = []
        for g in f.record:
            value, at = _read(g, data, at)
            out.append(value)
        return tuple(out), at
    if f.base in ("string", "wstring"):
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n > len(data):
            raise RiverlogError("the message is too short")
        return data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n
    code = PRIMITIVES[f.base][0]
    values = struct.unpack_from(f"<{code}", data, at)
    at += struct.calcsize(f"<{code}")
    return (values[0] * 10**9 + values[1] if code == "II" else _signed(f.base, values[0])), at


def encode(fields: tuple[MsgField, ...], values: tuple) -> bytes:
    """The ros1 bytes of a message: the inverse of ``Decoder``."""

    def one(f: MsgField, v) -> bytes:
        if f.record is not None:
            return encode(f.record, v)
        if f.base in ("string", "wstring"):
            raw = v.encode()
            return struct.pack("<I", len(raw)) + raw
        code = PRIMITIVES[f.base][0]
        return struct.pack("<II", *divmod(v, 10**9)) if code == "II" else struct.pack(f"<{code}", v % (1 << 64) if f.base == "uint64" else v)

    out = []
    for f, v in zip(fields, values, strict=True):
        if f.size is None:
            out.append(one(f, v))
        else:
            out.append(b"" if f.size else struct.pack("<I", len(v)))
            out.append(bytes(v) if isinstance(v, (bytes, bytearray)) else b"".join(one(f, x) for x in v))
    return b"".join(out)
