"""Logical types, written as Python annotations, and the Spark types that hold them."""

from __future__ import annotations

import dataclasses
import datetime
import re
import types
import typing
import uuid
from typing import Annotated, Any, Literal, NamedTuple

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclasses.dataclass(frozen=True)
class VectorInfo:
    dim: int | None = None


@dataclasses.dataclass(frozen=True)
class TypeKind:
    kind: str


@dataclasses.dataclass(frozen=True)
class TypeAttr:
    key: str
    value: Any


Float32 = Annotated[float, TypeKind("Float32")]
Float64 = Annotated[float, TypeKind("Float64")]
Json = Annotated[Any, TypeKind("Json")]
LocalDateTime = Annotated[datetime.datetime, TypeKind("LocalDateTime")]
OffsetDateTime = Annotated[datetime.datetime, TypeKind("OffsetDateTime")]
Range = Annotated[tuple[int, int], TypeKind("Range")]


class Vector:
    """Vector[T, dim] or Vector[T]."""

    def __class_getitem__(cls, item):
        inner, dim = item if isinstance(item, tuple) else (item, None)
        if typing.get_origin(dim) is Literal:
            dim = typing.get_args(dim)[0]
        return Annotated[list[inner], VectorInfo(dim)]


class Field(NamedTuple):
    """A Spark type with what Spark doesn't hold: the logical kind, the key of a keyed table, attributes."""

    data_type: T.DataType
    nullable: bool = False
    metadata: dict = {}

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.data_type, self.nullable, self.metadata)


BASIC = {
    bytes: T.BinaryType(), str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(),
    datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), datetime.timedelta: T.DayTimeIntervalType(),
}
RANGE = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
KINDS = {
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Json": T.StringType(), "LocalDateTime": T.TimestampNTZType(),
    "OffsetDateTime": T.TimestampType(), "Range": RANGE, "Int64": T.LongType(), "Str": T.StringType(), "Bytes": T.BinaryType(), "Bool": T.BooleanType(),
}
#: Logical kinds that can be part of a key.
KEYS = (T.BinaryType, T.StringType, T.BooleanType, T.LongType, T.DateType)


def members(kind: Any) -> list[tuple[str, Any]] | None:
    """Fields of a dataclass, a NamedTuple or a Pydantic model; None for anything else."""
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind, include_extras=True)
        return [(f.name, hints[f.name]) for f in dataclasses.fields(kind)]
    if isinstance(kind, type) and issubclass(kind, tuple) and hasattr(kind, "_fields"):
        hints = typing.get_type_hints(kind, include_extras=True)
        return [(n, hints[n]) for n in kind._fields]
    if isinstance(kind, type) and hasattr(kind, "model_fields"):
        return [(n, f.annotation) for n, f in kind.model_fields.items()]
    return None


def resolve(annotation: Any) -> Field:
    """The Spark type of an annotation.

    list[Struct] is an ordered table, dict[Key, Struct] a keyed one, both arrays of structs; a union of other types
    holds one nullable member per alternative, the first that fits winning."""
    notes: tuple = ()
    if typing.get_origin(annotation) is Annotated:
        annotation, *rest = typing.get_args(annotation)
        notes = tuple(rest)
    attributes = {a.key: a.value for a in notes if isinstance(a, TypeAttr)}
    for note in notes:
        if isinstance(note, TypeKind):
            if note.kind not in KINDS:
                raise ValueError(f"unknown kind {note.kind}")
            return Field(KINDS[note.kind], False, {"logical": note.kind, **attributes})
    vector = next((n for n in notes if isinstance(n, VectorInfo)), None)
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        some = [a for a in args if a is not type(None)]
        if len(some) == 1:
            inner = resolve(some[0])
            return inner._replace(nullable=len(some) < len(args), metadata={**inner.metadata, **attributes})
        fields = [resolve(a)._replace(nullable=True).field(f"v{i}") for i, a in enumerate(some)]
        return Field(T.StructType(fields), len(some) < len(args), {"logical": "Union", **attributes})
    if annotation is uuid.UUID:
        return Field(T.StringType(), False, {"logical": "Uuid", **attributes})
    if annotation is datetime.time:
        return Field(T.TimeType() if hasattr(T, "TimeType") else T.LongType(), False, {"logical": "Time", **attributes})
    if annotation in BASIC:
        return Field(BASIC[annotation], False, attributes)
    if annotation is Any or annotation is dict:
        return Field(T.StringType(), False, {"logical": "Json", **attributes})
    if (fields := members(annotation)) is not None:
        return Field(T.StructType([resolve(t).field(n) for n, t in fields]), False, attributes)
    if origin is dict:
        value = resolve(args[1])
        if not isinstance(value.data_type, T.StructType):
            raise ValueError("a keyed table has structs as values")
        keys = [f.name for f in resolve(args[0]).data_type.fields] if members(args[0]) else ["key"]
        inner = resolve(args[0]).data_type.fields if members(args[0]) else [resolve(args[0]).field("key")]
        return Field(T.ArrayType(T.StructType([*inner, *value.data_type.fields]), False), False, {"table": "K", "keys": keys, **attributes})
    if origin in (list, typing.Sequence) and args:
        value = resolve(args[0])
        if isinstance(value.data_type, T.StructType) and vector is None:
            return Field(T.ArrayType(value.data_type, value.nullable), False, {"table": "L", **attributes})
        return Field(T.ArrayType(value.data_type, value.nullable), False, {"logical": "Vector", "dim": vector.dim if vector else None, **attributes})
    raise ValueError(f"unsupported type: {annotation!r}")


def is_key(field: T.StructField) -> bool:
    kind = field.dataType
    return all(map(is_key, kind.fields)) if isinstance(kind, T.StructType) else isinstance(kind, KEYS)


def loosened(kind: T.DataType) -> T.DataType:
    """The type with all fields of structs nullable, as Python functions may give nulls anywhere."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, loosened(f.dataType), True, f.metadata) for f in kind])
    return T.ArrayType(loosened(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6}
NAMES = {"day": "d", "hour": "h", "minute": "m", "second": "s", "millisecond": "ms", "microsecond": "us"}


def duration(text: str) -> datetime.timedelta:
    """An interval in ISO 8601 (`P1DT2H`, `-PT0.5S`) or in words (`1 day 2 hours`); weeks too in ISO. Months and years
    have no fixed length and are refused."""
    s = text.strip()
    if m := re.fullmatch(r"([+-]?)P(?=.)(?:([+-]?\d+(?:\.\d+)?)W)?(?:([+-]?\d+(?:\.\d+)?)D)?(?:T(?=.)(?:([+-]?\d+(?:\.\d+)?)H)?(?:([+-]?\d+(?:\.\d+)?)M)?(?:([+-]?\d+(?:\.\d+)?)S)?)?", s):
        weeks, days, hours, minutes, seconds = (float(x or 0) for x in m.groups()[1:])
        return (-1 if m[1] == "-" else 1) * datetime.timedelta(days=days + 7 * weeks, hours=hours, minutes=minutes, seconds=seconds)
    found = re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", s)
    if not found or re.sub(r"[+-]?\d+(?:\.\d+)?\s*[a-zA-Z]+[\s,]*", "", s):
        raise ValueError(f"not an interval: {text!r}")
    total = 0.0
    for n, unit in found:
        short = NAMES.get(unit.lower().removesuffix("s"), unit.lower())
        if short not in UNITS:
            raise ValueError(f"unknown unit {unit!r}")
        total += float(n) * UNITS[short]
    return datetime.timedelta(seconds=total)


def json_schema(data_type: T.DataType, nullable: bool = False, metadata: dict | None = None) -> dict:
    """The JSON schema that describes values of a Spark type."""
    metadata = metadata or {}
    if metadata.get("logical") == "Union":
        out = {"oneOf": [json_schema(f.dataType, False, f.metadata) for f in data_type.fields]}
    elif metadata.get("logical") == "Range" or data_type == RANGE:
        out = {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 2}
    elif metadata.get("logical") == "Json":
        out = {}
    elif isinstance(data_type, T.StructType):
        fields = data_type.fields
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType, f.nullable, f.metadata) for f in fields}, "required": [f.name for f in fields], "additionalProperties": False}
    elif isinstance(data_type, T.ArrayType):
        out = {"type": "array", "items": json_schema(data_type.elementType, data_type.containsNull)}
        if dim := metadata.get("dim"):
            out |= {"minItems": dim, "maxItems": dim}
    else:
        formats = {T.DateType: "date", T.TimestampType: "date-time", T.TimestampNTZType: "date-time", T.DayTimeIntervalType: "duration"}
        if isinstance(data_type, T.BooleanType):
            out = {"type": "boolean"}
        elif isinstance(data_type, T.IntegralType):
            out = {"type": "integer"}
        elif isinstance(data_type, T.NumericType):
            out = {"type": "number"}
        else:
            out = {"type": "string"} | ({"format": f} if (f := formats.get(type(data_type)) or {"Uuid": "uuid", "Time": "time"}.get(metadata.get("logical"))) else {})
    if nullable:
        out = out | {"type": [out["type"], "null"]} if isinstance(out.get("type"), str) else {"oneOf": [*out.get("oneOf", [out]), {"type": "null"}]} if out else out
    return out


def wrapped_schema(data_type: T.DataType, metadata: dict | None = None) -> tuple[dict, bool]:
    """The schema with an object at the top, and whether it had to be wrapped as `{"value": ...}`."""
    inner = json_schema(data_type, False, metadata)
    if inner.get("type") == "object":
        return inner, False
    return {"type": "object", "properties": {"value": inner}, "required": ["value"], "additionalProperties": False}, True


def with_facts(column: Column, **facts: Any) -> Column:
    """The column with what is known of its type beyond Spark's (a vector's length, a UUID), which follows it through scopes
    and collectors to the targets."""
    known = {k: v for k, v in facts.items() if v is not None}
    return column.alias("value", metadata=known) if known else column
