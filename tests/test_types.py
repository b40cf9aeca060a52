import datetime
from dataclasses import dataclass
from typing import Literal, NamedTuple

import pytest
from pyspark.sql import types as T

from rillspark.schema import check_name, compatibility, merge_schemas
from rillspark.types import RANGE, Float32, Json, Range, Vector, duration, json_schema, resolve, wrapped_schema


@dataclass
class Child:
    value: int
    note: str | None


class Key(NamedTuple):
    a: str
    b: int


def test_basic():
    assert resolve(int).data_type == T.LongType() and not resolve(int).nullable
    assert resolve(str | None) == (T.StringType(), True, {})
    assert resolve(Float32).data_type == T.FloatType()
    assert resolve(Range).data_type == RANGE
    assert resolve(datetime.timedelta).data_type == T.DayTimeIntervalType()
    assert resolve(Json).metadata == {"logical": "Json"}


def test_vectors_and_tables():
    v = resolve(Vector[Float32, Literal[3]])
    assert v.data_type == T.ArrayType(T.FloatType(), False) and v.metadata["dim"] == 3
    assert resolve(Vector[Vector[float, 2]]).data_type == T.ArrayType(T.ArrayType(T.DoubleType(), False), False)
    assert resolve(list[Child]).metadata == {"table": "L"}
    k = resolve(dict[Key, Child])
    assert k.data_type.elementType.names == ["a", "b", "value", "note"] and k.metadata["keys"] == ["a", "b"]
    assert resolve(dict[str, Child]).data_type.elementType.names[0] == "key"
    u = resolve(int | str | None)
    assert u.nullable and [f.dataType for f in u.data_type] == [T.LongType(), T.StringType()]
    with pytest.raises(ValueError):
        resolve(complex)


def test_json_schema():
    s = json_schema(resolve(Child).data_type)
    assert s["properties"]["note"] == {"type": ["string", "null"]} and s["required"] == ["value", "note"]
    assert wrapped_schema(T.LongType())[1] and not wrapped_schema(resolve(Child).data_type)[1]
    v = resolve(Vector[int, 2])
    assert json_schema(v.data_type, False, v.metadata)["minItems"] == 2
    assert json_schema(RANGE) == {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 2}
    u = resolve(int | str)
    assert json_schema(u.data_type, False, u.metadata) == {"oneOf": [{"type": "integer"}, {"type": "string"}]}


@pytest.mark.parametrize(("text", "seconds"), [("P1D", 86400), ("PT1H2M3.5S", 3723.5), ("-PT0.5S", -0.5), ("P1W", 604800), ("1 day 2 hours", 93600), ("90 minutes", 5400), ("250 ms", 0.25), ("-2 s", -2)])
def test_durations(text, seconds):
    assert duration(text).total_seconds() == pytest.approx(seconds)


@pytest.mark.parametrize("text", ["", "P", "PT", "1 month", "abc", "1 day x"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration(text)


def test_names():
    assert check_name("a_1") == "a_1"
    for bad in ("", "__x", "a-b", "1a", "x" * 65):
        with pytest.raises(ValueError):
            check_name(bad)


def schema(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


def test_merge():
    a = schema(("k", T.LongType(), False), ("x", T.StringType(), False))
    b = schema(("k", T.LongType(), False), ("y", T.DoubleType(), False), ("x", T.StringType(), True))
    m = merge_schemas(a, b)
    assert [(f.name, f.nullable) for f in m] == [("k", False), ("y", True), ("x", True)]
    with pytest.raises(ValueError):
        merge_schemas(a, schema(("x", T.StringType(), False), ("k", T.LongType(), False)))
    with pytest.raises(ValueError):
        merge_schemas(a, schema(("k", T.StringType(), False)))


def test_compatibility():
    a = schema(("k", T.LongType(), False), ("x", T.StringType(), True))
    assert compatibility(a, schema(("k", T.LongType(), False), ("x", T.StringType(), True), ("y", T.LongType(), True)), ["k"]) == "compatible"
    assert compatibility(a, schema(("k", T.LongType(), False)), ["k"]) == "partial"
    assert compatibility(a, schema(("k", T.StringType(), False), ("x", T.StringType(), True)), ["k"]) == "incompatible"
