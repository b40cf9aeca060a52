"""Checks that Spark doesn't make: names, merged collector schemas, compatible changes of a table."""

from __future__ import annotations

import re

from pyspark.sql import types as T

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def check_name(name: str, what: str = "field", most: int = 64) -> str:
    if not name or len(name) > most:
        raise ValueError(f"{what} name must have 1 to {most} characters: {name!r}")
    if name.startswith("__"):
        raise ValueError(f"{what} name must not start with __: {name!r}")
    if not NAME.fullmatch(name):
        raise ValueError(f"{what} name must be an identifier: {name!r}")
    return name


def check_full_flow_name(name: str) -> str:
    for part in name.split("."):
        check_name(part, "flow")
    return name


def merge_schemas(first: T.StructType, second: T.StructType) -> T.StructType:
    """Fields of both. Common ones must stand in the same order and have the same type; they become nullable if either
    is, or if only one schema has them, and keep the metadata both agree on. New fields follow the common one that they
    follow in their own schema."""
    names = [f.name for f in first]
    common = [f.name for f in second if f.name in names]
    if common != [n for n in names if n in common]:
        raise ValueError(f"common fields are in another order: {common} and {[n for n in names if n in common]}")
    out = []
    rest = list(second.fields)
    for f in first:
        if f.name in common:
            while rest[0].name != f.name:
                out.append(nullable(rest.pop(0)))
            g = rest.pop(0)
            if f.dataType != g.dataType:
                raise ValueError(f"field {f.name}: {f.dataType.simpleString()} and {g.dataType.simpleString()}")
            both = {k: v for k, v in f.metadata.items() if g.metadata.get(k) == v}
            out.append(T.StructField(f.name, f.dataType, f.nullable or g.nullable, both))
        else:
            out.append(nullable(f))
    return T.StructType(out + [nullable(f) for f in rest])


def nullable(f: T.StructField) -> T.StructField:
    return T.StructField(f.name, f.dataType, True, f.metadata)


def compatibility(old: T.StructType, new: T.StructType, keys: list[str], old_keys: list[str] | None = None) -> str:
    """`incompatible` if a key changed (the table is built anew), `partial` if a value column went or changed its type
    (its contents are lost), else `compatible`."""
    if (old_keys or keys) != keys or any(k not in old.names or k not in new.names or old[k].dataType != new[k].dataType for k in keys):
        return "incompatible"
    values = [f for f in old if f.name not in keys]
    return "partial" if any(f.name not in new.names or new[f.name].dataType != f.dataType for f in values) else "compatible"
