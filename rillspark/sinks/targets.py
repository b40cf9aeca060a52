"""What an export writes to: specs of targets, custom connectors, and dumps without any target."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.session import for_batches

METRICS = {"CosineSimilarity": "cosine", "L2Distance": "l2", "InnerProduct": "ip"}


@dataclass(frozen=True)
class HnswVectorIndexMethod:
    m: int | None = None
    ef_construction: int | None = None


@dataclass(frozen=True)
class IvfFlatVectorIndexMethod:
    lists: int | None = None


@dataclass(frozen=True)
class VectorIndexDef:
    field_name: str
    metric: str = "CosineSimilarity"
    method: Any = HnswVectorIndexMethod()


@dataclass(frozen=True)
class FtsIndexDef:
    field_name: str
    parameters: dict = field(default_factory=dict)


@dataclass
class Stored:
    """A keyed table in a folder; `path` or a place under the flow's own folder."""

    path: str | None = None
    setup_sql: tuple[str, ...] = ()
    teardown_sql: tuple[str, ...] = ()


@dataclass
class JdbcTable:
    """A table of a database with `INSERT ... ON CONFLICT`: rows are sent by the tasks that hold them, in batches that
    keep under the limit of bound values."""

    connect: Callable[[], Any]
    table: str
    most_bound: int = 65535
    mark: str = "%s"

    def statements(self, columns: list[str], keys: list[str]) -> tuple[str, str]:
        names, marks = ", ".join(f'"{c}"' for c in columns), ", ".join([self.mark] * len(columns))
        values = [c for c in columns if c not in keys]
        on = "DO UPDATE SET " + ", ".join(f'"{c}" = EXCLUDED."{c}"' for c in values) if values else "DO NOTHING"
        same = " AND ".join(f'"{k}" = {self.mark}' for k in keys)
        return f'INSERT INTO {self.table} ({names}) VALUES ({marks}) ON CONFLICT ({", ".join(f'"{k}"' for k in keys)}) {on}', f"DELETE FROM {self.table} WHERE {same}"

    def apply(self, upserts: DataFrame, deletes: DataFrame, keys: list[str]) -> None:
        upsert, delete = self.statements(upserts.columns, keys)
        send(deletes.select(*keys), delete, self.connect, self.most_bound)
        send(upserts, upsert, self.connect, self.most_bound)


def send(df: DataFrame, statement: str, connect: Callable[[], Any], most: int) -> None:
    size = max(1, most // max(1, len(df.columns)))

    def use(batches: Iterator[list[dict]]) -> None:
        connection = None
        for rows in batches:
            connection = connection or connect()
            cursor = connection.cursor()
            for at in range(0, len(rows), size):
                cursor.executemany(statement, [tuple(r.values()) for r in rows[at : at + size]])
        if connection:
            connection.commit()
            connection.close()

    for_batches(df, use)


@dataclass
class CustomTarget:
    """mutate(batches of (key dict, value dict or None)) runs in each task; of changes to one key the last counts, as
    they are reduced to one per key before. prepare() runs once per task, setup(old, new) on the driver."""

    mutate: Callable[[Any, list[tuple[dict, dict | None]]], None]
    prepare: Callable[[], Any] = lambda: None
    setup: Callable[[dict | None, dict | None], None] = lambda old, new: None
    persistent_key: str = ""

    def apply(self, upserts: DataFrame, deletes: DataFrame, keys: list[str]) -> None:
        mutate, prepare = self.mutate, self.prepare
        rows = upserts.withColumn("_deleted", F.lit(False)).unionByName(deletes.select(*keys).withColumn("_deleted", F.lit(True)), allowMissingColumns=True)
        names = [c for c in upserts.columns if c not in keys]

        def use(batches: Iterator[list[dict]]) -> None:
            ready = prepare()
            for rows in batches:
                mutate(ready, [({k: r[k] for k in keys}, None if r["_deleted"] else {n: r[n] for n in names}) for r in rows])

        for_batches(rows.repartition(*keys), use)


def target_connector(**options: Any):
    """A class with `mutate(self, changes)`, optional `prepare` and `apply_setup_change`, becomes a target when called."""

    def wrap(cls: type):
        def make(*args: Any, **kwargs: Any) -> CustomTarget:
            setup = getattr(cls, "apply_setup_change", lambda old, new: None)

            def prepare():
                made = cls(*args, **kwargs)
                if hasattr(made, "prepare"):
                    made.prepare()
                return made

            return CustomTarget(lambda made, changes: made.mutate(changes), prepare, setup, getattr(cls, "persistent_key", cls.__name__))

        return make

    return wrap


def vector_points(rows: DataFrame, key: str) -> DataFrame:
    """Rows as points of a vector store: `id`, named vectors (fixed-length and multi-vectors; null ones left out), the
    rest as a JSON payload. The key has one part, a string, an integer or a UUID."""
    if not isinstance(rows.schema[key].dataType, (T.StringType, T.LongType)):
        raise ValueError(f"{key} can't be the id of a point")
    is_vector = lambda t: isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType))
    vectors = [f.name for f in rows.schema if is_vector(f.dataType)]
    multi = [f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType) and is_vector(f.dataType.elementType)]
    rest = [c for c in rows.columns if c not in {key, *vectors, *multi}]

    def named(fields: list[str], kind: str) -> Any:
        pairs = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f).cast(kind).alias("value"))) for f in fields]
        return F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.create_map().cast(f"map<string,{kind}>")

    payload = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return rows.select(F.col(key).alias("id"), named(vectors, "array<float>").alias("vectors"), named(multi, "array<array<float>>").alias("multi_vectors"), payload.alias("payload"))


def yaml_of(value: Any, indent: int = 0) -> str:
    """Plain data as YAML: nested lists and maps by indentation, texts of several lines as blocks, others quoted as JSON."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(str(k), ensure_ascii=False)}:{inner(v, indent)}" for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-{inner(v, indent)}" for v in value)
    return pad + inner(value, indent).lstrip()


def inner(v: Any, indent: int) -> str:
    if isinstance(v, dict | list) and v:
        return "\n" + yaml_of(v, indent + 1)
    if isinstance(v, str) and "\n" in v and v.strip() and v[0] not in " \n" and not v.endswith("\n") and v.replace("\n", "").replace("\t", " ").isprintable():
        return " |-\n" + "".join(f"{'  ' * (indent + 1)}{line}\n" if line else "\n" for line in v.split("\n"))
    return " " + json.dumps(v, ensure_ascii=False) + "\n"


def evaluate_and_dump(flow: Any, spark: SparkSession, path: str) -> list[str]:
    """What each source row gives, as YAML; no target is written. A row's key and the records of every collector make one
    document, in a folder by source that is split by the start of the key's hash. The folders' names are returned."""

    def documents(batches):
        for b in batches:
            texts = []
            for source, owner, records in zip(b["_source"], b["_owner"], b["records"]):
                found: dict[str, list] = {}
                for r in sorted(map(json.loads, records), key=lambda r: json.dumps(r, sort_keys=True)):
                    found.setdefault(r["collector"], []).append(json.loads(r["record"]))
                texts.append("---\n" + yaml_of({"key": json.loads(owner or "{}"), "exports": found}))
            yield pd.DataFrame({"source": b["_source"], "part": b["part"], "value": texts})

    rows = None
    for name, df in flow.compile(spark, owned=True).items():
        record = F.to_json(F.struct(*[c for c in df.columns if c not in ("_source", "_owner")]), {"ignoreNullFields": "false"})
        one = df.select("_source", "_owner", F.to_json(F.struct(F.lit(name).alias("collector"), record.alias("record"))).alias("r"))
        rows = one if rows is None else rows.union(one)
    by_row = rows.groupBy("_source", "_owner").agg(F.collect_list("r").alias("records")).withColumn("part", F.substring(F.md5("_owner"), 1, 2))
    by_row.mapInPandas(documents, "source string, part string, value string").write.mode("overwrite").partitionBy("source", "part").text(path)
    return sorted(flow.sources)
