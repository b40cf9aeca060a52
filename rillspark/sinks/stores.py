"""Targets in databases and vector stores: what a resource should look like, the statements that change it, and what tasks send.

Each store has a client that the user's `connect` opens, on the driver for changes of the resource and in every task for
rows. `wanted` describes the resource as plain data, kept with an indexer's tracking; `change` makes the statements or calls
from an old description to a new one (None: no resource), and `run` carries them out. `mutate` sends the changes of a task.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.session import for_batches
from rillspark.sinks.targets import HnswVectorIndexMethod, IvfFlatVectorIndexMethod, JdbcTable, VectorIndexDef

Changes = list[tuple[dict, dict | None]]
#: Steps that take a resource's rows away.
DROPS = re.compile(r"\bDROP (NODE |REL )?TABLE\b|\bDELETE\b|delete_collection|delete_index|drop_table")


def plain(v: Any) -> Any:
    """A value of a row as JSON takes it."""
    if isinstance(v, np.ndarray | list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT":
        return None
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v.isoformat() if isinstance(v, datetime.date | datetime.time) else v


def dimension(f: T.StructField) -> int | None:
    """The fixed length of a vector field, or of the vectors of a multi-vector field; 0 if it isn't fixed, None for others."""
    kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return int(f.metadata.get("dim") or 0) if isinstance(kind, T.FloatType | T.DoubleType) else None


def multiple(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType)


def batches(items: list, size: int) -> Iterator[list]:
    return (items[i : i + size] for i in range(0, len(items), size))


def one_key(key: dict) -> Any:
    (value,) = key.values()
    return value


class Store:
    """What the stores share."""

    connect: Callable[[], Any]
    #: Whether deletions come with the deleted rows' columns rather than keys alone.
    needs_old = False
    #: Relationships are deleted before nodes and written after them.
    after_nodes = False

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        raise NotImplementedError

    def change(self, old: dict | None, new: dict | None) -> list[Any]:
        raise NotImplementedError

    def place(self) -> str | None:
        """The name of the resource in its store; None for that of the export."""
        return next((getattr(self, n) for n in ("table", "collection", "index") if isinstance(getattr(self, n, None), str)), None)

    def rebuilds(self, old: dict | None, new: dict | None) -> bool:
        """Whether a change of description takes the resource's rows away, so that all have to be sent again."""
        return bool(old and new and old != new) and any(DROPS.search(str(s)) for s in self.change(old, new))

    def run(self, client: Any, steps: list[Any]) -> None:
        """Steps are (method, arguments) of the client."""
        for method, arguments in steps:
            getattr(client, method)(**arguments)

    def setup(self, old: dict | None, new: dict | None) -> list[Any]:
        steps = self.change(old, new) if old != new else []
        if steps:
            self.run(self.connect(), steps)
        return steps

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        raise NotImplementedError

    def apply(self, upserts: DataFrame, deletes: DataFrame, keys: list[str], spec: dict | None = None) -> None:
        """Changes of one key are one row here; each task opens a client and sends what it holds. spec: the resource as it was
        described by `wanted`."""
        connect, mutate = self.connect, partial(self.mutate, spec=spec) if spec else self.mutate
        rows = upserts.withColumn("_deleted", F.lit(False)).unionByName(deletes.withColumn("_deleted", F.lit(True)), allowMissingColumns=True)
        names = [c for c in rows.columns if c not in {*keys, "_deleted"}]
        old = self.needs_old

        def use(parts: Iterator[list[dict]]) -> None:
            client = connect()
            for rows in parts:
                records = [{c: plain(v) for c, v in r.items()} for r in rows]
                gone = lambda r: {n: r[n] for n in names} | {"_gone": True} if old else None
                mutate(client, [({k: r[k] for k in keys}, gone(r) if r["_deleted"] else {n: r[n] for n in names}) for r in records])

        for_batches(rows.repartition(*keys), use)


# relational


@dataclass(frozen=True)
class SqlCommand:
    """An attachment: statements run when it is new and when it goes."""

    name: str
    setup_sql: str
    teardown_sql: str | None = None


POSTGRES_TYPES = {
    T.StringType: "text", T.LongType: "bigint", T.IntegerType: "bigint", T.FloatType: "real", T.DoubleType: "double precision", T.BooleanType: "boolean", T.BinaryType: "bytea",
    T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamp with time zone", T.DayTimeIntervalType: "interval",
}
POSTGRES_OPERATORS = {"CosineSimilarity": "vector_cosine_ops", "L2Distance": "vector_l2_ops", "InnerProduct": "vector_ip_ops"}


def postgres_type(f: T.StructField) -> str:
    if dimension(f) and not multiple(f):
        return f"vector({dimension(f)})"
    if str(f.metadata.get("logical")).lower() == "uuid":
        return "uuid"
    return POSTGRES_TYPES.get(type(f.dataType), "jsonb")


def index_spec(d: VectorIndexDef) -> dict:
    method = {HnswVectorIndexMethod: "hnsw", IvfFlatVectorIndexMethod: "ivfflat"}[type(d.method)]
    return {"field": d.field_name, "metric": d.metric, "method": method, "options": {k: v for k, v in vars(d.method).items() if v is not None}}


def table_spec(name: str, schema: T.StructType, keys: list[str], export: Any, type_of: Callable[[T.StructField], str]) -> dict:
    return {
        "name": name, "columns": {f.name: type_of(f) for f in schema}, "keys": list(keys),
        "vector_indexes": [index_spec(d) for d in export.vector_indexes], "fts_indexes": [{"field": d.field_name, **d.parameters} for d in export.fts_indexes],
        "attachments": [{"name": a.name, "setup": a.setup_sql, "teardown": a.teardown_sql} for a in export.attachments],
    }


def changed_items(old: dict | None, new: dict | None, what: str) -> tuple[list[dict], list[dict]]:
    """Descriptions of `what` that go and that come."""
    a, b = (old or {}).get(what, []), (new or {}).get(what, [])
    return [x for x in a if x not in b], [x for x in b if x not in a]


@dataclass
class Postgres(JdbcTable, Store):
    """A table with a vector extension. Key changes build it anew; other columns are added, dropped or retyped in place."""

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        for d in export.vector_indexes:
            if not dimension(schema[d.field_name]):
                raise ValueError(f"{d.field_name}: an index needs a fixed dimension")
        return table_spec(self.table, schema, keys, export, postgres_type)

    def index_name(self, x: dict) -> str:
        return f'"{self.table.replace(".", "_")}__{x["field"]}__{x.get("metric", "fts").lower()}"'

    def change(self, old: dict | None, new: dict | None) -> list[str]:
        out = []
        gone, come = changed_items(old, new, "attachments")
        out += [x["teardown"] for x in gone if x["teardown"]]
        anew = bool(old and new) and ([(k, old["columns"][k]) for k in old["keys"]] != [(k, new["columns"][k]) for k in new["keys"]])
        if old and (not new or anew):
            out.append(f"DROP TABLE IF EXISTS {self.table}")
            old = None
        if not new:
            return out
        if any(t.startswith("vector") for t in new["columns"].values()):
            out.append("CREATE EXTENSION IF NOT EXISTS vector")
        if not old:
            columns = [f'"{c}" {t}{" NOT NULL" if c in new["keys"] else ""}' for c, t in new["columns"].items()]
            out.append(f"CREATE TABLE IF NOT EXISTS {self.table} ({', '.join(columns)}, PRIMARY KEY ({', '.join(f'"{k}"' for k in new['keys'])}))")
        else:
            was, now = old["columns"], new["columns"]
            out += [f"DROP INDEX IF EXISTS {self.index_name(x)}" for x in changed_items(old, new, "vector_indexes")[0]]
            out += [f'ALTER TABLE {self.table} DROP COLUMN IF EXISTS "{c}"' for c in was if now.get(c) != was[c]]
            out += [f'ALTER TABLE {self.table} ADD COLUMN IF NOT EXISTS "{c}" {t}' for c, t in now.items() if was.get(c) != t]
        for x in changed_items(old, new, "vector_indexes")[1]:
            options = f" WITH ({', '.join(f'{k} = {v}' for k, v in x['options'].items())})" if x["options"] else ""
            out.append(f'CREATE INDEX IF NOT EXISTS {self.index_name(x)} ON {self.table} USING {x["method"]} ("{x["field"]}" {POSTGRES_OPERATORS[x["metric"]]}){options}')
        for x in changed_items(old, new, "fts_indexes")[1]:
            out.append(f"CREATE INDEX IF NOT EXISTS {self.index_name(x)} ON {self.table} USING gin (to_tsvector('{x.get('language', 'simple')}', \"{x['field']}\"))")
        return out + [x["setup"] for x in come]

    def run(self, client: Any, steps: list[str]) -> None:
        cursor = client.cursor()
        for s in steps:
            cursor.execute(s)
        client.commit()

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        """Upserts and deletions of a batch in one transaction, within the limit of bound values."""
        rows = [k | v for k, v in changes if v is not None]
        gone, cursor = [tuple(k.values()) for k, v in changes if v is None], client.cursor()
        keys = list(changes[0][0]) if changes else []
        bound = lambda v: json.dumps(v) if isinstance(v, dict | list) else v.replace("\0", "") if isinstance(v, str) else v
        upsert, delete = self.statements(list(rows[0]) if rows else keys, keys)
        for part in batches(gone, max(1, self.most_bound // max(1, len(keys)))):
            cursor.executemany(delete, part)
        for part in batches([tuple(map(bound, r.values())) for r in rows], max(1, self.most_bound // max(1, len(rows[0]) if rows else 1))):
            cursor.executemany(upsert, part)
        client.commit()

    def apply(self, upserts: DataFrame, deletes: DataFrame, keys: list[str], spec: dict | None = None) -> None:
        Store.apply(self, upserts, deletes, keys)


DORIS_TYPES = {
    T.StringType: "TEXT", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN", T.BinaryType: "STRING",
    T.DateType: "DATE", T.TimestampNTZType: "DATETIME(6)", T.TimestampType: "DATETIME(6)",
}
DORIS_METRICS = {"L2Distance": "l2_distance", "InnerProduct": "inner_product"}


@dataclass
class Doris(Store):
    """A table of duplicate keys: changed keys are deleted, then rows loaded as a stream of JSON lines; the two aren't one
    transaction, and a repeated update mends what a break between them leaves. The client has sql(statement) and
    load(table, lines, headers)."""

    connect: Callable[[], Any]
    table: str
    buckets: str = "AUTO"
    replication: int = 1
    batch: int = 10_000

    def type_of(self, f: T.StructField, key: bool = False) -> str:
        if dimension(f) is not None and not multiple(f):
            return "ARRAY<FLOAT>"
        return "VARCHAR(512)" if key and isinstance(f.dataType, T.StringType) else DORIS_TYPES.get(type(f.dataType), "JSON")

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        spec = table_spec(self.table, schema, keys, export, lambda f: self.type_of(f, f.name in keys))
        for x in spec["vector_indexes"]:
            if x["metric"] not in DORIS_METRICS:
                raise ValueError(f"{x['field']}: no index for {x['metric']}")
            x["dim"] = dimension(schema[x["field"]])
            if not x["dim"]:
                raise ValueError(f"{x['field']}: an index needs a fixed dimension")
        return spec

    def indexes(self, spec: dict) -> list[str]:
        out = []
        for x in spec["vector_indexes"]:
            options = {"index_type": x["method"], "metric_type": DORIS_METRICS[x["metric"]], "dim": x["dim"]} | {{"m": "max_degree"}.get(k, k): v for k, v in x["options"].items()}
            out.append(f"INDEX idx_{x['field']}_ann (`{x['field']}`) USING ANN PROPERTIES ({', '.join(f'"{k}" = "{v}"' for k, v in options.items())})")
        return out + [f"INDEX idx_{x['field']}_inv (`{x['field']}`) USING INVERTED PROPERTIES (\"parser\" = \"{x.get('parser', 'unicode')}\")" for x in spec["fts_indexes"]]

    def change(self, old: dict | None, new: dict | None) -> list[tuple[str, dict]]:
        out, same = [], lambda s: (s["keys"], [s["columns"][k] for k in s["keys"]], s["vector_indexes"], s["fts_indexes"])
        if old and (not new or same(old) != same(new)):
            out.append(f"DROP TABLE IF EXISTS {self.table}")
            old = None
        if new and not old:
            order = [*new["keys"], *(c for c in new["columns"] if c not in new["keys"])]
            columns = [f"`{c}` {new['columns'][c]} {'NOT NULL' if c in new['keys'] or new['columns'][c].startswith('ARRAY') else 'NULL'}" for c in order]
            key = ", ".join(f"`{k}`" for k in new["keys"])
            out.append(f"CREATE TABLE IF NOT EXISTS {self.table} ({', '.join([*columns, *self.indexes(new)])}) ENGINE=OLAP DUPLICATE KEY({key}) DISTRIBUTED BY HASH({key}) BUCKETS {self.buckets} PROPERTIES (\"replication_num\" = \"{self.replication}\")")
        elif new:
            was, now = old["columns"], new["columns"]
            out += [f"ALTER TABLE {self.table} DROP COLUMN `{c}`" for c in was if now.get(c) != was[c]]
            out += [f"ALTER TABLE {self.table} ADD COLUMN `{c}` {t} NULL" for c, t in now.items() if was.get(c) != t]
        return [("sql", {"statement": s}) for s in out]

    def literal(self, v: Any) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(int(v) if isinstance(v, bool) else v)

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        for part in batches(changes, self.batch):
            names = list(part[0][0])
            keys = [", ".join(self.literal(v) for v in k.values()) for k, _ in part]
            if len(names) == 1:
                client.sql(statement=f"DELETE FROM {self.table} WHERE `{names[0]}` IN ({', '.join(keys)})")
            else:
                for k, _ in part:
                    client.sql(statement=f"DELETE FROM {self.table} WHERE {' AND '.join(f'`{n}` = {self.literal(v)}' for n, v in k.items())}")
            rows = [json.dumps(k | v) for k, v in part if v is not None]
            if rows:
                client.load(table=self.table, lines="\n".join(rows), headers={"format": "json", "read_json_by_line": "true"})


# vector stores


@dataclass
class Qdrant(Store):
    """A collection of points; vectors of a fixed length are named vectors, multi-vectors compare by the largest
    similarity, all other fields are the payload. Another set of vectors builds the collection anew."""

    connect: Callable[[], Any]
    collection: str
    batch: int = 256
    METRICS = {"CosineSimilarity": "Cosine", "L2Distance": "Euclid", "InnerProduct": "Dot"}

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        if len(keys) != 1 or not isinstance(schema[keys[0]].dataType, T.StringType | T.LongType):
            raise ValueError("a point's id is one key field, a string, an integer or a UUID")
        metric = {d.field_name: self.METRICS[d.metric] for d in export.vector_indexes}
        sized = {f.name: {"size": dimension(f), "distance": metric.get(f.name, "Cosine")} | ({"multivector_config": {"comparator": "max_sim"}} if multiple(f) else {}) for f in schema if dimension(f)}
        return {"name": self.collection, "vectors": sized, "keys": list(keys)}

    def change(self, old: dict | None, new: dict | None) -> list[tuple[str, dict]]:
        out = []
        if old and old != new:
            out.append(("delete_collection", {"collection_name": self.collection}))
        return out + ([("create_collection", {"collection_name": self.collection, "vectors_config": new["vectors"]})] if new else [])

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        points, own = [], spec["vectors"]
        for k, v in changes:
            if v is not None:
                vectors = {n: v[n] for n in own if v.get(n) is not None}
                points.append({"id": one_key(k), "vector": vectors, "payload": {n: x for n, x in v.items() if n not in own}})
        for part in batches(points, self.batch):
            client.upsert(collection_name=self.collection, points=part)
        for part in batches([one_key(k) for k, v in changes if v is None], self.batch):
            client.delete(collection_name=self.collection, points_selector=part)


@dataclass
class Pinecone(Store):
    """An index with one vector field of a fixed length; the id is the key as a string, the rest metadata."""

    connect: Callable[[], Any]
    index: str
    namespace: str = ""
    batch: int = 100
    METRICS = {"CosineSimilarity": "cosine", "L2Distance": "euclidean", "InnerProduct": "dotproduct"}

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        vectors = [f for f in schema if dimension(f) and not multiple(f)]
        if len(vectors) != 1 or len(keys) != 1:
            raise ValueError("there must be one vector field of a fixed length and one key field")
        return {"name": self.index, "vector": vectors[0].name, "dimension": dimension(vectors[0]), "metric": self.METRICS[export.vector_indexes[0].metric if export.vector_indexes else "CosineSimilarity"]}

    def change(self, old: dict | None, new: dict | None) -> list[tuple[str, dict]]:
        return ([("delete_index", {"name": self.index})] if old else []) + ([("create_index", {k: v for k, v in new.items() if k != "vector"})] if new else [])

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        index, rows, vector = client.Index(self.index), [], spec["vector"]
        for k, v in changes:
            if v is not None:
                if v[vector] is None:
                    raise ValueError(f"{k}: no {vector}")
                rest = {n: x if isinstance(x, str | int | float | bool) else json.dumps(x) for n, x in v.items() if n != vector and x is not None}
                rows.append({"id": str(one_key(k)), "values": v[vector], "metadata": rest})
        for part in batches(rows, self.batch):
            index.upsert(vectors=part, namespace=self.namespace)
        for part in batches([str(one_key(k)) for k, v in changes if v is None], self.batch):
            index.delete(ids=part, namespace=self.namespace)


@dataclass
class Chroma(Store):
    """A collection: one vector field is the embedding, one string field may be the document, scalars are metadata."""

    connect: Callable[[], Any]
    collection: str
    document_field: str | None = None
    batch: int = 1000
    METRICS = {"CosineSimilarity": "cosine", "L2Distance": "l2", "InnerProduct": "ip"}

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        vectors = [f.name for f in schema if dimension(f) is not None and not multiple(f)]
        if len(vectors) > 1:
            raise ValueError("there can be one vector field")
        return {"name": self.collection, "vector": vectors[0] if vectors else None, "metadata": {"hnsw:space": self.METRICS[export.vector_indexes[0].metric if export.vector_indexes else "CosineSimilarity"]}}

    def change(self, old: dict | None, new: dict | None) -> list[tuple[str, dict]]:
        return ([("delete_collection", {"name": self.collection})] if old else []) + ([("get_or_create_collection", {k: v for k, v in new.items() if k != "vector"})] if new else [])

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        collection = client.get_collection(name=self.collection)
        name = lambda k: "|".join(str(x) for x in k.values())
        vector = spec["vector"]
        own = {vector, self.document_field}
        for part in batches([c for c in changes if c[1] is not None], self.batch):
            given = {"ids": [name(k) for k, _ in part], "metadatas": [{n: x if isinstance(x, str | int | float | bool) else json.dumps(x) for n, x in (k | v).items() if n not in own and x is not None} for k, v in part]}
            if vector:
                given["embeddings"] = [v[vector] for _, v in part]
            if self.document_field:
                given["documents"] = [v[self.document_field] for _, v in part]
            collection.upsert(**given)
        for part in batches([name(k) for k, v in changes if v is None], self.batch):
            collection.delete(ids=part)


@dataclass
class LanceDB(Store):
    """A table merged by key: matched rows are updated, others inserted, deleted keys by a predicate. After `optimize_after`
    batches of a task the table is compacted."""

    connect: Callable[[], Any]
    table: str
    optimize_after: int = 50
    sent: dict = field(default_factory=lambda: {"n": 0})

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        fixed = lambda f: f"fixed_size_list<float>[{dimension(f)}]" if dimension(f) and not multiple(f) else f.dataType.simpleString()
        return table_spec(self.table, schema, keys, export, fixed)

    def change(self, old: dict | None, new: dict | None) -> list[tuple[str, dict]]:
        out = [("drop_table", {"name": self.table})] if old and (not new or old["columns"] != new["columns"] or old["keys"] != new["keys"]) else []
        if new and (not old or out):
            out.append(("create_table", {"name": self.table, "schema": new["columns"]}))
        for x in changed_items(None if out else old, new, "vector_indexes")[1]:
            out.append(("create_index", {"table": self.table, "column": x["field"], "metric": {"CosineSimilarity": "cosine", "L2Distance": "l2", "InnerProduct": "dot"}[x["metric"]], "index_type": x["method"], **x["options"]}))
        for x in changed_items(None if out else old, new, "fts_indexes")[1]:
            out.append(("create_fts_index", {"table": self.table, "column": x["field"]}))
        return out

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        table, keys = client.open_table(self.table), list(changes[0][0]) if changes else []
        rows = [k | v for k, v in changes if v is not None]
        if rows:
            table.merge_insert(keys).when_matched_update_all().when_not_matched_insert_all().execute(rows)
        quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v)
        gone = [" AND ".join(f"{n} = {quoted(v)}" for n, v in k.items()) for k, v in changes if v is None]
        for part in batches(gone, 500):
            table.delete(" OR ".join(f"({g})" for g in part))
        self.sent["n"] += 1
        if self.sent["n"] % self.optimize_after == 0:
            table.optimize()
