"""Graph databases: nodes and relationships as parameterised Cypher, in three dialects.

A node that a relationship names but that has no row of its own is made by the relationship, and goes when the last one
that touches it has gone; `_own` marks those with a row. Relationships are deleted before nodes are, and written after
them. All rows of a batch are one statement's parameter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from rillspark.sinks.graph import NodeFromFields, Nodes, Relationships
from rillspark.sinks.stores import Changes, Store, dimension

SIMILARITY = {"CosineSimilarity": "cosine", "L2Distance": "euclidean"}


def pattern(name: str, label: str, keys: list[str], row: str) -> str:
    return f"({name}:`{label}` {{{', '.join(f'`{k}`: {row}.`{k}`' for k in keys)}}})"


@dataclass
class Cypher(Store):
    """mapping: Nodes or Relationships, of the rows' fields. label_keys: the key fields of each label that relationships
    touch. The client has run(statement, rows)."""

    connect: Callable[[], Any]
    mapping: Nodes | Relationships
    label_keys: dict[str, tuple[str, ...]]

    def __post_init__(self):
        self.after_nodes = isinstance(self.mapping, Relationships)

    # rows

    def parts(self, end: NodeFromFields, row: dict) -> dict:
        """Key and other properties of an endpoint."""
        all_ = {f.name: row[f.source] for f in end.fields}
        keys = self.label_keys[end.label]
        if missing := [k for k in keys if all_.get(k) is None]:
            raise ValueError(f"{end.label}: no {', '.join(missing)}")
        return {"key": {k: all_[k] for k in keys}, "properties": {k: v for k, v in all_.items() if k not in keys}}

    def rows_of(self, changes: Changes) -> tuple[list[dict], list[dict]]:
        gone = [{"key": k} for k, v in changes if v is None]
        if isinstance(self.mapping, Nodes):
            return [{"key": k, "properties": v} for k, v in changes if v is not None], gone
        ends = (self.mapping.source, self.mapping.target)
        used = {f.source for e in ends for f in e.fields}
        return [{"key": k, "source": self.parts(ends[0], k | v), "target": self.parts(ends[1], k | v), "properties": {n: x for n, x in v.items() if n not in used}} for k, v in changes if v is not None], gone

    # statements

    def upsert(self, keys: list[str]) -> str:
        if isinstance(self.mapping, Nodes):
            return f"UNWIND $rows AS row MERGE {pattern('n', self.mapping.label, keys, 'row.key')} SET n += row.properties, n.`_own` = true"
        m = self.mapping
        made = [f"MERGE {pattern(v, e.label, list(self.label_keys[e.label]), f'row.{side}.key')} ON CREATE SET {v} += row.{side}.properties" for v, side, e in (("s", "source", m.source), ("t", "target", m.target))]
        edge = ", ".join(f"`{k}`: row.key.`{k}`" for k in keys)
        return f"UNWIND $rows AS row {' '.join(made)} MERGE (s)-[r:`{m.rel_type}` {{{edge}}}]->(t) SET r += row.properties"

    def delete(self, keys: list[str]) -> list[str]:
        if isinstance(self.mapping, Nodes):
            return [f"UNWIND $rows AS row MATCH {pattern('n', self.mapping.label, keys, 'row.key')} REMOVE n.`_own` WITH n WHERE NOT (n)--() DELETE n"]
        edge = ", ".join(f"`{k}`: row.key.`{k}`" for k in keys)
        return [f"UNWIND $rows AS row MATCH (s)-[r:`{self.mapping.rel_type}` {{{edge}}}]->(t) DELETE r WITH s, t UNWIND [s, t] AS n WITH DISTINCT n WHERE n.`_own` IS NULL AND NOT (n)--() DELETE n"]

    def mutate(self, client: Any, changes: Changes, spec: dict | None = None) -> None:
        if not changes:
            return
        keys = list(changes[0][0])
        rows, gone = self.rows_of(changes)
        for statement in self.delete(keys) if gone else []:
            client.run(statement, gone)
        if rows:
            client.run(self.upsert(keys), rows)

    # resources

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        labels = {self.mapping.label: list(keys)} if isinstance(self.mapping, Nodes) else {e.label: list(self.label_keys[e.label]) for e in (self.mapping.source, self.mapping.target)}
        label = next(iter(labels)) if isinstance(self.mapping, Nodes) else None
        indexes = [{"label": label, "field": d.field_name, "metric": d.metric, "dim": dimension(schema[d.field_name])} for d in export.vector_indexes]
        return {"labels": labels, "type": getattr(self.mapping, "rel_type", None), "keys": list(keys), "vector_indexes": indexes, "fts_indexes": [{"label": label, "field": d.field_name} for d in export.fts_indexes], "columns": {f.name: f.dataType.simpleString() for f in schema}}

    def constraint(self, label: str, keys: list[str]) -> str:
        return f"CREATE CONSTRAINT `n__{label}__{'__'.join(keys)}` IF NOT EXISTS FOR (n:`{label}`) REQUIRE ({', '.join(f'n.`{k}`' for k in keys)}) IS UNIQUE"

    def vector_index(self, x: dict) -> str:
        return f"CREATE VECTOR INDEX `v__{x['label']}__{x['field']}` IF NOT EXISTS FOR (n:`{x['label']}`) ON (n.`{x['field']}`) OPTIONS {{indexConfig: {{`vector.dimensions`: {x['dim']}, `vector.similarity_function`: '{SIMILARITY[x['metric']]}'}}}}"

    def fts_index(self, x: dict) -> str:
        return f"CREATE FULLTEXT INDEX `f__{x['label']}__{x['field']}` IF NOT EXISTS FOR (n:`{x['label']}`) ON EACH [n.`{x['field']}`]"

    def cleared(self, old: dict) -> list[str]:
        """All that rows of the old description left."""
        if old["type"]:
            return [f"MATCH ()-[r:`{old['type']}`]->() DELETE r", *(f"MATCH (n:`{label}`) WHERE n.`_own` IS NULL AND NOT (n)--() DELETE n" for label in old["labels"])]
        return [f"MATCH (n:`{label}`) REMOVE n.`_own` WITH n WHERE NOT (n)--() DELETE n" for label in old["labels"]]

    def change(self, old: dict | None, new: dict | None) -> list[str]:
        out = self.cleared(old) if old and (not new or (old["labels"], old["type"], old["keys"]) != (new["labels"], new["type"], new["keys"])) else []
        if not new:
            return out
        out += [self.constraint(label, keys) for label, keys in new["labels"].items() if out or not old or old["labels"].get(label) != keys]
        was = old or {"vector_indexes": [], "fts_indexes": []}
        out += [self.vector_index(x) for x in new["vector_indexes"] if x not in was["vector_indexes"]]
        return out + [self.fts_index(x) for x in new["fts_indexes"] if x not in was["fts_indexes"]]

    def run(self, client: Any, steps: list[str]) -> None:
        for s in steps:
            client.run(s, [])


class Neo4j(Cypher):
    """Statements as above, each a transaction."""


class FalkorDB(Cypher):
    """No transactions over statements, other forms of indexes, and orphans are looked for end by end."""

    def constraint(self, label: str, keys: list[str]) -> str:
        return f"CREATE INDEX FOR (n:`{label}`) ON ({', '.join(f'n.`{k}`' for k in keys)})"

    def vector_index(self, x: dict) -> str:
        return f"CREATE VECTOR INDEX FOR (n:`{x['label']}`) ON (n.`{x['field']}`) OPTIONS {{dimension: {x['dim']}, similarityFunction: '{SIMILARITY[x['metric']]}'}}"

    def fts_index(self, x: dict) -> str:
        return f"CALL db.idx.fulltext.createNodeIndex('{x['label']}', '{x['field']}')"

    def delete(self, keys: list[str]) -> list[str]:
        if isinstance(self.mapping, Nodes):
            return super().delete(keys)
        edge = ", ".join(f"`{k}`: row.key.`{k}`" for k in keys)
        gone = f"UNWIND $rows AS row MATCH ()-[r:`{self.mapping.rel_type}` {{{edge}}}]->() DELETE r"
        return [gone, *dict.fromkeys(f"MATCH (n:`{e.label}`) WHERE n.`_own` IS NULL AND NOT (n)--() DELETE n" for e in (self.mapping.source, self.mapping.target))]


LADYBUG_TYPES = {"string": "STRING", "bigint": "INT64", "int": "INT64", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOL", "binary": "BLOB", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP_TZ"}


class Ladybug(Cypher):
    """Typed tables of nodes and of relationships. A relationship is found by both ends, so that deletions come with the old
    rows, and its ends go with it where nothing else holds them."""

    needs_old = True

    def typed(self, columns: dict[str, str], names: list[str]) -> str:
        kind = lambda t: f"FLOAT[{t}]" if isinstance(t, int) else LADYBUG_TYPES.get(t, "STRING")
        return ", ".join(f"`{c}` {kind(columns[c])}" for c in names)

    def wanted(self, schema: T.StructType, keys: list[str], export: Any) -> dict:
        spec = super().wanted(schema, keys, export)
        spec["columns"] = {f.name: dimension(f) or f.dataType.simpleString() for f in schema}
        return spec

    def cleared(self, old: dict) -> list[str]:
        return [f"DROP TABLE IF EXISTS `{old['type']}`"] if old["type"] else [f"DROP TABLE IF EXISTS `{label}`" for label in old["labels"]]

    def change(self, old: dict | None, new: dict | None) -> list[str]:
        same = lambda s: (s["labels"], s["type"], s["keys"], {k: s["columns"][k] for k in s["keys"]})
        out = self.cleared(old) if old and (not new or same(old) != same(new)) else []
        if not new:
            return out
        table = new["type"] or next(iter(new["labels"]))
        if old and not out:
            was, now = old["columns"], new["columns"]
            gone = [f"ALTER TABLE `{table}` DROP `{c}`" for c in was if now.get(c) != was[c]]
            return gone + [f"ALTER TABLE `{table}` ADD {self.typed(now, [c])}" for c in now if was.get(c) != now[c]]
        if new["type"] is None:
            (label,) = new["labels"]
            return [*out, f"CREATE NODE TABLE IF NOT EXISTS `{label}` ({self.typed(new['columns'], list(new['columns']))}, `_own` BOOL, PRIMARY KEY ({', '.join(f'`{k}`' for k in new['keys'])}))"]
        m = self.mapping
        for e in {e.label: e for e in (m.source, m.target)}.values():
            columns = {f.name: new["columns"][f.source] for f in e.fields}
            out.append(f"CREATE NODE TABLE IF NOT EXISTS `{e.label}` ({self.typed(columns, list(columns))}, `_own` BOOL, PRIMARY KEY ({', '.join(f'`{k}`' for k in self.label_keys[e.label])}))")
        used = {f.source for e in (m.source, m.target) for f in e.fields} - set(new["keys"])
        return [*out, f"CREATE REL TABLE IF NOT EXISTS `{m.rel_type}` (FROM `{m.source.label}` TO `{m.target.label}`, {self.typed(new['columns'], [c for c in new['columns'] if c not in used])})"]

    def rows_of(self, changes: Changes) -> tuple[list[dict], list[dict]]:
        rows, _ = super().rows_of([(k, v) for k, v in changes if not (v or {}).get("_gone")])
        gone = [(k, v) for k, v in changes if (v or {}).get("_gone")]
        if isinstance(self.mapping, Nodes):
            return rows, [{"key": k} for k, _ in gone]
        ends = (self.mapping.source, self.mapping.target)
        return rows, [{"key": k, "source": self.parts(ends[0], k | v), "target": self.parts(ends[1], k | v)} for k, v in gone]

    def delete(self, keys: list[str]) -> list[str]:
        if isinstance(self.mapping, Nodes):
            node = pattern("n", self.mapping.label, keys, "row.key")
            return [f"UNWIND $rows AS row MATCH {node} SET n.`_own` = NULL", f"UNWIND $rows AS row MATCH {node} WHERE NOT (n)--() DELETE n"]
        m, edge = self.mapping, ", ".join(f"`{k}`: row.key.`{k}`" for k in keys)
        ends = [pattern(v, e.label, list(self.label_keys[e.label]), f"row.{side}.key") for v, side, e in (("s", "source", m.source), ("t", "target", m.target))]
        out = [f"UNWIND $rows AS row MATCH {ends[0]}-[r:`{m.rel_type}` {{{edge}}}]->{ends[1]} DELETE r"]
        for side, e in (("source", m.source), ("target", m.target)):
            out.append(f"UNWIND $rows AS row MATCH {pattern('n', e.label, list(self.label_keys[e.label]), f'row.{side}.key')} WHERE n.`_own` IS NULL AND NOT (n)--() DELETE n")
        return out


def declared(flow: Any) -> dict[str, tuple[str, ...]]:
    """The key fields of each label that a flow declares, as label_keys takes them."""
    return {d.label: tuple(d.primary_key_fields) for d in flow.declarations}
