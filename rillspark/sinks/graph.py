"""Property graphs: collectors mapped to nodes and relationships, as two kinds of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.sinks.keyed import NAMED, Folder, KeyedTarget, key_json


@dataclass(frozen=True)
class TargetFieldMapping:
    source: str
    target: str | None = None

    @property
    def name(self) -> str:
        return self.target or self.source


@dataclass(frozen=True)
class NodeFromFields:
    label: str
    fields: tuple[TargetFieldMapping, ...]


@dataclass(frozen=True)
class Nodes:
    label: str


@dataclass(frozen=True)
class Relationships:
    rel_type: str
    source: NodeFromFields
    target: NodeFromFields


@dataclass
class NodeDeclaration:
    label: str
    primary_key_fields: tuple[str, ...]
    vector_indexes: list = field(default_factory=list)


def endpoints(rows: DataFrame, end: NodeFromFields, order: Column) -> DataFrame:
    return rows.select(*[F.col(f.source).alias(f.name) for f in end.fields], order.alias("_order"))


def nodes(own: DataFrame | None, ends: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key. Properties come from the node's own row, else from the endpoint with the largest `_order`; a null
    doesn't replace a value. A column `_own` says whether the node has a row of its own."""
    parts = [e.withColumn("_own", F.lit(False)) for e in ends]
    if own is not None:
        parts.append(own.withColumn("_own", F.lit(True)) if "_order" in own.columns else own.withColumn("_order", F.lit(None).cast("bigint")).withColumn("_own", F.lit(True)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in {*keys, "_order", "_own"}]
    latest = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("_own", F.coalesce("_order", F.lit(0))))).alias(c) for c in values]
    return rows.groupBy(*keys).agg(*latest, F.max("_own").alias("_own"))


def relationships(rows: DataFrame, spec: Relationships, keys: list[str]) -> DataFrame:
    """Edges: source_* and target_* keys, and all other fields as properties."""
    used = {f.source for end in (spec.source, spec.target) for f in end.fields}
    rest = [c for c in rows.columns if c not in used or c in keys]
    return rows.select(*[F.col(f.source).alias(f"source_{f.name}") for f in spec.source.fields], *[F.col(f.source).alias(f"target_{f.name}") for f in spec.target.fields], *rest)


def orphans(all_nodes: DataFrame, edges: list[tuple[DataFrame, list[str]]], keys: list[str]) -> DataFrame:
    """Nodes without a row of their own that no edge touches; edges come with the columns that hold a node's key."""
    left = all_nodes.where("NOT _own").select(*keys)
    for df, columns in edges:
        touched = df.select(*[F.col(c).alias(k) for c, k in zip(columns, keys)]).distinct()
        left = left.join(touched, keys, "left_anti")
    return left


class EndpointCounts:
    """How many relationships of one type touch each node, kept by what changes: an update reads the changed relationships as
    they stood and the counts of their endpoints, no others. keys: the columns of a relationship that tell it apart; ends: of
    each endpoint its columns, in the order of `node`, the key columns of nodes. A relationship whose endpoint has a null key
    touches no node there; one with both endpoints at one node touches it twice."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], ends: list[list[str]], node: list[str], buckets: int | None = None):
        self.spark, self.keys, self.ends, self.node, self.folder = spark, keys, ends, node, Folder(spark, path)
        self.edges, self.counts = KeyedTarget(spark, f"{path}/edges", keys, buckets), KeyedTarget(spark, f"{path}/counts", node, buckets)

    def touches(self, edges: DataFrame, weight: int) -> DataFrame:
        each = [edges.select(*(F.col(c).alias(k) for c, k in zip(end, self.node)), F.lit(weight).cast("bigint").alias("n")).dropna() for end in self.ends]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out.groupBy(*self.node).agg(F.sum("n").alias("n"))

    def of(self, target: KeyedTarget, owners: DataFrame) -> DataFrame | None:
        """The rows of a target that belong to some owners; of few of them without reading the files that have none."""
        few = [r[0] for r in owners.limit(NAMED + 1).collect()]
        rows = target.rows(owners=[("", o) for o in few] if len(few) <= NAMED else None)
        return None if rows is None else rows.join(owners, "_owner", "left_semi")

    def add(self, given: DataFrame) -> None:
        """Changes of counts; a node whose count falls to nothing goes."""
        given = given.where("n <> 0").withColumn("_owner", key_json(self.node))
        old, node = self.of(self.counts, given.select("_owner").distinct()), ["_owner", *self.node]
        if old is not None:
            given = given.unionByName(old.select(*node, "n")).groupBy(*node).agg(F.sum("n").alias("n"))
        rows = given.withColumn("_source", F.lit(""))
        gone = rows.where("n <= 0").select(F.col("_owner").alias("_key"), "_source", "_owner")
        self.counts.merge(rows.where("n > 0").select(*self.node, "n", "_source", "_owner"), gone)

    def update(self, edges: DataFrame, gone: DataFrame | None = None) -> None:
        """Relationships that are new or changed, and keys of those that went; of one given twice one counts. If an update broke
        off between the relationships and the counts, all are counted again."""
        self.mend()
        columns = list(dict.fromkeys([*self.keys, *(c for end in self.ends for c in end)]))
        rows = edges.select(*columns).dropDuplicates(self.keys).withColumn("_source", F.lit("")).withColumn("_owner", key_json(self.keys))
        touched = rows.select("_source", "_owner")
        if gone is not None:
            touched = touched.union(gone.select(F.lit(""), key_json(self.keys))).distinct()
        old = self.of(self.edges, touched.select("_owner"))
        change = self.touches(rows, 1)
        if old is not None:
            change = change.unionByName(self.touches(old, -1)).groupBy(*self.node).agg(F.sum("n").alias("n"))
        # kept before the relationships are replaced, as what stood is found among them no more
        path = f"{self.folder.path}/change"
        change.write.mode("overwrite").parquet(path)
        self.folder.write("counted", {"edges": -1})
        version = self.edges.replace(rows, touched)
        self.add(self.spark.read.schema(change.schema).parquet(path))
        self.folder.write("counted", {"edges": version})

    def mend(self) -> None:
        counted = self.folder.read("counted")
        if counted is not None and counted["edges"] < 0:
            self.counts.drop()
            rows = self.edges.rows()
            if rows is not None:
                self.add(self.touches(rows, 1))
            self.folder.write("counted", {"edges": self.edges.state()["version"]})

    def read(self) -> DataFrame:
        """Nodes that relationships touch, with how many as `n`."""
        self.mend()
        return self.counts.rows(columns=[*self.node, "n"]).select(*self.node, "n")
