import json
import pathlib
import sqlite3
import uuid
from functools import partial

import pytest
from pyspark.sql import types as T

from rillspark.flow import Flow
from rillspark.operators.incremental import Indexer
from rillspark.sinks.cypher import FalkorDB, Ladybug, Neo4j, declared
from rillspark.sinks.graph import NodeDeclaration, NodeFromFields, Nodes, Relationships, TargetFieldMapping
from rillspark.sinks.stores import Chroma, Doris, LanceDB, Pinecone, Postgres, Qdrant, SqlCommand, plain
from rillspark.sinks.targets import FtsIndexDef, HnswVectorIndexMethod, IvfFlatVectorIndexMethod, VectorIndexDef
from rillspark.sources.tables import Table

DIM = {"dim": 2}
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("v", T.ArrayType(T.FloatType()), True, DIM), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


class Export:
    def __init__(self, vector_indexes=(), fts_indexes=(), attachments=()):
        self.vector_indexes, self.fts_indexes, self.attachments = vector_indexes, fts_indexes, attachments


class Log:
    """A client whose every call becomes a file, in order of time."""

    def __init__(self, folder):
        self.folder = pathlib.Path(folder)
        self.folder.mkdir(exist_ok=True)

    def __getattr__(self, name):
        def call(*args, **kwargs):
            import time

            (self.folder / f"{time.time_ns():020d}-{uuid.uuid4().hex}").write_text(json.dumps([name, *args, kwargs], default=str))
            return self

        return call


def calls(folder):
    found = sorted(p for p in pathlib.Path(folder).iterdir())
    out = [json.loads(p.read_text()) for p in found]
    for p in found:
        p.unlink()
    return out


def flow_of(current, target, schema="id long, text string", keys=("id",), **options):
    flow = Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(Table(lambda s: s.createDataFrame(current["rows"], schema), list(keys)), name="s").row() as r:
        out.collect(**{f: r[f] for f in r.base_fields()})
    out.export("rows", target, primary_key_fields=list(keys), **options)
    return flow


def test_postgres_statements():
    t = Postgres(None, "docs")
    spec = t.wanted(SCHEMA, ["id"], Export([VectorIndexDef("v", "L2Distance", HnswVectorIndexMethod(16, 64))], [FtsIndexDef("text")], [SqlCommand("x", "SELECT 1", "SELECT 2")]))
    made = t.change(None, spec)
    assert made == [
        "CREATE EXTENSION IF NOT EXISTS vector",
        'CREATE TABLE IF NOT EXISTS docs ("id" bigint NOT NULL, "text" text, "v" vector(2), "extra" jsonb, PRIMARY KEY ("id"))',
        'CREATE INDEX IF NOT EXISTS "docs__v__l2distance" ON docs USING hnsw ("v" vector_l2_ops) WITH (m = 16, ef_construction = 64)',
        'CREATE INDEX IF NOT EXISTS "docs__text__fts" ON docs USING gin (to_tsvector(\'simple\', "text"))', "SELECT 1",
    ]
    other = t.wanted(T.StructType([SCHEMA["id"], T.StructField("text", T.LongType()), SCHEMA["v"]]), ["id"], Export([VectorIndexDef("v", "CosineSimilarity", IvfFlatVectorIndexMethod(9))]))
    assert t.change(spec, other) == [
        "SELECT 2", "CREATE EXTENSION IF NOT EXISTS vector", 'DROP INDEX IF EXISTS "docs__v__l2distance"', 'ALTER TABLE docs DROP COLUMN IF EXISTS "text"', 'ALTER TABLE docs DROP COLUMN IF EXISTS "extra"',
        'ALTER TABLE docs ADD COLUMN IF NOT EXISTS "text" bigint', 'CREATE INDEX IF NOT EXISTS "docs__v__cosinesimilarity" ON docs USING ivfflat ("v" vector_cosine_ops) WITH (lists = 9)',
    ]
    key = t.wanted(T.StructType([T.StructField("id", T.StringType())]), ["id"], Export())
    assert t.change(other, key)[0] == "DROP TABLE IF EXISTS docs" and t.change(key, None) == ["DROP TABLE IF EXISTS docs"] and t.setup(key, key) == []


def test_a_table_is_made_kept_and_dropped(spark, tmp_path):
    path = str(tmp_path / "db")
    current = {"rows": [(1, "a"), (2, "b"), (3, None)]}
    indexer = Indexer(flow_of(current, Postgres(partial(sqlite3.connect, path, timeout=30), "docs", mark="?")), spark, str(tmp_path / "x"))
    stored = lambda: sorted(sqlite3.connect(path).execute("SELECT id, text FROM docs").fetchall())
    indexer.update()
    assert stored() == [(1, "a"), (2, "b"), (3, None)]
    current["rows"] = [(1, "a"), (2, "new"), (4, "d")]
    indexer.update()
    assert stored() == [(1, "a"), (2, "new"), (4, "d")] and indexer.setup() == {"rows": []}
    indexer.drop()
    with pytest.raises(sqlite3.OperationalError):
        stored()


def test_resources_that_users_set_up_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "db")
    flow = flow_of({"rows": [(1, "a")]}, Postgres(partial(sqlite3.connect, path), "docs", mark="?"), setup_by_user=True)
    assert Indexer(flow, spark, str(tmp_path / "x")).setup() == {}
    twice = flow_of({"rows": [(1, "a")]}, Postgres(None, "docs"))
    twice.collectors[0].export("again", Postgres(None, "docs"), primary_key_fields=["id"])
    with pytest.raises(ValueError, match="one resource"):
        Indexer(twice, spark, str(tmp_path / "y")).setup()


def test_doris(tmp_path):
    t = Doris(None, "db.docs")
    schema = T.StructType([SCHEMA["text"], SCHEMA["id"], SCHEMA["v"]])
    spec = t.wanted(schema, ["id"], Export([VectorIndexDef("v", "L2Distance", HnswVectorIndexMethod(8))], [FtsIndexDef("text", {"parser": "english"})]))
    (made,) = t.change(None, spec)
    assert made[1]["statement"] == (
        "CREATE TABLE IF NOT EXISTS db.docs (`id` BIGINT NOT NULL, `text` TEXT NULL, `v` ARRAY<FLOAT> NOT NULL, "
        'INDEX idx_v_ann (`v`) USING ANN PROPERTIES ("index_type" = "hnsw", "metric_type" = "l2_distance", "dim" = "2", "max_degree" = "8"), '
        'INDEX idx_text_inv (`text`) USING INVERTED PROPERTIES ("parser" = "english")) ENGINE=OLAP DUPLICATE KEY(`id`) DISTRIBUTED BY HASH(`id`) BUCKETS AUTO PROPERTIES ("replication_num" = "1")'
    )
    with pytest.raises(ValueError, match="no index"):
        t.wanted(schema, ["id"], Export([VectorIndexDef("v", "CosineSimilarity")]))
    client = Log(tmp_path / "log")
    t.mutate(client, [({"id": 1}, {"text": "x"}), ({"id": 2}, None)])
    sql, load = calls(tmp_path / "log")
    assert sql[-1]["statement"] == "DELETE FROM db.docs WHERE `id` IN (1, 2)" and load[0] == "load" and load[-1]["lines"] == '{"id": 1, "text": "x"}'
    t.mutate(client, [({"a": "it's", "b": 2}, None)])
    assert calls(tmp_path / "log")[0][-1]["statement"] == "DELETE FROM db.docs WHERE `a` = 'it''s' AND `b` = 2"


def test_vector_stores(tmp_path):
    client = Log(tmp_path / "log")
    multi = T.StructType([*SCHEMA, T.StructField("m", T.ArrayType(T.ArrayType(T.FloatType())), True, {"dim": 3})])
    q = Qdrant(None, "c")
    spec = q.wanted(multi, ["id"], Export([VectorIndexDef("v", "InnerProduct")]))
    assert spec["vectors"] == {"v": {"size": 2, "distance": "Dot"}, "m": {"size": 3, "distance": "Cosine", "multivector_config": {"comparator": "max_sim"}}}
    assert [m for m, _ in q.change(spec, spec | {"vectors": {}})] == ["delete_collection", "create_collection"]
    q.mutate(client, [({"id": 1}, {"text": "a", "v": [1.0, 2.0], "m": None}), ({"id": 2}, None)], spec)
    up, gone = calls(tmp_path / "log")
    assert up[-1]["points"] == [{"id": 1, "vector": {"v": [1.0, 2.0]}, "payload": {"text": "a"}}] and gone[-1]["points_selector"] == [2]
    with pytest.raises(ValueError):
        q.wanted(multi, ["id", "text"], Export())

    p = Pinecone(None, "i", "ns", batch=1)
    assert p.change(None, p.wanted(SCHEMA, ["id"], Export())) == [("create_index", {"name": "i", "dimension": 2, "metric": "cosine"})]
    p.mutate(client, [({"id": 1}, {"text": "a", "v": [1.0, 2.0], "extra": {"k": "x"}}), ({"id": 3}, {"text": None, "v": [0.0, 1.0], "extra": None}), ({"id": 2}, None)], p.wanted(SCHEMA, ["id"], Export()))
    _, one, two, gone = calls(tmp_path / "log")
    assert one[-1] == {"vectors": [{"id": "1", "values": [1.0, 2.0], "metadata": {"text": "a", "extra": '{"k": "x"}'}}], "namespace": "ns"} and two[-1]["vectors"][0]["metadata"] == {} and gone[-1]["ids"] == ["2"]
    with pytest.raises(ValueError, match="no v"):
        p.mutate(client, [({"id": 1}, {"v": None})], p.wanted(SCHEMA, ["id"], Export()))

    c = Chroma(None, "c", document_field="text")
    calls(tmp_path / "log")
    c.mutate(client, [({"id": 1}, {"text": "a", "v": [1.0, 2.0], "extra": None}), ({"id": 2}, None)], c.wanted(SCHEMA, ["id"], Export()))
    _, up, gone = calls(tmp_path / "log")
    assert up[-1] == {"ids": ["1"], "metadatas": [{"id": 1}], "embeddings": [[1.0, 2.0]], "documents": ["a"]} and gone[-1] == {"ids": ["2"]}

    t = LanceDB(None, "t", optimize_after=1)
    spec = t.wanted(SCHEMA, ["id"], Export([VectorIndexDef("v")]))
    assert [m for m, _ in t.change(None, spec)] == ["create_table", "create_index"] and t.change(spec, spec) == []
    t.mutate(client, [({"id": 1}, {"text": "a"}), ({"id": "o'n"}, None)])
    names = calls(tmp_path / "log")
    assert [x[0] for x in names] == ["open_table", "merge_insert", "when_matched_update_all", "when_not_matched_insert_all", "execute", "delete", "optimize"] and names[5][1] == "(id = 'o''n')"


EDGE = Relationships("KNOWS", NodeFromFields("P", (TargetFieldMapping("a", "name"),)), NodeFromFields("P", (TargetFieldMapping("b", "name"), TargetFieldMapping("age"))))


def test_graphs_delete_relationships_first_and_write_them_last(spark, tmp_path):
    folder = str(tmp_path / "log")
    flow, current = Flow("g"), {"p": [("ann", 1), ("bob", 2)], "e": [(1, "ann", "bob", 5)]}
    flow.declare(NodeDeclaration("P", ("name",)))
    people, edges = flow.add_collector("people"), flow.add_collector("edges")
    with flow.add_source(Table(lambda s: s.createDataFrame(current["p"], "name string, n long"), ["name"]), name="p").row() as r:
        people.collect(name=r["name"], n=r["n"])
    with flow.add_source(Table(lambda s: s.createDataFrame(current["e"], "id long, a string, b string, age long"), ["id"]), name="e").row() as r:
        edges.collect(id=r["id"], a=r["a"], b=r["b"], age=r["age"])
    edges.export("knows", Neo4j(partial(Log, folder), EDGE, declared(flow)), primary_key_fields=["id"])
    people.export("people", Neo4j(partial(Log, folder), Nodes("P"), declared(flow)), primary_key_fields=["name"])
    indexer = Indexer(flow, spark, str(tmp_path / "x"))
    indexer.update()
    said = calls(folder)
    assert [s[1].split()[0] for s in said][:2] == ["CREATE", "CREATE"] and "MERGE (s)-[r:`KNOWS` {`id`: row.key.`id`}]->(t)" in said[-1][1]
    assert said[-1][2] == [{"key": {"id": 1}, "source": {"key": {"name": "ann"}, "properties": {}}, "target": {"key": {"name": "bob"}, "properties": {"age": 5}}, "properties": {}}]
    assert sorted(row["key"]["name"] for s in said[2:-1] for row in s[2]) == ["ann", "bob"]
    current["p"], current["e"] = [("ann", 1), ("cat", 3)], [(2, "cat", "ann", 7)]
    indexer.update()
    said = calls(folder)
    assert "DELETE r" in said[0][1] and said[0][2] == [{"key": {"id": 1}}] and "MERGE (s)" in said[-1][1]
    assert any("REMOVE n.`_own`" in s[1] and s[2] == [{"key": {"name": "bob"}}] for s in said[1:-1])
    indexer.drop()
    assert [s[1] for s in calls(folder)][0] == "MATCH ()-[r:`KNOWS`]->() DELETE r"


def test_graph_dialects():
    edge = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("age", T.LongType()), T.StructField("since", T.DateType())])
    node = T.StructType([T.StructField("name", T.StringType()), T.StructField("v", T.ArrayType(T.FloatType()), True, DIM)])
    index = Export([VectorIndexDef("v")], [FtsIndexDef("name")])
    f = FalkorDB(None, Nodes("P"), {})
    assert f.change(None, f.wanted(node, ["name"], index)) == ["CREATE INDEX FOR (n:`P`) ON (n.`name`)", "CREATE VECTOR INDEX FOR (n:`P`) ON (n.`v`) OPTIONS {dimension: 2, similarityFunction: 'cosine'}", "CALL db.idx.fulltext.createNodeIndex('P', 'name')"]
    f = FalkorDB(None, EDGE, {"P": ("name",)})
    assert len(f.delete(["id"])) == 2 and f.delete(["id"])[1].startswith("MATCH (n:`P`)")
    b = Ladybug(None, EDGE, {"P": ("name",)})
    spec = b.wanted(edge, ["id"], Export())
    assert b.change(None, spec) == ["CREATE NODE TABLE IF NOT EXISTS `P` (`name` STRING, `age` INT64, `_own` BOOL, PRIMARY KEY (`name`))", "CREATE REL TABLE IF NOT EXISTS `KNOWS` (FROM `P` TO `P`, `id` INT64, `since` DATE)"]
    rows, gone = b.rows_of([({"id": 1}, {"a": "x", "b": "y", "age": 1, "since": None, "_gone": True})])
    assert rows == [] and gone == [{"key": {"id": 1}, "source": {"key": {"name": "x"}, "properties": {}}, "target": {"key": {"name": "y"}, "properties": {"age": 1}}}]
    assert b.delete(["id"])[0] == "UNWIND $rows AS row MATCH (s:`P` {`name`: row.source.key.`name`})-[r:`KNOWS` {`id`: row.key.`id`}]->(t:`P` {`name`: row.target.key.`name`}) DELETE r"
    n = Ladybug(None, Nodes("P"), {})
    assert n.change(n.wanted(node, ["name"], Export()), n.wanted(T.StructType([node["name"]]), ["name"], Export())) == ["ALTER TABLE `P` DROP `v`"]
    with pytest.raises(ValueError, match="no name"):
        b.rows_of([({"id": 1}, {"a": None, "b": "y", "age": 1, "since": None})])


def test_plain_values():
    import datetime

    import numpy as np
    import pandas as pd

    assert plain({"a": np.array([1.5, 2.0]), "b": float("nan"), "c": pd.NaT, "d": np.int64(3), "e": datetime.date(2024, 1, 2), "f": [np.array([1.0])]}) == {"a": [1.5, 2.0], "b": None, "c": None, "d": 3, "e": "2024-01-02", "f": [[1.0]]}


def test_facts_of_types_reach_targets_from_operators(spark, tmp_path):
    """A flow that embeds chunks: the length of its vectors and the UUID are known to both stores from setup alone."""
    from rillspark.flow import GeneratedField
    from rillspark.functions.model import embed_text
    from rillspark.functions.split import split_recursively
    from rillspark.functions.udf import function
    from rillspark.types import Vector

    @function()
    def direction(text: str) -> Vector[float, 3]:
        return [float(len(text)), 0.0, 1.0]

    folder, flow = str(tmp_path / "log"), Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(Table(lambda s: s.createDataFrame([(1, "some words to embed"), (2, "more")], "id long, text string"), ["id"]), name="s").row() as r:
        whole = r["text"].transform(direction)
        r["chunks"] = r["text"].transform(split_recursively, 1000, 300, 100)
        with r["chunks"].row() as chunk:
            out.collect(key=GeneratedField.UUID, id=r["id"], text=chunk["text"], v=chunk["text"].transform(embed_text, dimension=8), w=whole)
    out.collect(key=GeneratedField.UUID, id=flow.sources["s"]["id"], text=flow.sources["s"]["text"], v=flow.sources["s"]["text"].transform(embed_text, dimension=8), w=whole)
    out.export("table", Postgres(partial(Log, folder), "docs"), primary_key_fields=["key"], vector_indexes=[VectorIndexDef("v")])
    out.export("points", Qdrant(partial(Log, folder), "c"), primary_key_fields=["key"], vector_indexes=[VectorIndexDef("w", "L2Distance")])
    indexer = Indexer(flow, spark, str(tmp_path / "x"))
    done = indexer.setup()
    assert done["table"][1] == 'CREATE TABLE IF NOT EXISTS docs ("key" uuid NOT NULL, "id" bigint, "text" text, "v" vector(8), "w" vector(3), PRIMARY KEY ("key"))'
    assert done["points"] == [("create_collection", {"collection_name": "c", "vectors_config": {"v": {"size": 8, "distance": "Cosine"}, "w": {"size": 3, "distance": "Euclid"}}})]
    calls(folder)
    indexer.update()
    points = [p for c in calls(folder) if c[0] == "upsert" for p in c[-1]["points"]]
    assert len(points) == 4 and all(len(p["vector"]["v"]) == 8 and p["vector"]["w"][2] == 1.0 and set(p["payload"]) == {"id", "text"} for p in points)
