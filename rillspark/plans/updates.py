"""Queries of incremental updates: diffs, ordinals, keyed targets, live runs."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.flow import Flow
from rillspark.functions.udf import function
from rillspark.operators.incremental import Indexer, latest, memoized
from rillspark.sinks.keyed import KeyedTarget
from rillspark.sinks.stores import Store
from rillspark.sinks.targets import Stored, evaluate_and_dump
from rillspark.session import shared_dir
from rillspark.sources.files import Files
from rillspark.sources.tables import Table
from rillspark.streaming.live import LiveUpdater, apply_changes, windowed_counts

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: An edit of the orders: those with status P are new, urgent ones without status P have gone, those with status F have a
#: changed price, and the rest only a later ordinal.
OLD = "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P'"
NEW = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority <> '1-URGENT'"


def old_orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice", "o_orderdate")


def new_orders(spark, sf) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").where("o_orderstatus = 'P' OR o_orderpriority <> '1-URGENT'").select("o_orderkey", price.alias("o_totalprice"), "o_orderdate")


def diff(spark, sf) -> DataFrame:
    """The old orders indexed, then what the engine would do with the new ones."""
    current = {"rows": old_orders}
    indexer = Indexer(order_flow(lambda s: current["rows"](s, sf)), spark, scratch(spark, "diff"))
    indexer.update()
    current["rows"] = new_orders
    return indexer.changes("source_0")


ACTIONS = f"""WITH a AS ({OLD}), b AS ({NEW}), d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
CASE WHEN b.o_orderkey IS NULL THEN 'delete' WHEN a.o_orderkey IS NULL THEN 'insert' WHEN a.o_totalprice = b.o_totalprice THEN 'no_change' ELSE 'update' END AS action FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


@query(f"{ACTIONS} SELECT o_orderkey, action FROM d")
def incremental_update(spark, sf):
    return diff(spark, sf).select("o_orderkey", "action")


@query(f"{ACTIONS} SELECT action, count(*) AS n FROM d GROUP BY action")
def update_stats(spark, sf):
    return diff(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, max_by(value, ts) AS value FROM events GROUP BY user_id, event_type")
def ordinal_dedupe(spark, sf):
    """Events as versions of (user, type): the latest of each key counts, whatever the order of arrival."""
    e = table(spark, sf, "events").withColumn("ordinal", F.unix_micros(F.col("ts").cast("timestamp")))
    return latest(e.select("user_id", "event_type", "value", "ordinal"), ["user_id", "event_type"], "ordinal").select("user_id", "event_type", "value")


def order_flow(rows, target=None) -> Flow:
    flow = Flow("orders")
    out = flow.add_collector("out")
    with flow.add_source(Table(rows, ["o_orderkey"], ordinal_column=None)).row() as o:
        cents = flow.transform(lambda p: F.round(p * 100).cast("bigint"), o["o_totalprice"])
        out.collect(o_orderkey=o["o_orderkey"], cents=cents)
    out.export("orders", target or Stored(), primary_key_fields=["o_orderkey"])
    return flow


def synced(spark, sf, *states) -> KeyedTarget:
    """A target kept in sync through the states of a source, one update each."""
    path, current = scratch(spark, "sync"), {"rows": states[0]}
    flow = order_flow(lambda s: current["rows"](s, sf))
    indexer = Indexer(flow, spark, path)
    for rows in states:
        current["rows"] = rows
        flow.sources["source_0"].source.__dict__.pop("_schema", None)
        indexer.update()
    return indexer.target(flow.collectors[0].exports[0])


CENTS = "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM ({})"


@query(CENTS.format(OLD))
def export_upsert(spark, sf):
    return synced(spark, sf, old_orders).read().select("o_orderkey", "cents")


@query(CENTS.format(NEW))
def export_delete(spark, sf):
    return synced(spark, sf, old_orders, new_orders).read().select("o_orderkey", "cents")


@query(f"WITH a AS ({OLD}), b AS ({NEW}) SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def export_merge(spark, sf):
    """Matched keys updated, others inserted, nothing deleted: a merge without a listing."""
    target = KeyedTarget(spark, scratch(spark, "merge"), ["o_orderkey"])
    for rows in (old_orders, new_orders):
        df = rows(spark, sf).select("o_orderkey", "o_totalprice", F.lit("s").alias("_source"), F.lit("").alias("_owner"))
        target.merge(df, spark.createDataFrame([], "_key string, _source string, _owner string"))
    return target.read().select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, length(text) + 1 AS output FROM documents")
def memoized_function(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    compute = lambda df: df.withColumn("output", F.length("text") + 1)
    _, memo = memoized(docs.where("lang = 'en'"), None, ["text"], "plus_one/1", compute)
    return memoized(docs, memo, ["text"], "plus_one/1", compute)[0].select("doc_id", "output")


@query(CENTS.format(NEW))
def custom_target(spark, sf):
    """A connector that writes the changes it gets as JSON rows of one key each, by task and update; what they leave is read
    back from there."""
    from rillspark.sinks.targets import CustomTarget

    path = scratch(spark, "custom")
    changes = re.sub("^file:(//)?", "", f"{path}/changes")
    current = {"rows": old_orders, "update": 0}

    def connector() -> CustomTarget:
        return CustomTarget(json_changes, partial(change_file, changes, current["update"]))

    flow = order_flow(lambda s: current["rows"](s, sf), connector())
    indexer = Indexer(flow, spark, path)
    indexer.update()
    current.update(rows=new_orders, update=1)
    flow.collectors[0].exports[0].target.prepare = connector().prepare
    indexer.update()
    sent = spark.read.schema("update int, o_orderkey bigint, deleted boolean, cents bigint").json(changes)
    last = sent.groupBy("o_orderkey").agg(F.max_by(F.struct("deleted", "cents"), "update").alias("last"))
    return last.where("NOT last.deleted").select("o_orderkey", "last.cents")


def change_file(folder: str, update: int) -> tuple[str, int]:
    """A new file of a task, and which update it's of."""
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{update}-{uuid.uuid4().hex}.json", update


def json_changes(ready: tuple[str, int], changes: list[tuple[dict, dict | None]]) -> None:
    path, update = ready
    with open(path, "a") as f:
        f.writelines(json.dumps({"update": update, **key, "deleted": value is None, **(value or {})}) + "\n" for key, value in changes)


@query()
def scan_local_file(spark, sf):
    """All Parquet files of the tables as binary sources, read whole: name, size and digest of what is in them."""
    return Files(sf, binary=True, included_patterns=["*.parquet"]).digests(spark).select("filename", "size", "digest")


@query(f"""SELECT '---' || chr(10) || '"key":' || chr(10) || '  "o_orderkey": ' || o_orderkey || chr(10) || '"exports":' || chr(10) || '  "out":' || chr(10) || '    -' || chr(10) || '      "o_orderkey": ' || o_orderkey || chr(10)
    || '      "cents": ' || cents AS document FROM ({CENTS.format(OLD)})""")
def evaluate_dump(spark, sf):
    """Each order's document, read back."""
    path = scratch(spark, "dump")
    evaluate_and_dump(order_flow(lambda s: old_orders(s, sf)), spark, path)
    whole = spark.read.option("lineSep", "---\n").text(path).where("value != ''")
    return whole.select(F.concat(F.lit("---\n"), F.rtrim(F.col("value"), F.lit("\n"))).alias("document"))


@query(CENTS.format(NEW))
def live_interval(spark, sf):
    current = {"rows": old_orders}
    indexer = Indexer(order_flow(lambda s: current["rows"](s, sf)), spark, scratch(spark, "live"))
    with LiveUpdater(indexer, refresh_interval=1.0) as live:
        live.next_status_updates()
        current["rows"] = new_orders
        for _ in range(100):  # a pass may have begun with the old rows; a dead ticker leaves them
            if any(set(s.stats["source_0"]) - {"no_change"} for s in live.next_status_updates()):
                break
    return indexer.target(indexer.flow.collectors[0].exports[0]).read().select("o_orderkey", "cents")


@query("SELECT user_id, event_type, max_by(value, ts) AS value FROM events GROUP BY user_id, event_type")
def live_stream(spark, sf):
    """Events as a stream of changes merged into a keyed target, the latest version of each key."""
    path = scratch(spark, "stream")
    changes = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return streamed(changes, path).select("user_id", "event_type", "value")


def streamed(changes: DataFrame, path: str, deleted: str | None = None) -> DataFrame:
    """What a stream of events leaves in a keyed target."""
    target = KeyedTarget(changes.sparkSession, f"{path}/target", ["user_id", "event_type"])
    changes = changes.withColumn("ordinal", F.unix_micros(F.col("ts").cast("timestamp"))).select("user_id", "event_type", "value", "ordinal", *([deleted] if deleted else []))
    apply_changes(changes, target, "ordinal", f"{path}/checkpoint", deleted).awaitTermination()
    return target.read()


#: Events that delete their key.
GOES = "event_id % 5 = 0"


@query(f"SELECT user_id, event_type, last.value AS value FROM (SELECT user_id, event_type, max_by({{'value': value, 'gone': {GOES}}}, ts) AS last FROM events GROUP BY user_id, event_type) WHERE NOT last.gone")
def live_stream_batches(spark, sf):
    """The same events out of order in eight files, a micro-batch each, of which some delete their key: the first file has the
    newest, so that most changes come too late."""
    path = scratch(spark, "batches")
    events = table(spark, sf, "events").withColumn("gone", F.expr(GOES))
    events.repartitionByRange(8, F.col("event_id").desc()).write.parquet(f"{path}/events")
    changes = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
    return streamed(changes, path, "gone").select("user_id", "event_type", "value")


@dataclass
class JsonStore(Store):
    """A store in a folder: changes as JSON lines, a file for each task and update; another index drops them all."""

    folder: str
    index: str

    def connect(self) -> str:
        return self.folder

    def place(self) -> str:
        return self.folder

    def wanted(self, schema, keys, export) -> dict:
        return {"index": self.index, "keys": list(keys), "columns": {f.name: f.dataType.simpleString() for f in schema}}

    def change(self, old, new) -> list:
        return ([("drop_table", {})] if old and old != new else []) + ([("create_table", {})] if new and old != new else [])

    def run(self, client, steps) -> None:
        for name, _ in steps:
            if name == "drop_table":
                shutil.rmtree(client)
            os.makedirs(client, exist_ok=True)

    def mutate(self, client, changes, spec=None) -> None:
        with open(f"{client}/{time.time_ns()}-{uuid.uuid4().hex}.json", "w") as f:
            f.writelines(json.dumps({"at": time.time_ns(), **key, "deleted": value is None, **(value or {})}) + "\n" for key, value in changes)

    def read(self, spark: SparkSession, columns: str) -> DataFrame:
        """What the changes leave."""
        sent = spark.read.schema(f"at bigint, o_orderkey bigint, deleted boolean, {columns}").json(self.folder)
        last = sent.groupBy("o_orderkey").agg(F.max_by(F.struct(*[c for c in sent.columns if c != "o_orderkey"]), "at").alias("last"))
        return last.where("NOT last.deleted").select("o_orderkey", "last.*").drop("at", "deleted")


def local(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


@query(CENTS.format(NEW))
def export_redefined(spark, sf):
    """A store whose index changes between two updates, so that it is made anew: rows that didn't change are sent again as
    well, with those that did."""
    path, current = scratch(spark, "redefined"), {"rows": old_orders}
    for index, rows in (("a", old_orders), ("b", new_orders), ("b", new_orders)):
        current["rows"] = rows
        store = JsonStore(local(f"{path}/store"), index)
        Indexer(order_flow(lambda s: current["rows"](s, sf), store), spark, path).update()
    return store.read(spark, "cents bigint")


@function()
def next_odd(x: int) -> int:
    return x + 2


BIG = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {} + 2 * o_orderkey END"


@query(f"SELECT o_orderkey, {BIG.format(9007199254740995)} AS big FROM orders")
def whole_integers(spark, sf):
    """Integers that floats don't hold, beside nulls, through a Python function and a store."""
    path = scratch(spark, "integers")
    flow, store = Flow("integers"), JsonStore(local(f"{path}/store"), "a")
    out = flow.add_collector("out")
    with flow.add_source(Table(lambda s: table(s, sf, "orders").selectExpr("o_orderkey", f"{BIG.format(9007199254740993)} AS x"), ["o_orderkey"])).row() as o:
        out.collect(o_orderkey=o["o_orderkey"], big=o["x"].transform(next_odd))
    out.export("integers", store, primary_key_fields=["o_orderkey"])
    Indexer(flow, spark, path).update()
    return store.read(spark, "big bigint")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """Beyond keyed updates: tumbling windows, with the same plan for a stream."""
    out = windowed_counts(table(spark, sf, "events"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("at"), "event_type", "n", F.round("total", 2).alias("total"))


