"""Incremental updates as joins: which rows changed in data or in logic, what they give now, what to write and delete.

Tracking holds one row per source row: its ordinal and the hashes of its content and of the flow's logic when it was
processed; targets know the owner of each of their rows. A first update and all later ones run the same plan. Sources are
listed by keys and ordinals; values are asked for of the keys alone that these don't settle, and what comes from files or
connectors is kept until the update ends, so that it is fetched once. Rows that didn't change are not evaluated. Targets
are written before tracking, so that a run that breaks off between is repeated with the same result. Passes of one indexer
wait for each other; two processes that update one folder both commit if they have no rows in common, else the later one
fails and is to be repeated.

Sources and the resources of exports have identities, kept with the tracking: a number, and for a resource the version of
its schema. A resource that is built anew, or that users set up otherwise than before, is another one; one that loses or
retypes columns has a new version. Both are part of the logic that a row went through, so that all rows are processed and
sent again; names of exports aren't.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.flow import Flow
from rillspark.schema import compatibility
from rillspark.sinks.keyed import NAMED, OWN, Conflict, Folder, KeyedTarget, any_of, key_json, row_fp
from rillspark.sinks.targets import JdbcTable, Stored
from rillspark.types import loosened

ACTIONS = ("no_change", "insert", "update", "reprocess", "delete")
TRACKING = "source string, key string, ordinal bigint, content_fp string, logic_fp string, process_ordinal bigint"


def action(listed: Column, tracked: Column, ordinal: Column, old_ordinal: Column, same_logic: Column, same_content: Column) -> Column:
    """What to do with a row that is listed, tracked or both. Without an ordinal nothing is skipped by it; a row of the
    same content is processed anew only for other logic."""
    stale = F.coalesce(ordinal < old_ordinal, F.lit(False)) | (F.coalesce(ordinal == old_ordinal, F.lit(False)) & same_logic)
    return (
        F.when(~listed, "delete").when(~tracked, "insert").when(stale, "no_change")
        .when(F.coalesce(same_content, F.lit(False)), F.when(same_logic, "no_change").otherwise("reprocess")).otherwise("update")
    )


def latest(changes: DataFrame, keys: list[str], ordinal: str, tracked: DataFrame | None = None) -> DataFrame:
    """Of changes to one key that with the largest ordinal (one without any counts as the latest), unless tracked
    (keys, ordinal) is as new."""
    order = F.coalesce(F.col(ordinal), F.lit(2**63 - 1))
    rows = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
    if tracked is None:
        return rows
    old = tracked.select(*keys, F.col(ordinal).alias("_old"))
    return rows.join(old, keys, "left").where(F.col("_old").isNull() | F.col(ordinal).isNull() | (F.col(ordinal) > F.col("_old"))).drop("_old")


def resource(export) -> str:
    """What an export writes to, whatever its own name: a place, a table or a connector."""
    target, kind = export.target, type(export.target).__name__
    name = target.path or export.name if isinstance(target, Stored) else getattr(target, "place", lambda: None)() or (target.table if isinstance(target, JdbcTable) else export.name)
    return f"{kind}:{name}"


def logic_fingerprint(flow: Flow, source: str, version: Any = None, registry: dict | None = None) -> str:
    """Of what a source's rows go through: the plan of each collector that they reach, the exports' keys, and the identities
    of the source and of the resources."""
    made = registry or {"sources": {}, "targets": {}}
    identity = lambda e: [made["targets"].get(resource(e), {}).get(k) for k in ("id", "schema_version")]
    spark = SparkSession.active()
    scope, parts = flow.sources[source], []
    for c in flow.collectors:
        mine = [p for p in c.parts if scope in p.scope.ancestors()]
        if mine and c.exports:
            shown = [(p.scope.name, sorted(p.values), [str(make()) for s in p.scope.ancestors() for _, make in s.ops], [str(v.col()) if hasattr(v, "col") else repr(v) for v in p.values.values() if not callable(getattr(v, "alias", None))]) for p in mine]
            parts.append((c.name, [(identity(e), e.primary_key_fields) for e in c.exports], shown))
    return hashlib.blake2b(json.dumps([parts, made["sources"].get(source, {}).get("id"), str(version), spark.version], default=str).encode(), digest_size=16).hexdigest()


@dataclass
class Update:
    stats: dict[str, dict[str, int]]

    def __str__(self) -> str:
        return "; ".join(f"{s}: {', '.join(f'{n} {a}' for a, n in sorted(d.items()))}" for s, d in self.stats.items())


@contextmanager
def limits(spark: SparkSession, of_sources: list[tuple[int | None, int | None]]):
    """Rows and bytes that a task hands to Python at once, no more than any source allows in flight."""
    names, before = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"), {}
    for name, found in zip(names, zip(*of_sources)):
        if least := min(filter(None, found), default=None):
            before[name] = spark.conf.get(name, None)
            spark.conf.set(name, str(least))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


class Indexer:
    """A flow and the folder that holds its tracking and targets. version: anything that stands for the logic beyond
    the plan, such as behaviour versions of functions."""

    def __init__(self, flow: Flow, spark: SparkSession, path: str, version: Any = None):
        self.flow, self.spark, self.folder, self.version, self.lock = flow, spark, Folder(spark, path), version, threading.RLock()
        self.made: dict | None = None  # the registry of a pass that hasn't ended

    def exports(self):
        return [(c, e) for c in self.flow.collectors for e in c.exports]

    def target(self, export) -> KeyedTarget:
        path = export.target.path if isinstance(export.target, Stored) and export.target.path else f"{self.folder.path}/targets/{self.registry()['targets'].get(resource(export), {}).get('id', 'none')}"
        return KeyedTarget(self.spark, path, export.primary_key_fields)

    def state(self) -> dict:
        return self.numbered_state()[1]

    def numbered_state(self) -> tuple[int, dict]:
        number, state = self.folder.numbered_state("tracking")
        return number, state or {"version": 0, "registry": {"last": 0, "sources": {}, "targets": {}}}

    def registry(self) -> dict:
        return self.made or self.state()["registry"]

    def tracked(self) -> KeyedTarget:
        return KeyedTarget(self.spark, f"{self.folder.path}/tracked", ["_source", "_owner"])

    def tracking(self, owners: list[tuple[str, str]] | None = None) -> DataFrame:
        rows = self.tracked().rows(owners=owners)
        if rows is None:
            return self.spark.createDataFrame([], TRACKING)
        return rows.select(F.col("_source").alias("source"), F.col("_owner").alias("key"), "ordinal", "content_fp", "logic_fp", "process_ordinal")

    def schemas(self) -> dict[str, T.StructType]:
        """The schema of what each collector gives; nothing is run."""
        none = {n: self.spark.createDataFrame([], s.source.schema()) for n, s in self.flow.sources.items()}
        return {n: df.schema for n, df in self.flow.compile(self.spark, none).items()}

    def identified(self, schemas: dict[str, T.StructType]) -> tuple[dict, set[str]]:
        """The registry of sources and resources as the flow now has them, and the resources that are to be filled anew."""
        have, built, fresh = self.state()["registry"], self.folder.read("setup") or {}, set()
        out = {"last": have["last"], "sources": {}, "targets": {}}

        def number(old: dict | None) -> int:
            if old:
                return old["id"]
            out["last"] += 1
            return out["last"]

        for name, scope in self.flow.sources.items():
            schema, old = scope.source.schema(), have["sources"].get(name)
            keys = [[k, schema[k].dataType.simpleString()] for k in scope.source.keys]
            out["sources"][name] = {"id": number(old if old and old["keys"] == keys else None), "keys": keys}
        for c, e in self.exports():
            at, schema = resource(e), schemas[c.name]
            if at in out["targets"]:
                raise ValueError("two exports write to one resource")
            columns = {f.name: f.dataType.simpleString() for f in schema}
            if hasattr(e.target, "wanted"):
                columns |= e.target.wanted(schema, e.primary_key_fields, e).get("columns", {})
            spec = {"keys": e.primary_key_fields, "columns": columns, "by_user": e.setup_by_user, "generation": built.get(at, {}).get("generation", 0)}
            old = have["targets"].get(at)
            gone = old and any(columns.get(n) != t for n, t in old["columns"].items())
            same = old and all(old[k] == spec[k] for k in ("keys", "by_user", "generation")) and all(old["columns"].get(k) == columns.get(k) for k in e.primary_key_fields)
            newest = (old or {}).get("schema_version", 0)
            version = newest if same and not gone else newest + 1
            if version > newest:
                fresh.add(at)
            out["targets"][at] = spec | {"id": number(old if same else None), "schema_version": version}
        return out, fresh

    def changes(self, name: str, mode: str = "normal", keep: str | None = None, told: DataFrame | None = None) -> DataFrame:
        """key (JSON), the key's columns, action, ordinal, content_fp and what was tracked of every row listed or tracked.
        keep: a folder for the listing and for fetched values, so that neither is asked for twice. told: keys of the source,
        `_ordinal` and `_gone`, the only ones that are looked at; nothing is listed then."""
        source, logic = self.flow.sources[name].source, logic_fingerprint(self.flow, name, self.version, self.registry())
        rows = None
        if told is None:
            listed = source.listing(self.spark)
            tracked = self.tracking()
        else:
            told = self.kept(told.withColumn("key", key_json(source.keys)), keep, "told")
            rows = self.kept(source.told(self.spark, told.where("NOT _gone").select(*source.keys)), keep, "values")
            listed = told.drop("key", "_gone").join(rows.select(*source.keys), source.keys, "left_semi")
            names = [r.key for r in told.select("key").limit(NAMED + 1).collect()]
            tracked = self.tracking([(name, k) for k in names]) if len(names) <= NAMED else self.tracking().join(told.select("key"), "key", "left_semi")
        listed = listed.withColumn("key", key_json(source.keys)).withColumn("_listed", F.lit(True))
        tracked = tracked.where(F.col("source") == name).select("key", F.col("ordinal").alias("_old_ordinal"), F.col("content_fp").alias("_old_fp"), F.col("logic_fp").alias("_old_logic"), F.lit(True).alias("_tracked"), F.col("process_ordinal").alias("_p"))
        if self.tracked().state()["schema"] is None:  # all are new, and none is shuffled to see it
            both = listed.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in tracked.schema if f.name != "key"))
        else:
            both = listed.join(tracked, "key", "full")
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        same_logic = F.coalesce(F.col("_old_logic") == logic, F.lit(False)) & F.lit(mode == "normal")
        first = action(yes("_listed"), yes("_tracked"), F.col("_ordinal"), F.col("_old_ordinal"), same_logic, F.lit(False))
        both = self.kept(both.withColumn("action", first), keep, "listed")
        if rows is None:
            rows = source.values(self.spark, both.where("action IN ('insert', 'update')").select(*source.keys))
            rows = self.kept(rows, keep, "values") if source.fetched else rows
        prints = rows.select(key_json(source.keys).alias("key"), row_fp(rows.columns).alias("content_fp"))
        seen = both.join(prints, "key", "left")
        second = action(yes("_listed"), yes("_tracked"), F.col("_ordinal"), F.col("_old_ordinal"), same_logic, F.col("content_fp") == F.col("_old_fp"))
        kind = T.StructType([T.StructField(k, listed.schema[k].dataType) for k in source.keys])
        keys = [F.coalesce(F.col(k), F.from_json("key", kind)[k]).alias(k) for k in source.keys]  # those of rows that went
        return seen.withColumn("action", second).select("key", *keys, "action", F.col("_ordinal").alias("ordinal"), F.coalesce("content_fp", "_old_fp").alias("content_fp"), "_old_ordinal", "_old_fp", "_old_logic", "_p")

    def kept(self, df: DataFrame, folder: str | None, what: str) -> DataFrame:
        if not folder:
            return df
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{what}")
        return self.spark.read.schema(df.schema).parquet(f"{folder}/{what}")

    def update(self, mode: str = "normal", told: dict[str, DataFrame] | None = None) -> Update:
        """One pass over all sources. mode: normal, reexport (every row is evaluated and all that it gives written again) or
        full_reprocess (as if nothing were tracked or stored: targets are emptied first). told: by source the keys that are
        said to have changed (their columns, `_ordinal` and `_gone`); only these are looked at, and no source is listed."""
        with self.lock, limits(self.spark, [s.limits for s in self.flow.sources.values()]):
            try:
                return self.passed(mode, told)
            finally:
                self.made = None

    def passed(self, mode: str, told: dict[str, DataFrame] | None = None) -> Update:
        number, state = self.numbered_state()
        stats: dict[str, dict[str, int]] = {}
        self.drop_stale(state)
        version, folder = state["version"] + 1, f"{self.folder.path}/diff/{uuid.uuid4().hex}"
        schemas = self.schemas()
        self.setup(schemas)
        self.made, fresh = self.identified(schemas)
        if fresh:
            told = None  # all rows are due
        diffs: dict[str, DataFrame] = {}
        for name in self.flow.sources if told is None else told:
            diffs[name] = self.kept(self.changes(name, mode, f"{folder}/{name}", told and told[name]), f"{folder}/{name}", "changes")  # feeds several writes
            stats[name] = {r.action: r["count"] for r in diffs[name].groupBy("action").count().collect()}
        if fresh or any(set(s) - {"no_change"} for s in stats.values()):
            changed = {n: self.rows_of(n, d.where("action IN ('insert', 'update', 'reprocess')"), f"{folder}/{n}") for n, d in diffs.items()}
            changed |= {n: self.spark.createDataFrame([], s.source.schema()) for n, s in self.flow.sources.items() if n not in diffs}
            if mode == "full_reprocess":
                self.folder.delete("memo")
            new = self.flow.compile(self.spark, changed, owned=True, memo=f"{self.folder.path}/memo")
            touched = None
            for n, d in diffs.items():
                part = d.where("action != 'no_change'").select(F.lit(n).alias("_source"), F.col("key").alias("_owner"))
                touched = part if touched is None else touched.union(part)
            self.write_all([(export, new[collector.name]) for collector, export in self.exports()], touched, mode, fresh)
        self.write_tracking(diffs, number, state, version, mode)
        self.folder.delete(folder.removeprefix(f"{self.folder.path}/"))
        return Update(stats)

    def rows_of(self, name: str, wanted: DataFrame, folder: str) -> DataFrame:
        source = self.flow.sources[name].source
        if not source.fetched and not self.folder.names(f"{folder.removeprefix(self.folder.path + '/')}/values"):
            return source.values(self.spark, wanted.select(*source.keys))
        rows = self.spark.read.schema(source.schema()).parquet(f"{folder}/values")
        (key,) = [next(n for n in ("key", "key_", "key__") if n not in rows.columns)]
        return rows.withColumn(key, key_json(source.keys)).join(wanted.select(F.col("key").alias(key)), key, "left_semi").drop(key)

    def setup(self, schemas: dict[str, T.StructType] | None = None) -> dict[str, list]:
        """Brings the targets' resources from what they were to what the flow now wants; what was done for each. Those
        that users set up are left alone, and so are those of exports that the flow no longer has."""
        schemas = schemas or self.schemas()
        stores = [(c, e) for c, e in self.exports() if hasattr(e.target, "wanted")]
        have, done = self.folder.read("setup") or {}, {}
        want = {resource(e): json.loads(json.dumps(e.target.wanted(schemas[c.name], e.primary_key_fields, e))) for c, e in stores}
        if len(want) < len(stores):
            raise ValueError("two exports write to one resource")
        now = dict(have)
        for _, e in stores:
            at = resource(e)
            old = have.get(at, {"spec": None, "generation": 0})
            anew = not e.setup_by_user and e.target.rebuilds(old["spec"], want[at])
            now[at] = {"spec": want[at], "generation": old["generation"] + anew}
            if not e.setup_by_user:
                done[e.name] = e.target.setup(old["spec"], want[at])
        if now != have:
            self.folder.write("setup", now)
        return done

    def write_all(self, rows: list[tuple[Any, DataFrame]], touched: DataFrame, mode: str, fresh: set[str] = frozenset()) -> None:
        """Targets outside get their changes before the engine's own tables, from which they are told, change; of
        relationships first the deletions, then nodes, then the rest."""
        named = [tuple(r) for r in touched.limit(NAMED + 1).collect()]
        owners = named if len(named) <= NAMED else None
        found = [(export, *self.difference(export, df, touched, "reexport" if mode == "normal" and resource(export) in fresh else mode, owners)) for export, df in rows]
        outside = [(e.target, up, gone, e.primary_key_fields) for e, up, _, gone in found if hasattr(e.target, "apply")]
        later = [x for x in outside if getattr(x[0], "after_nodes", False)]
        sent = lambda up: up.drop("_source", "_owner")
        built = self.folder.read("setup") or {}
        specs = {id(e.target): {"spec": built[resource(e)]["spec"]} for e, *_ in found if resource(e) in built}
        for target, up, gone, keys in later:
            target.apply(sent(up).limit(0), gone, keys, **specs.get(id(target), {}))
        for target, up, gone, keys in outside:
            if not getattr(target, "after_nodes", False):
                target.apply(sent(up), gone, keys, **specs.get(id(target), {}))
        for target, up, gone, keys in later:
            target.apply(sent(up), gone.limit(0), keys, **specs.get(id(target), {}))
        for export, up, owned, _ in found:
            self.target(export).merge(up, owned)

    def difference(self, export, rows: DataFrame, touched: DataFrame, mode: str = "normal", owners: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Rows to write, owned rows to take away, and rows that no owner has any more (where the target needs them). Rows with
        the same key and values as before are left alone, unless all are to be written again. Of the old rows only keys,
        owners and hashes of values are read, and only those of the owners if these are few; of rows that may be shared with
        other owners, their buckets."""
        target = self.target(export)
        if mode == "full_reprocess":
            target.drop()
        if export.setup_by_user is False and target.state()["schema"] is not None:
            have, now = T.StructType([f for f in T.StructType.fromJson(target.state()["schema"]) if f.name not in OWN]), loosened(rows.drop("_source", "_owner").schema)
            how = compatibility(have, now, export.primary_key_fields)
            if how == "incompatible":
                target.drop()
            elif have.names != now.names or how == "partial":
                target.evolve(now)
        values = [c for c in rows.columns if c not in ("_source", "_owner")]
        keyed = rows.withColumn("_key", key_json(export.primary_key_fields))
        old = target.rows(columns=[], owners=owners)
        if old is None:
            upserts, gone = rows, self.spark.createDataFrame([], "_key string, _source string, _owner string")
        else:
            mine = old.select("_key", "_source", "_owner", "_fp").join(touched, ["_source", "_owner"], "left_semi")
            upserts = keyed.withColumn("_fp", row_fp(values)).join(mine, ["_key", "_source", "_owner", "_fp"], "left_anti").select(*rows.columns) if mode == "normal" else rows
            gone = mine.join(keyed.select("_key", "_source", "_owner"), ["_key", "_source", "_owner"], "left_anti").select("_key", "_source", "_owner")
        left = None
        if hasattr(export.target, "apply"):
            if old is not None:
                buckets = target.state()["buckets"]
                some = [r[0] for r in gone.select(F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")).distinct().collect()]
                needs = getattr(export.target, "needs_old", False)
                all_ = target.rows(only=some, columns=None if needs else [])
                left = gone.join(all_.join(gone, ["_key", "_source", "_owner"], "left_anti").select("_key"), "_key", "left_anti").join(keyed.select("_key"), "_key", "left_anti")
            else:
                left, needs = gone, False
            if needs:
                left = all_.join(left.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).select(*values)
            else:
                kind = rows.select(F.struct(*export.primary_key_fields).alias("k")).schema["k"].dataType
                left = left.select("_key").distinct().select(F.from_json("_key", kind).alias("k")).select("k.*")
        return upserts, gone, left

    def write_tracking(self, diffs: dict[str, DataFrame], number: int, state: dict, version: int, mode: str) -> None:
        """What differs from before is tracked: rows that were processed, rows that went, and new ordinals of others."""
        rows, gone = None, None
        for name, diff in diffs.items():
            logic, changed = logic_fingerprint(self.flow, name, self.version, self.registry()), F.col("action") != "no_change"
            ordinal = F.greatest(F.coalesce("ordinal", "_old_ordinal"), F.coalesce("_old_ordinal", "ordinal"))
            new = diff.where("action != 'delete'").where(changed | ~ordinal.eqNullSafe(F.col("_old_ordinal")) | ~F.col("content_fp").eqNullSafe(F.col("_old_fp"))).select(
                F.lit(name).alias("_source"), F.col("key").alias("_owner"), ordinal.alias("ordinal"), "content_fp", F.when(changed, logic).otherwise(F.col("_old_logic")).alias("logic_fp"),
                F.when(changed, F.lit(version)).otherwise(F.col("_p")).cast("bigint").alias("process_ordinal"),
            )
            out = diff.where("action = 'delete'").select(F.to_json(F.struct(F.lit(name).alias("_source"), F.col("key").alias("_owner"))).alias("_key"), F.lit(name).alias("_source"), F.col("key").alias("_owner"))
            rows, gone = (new, out) if rows is None else (rows.unionByName(new), gone.unionByName(out))
        if rows is not None:
            self.tracked().merge(rows, gone)
        made = {"version": version, "registry": self.registry(), "sources": list(self.flow.sources)}
        while True:
            try:
                self.folder.write("tracking", made, number)
                break
            except Conflict:
                number, now = self.numbered_state()
                if now["registry"] != state["registry"] or now["registry"] != made["registry"]:
                    raise
                made["version"] = now["version"] + 1
        kept = {t["id"] for t in made["registry"]["targets"].values()}
        for t in state["registry"]["targets"].values():
            if t["id"] not in kept:
                self.folder.delete(f"targets/{t['id']}")

    def drop_stale(self, state: dict) -> None:
        """Rows that a source which is no longer in the flow gave go from all targets."""
        gone = [s for s in state.get("sources", []) if s not in self.flow.sources]
        targets = [self.target(export) for _, export in self.exports()] + [self.tracked()] if gone else []
        for target in targets:
            rows = target.rows()
            if rows is not None:
                target.merge(rows.where("false").drop(*(c for c in OWN if c not in ("_source", "_owner"))), rows.where(F.col("_source").isin(gone)).select("_key", "_source", "_owner"))

    def drop(self) -> None:
        have = self.folder.read("setup") or {}
        for _, export in sorted(self.exports(), key=lambda x: not getattr(x[1].target, "after_nodes", False)):
            if hasattr(export.target, "wanted") and not export.setup_by_user:
                export.target.setup(have.get(resource(export), {}).get("spec"), None)
            self.target(export).drop()
        self.folder.delete("")


def memoized(df: DataFrame, memo: DataFrame | None, inputs: list[str], op_fp: str, compute) -> tuple[DataFrame, DataFrame]:
    """df with `output`, computed only for distinct inputs that memo (input_fp, output) lacks; and the memo of this run,
    without entries that it didn't use. compute(df) adds `output`."""
    keyed = df.withColumn("input_fp", F.md5(F.concat(F.lit(op_fp), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}))))
    wanted = keyed.select("input_fp", *inputs).dropDuplicates(["input_fp"])
    if memo is not None:
        known = memo.join(wanted.select("input_fp"), "input_fp", "left_semi")
        fresh = compute(wanted.join(memo.select("input_fp"), "input_fp", "left_anti")).select("input_fp", "output")
        now = known.select("input_fp", "output").unionByName(fresh)
    else:
        now = compute(wanted).select("input_fp", "output")
    return keyed.join(now, "input_fp", "left").drop("input_fp"), now
