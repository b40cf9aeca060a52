"""Keyed targets in a folder: Parquet in buckets by key, and a state that says which writes of it count.

A writer puts what it changes, rows and marks of deleted ones, into a folder of its own attempt and then commits by the next
number of one small file, which only one writer can make. Whoever finds the number taken looks at what was committed since:
where that has none of the same keys, it commits its attempt after it; else it fails and nothing has changed. Readers see
the attempts of one state, in the order of their versions, and keep the latest version of each owner's row; of rows with
ordinals that with the largest, whenever it came, so that late changes change nothing and marks of deleted rows stay. A
bucket with many versions is compacted to one, and when buckets grow too large their number does, so that the cost of an
update follows what it changes. Attempts that are replaced stay for one more compaction, for readers of the state before.
Rows of several owners may share a key; readers get that of the latest update, of two from one update that of the larger
owner.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.types import loosened

#: Versions of a bucket from which on it is compacted, and rows of a bucket, on average, above which there are four times
#: as many.
DELTAS, LARGE = 6, 4_000_000
OWN = ["_key", "_source", "_owner", "_version", "_ordinal", "_fp", "_deleted"]
#: Age in seconds of an attempt that no state names, after which a compaction takes it away: its writer has gone.
LEFT = 86_400
#: Owners that a read is told by name, so that files and row groups without them aren't read.
NAMED = 100
LAST = 2**63 - 1


class Conflict(OSError):
    """Another writer has committed what this one was to change."""


class Folder:
    """Small files and deletions through Hadoop's file systems, local or not."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def numbered(self, name: str) -> dict[int, str]:
        """The files that hold the states of `name`, by number."""
        return {int(m[1]): f for f in self.names() if (m := re.fullmatch(rf"{re.escape(name)}-(\d+)\.json", f))}

    def numbered_state(self, name: str) -> tuple[int, dict | None]:
        """The number of the latest state of `name` and the state; 0 and None before the first."""
        found = self.numbered(name)
        if not found:
            return 0, None
        stream = self.fs.open(self.at(found[max(found)]))
        try:
            return max(found), json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, name: str) -> dict | None:
        """The latest state of `name`."""
        return self.numbered_state(name)[1]

    def write(self, name: str, value: dict, after: int | None = None) -> int:
        """The next state of `name`, or that after the one that was read, whole or not at all: written beside and moved to a
        number that has no file, so that the one before counts until then, and of two writers one fails."""
        found = self.numbered(name)
        number, beside = (max(found, default=0) if after is None else after) + 1, self.at(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if number <= max(found, default=0) or not self.moved(beside, self.at(f"{name}-{number}.json")):
            self.fs.delete(beside, False)
            raise Conflict(f"{name}: another update has written state {number}")
        for n, f in found.items():
            if n < number - 1:
                self.fs.delete(self.at(f), False)
        return number

    def moved(self, beside, to) -> bool:
        """Whether the file got a name that had none. Local files get it by a link and others by a move that doesn't replace,
        each of which the file system grants to one writer."""
        from py4j.protocol import Py4JJavaError

        try:
            if self.fs.getUri().getScheme() == "file":
                path = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(path(to), path(beside))
                self.fs.delete(beside, False)
            else:
                options = self.jvm.org.apache.hadoop.fs.Options
                kinds = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.NONE.getClass(), 1)
                kinds[0] = options.Rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(beside, to, kinds)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def key_json(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def row_fp(columns: list[str]) -> Column:
    """MD5 in base 64 without its filling, as it is written and shuffled with each row: 22 characters."""
    return F.substring(F.base64(F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))), 1, 22) if columns else F.lit("")


def any_of(column: str, values: list[str]) -> Column:
    """The column is one of values, as equalities that reach the files' Bloom filters; they are joined in pairs, so that the
    expression isn't deep."""
    found = [F.col(column) == v for v in sorted(set(values))] or [F.lit(False)]
    while len(found) > 1:
        found = [a | b for a, b in zip(found[::2], found[1::2])] + found[len(found) // 2 * 2 :]
    return found[0]


class KeyedTarget:
    """One target: its rows with `_key`, `_source`, `_owner`, `_version` (the update that wrote them), `_ordinal` (null where
    there is none) and `_fp` (their values' hash). buckets: how many to begin with; by default as many as a shuffle has
    partitions. by: keys whose values alone say in which bucket a row is, so that those of some values are read alone."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int | None = None, by: list[str] | None = None):
        self.spark, self.folder, self.keys, self.first, self.by = spark, Folder(spark, path), keys, buckets, by

    def bucket(self, buckets: int, has: dict[str, str] | None = None) -> Column:
        """The bucket by `_key`, or by columns that hold the values of `by`: has, the name of each. They are null in marks."""
        told = lambda c: F.get_json_object("_key", f"$.{c}")
        of = [F.coalesce(F.col(f"`{has[c]}`").cast("string"), told(c)) if has else told(c) for c in self.by] if self.by else ["_key"]
        return F.pmod(F.xxhash64(*of), F.lit(buckets)).cast("int")

    def buckets_of(self, values: list[tuple]) -> list[int]:
        """The buckets of rows that have some values of `by`."""
        if not values:
            return []
        given = F.lit(json.dumps([dict(zip(self.by, v)) for v in values]))  # one literal, and no task of Python
        kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in self.by]))
        rows = self.spark.range(0, 1, 1, 1).select(F.explode(F.from_json(given, kind)).alias("v")).select(F.to_json("v").alias("_key"))
        return sorted({r[0] for r in rows.select(self.bucket(self.state()["buckets"])).collect()})

    def numbered_state(self) -> tuple[int, dict]:
        number, state = self.folder.numbered_state("state")
        return number, state or {"version": 0, "buckets": self.first or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "base": [], "deltas": [], "rows": [], "schema": None, "attempts": {}, "replaced": [], "names": {}, "used": []}

    def state(self) -> dict:
        """base: of each bucket the version that holds all of it; deltas: how many came after; rows: how many were written;
        attempts: the version of each; replaced: those that the last compaction has made needless; names: of each value column
        what it is called in files, and as what type, the newest first; used: all names that files may have."""
        return self.numbered_state()[1]

    def written(self, state: dict, only: list[int] | None = None) -> DataFrame:
        """What counts of all versions, marks of deleted rows included."""
        schema = T.StructType.fromJson(state["schema"])
        if not state["attempts"]:
            return self.spark.createDataFrame([], T.StructType([*schema, T.StructField("_bucket", T.IntegerType())]))
        files = T.StructType([T.StructField(n, T.StructType.fromJson(t)["x"].dataType) for f in schema for n, t in state["names"].get(f.name, [])] + [f for f in schema if f.name in OWN])
        files = T.StructType([*files, T.StructField("_a", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        top = f"{self.folder.path}/rows"
        rows = self.spark.read.schema(files).option("basePath", top).parquet(*(f"{top}/_a={a}" for a in state["attempts"]))
        version = F.element_at(F.create_map(*(F.lit(x) for a, v in state["attempts"].items() for x in (a, v))), F.col("_a")).cast("bigint")
        base = F.get(F.lit(state["base"]), F.col("_bucket")) if len(set(state["base"])) > 1 else F.lit(state["base"][0])
        rows = rows.where(version >= base)  # of partition columns alone: other files aren't listed for the scan
        if only is not None:
            rows = rows.where(F.col("_bucket").isin(only))
        own = {"_version": F.coalesce("_version", version)}
        as_now = lambda c, f: c if len(state["names"][f.name]) == 1 else c.cast(f.dataType)
        value = lambda f: F.coalesce(*(as_now(F.col(f"`{n}`"), f) for n, _ in state["names"][f.name]))
        return rows.select(*((own.get(f.name, F.col(f.name)) if f.name in OWN else value(f)).alias(f.name) for f in schema), "_bucket")

    def rows(self, only: list[int] | None = None, columns: list[str] | None = None, owners: list[tuple[str, str]] | None = None, having: tuple[str, list] | None = None) -> DataFrame | None:
        """The latest row of each key and owner, of some buckets or all; None before the first update. columns: those of the
        values that are wanted, so that no others are read. owners: (source, owner) whose rows are wanted, few enough to be
        named; files and row groups that have none of them are not read. having: a column of `by` and its wanted values;
        other rows are left out before versions are compared, and row groups without them aren't read."""
        state = self.state()
        return None if state["schema"] is None else self.latest(state, only, columns, owners, having=having)

    def latest(self, state: dict, only: list[int] | None = None, columns: list[str] | None = None, owners: list[tuple[str, str]] | None = None, marks: bool = False, having: tuple[str, list] | None = None) -> DataFrame:
        rows = self.written(state, only)
        if having is not None:  # marks have the value in their keys alone
            c, values = having
            rows = rows.where(F.col(c).isNull() | F.col(c).isin(values)).where(F.col(c).isNotNull() | F.get_json_object("_key", f"$.{c}").isin([str(v) for v in values]))
        if columns is not None:
            rows = rows.select(*columns, *OWN, "_bucket")
        if owners is not None:
            rows = rows.where(any_of("_owner", [o for _, o in owners])).where(F.col("_source").isin(sorted({s for s, _ in owners})))
        if state.get("ordinals") or any(state["deltas"][b] for b in (range(state["buckets"]) if only is None else only)):
            keys = ["_key", "_source", "_owner"]
            rest = [c for c in rows.columns if c not in keys]
            has = F.col("_ordinal").isNotNull()  # of one ordinal the first version counts, without any the last
            order = F.struct(F.coalesce("_ordinal", F.lit(LAST)), F.when(has, -F.col("_version")).otherwise(F.col("_version")), "_fp")
            rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        return rows.drop("_bucket") if marks else rows.where("NOT _deleted").drop("_deleted", "_bucket")

    def read(self) -> DataFrame:
        rows = self.rows()
        if rows is None:
            raise FileNotFoundError(self.folder.path)
        columns = [c for c in rows.columns if not c.startswith("_")]
        best = F.max_by(F.struct(*columns), F.struct("_version", "_source", "_owner"))
        return rows.groupBy("_key").agg(best.alias("r")).select("r.*") if columns else rows.select()

    def put(self, rows: DataFrame, attempt: str, buckets: int, names: dict[str, list], stands: DataFrame | None = None) -> dict[int, int]:
        """Rows written as an attempt, in order of owner (or of key, if buckets go `by` some) and with Bloom filters of it: how many each bucket got. Rows are dealt
        to buckets once; there, of equal keys of one owner, a row counts before a mark and of rows that with the larger hash.
        stands: rows as they stand, of owners whose rows are all given: those that come again are left out, and of those that
        don't come a mark is written."""
        path = f"{self.folder.path}/rows/_a={attempt}"
        keys = ["_bucket", "_key", "_source", "_owner"] if self.by else ["_bucket", "_source", "_owner", "_key"]
        if stands is not None:
            marks = stands.select("_key", "_source", "_owner", "_fp", F.lit(True).alias("_deleted"), F.lit(True).alias("_stands"))
            rows = rows.withColumn("_stands", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        rows = rows.select(*(F.col(f"`{c}`").alias(names[c][0][0]) if c in names else F.col(c) for c in rows.columns))
        has = {c: names[c][0][0] for c in self.by or []}
        alike = all(rows.schema[n].dataType.typeName() in ("string", "byte", "short", "integer", "long") for n in has.values())
        dealt = rows.withColumn("_bucket", self.bucket(buckets, has if alike else None)).repartition(buckets, "_bucket")
        one = Window.partitionBy(*keys)
        if stands is not None:
            dealt = dealt.withColumn("_old", F.max(F.when(F.col("_stands"), F.col("_fp"))).over(one))
        dealt = dealt.withColumn("_n", F.row_number().over(one.orderBy("_deleted", F.desc("_fp")))).where("_n = 1").drop("_n")
        if stands is not None:
            dealt = dealt.where("_deleted OR _old IS NULL OR _fp <> _old").drop("_old", "_stands")
        writer = dealt.sortWithinPartitions(*keys).write.partitionBy("_bucket").option("compression", "zstd").option("parquet.bloom.filter.enabled#_owner", "true").option("parquet.bloom.filter.expected.ndv#_owner", "100000")
        writer.mode("errorifexists").parquet(path)
        if not any(f.isDirectory() for f in self.folder.fs.listStatus(self.folder.at(f"rows/_a={attempt}"))):
            return {}
        counts = self.spark.read.schema("_bucket int").option("basePath", path).parquet(path).groupBy("_bucket").count()
        return {r["_bucket"]: r["count"] for r in counts.collect()}

    def merge(self, upserts: DataFrame, gone: DataFrame | None = None, ordinal: str | None = None, stands: DataFrame | None = None) -> int:
        """Rows of gone (`_key`, `_source`, `_owner`) go, then upserts (columns, `_source`, `_owner`) take the place of
        their owner's rows of the same key. Of equal keys of one owner one stays. The new version is returned. ordinal: a
        column of both that says how new a change is; of one key and owner the newest counts, whatever came before, and
        changes are reduced before they are shuffled. stands: see `put`."""
        keys = ["_key", "_source", "_owner"]
        values = [c for c in upserts.columns if c not in ("_source", "_owner")]
        of = lambda df: df.withColumn("_ordinal", (F.col(ordinal) if ordinal else F.lit(None)).cast("bigint"))
        rows = of(upserts).withColumn("_fp", row_fp(values)).withColumn("_key", key_json(self.keys)).withColumn("_deleted", F.lit(False))
        number, state = self.numbered_state()
        if gone is not None and (ordinal or state["schema"]):
            rows = rows.unionByName(of(gone).select(*keys, "_ordinal").withColumn("_deleted", F.lit(True)), allowMissingColumns=True)
        if ordinal:
            rest = [c for c in rows.columns if c not in keys]
            newest = F.struct(F.coalesce("_ordinal", F.lit(LAST)), ~F.col("_deleted"), "_fp")
            rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("r")).select(*keys, "r.*")
        rows = rows.withColumn("_version", F.lit(None).cast("bigint")).select(*values, *OWN)
        attempt = uuid.uuid4().hex
        fields = [T.StructField(f.name, loosened(f.dataType), True) for f in rows.schema]
        state = self.named(state, fields)
        counts = self.put(rows, attempt, state["buckets"], state["names"], stands)
        if not counts:
            self.folder.delete(f"rows/_a={attempt}")
            if state["schema"] is not None:
                return state["version"]
        return self.commit(number, state, attempt, counts, fields, bool(ordinal))

    def named(self, state: dict, fields: list[T.StructField]) -> dict:
        """The state with names in files for all value columns: the column's own, or another where files have that already."""
        names, used = dict(state["names"]), list(state["used"])
        for f in fields:
            if f.name not in names and f.name not in OWN:
                name = f.name
                while name.lower() in {u.lower() for u in used}:
                    name = f"{f.name}__{uuid.uuid4().hex[:8]}"
                names[f.name] = [[name, T.StructType([T.StructField("x", f.dataType)]).jsonValue()]]
                used.append(name)
        return state | {"names": names, "used": used}

    def commit(self, number: int, state: dict, attempt: str, counts: dict[int, int], fields: list[T.StructField], ordinals: bool) -> int:
        """The attempt after the state that it was made for, or after what others have committed since, if that has none of
        its keys."""
        while True:
            new = self.after(state, attempt, counts, fields, ordinals)
            try:
                number = self.folder.write("state", new, number)
                break
            except Conflict:
                number, now = self.numbered_state()
                if counts and (now["buckets"] != state["buckets"] or (not ordinals and self.meets(attempt, state, now))):
                    self.folder.delete(f"rows/_a={attempt}")
                    raise
                state = now | {"names": state["names"] | now["names"], "used": [*now["used"], *(u for u in state["used"] if u not in now["used"])]}
        try:
            if sum(new["rows"]) > LARGE * new["buckets"]:
                self.compact(number, new, list(range(new["buckets"])), 4 * new["buckets"])
            elif full := [b for b, d in enumerate(new["deltas"]) if d >= DELTAS]:
                self.compact(number, new, full)
        except Conflict:
            pass  # whoever came between finds the same bucket full
        return new["version"]

    def after(self, state: dict, attempt: str, counts: dict[int, int], fields: list[T.StructField], ordinals: bool) -> dict:
        version, n = state["version"] + 1, state["buckets"]
        if state["schema"] is None:
            base, deltas, size = [version] * n, [0] * n, [counts.get(b, 0) for b in range(n)]
        else:
            old = T.StructType.fromJson(state["schema"])
            fields = [f for f in old if f.name not in {x.name for x in fields}] + fields
            base, deltas = state["base"], [d + (b in counts) for b, d in enumerate(state["deltas"])]
            size = [x + counts.get(b, 0) for b, x in enumerate(state["rows"])]
        attempts = state["attempts"] | ({attempt: version} if counts else {})
        return {"version": version, "buckets": n, "base": base, "deltas": deltas, "rows": size, "schema": T.StructType(fields).jsonValue(), "attempts": attempts, "replaced": state["replaced"], "ordinals": bool(state.get("ordinals") or ordinals), "names": state["names"], "used": state["used"]}

    def meets(self, attempt: str, before: dict, now: dict) -> bool:
        """Whether what was committed since has keys of the attempt."""
        since = [a for a, v in now["attempts"].items() if v > before["version"]]
        if not set(before["attempts"]) <= set(now["attempts"]):  # compacted, so that they can't be told apart
            return True
        top = f"{self.folder.path}/rows"
        keys = lambda names: self.spark.read.schema("_key string").option("basePath", top).parquet(*(f"{top}/_a={a}" for a in names)).select("_key")
        return bool(since) and not keys([attempt]).join(keys(since), "_key", "left_semi").isEmpty()

    def compact(self, number: int, state: dict, some: list[int], buckets: int | None = None) -> None:
        """Some buckets as one version each, or all of them as another number of buckets. Rows with ordinals keep their marks
        of deletion, so that changes which come later still find them."""
        version, n, attempt = state["version"] + 1, buckets or state["buckets"], uuid.uuid4().hex
        rows = self.latest(state, None if len(some) == state["buckets"] else some, marks=True)
        rows = rows if state.get("ordinals") else rows.where("NOT _deleted")
        counts = self.put(rows, attempt, n, state["names"])
        if n != state["buckets"]:
            base, deltas, size = [version] * n, [0] * n, [counts.get(b, 0) for b in range(n)]
        else:
            at = set(some)
            base, deltas = [version if b in at else x for b, x in enumerate(state["base"])], [0 if b in at else x for b, x in enumerate(state["deltas"])]
            size = [counts.get(b, 0) if b in at else x for b, x in enumerate(state["rows"])]
        attempts = {a: v for a, v in state["attempts"].items() if v >= min(base)} | ({attempt: version} if counts else {})
        replaced = [a for a in state["attempts"] if a not in attempts]
        made = {"version": version, "buckets": n, "base": base, "deltas": deltas, "rows": size, "schema": state["schema"], "attempts": attempts, "replaced": replaced, "ordinals": bool(state.get("ordinals")), "names": state["names"], "used": state["used"]}
        try:
            self.folder.write("state", made, number)
        except Conflict:
            self.folder.delete(f"rows/_a={attempt}")
            raise
        self.sweep(attempts, replaced, state["replaced"])

    def sweep(self, attempts: dict[str, int], replaced: list[str], before: list[str]) -> None:
        """Deletes what the compaction before has replaced, and attempts of writers that have gone."""
        old = (time.time() - LEFT) * 1000
        for f in self.folder.fs.listStatus(self.folder.at("rows")):
            name = f.getPath().getName().removeprefix("_a=")
            if name in before or (name not in attempts and name not in replaced and f.getModificationTime() < old):
                self.folder.delete(f"rows/_a={name}")

    def replace(self, rows: DataFrame, touched: DataFrame) -> int:
        """All rows of the touched owners (`_source`, `_owner`) become those given; what stays as it was isn't written again.
        The new rows and those that stand meet in the buckets that they are written to, after one shuffle."""
        if self.state()["schema"] is None:
            return self.merge(rows)
        few = [tuple(r) for r in touched.select("_source", "_owner").distinct().limit(NAMED + 1).collect()]
        old = self.rows(columns=[], owners=few if len(few) <= NAMED else None)
        return self.merge(rows, stands=old.join(touched.select("_source", "_owner"), ["_source", "_owner"], "left_semi"))

    def evolve(self, schema: T.StructType) -> None:
        """Drop, add and retype value columns; the keys stay. No row is written: a new column has a name of its own in files to
        come and is null in those there are, and a retyped one reads what older files have, cast."""
        number, state = self.numbered_state()
        if state["schema"] is None:
            return
        old, schema = T.StructType.fromJson(state["schema"]), loosened(schema)
        stays = [f for f in schema if f.name in old.names and old[f.name].dataType == f.dataType]
        before = {f.name: state["names"][f.name] for f in schema if f.name in old.names}
        made = self.named(state | {"names": {f.name: before[f.name] for f in stays}}, list(schema))
        for f in schema:
            if f.name in before and f not in stays:
                made["names"][f.name] = [*made["names"][f.name], *before[f.name]]
        fields = [*(T.StructField(f.name, f.dataType, True) for f in schema), *(f for f in old if f.name in OWN)]
        self.folder.write("state", made | {"schema": T.StructType(fields).jsonValue()}, number)

    def drop(self) -> None:
        self.folder.delete("")
