"""Flows: sources, transformations in nested scopes, collectors and exports, compiled to DataFrames.

A flow is a declaration. Scopes form a tree: the root, the rows of a source, the rows of nested tables in them. A field
that a transformation adds is a column of its scope's DataFrame; ancestors' fields are carried along, so that every
expression is a plain Column. `compile` turns each collector into one DataFrame, a union of selects.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from contextlib import AbstractContextManager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.schema import check_name, merge_schemas
from rillspark.session import workers_find_us
from rillspark.sinks.keyed import Folder
from rillspark.types import with_facts


class GeneratedField:
    UUID = object()


class Scope:
    """Rows of one level. ops: (field, function from the scope to a Column), in order; a field is defined once."""

    def __init__(self, flow: Flow, parent: Scope | None, slice_: Slice | None, name: str):
        self.flow, self.parent, self.of, self.name = flow, parent, slice_, name
        self.ops: list[tuple[str, Callable[[], Column]]] = []
        self.id = next(flow.ids)
        self.children: list[Scope] = []
        if parent:
            parent.children.append(self)

    def column(self, name: str) -> str:
        return f"s{self.id}_{name}"

    def ancestors(self) -> list[Scope]:
        return [self, *(self.parent.ancestors() if self.parent else [])]

    def __getitem__(self, name: str) -> Slice:
        for scope in self.ancestors():
            if name in scope.fields():
                return Slice(scope, name)
        raise KeyError(name)

    def __setitem__(self, name: str, value: Slice) -> None:
        check_name(name)
        self.define(name, lambda: value.col())

    def fields(self) -> list[str]:
        return [*self.base_fields(), *(n for n, _ in self.ops)]

    def base_fields(self) -> list[str]:
        return []

    def define(self, name: str, make: Callable[[], Column]) -> Slice:
        if name in self.fields():
            raise ValueError(f"field {name!r} is defined already")
        self.ops.append((name, make))
        return Slice(self, name)

    def add_collector(self, name: str | None = None) -> Collector:
        return self.flow.add_collector(name, self)

    def frame(self, spark: SparkSession, cache: dict) -> DataFrame:
        if self not in cache:
            df = self.base(spark, cache)
            for name, make in self.ops:
                memo = cache.get("memo") if isinstance(make, Remembered) else None
                df = make.into(df, self.column(name), memo) if memo else df.withColumn(self.column(name), make())
            cache[self] = df
        return cache[self]

    def base(self, spark: SparkSession, cache: dict) -> DataFrame:
        return spark.range(1).select()


@dataclass(frozen=True)
class Remembered:
    """A call of a function whose results are kept: `cache` is among its options."""

    fn: Any
    args: Callable[[], list]

    def __call__(self) -> Column:
        return self.fn(*self.args())

    def into(self, df: DataFrame, out: str, folder: str) -> DataFrame:
        """df with `out`, evaluated only for inputs that have no result in the folder, once each; those are added to it. A
        result belongs to the function's name and behaviour version."""
        from rillspark.operators.incremental import memoized

        spark, path = df.sparkSession, f"{folder}/{self.fn.name}-{self.fn.options.behavior_version}"
        args = [a if isinstance(a, Column) else F.lit(a) for a in self.args()]
        names = [f"__in{i}" for i in range(len(args))]
        df = df.withColumns(dict(zip(names, args)))
        store = Folder(spark, path)
        known = spark.read.parquet(path) if store.fs.exists(store.at("")) else None
        compute = lambda rows: rows.withColumn("output", self.fn(*map(F.col, names)))
        _, now = memoized(df, known, names, self.fn.name, compute)
        fresh = now if known is None else now.join(known.select("input_fp"), "input_fp", "left_anti")
        fresh.write.mode("append").parquet(path)
        done, _ = memoized(df, spark.read.schema(now.schema).parquet(path), names, self.fn.name, lambda rows: rows.withColumn("output", F.lit(None).cast(now.schema["output"].dataType)))
        return done.withColumnRenamed("output", out).drop(*names)


class SourceScope(Scope):
    def __init__(self, flow: Flow, name: str, source: Any):
        super().__init__(flow, flow.root, None, name)
        self.source, self.refresh_interval, self.limits = source, None, (None, None)

    def base_fields(self) -> list[str]:
        return list(self.source.schema().names)

    def base(self, spark: SparkSession, cache: dict) -> DataFrame:
        df = cache.get(("rows", self.name))
        df = self.source.read(spark) if df is None else df
        return df.select(*[F.col(f"`{c}`").alias(self.column(c)) for c in self.source.schema().names])


class NestedScope(Scope):
    """Rows of a nested table: `index` is the position, the element's fields are fields (or `value`, if not a struct)."""

    def element(self) -> T.DataType | None:
        kind = self.of.data_type()
        return kind.elementType if isinstance(kind, T.ArrayType) else None

    def base_fields(self) -> list[str]:
        kind = self.element()
        return ["index", *(kind.names if isinstance(kind, T.StructType) else ["value"])]

    def base(self, spark: SparkSession, cache: dict) -> DataFrame:
        parent = self.of.scope.frame(spark, cache) if self.of.scope is self.parent else self.parent.frame(spark, cache)
        item, at = self.column("__item"), self.column("index")
        df = parent.select("*", F.posexplode(self.of.col()).alias(at, item)).withColumn(at, F.col(at).cast("bigint"))
        names = [n for n in self.base_fields() if n != "index"]
        take = {n: F.col(item) if n == "value" and not isinstance(self.element(), T.StructType) else F.col(f"{item}.`{n}`") for n in names}
        return df.withColumns({self.column(n): c for n, c in take.items()}).drop(item)

    def folded(self, spark: SparkSession) -> DataFrame:
        """The parent's rows, their table with the fields added here as fields of its elements; null and empty tables
        stay as they are. Elements are gathered again by the parent row's number and sorted by position."""
        row, item = "__row", "__elements"
        parent = self.parent.frame(spark, {}).withColumn(row, F.monotonically_increasing_id())
        rows = self.frame(spark, {self.parent: parent})
        names = [n for n in self.fields() if n != "index"]
        element = F.struct(F.col(self.column("index")).alias("index"), *[F.col(self.column(n)).alias(n) for n in names])
        gathered = rows.groupBy(row).agg(F.array_sort(F.collect_list(element)).alias(item))
        table = F.transform(item, lambda x: F.struct(*[x[n].alias(n) for n in names]))
        kept = F.coalesce(table, F.when(self.of.col().isNotNull(), F.array().cast(rows.select(F.array(F.struct(*[F.col(self.column(n)).alias(n) for n in names])).alias("x")).schema["x"].dataType)))
        return parent.join(gathered, row, "left").withColumn(self.of.scope.column(self.of.path), kept).drop(row, item)


@dataclass(frozen=True)
class Slice:
    """A typed reference to a field of a scope."""

    scope: Scope
    path: str

    def root(self) -> str:
        return self.path.split(".")[0]

    def col(self) -> Column:
        head, *rest = self.path.split(".")
        column = F.col(self.scope.column(head))
        for part in rest:
            column = column.getField(part)
        return column

    def data_type(self) -> T.DataType:
        spark = SparkSession.active()
        return self.scope.frame(spark, {}).select(self.col().alias("x")).schema["x"].dataType

    def __getitem__(self, name: str) -> Slice:
        kind = self.data_type()
        if not isinstance(kind, T.StructType) or name not in kind.names:
            raise KeyError(name)
        return Slice(self.scope, f"{self.path}.{name}")

    def transform(self, fn: Callable[..., Column], *args: Any, **kwargs: Any) -> Slice:
        return self.scope.flow.transform(fn, self, *args, **kwargs)

    def row(self) -> Rows:
        return Rows(NestedScope(self.scope.flow, self.scope, self, self.path))

    def for_each(self, use: Callable[[Scope], Any]) -> None:
        with self.row() as scope:
            use(scope)

    def call(self, fn: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return fn(self, *args, **kwargs)


class Rows(AbstractContextManager):
    def __init__(self, scope: Scope):
        self.scope = scope

    def __enter__(self) -> Scope:
        return self.scope

    def __exit__(self, *_: Any) -> None:
        return None


@dataclass(frozen=True)
class SourceTable:
    """What add_source returns: a keyed table, whose rows are a scope."""

    scope: SourceScope

    def row(self) -> Rows:
        return Rows(self.scope)

    def for_each(self, use: Callable[[Scope], Any]) -> None:
        use(self.scope)


@dataclass
class Collect:
    scope: Scope
    values: dict[str, Any]


@dataclass
class Export:
    name: str
    target: Any
    primary_key_fields: list[str]
    vector_indexes: list = field(default_factory=list)
    fts_indexes: list = field(default_factory=list)
    attachments: list = field(default_factory=list)
    setup_by_user: bool = False


class Collector:
    def __init__(self, flow: Flow, name: str, scope: Scope):
        self.flow, self.name, self.scope = flow, name, scope
        self.parts: list[Collect] = []
        self.exports: list[Export] = []

    def collect(self, **values: Any) -> None:
        """One record per row of the lowest scope among the values. At most one may be GeneratedField.UUID."""
        for n in values:
            check_name(n)
        if sum(v is GeneratedField.UUID for v in values.values()) > 1:
            raise ValueError("at most one generated UUID")
        self.parts.append(Collect(lowest([v.scope for v in values.values() if isinstance(v, Slice)], self.scope), values))

    def export(self, name: str, target: Any, *, primary_key_fields: list[str], vector_indexes=(), fts_indexes=(), attachments=(), setup_by_user: bool = False) -> None:
        if self.scope is not self.flow.root:
            raise ValueError("only collectors of the root can be exported")
        if not primary_key_fields:
            raise ValueError("an export needs a primary key")
        if any(e.name == name for c in self.flow.collectors for e in c.exports):
            raise ValueError(f"export {name!r} is defined already")
        self.exports.append(Export(name, target, list(primary_key_fields), list(vector_indexes), list(fts_indexes), list(attachments), setup_by_user))

    def frame(self, spark: SparkSession, cache: dict, owned: bool = False) -> DataFrame:
        """All records; `owned`: with _source and _owner, the source and the key (JSON) of the row each comes from."""
        frames, schema = [], None
        for part in self.parts:
            df = part.scope.frame(spark, cache)
            source = next((s for s in part.scope.ancestors() if isinstance(s, SourceScope)), None)
            keys = F.to_json(F.struct(*[F.col(source.column(k)).alias(k) for k in source.source.keys])) if source else F.lit("{}")
            order = [F.col(s.column("index")) for s in part.scope.ancestors()[::-1] if isinstance(s, NestedScope)]
            plain = {n: v.col() if isinstance(v, Slice) else v if isinstance(v, Column) else F.lit(v) for n, v in part.values.items() if v is not GeneratedField.UUID}
            out = df.select(*[c.alias(n) for n, c in plain.items()], F.lit(source.name if source else "").alias("_source"), keys.alias("_owner"), F.struct(F.lit(len(frames)), *order).alias("_order"))
            for n, v in part.values.items():
                if v is GeneratedField.UUID:
                    out = with_uuid(out, n, list(plain))
            out = out.select(*part.values, "_source", "_owner")
            own = T.StructType([f for f in out.schema if f.name not in ("_source", "_owner")])
            schema = own if schema is None else merge_schemas(schema, own)
            frames.append(out)
        if not frames:
            raise ValueError(f"nothing is collected in {self.name!r}")
        all_ = frames[0]
        for f in frames[1:]:
            all_ = all_.unionByName(f, allowMissingColumns=True)
        facts = [F.col(f.name).alias(f.name, metadata=f.metadata) if f.metadata else F.col(f.name) for f in schema]
        return all_.select(*facts, *(("_source", "_owner") if owned else ()))


def with_uuid(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """A UUID of the row's values and of how many equal records of the same owner come before it: it stays while the
    values stay, and equal records differ."""
    from pyspark.sql import Window

    value = F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    df = df.withColumn("_fp", value)
    nth = F.row_number().over(Window.partitionBy("_source", "_owner", "_fp").orderBy("_order"))
    return df.withColumn(name, with_facts(uuid_text(F.md5(F.concat_ws("|", "_source", "_owner", "_fp", nth.cast("string")))), logical="Uuid")).drop("_fp")


def uuid_text(h: Column) -> Column:
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def lowest(scopes: list[Scope], floor: Scope) -> Scope:
    """The lowest of scopes, which must lie on one chain of ancestors."""
    low = floor
    for s in scopes:
        if low in s.ancestors():
            low = s
        elif s not in low.ancestors():
            raise ValueError(f"{s.name!r} and {low.name!r} aren't on one chain of scopes")
    return low


class Flow:
    """The builder and the built flow: `flow_builder` and the root scope in one."""

    def __init__(self, name: str):
        self.name, self.ids = name, itertools.count()
        self.root = Scope(self, None, None, "root")
        self.sources: dict[str, SourceScope] = {}
        self.collectors: list[Collector] = []
        self.declarations: list[Any] = []
        self.query_handlers: dict[str, Callable[..., Any]] = {}

    def add_source(self, source: Any, *, name: str | None = None, refresh_interval: Any = None, max_inflight_rows: int | None = None, max_inflight_bytes: int | None = None) -> SourceTable:
        """refresh_interval: seconds between passes of a live update. The limits bound what an update's tasks hand to Python
        functions at once."""
        name = check_name(name or f"source_{len(self.sources)}", "source")
        if name in self.sources:
            raise ValueError(f"source {name!r} is defined already")
        scope = SourceScope(self, name, source)
        scope.refresh_interval, scope.limits = refresh_interval, (max_inflight_rows, max_inflight_bytes)
        self.sources[name] = scope
        return SourceTable(scope)

    def transform(self, fn: Callable[..., Column], *args: Any, **kwargs: Any) -> Slice:
        """Adds one field to the lowest scope of the arguments: fn of Columns, constants as literals."""
        slices = [a for a in (*args, *kwargs.values()) if isinstance(a, Slice)]
        scope = lowest([s.scope for s in slices], self.root)
        col = lambda a: a.col() if isinstance(a, Slice) else a
        if getattr(getattr(fn, "options", None), "cache", False):
            given = fn.given(*args, **kwargs)
            return scope.define(f"_t{next(self.ids)}", Remembered(fn, lambda: list(map(col, given))))
        return scope.define(f"_t{next(self.ids)}", lambda: fn(*map(col, args), **{k: col(v) for k, v in kwargs.items()}))

    def add_collector(self, name: str | None = None, scope: Scope | None = None) -> Collector:
        made = Collector(self, check_name(name or f"collector_{len(self.collectors)}", "collector"), scope or self.root)
        self.collectors.append(made)
        return made

    def declare(self, spec: Any) -> None:
        self.declarations.append(spec)

    def query_handler(self, name: str | None = None):
        def add(fn):
            self.query_handlers[name or fn.__name__] = fn
            return fn

        return add

    def add_query_handler(self, name: str, fn: Callable[..., Any]) -> None:
        self.query_handlers[check_name(name, "query handler")] = fn

    def compile(self, spark: SparkSession, rows: dict[str, DataFrame] | None = None, owned: bool = False, memo: str | None = None) -> dict[str, DataFrame]:
        """The DataFrame of each collector. rows: what to read for a source instead of its whole table. memo: the folder of
        cached functions' results; without one they are evaluated like others."""
        workers_find_us(spark)
        cache: dict = {("rows", n): df for n, df in (rows or {}).items()} | {"memo": memo}
        return {c.name: c.frame(spark, cache, owned) for c in self.collectors if c.parts}

    def frames_of(self, spark: SparkSession, slice_: Slice) -> DataFrame:
        return slice_.scope.frame(spark, {})


_flows: dict[str, Flow] = {}


def open_flow(name: str, define: Callable[[Flow, Scope], None]) -> Flow:
    check_name(name, "flow")
    if name in _flows:
        raise KeyError(f"flow {name!r} exists")
    flow = Flow(name)
    define(flow, flow.root)
    _flows[name] = flow
    return flow


def flow_def(name: str | None = None):
    return lambda fn: open_flow(name or fn.__name__, fn)


add_flow_def = open_flow


def flow_names() -> list[str]:
    return sorted(_flows)


def flow_by_name(name: str) -> Flow:
    return _flows[name]


def remove_flow(name: str) -> None:
    _flows.pop(name, None)


class TransformFlow:
    """A function of Columns, used in flows, on DataFrames and on single values alike."""

    def __init__(self, fn: Callable[..., Column], types: tuple[str, ...] = ("string",)):
        self.fn, self.types = fn, types

    def __call__(self, *args: Any) -> Any:
        first = next((a for a in args if isinstance(a, Slice)), None)
        return first.scope.flow.transform(self.fn, *args) if first else self.fn(*args)

    def on(self, df: DataFrame, out: str, *columns: str) -> DataFrame:
        return df.withColumn(out, self.fn(*map(F.col, columns)))

    def eval(self, spark: SparkSession, *values: Any) -> Any:
        schema = ", ".join(f"a{i} {t}" for i, t in enumerate(self.types))
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(self.fn(*(F.col(f"a{i}") for i in range(len(values)))).alias("x")).first().x


def transform_flow(*types: str):
    return lambda fn: TransformFlow(fn, types or ("string",))


@dataclass
class QueryOutput:
    results: Any
    query_info: dict = field(default_factory=dict)
