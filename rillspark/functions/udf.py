"""Python functions as operators: typed by annotations, batched, cached, with a deadline.

A required argument that is null skips the function: the result is null. Functions run in Arrow batches; an executor
class is prepared once per worker.
"""

from __future__ import annotations

import concurrent.futures
import contextlib
import fcntl
import inspect
import logging
import os
import tempfile
import time
import typing
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rillspark.types import loosened, members, resolve, with_facts

REGISTRY: dict[str, Operator] = {}
TIMEOUT_S = 1800.0


@dataclass(frozen=True)
class Options:
    """gpu: batches of all workers of a machine run one after another. cache: results are kept by input and behaviour version
    in an indexer's folder, so that later updates don't evaluate them again; outside an indexer it does nothing.
    arg_relationship: what an argument is to the result (such as the text of an embedding), for whoever asks the registry."""

    gpu: bool = False
    cache: bool = False
    batching: bool = False
    max_batch_size: int | None = None
    behavior_version: int | None = None
    timeout: float = TIMEOUT_S
    arg_relationship: tuple | None = None

    def __post_init__(self):
        if self.cache and self.behavior_version is None:
            raise ValueError("a cached function needs a behavior_version")


def plain(value: Any) -> Any:
    """A result as Spark takes it: structs as dicts, keyed tables as lists of rows."""
    fields = members(type(value))
    if fields is not None:
        return {n: plain(getattr(value, n)) for n, _ in fields}
    if isinstance(value, dict) and value and all(members(type(v)) is not None for v in value.values()):
        return [{**(plain(k) if members(type(k)) is not None else {"key": k}), **plain(v)} for k, v in value.items()]
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def typed(value: Any, annotation: Any) -> Any:
    """A row as the struct the annotation names."""
    if annotation is None or value is None:
        return value
    if (fields := members(annotation)) is not None and isinstance(value, dict):
        return annotation(**{n: typed(value[n], t) for n, t in fields})
    if typing.get_origin(annotation) is list and not isinstance(value, str):
        return [typed(v, typing.get_args(annotation)[0]) for v in value]
    return value


def runs_before(seconds: float, name: str, call: Callable[[], Any]) -> Any:
    """call() or TimeoutError; a warning at half the time, after 30 s at least."""
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        job, began = pool.submit(call), time.monotonic()
        try:
            return job.result(min(seconds, max(seconds / 2, 30.0)))
        except concurrent.futures.TimeoutError:
            if job.done():
                raise
            logging.getLogger(__name__).warning("%s has run for %.0f s", name, time.monotonic() - began)
        try:
            return job.result(max(0.0, seconds - (time.monotonic() - began)))
        except concurrent.futures.TimeoutError:
            raise TimeoutError(f"{name} took more than {seconds} s") from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


@contextlib.contextmanager
def one_at_a_time() -> Iterator[None]:
    """The machine's accelerator is one worker's at a time; the others wait at a lock of this machine."""
    with open(os.path.join(tempfile.gettempdir(), "rillspark-gpu.lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        yield


class Operator:
    """What @function and @executor_class make: called with Columns (or constants) it is a Column."""

    def __init__(self, name: str, make: Callable[[], Callable[..., Any]], signature: inspect.Signature, hints: dict, options: Options):
        self.name, self.make, self.options = name, make, options
        self.parameters = [p for p in signature.parameters.values() if p.name != "self"]
        self.hints, self.returns = hints, resolve(hints["return"] if not options.batching else typing.get_args(hints["return"])[0])
        inner = (lambda t: typing.get_args(t)[0]) if options.batching else lambda t: t
        self.kinds = [inner(hints.get(p.name, Any)) for p in self.parameters]
        self.optional = [type(None) in typing.get_args(k) for k in self.kinds]
        REGISTRY[name] = self

    def given(self, *args: Any, **kwargs: Any) -> list[Any]:
        """The value of each parameter, in order."""
        named = dict(zip((p.name for p in self.parameters), args)) | kwargs
        out = [named[p.name] if p.name in named else p.default for p in self.parameters]
        if inspect.Parameter.empty in [v for v in out if isinstance(v, type)]:
            raise TypeError(f"{self.name} needs {', '.join(p.name for p, v in zip(self.parameters, out) if v is inspect.Parameter.empty)}")
        return out

    def __call__(self, *args: Any, **kwargs: Any) -> Column:
        columns = [v if isinstance(v, Column) else F.lit(v).cast("string") if v is None else F.lit(v) for v in self.given(*args, **kwargs)]
        out = self.udf()(*columns)
        if isinstance(self.returns.data_type, T.StructType):
            needed = [c.isNotNull() for c, o in zip(columns, self.optional) if not o]
            out = F.when(reduce(and_, needed), out) if needed else out
        return with_facts(out, **self.returns.metadata)

    def udf(self):
        make, options, optional, kinds, name = self.make, self.options, self.optional, self.kinds, self.name
        kind = loosened(self.returns.data_type)
        arrow = to_arrow_type(kind)

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            fn = make()
            most = options.max_batch_size or 1 << 30
            for given in batches:
                columns = given if isinstance(given, tuple) else (given,)
                rows = list(zip(*(values(c) for c in columns)))
                live = [i for i, r in enumerate(rows) if all(o or v is not None for v, o in zip(r, optional))]
                out: list[Any] = [None] * len(rows)
                args = [tuple(typed(v, k) for v, k in zip(rows[i], kinds)) for i in live]
                with one_at_a_time() if options.gpu else contextlib.nullcontext():
                    if options.batching:
                        found = (x for at in range(0, len(args), most) for x in runs_before(options.timeout, name, lambda at=at: fn(*map(list, zip(*args[at : at + most])))))  # noqa: B023
                    else:
                        found = runs_before(options.timeout * max(1, len(args)), name, lambda args=args: [fn(*a) for a in args])
                    for i, x in zip(live, found):
                        out[i] = plain(x)
                yield pa.array(out, arrow)

        return run.asNondeterministic()  # evaluated once, also where filters are inferred from its result


def values(column: pa.Array) -> list:
    """What a function gets: nulls as None, integers whole, not-a-number as it is in nested values and as None by itself."""
    found = column.to_pylist(maps_as_pydicts="lossy")
    return [None if v != v else v for v in found] if pa.types.is_floating(column.type) else found


def camel(name: str) -> str:
    return "".join(p.capitalize() for p in name.split("_"))


def function(**options: Any):
    """Decorator of a function with annotations; it stays callable on values as `.fn`."""

    def wrap(fn: Callable[..., Any]) -> Operator:
        made = Operator(camel(fn.__name__), lambda: fn, inspect.signature(fn), typing.get_type_hints(fn, include_extras=True), Options(**options))
        made.fn = fn
        return made

    return wrap


@lru_cache(maxsize=16)
def prepared(cls: type, spec: Any) -> Any:
    made = cls.__new__(cls)
    made.spec = spec
    if hasattr(made, "prepare"):
        made.prepare()
    return made


def executor_class(**options: Any):
    """Decorator of a class with `spec`, optional `prepare` and `__call__`; one instance per worker and spec."""

    def wrap(cls: type) -> Callable[..., Operator]:
        def with_spec(spec: Any = None) -> Operator:
            call = cls.__call__
            return Operator(cls.__name__, lambda: prepared(cls, spec), inspect.signature(call), typing.get_type_hints(call, include_extras=True), Options(**options))

        return with_spec

    return wrap
