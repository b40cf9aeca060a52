"""What the operators of this subpackage share: sessions, shared folders and row keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.session import workers_find_us

__all__ = ["col", "forget", "fresh", "later", "raw_bytes", "shared_dir", "slices", "table", "temporary", "text_or_empty", "workers_find_us", "written"]

#: Tables written inside `temporary`, a list for each that is open.
OPEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local one if all runs in one process (as in
    tests); on a cluster that is an error, as executors wouldn't see it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="rillspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends there, whatever executors are lost. The table
    is deleted at the end of the `temporary` block it was written in, if any, unless its path is to be added to `kept`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if kept is not None:
        kept.append(path)
    elif OPEN:
        OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def later(paths: list[str]) -> None:
    """Tables whose path was kept go with those of the open `temporary` block after all."""
    if OPEN:
        OPEN[-1] += paths


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at its end; what they return must be used up or written before."""
    OPEN.append([])
    try:
        yield
    finally:
        forget(spark, OPEN.pop())


def col(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names that none of `taken` clashes with, in any case of letters."""
    taken, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about `most` bytes of `column`, a longer row alone, so that memory doesn't follow the row count."""
    sizes = pa.compute.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def raw_bytes(array: pa.Array) -> tuple[memoryview, list[int]]:
    """The UTF-8 bytes of a string array, nulls as empty, and the offsets of its rows in them."""
    import numpy as np

    array = pa.compute.fill_null(array, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return flat, ends - ends[0]
