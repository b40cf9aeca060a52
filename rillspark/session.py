"""What a session needs before Python workers run functions of this package."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def workers_find_us(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package, wherever the driver was started; a cluster gets it with
    --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))


def spread(df: DataFrame, finer: int = 1) -> DataFrame:
    """df over all cores where its scan has fewer tasks than there are cores, as for a file of one row group; a large
    scan is left as it is and shuffles nothing. finer: for work that takes far longer than a shuffle, so many tasks for one of
    the scan, however large it is, so that none has a large row group to itself."""
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, finer * n)) if n <= cores or finer > 1 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local one if all runs in one process (as in
    tests); on a cluster that is an error, as executors wouldn't see it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rillspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def for_batches(df: DataFrame, use: Callable[[Iterator[list[dict[str, Any]]]], None]) -> int:
    """Hands each task's rows to use, as batches of dicts whose values are what they were: integers beside nulls stay
    integers, and so do those in structs and lists. How many rows there were is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def rows() -> Iterator[list[dict[str, Any]]]:
            nonlocal n
            for b in batches:
                if b.num_rows:
                    n += b.num_rows
                    yield b.to_pylist(maps_as_pydicts="lossy")

        use(rows())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.mapInArrow(run, "n bigint").agg({"n": "sum"}).first()[0] or 0
