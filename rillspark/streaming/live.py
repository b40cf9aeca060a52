"""Live updates: a source's changes processed in micro-batches by the same plans as one-time updates."""

from __future__ import annotations

import asyncio
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.operators.incremental import Indexer
from rillspark.sinks.keyed import KeyedTarget, key_json
from rillspark.streaming.changes import Feed, told


@dataclass
class LiveUpdater:
    """start, wait, abort and status of a flow that is kept up to date. refresh_interval: seconds between passes over
    the sources, by default the least of the sources' own; a pass that takes longer delays the next. changes: streams of (key
    columns, `_ordinal`, `_gone`) that say what changed; each micro-batch with changes is one pass over its keys alone, its
    checkpoint the acknowledgement. feeds: services asked every `poll` seconds, told when a pass over the keys they named
    has followed. Passes wait for each other. One that fails is repeated after `retry` seconds, twice as many each time up to
    `retry_most`, as long as it fails; a change is acknowledged when its pass has succeeded."""

    indexer: Indexer
    refresh_interval: float | None = None
    changes: list[DataFrame] = field(default_factory=list)
    feeds: list[Feed] = field(default_factory=list)
    poll: float = 1.0
    checkpoint: str | None = None
    stats: list[Any] = field(default_factory=list)
    queries: list[Any] = field(default_factory=list)
    on_status: Callable[[Any], None] = lambda status: None
    retry: float = 5.0
    retry_most: float = 60.0
    stopped: threading.Event = field(default_factory=threading.Event)

    def passed(self, changes: DataFrame | None = None, source: str | None = None) -> None:
        """A pass over all sources, or over the keys that a source's changes tell of."""
        wait = self.retry
        while True:
            try:
                status = self.indexer.update() if changes is None else self.indexer.update(told={source: changes})
                break
            except Exception as error:
                self.on_status(error)
                if self.stopped.wait(wait):
                    raise
                wait = min(2 * wait, self.retry_most)
        self.stats.append(status)
        self.on_status(status)

    def start(self) -> LiveUpdater:
        self.passed()
        spark = self.indexer.spark
        streams = list(self.changes)
        own = [s.refresh_interval for s in self.indexer.flow.sources.values() if s.refresh_interval]
        self.refresh_interval = self.refresh_interval or min((i.total_seconds() if hasattr(i, "total_seconds") else i for i in own), default=None)
        if self.refresh_interval:
            ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            self.queries.append(self.stream(ticks, 0, processingTime=f"{self.refresh_interval} seconds", always=True))
        self.queries += [self.stream(s, i + 1, availableNow=True) if getattr(s, "available_now", False) else self.stream(s, i + 1, processingTime="0 seconds") for i, s in enumerate(streams)]
        for feed in self.feeds:
            threading.Thread(target=self.follow, args=(feed,), daemon=True).start()
        return self

    def follow(self, feed: Feed) -> None:
        position: dict = {}
        while not self.stopped.is_set():
            try:
                found, after = feed.poll(position)
                if found:
                    name = feed.source or next(iter(self.indexer.flow.sources))
                    source = self.indexer.flow.sources[name].source
                    kind = T.StructType([source.schema()[k] for k in source.keys])
                    self.passed(told(self.indexer.spark, found, kind), name)
                feed.done(after)
                position = after
            except Exception as error:
                self.on_status(error)
            self.stopped.wait(self.poll)

    def stream(self, df: DataFrame, n: int, always: bool = False, **trigger: Any):
        """Each micro-batch is a pass: over the keys that it has, where it has those of one source and `_ordinal` and `_gone`,
        else over everything."""
        sources = self.indexer.flow.sources
        name = next((s for s, x in sources.items() if {*x.source.keys, "_ordinal", "_gone"} <= {*df.columns}), None)

        def each(batch: DataFrame, _: int) -> None:
            if always:
                self.passed()
            elif not batch.isEmpty():
                if name is None:
                    return self.passed()
                keys = sources[name].source.keys
                newest = F.max_by(F.struct("_ordinal", "_gone"), F.coalesce("_ordinal", F.lit(2**63 - 1)))
                self.passed(batch.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*"), name)

        writer = df.writeStream.foreachBatch(each).trigger(**trigger)
        return (writer.option("checkpointLocation", f"{self.checkpoint}/{n}") if self.checkpoint else writer).start()

    def next_status_updates(self, timeout: float = 60.0) -> list[Any]:
        """What passes did since the last call; waits for one."""
        until = time.monotonic() + timeout
        while not self.stats and time.monotonic() < until:
            time.sleep(0.05)
        out, self.stats = self.stats, []
        return out

    def wait(self, timeout: float | None = None) -> None:
        for q in self.queries:
            q.awaitTermination(timeout) if timeout else q.awaitTermination()

    async def wait_async(self, timeout: float | None = None) -> None:
        await asyncio.to_thread(self.wait, timeout)

    async def next_status_updates_async(self, timeout: float = 60.0) -> list[Any]:
        return await asyncio.to_thread(self.next_status_updates, timeout)

    def abort(self) -> None:
        self.stopped.set()
        for q in self.queries:
            q.stop()

    def __enter__(self) -> LiveUpdater:
        return self.start()

    def __exit__(self, *_: Any) -> None:
        self.abort()

    async def __aenter__(self) -> LiveUpdater:
        return await asyncio.to_thread(self.start)

    async def __aexit__(self, *_: Any) -> None:
        await asyncio.to_thread(self.abort)


def apply_changes(stream: DataFrame, target: KeyedTarget, ordinal: str, checkpoint: str, deleted: str | None = None, source: str = "stream", once: bool = True):
    """Changes of a stream, with the target's keys and an ordinal, kept in the target: of each key the change with the largest
    ordinal counts, in whatever order and micro-batch changes come, and however often. deleted: a column that is true where
    a key goes; a mark with its ordinal stays, so that older changes which come later don't bring the key back. Nothing
    that is stored is read for it."""

    def each(batch: DataFrame, _: int) -> None:
        own = batch.withColumn("_source", F.lit(source)).withColumn("_owner", F.lit(""))
        goes = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        marks = own.where(goes).select(key_json(target.keys).alias("_key"), "_source", "_owner", ordinal)
        target.merge(own.where(~goes).drop(*([deleted] if deleted else [])), marks, ordinal)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Beyond keyed updates: counts and sums of events per window and type, with a watermark where events stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
