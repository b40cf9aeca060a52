"""python -m rillspark COMMAND MODULE[:FLOW]: ls, show, setup, drop, update [--live SECONDS], evaluate [--out DIR],
server [--address HOST:PORT] [--live SECONDS].

MODULE is imported to define flows; the store is --store or $RILLSPARK_STORE."""

from __future__ import annotations

import argparse
import importlib
import sys
import threading

from pyspark.sql import SparkSession

from rillspark import service
from rillspark.operators.incremental import Indexer
from rillspark.server import Api, serve
from rillspark.settings import Settings, full_name
from rillspark.sinks.targets import evaluate_and_dump
from rillspark.streaming.live import LiveUpdater


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rillspark", description=__doc__)
    parser.add_argument("command", choices=["ls", "show", "setup", "drop", "update", "evaluate", "server"])
    parser.add_argument("target", help="MODULE or MODULE:FLOW")
    parser.add_argument("--store", default=Settings.from_env().store)
    parser.add_argument("--live", type=float, help="seconds between passes")
    parser.add_argument("--mode", default="normal", choices=["normal", "reexport", "full_reprocess"])
    parser.add_argument("--out", default="evaluated")
    parser.add_argument("--address", default="127.0.0.1:8741")
    parser.add_argument("--for-seconds", type=float, help="how long the server runs; for ever by default")
    given = parser.parse_args(argv)
    module, _, name = given.target.partition(":")
    importlib.import_module(module)
    names = [name] if name else service.flows()
    if given.command == "ls":
        print("\n".join(names))
        return 0
    spark, settings = SparkSession.builder.getOrCreate(), Settings.from_env()
    if given.command not in ("show", "evaluate") and not given.store:
        parser.error("a store is needed: --store or RILLSPARK_STORE")
    if given.command == "server":
        api, live = Api(spark, given.store, settings), []
        running = serve(api, given.address)
        print(f"serving at {given.address}")
        live += [LiveUpdater(api.indexer(n), refresh_interval=given.live).start() for n in names] if given.live else []
        try:
            threading.Event().wait(given.for_seconds)
        finally:
            running.shutdown()
            for x in live:
                x.abort()
        return 0
    for n in names:
        flow = service.named(n)
        if given.command == "show":
            print("\n".join(service.describe(flow)))
            continue
        if given.command == "evaluate":
            print(*evaluate_and_dump(flow, spark, f"{given.out}/{n}"))
            continue
        indexer = Indexer(flow, spark, f"{given.store}/{full_name(settings, n)}")
        if given.command == "setup":
            for _, export in indexer.exports():
                for statement in getattr(export.target, "setup_sql", ()):
                    spark.sql(statement)
                print(f"{n}: {export.name} is {'kept' if indexer.target(export).state()['schema'] else 'new'}")
            for name, steps in indexer.setup().items():
                print(*(f"{n}: {name}: {s}" for s in steps), sep="\n")
        elif given.command == "drop":
            for _, export in indexer.exports():
                for statement in getattr(export.target, "teardown_sql", ()):
                    spark.sql(statement)
            indexer.drop()
        elif given.live:
            with LiveUpdater(indexer, refresh_interval=given.live) as live:
                live.wait()
        else:
            print(n, indexer.update(given.mode))
    return 0


if __name__ == "__main__":
    sys.exit(main())
