"""What a user asks of flows: their shape, rows, states and answers; the command line calls the same."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.flow import Flow, QueryOutput, flow_by_name, flow_names
from rillspark.operators.incremental import Indexer
from rillspark.sinks.keyed import key_json


def flows() -> list[str]:
    return flow_names()


def describe(flow: Flow) -> list[str]:
    """Sources, fields, collectors and exports, a line each."""
    lines = [f"flow {flow.name}"]
    for s in flow.sources.values():
        lines.append(f"  source {s.name}: key ({', '.join(s.source.keys)})")
        lines += [f"    {'  ' * (len(c.ancestors()) - 2)}{c.name}: {', '.join(c.fields())}" for c in below(s)]
    for c in flow.collectors:
        lines.append(f"  collector {c.name}: " + "; ".join(", ".join(p.values) for p in c.parts))
        lines += [f"    export {e.name}: key ({', '.join(e.primary_key_fields)})" for e in c.exports]
    return lines


def below(scope) -> list:
    return [scope, *(x for c in scope.children for x in below(c))]


def keys(flow: Flow, spark: SparkSession, source: str) -> DataFrame:
    """Keys and ordinals without values."""
    return flow.sources[source].source.listing(spark)


def evaluated(flow: Flow, spark: SparkSession, source: str, key: str) -> dict[str, DataFrame]:
    """What one source row gives, by its key as JSON; nothing is written."""
    made = flow.sources[source].source
    rows = made.read(spark).withColumn("__key", key_json(made.keys)).where(F.col("__key") == key).drop("__key")
    none = {n: s.source.read(spark).where("false") for n, s in flow.sources.items() if n != source}
    return flow.compile(spark, {source: rows, **none})


def row_status(indexer: Indexer, source: str, key: str) -> dict[str, Any] | None:
    """Ordinal, processing and current action of a row; None if it is neither listed nor tracked."""
    found = indexer.changes(source).where(F.col("key") == key).first()
    tracked = indexer.tracking().where((F.col("source") == source) & (F.col("key") == key)).first()
    return None if found is None else {"action": found.action, "ordinal": found.ordinal, "process_ordinal": tracked.process_ordinal if tracked else None}


def ask(flow: Flow, spark: SparkSession, handler: str, query: str) -> QueryOutput:
    out = flow.query_handlers[handler](spark, query)
    return out if isinstance(out, QueryOutput) else QueryOutput(out)


def named(name: str) -> Flow:
    return flow_by_name(name)
