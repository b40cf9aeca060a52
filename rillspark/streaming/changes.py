"""Feeds of changes for live updates, from services that tell of them through clients that are passed in.

A feed says what has changed; a live updater then makes a pass over these keys alone, which asks the source for their values,
and tells the feed when it has succeeded, so that a change whose pass failed is told again. Messages are few beside rows:
they are read on the driver, the rows they are about by the pass's tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Feed:
    """What a service says of one source, named by `source`, or the flow's only one. poll(position): changes (key as JSON, ordinal, deleted) after a position, and the next position,
    which must be plain data; done(position): everything before it has been processed."""

    source: str | None = None

    def poll(self, position: dict) -> tuple[list[tuple[str, int | None, bool]], dict]:
        raise NotImplementedError

    def done(self, position: dict) -> None:
        return None


class QueueFeed(Feed):
    """Notices of an object store in a queue. The client has receive(most) -> [(receipt, body)] and delete(receipt); a message
    is deleted when its changes have been processed. Keys outside the prefix and other notices are acknowledged unread."""

    def __init__(self, client: Any, prefix: str = "", most: int = 10):
        self.client, self.prefix, self.most, self.held, self.n = client, prefix, most, {}, 0

    def poll(self, position: dict) -> tuple[list[tuple[str, int | None, bool]], dict]:
        out = []
        for receipt, body in self.client.receive(self.most):
            self.n += 1
            self.held[self.n] = receipt
            out += notices(body, self.prefix)
        return out, {"n": self.n}

    def done(self, position: dict) -> None:
        for n in [n for n in self.held if n <= position.get("n", 0)]:
            self.client.delete(self.held.pop(n))


class ChannelFeed(Feed):
    """Notices of an object store on a publish-subscribe channel, which knows no acknowledgement. The client has messages()
    -> [body]."""

    def __init__(self, client: Any, prefix: str = ""):
        self.client, self.prefix, self.n = client, prefix, 0

    def poll(self, position: dict) -> tuple[list[tuple[str, int | None, bool]], dict]:
        found = [x for body in self.client.messages() for x in notices(body, self.prefix)]
        self.n += len(found)
        return found, {"n": self.n}


def notices(body: str, prefix: str) -> Iterator[tuple[str, int | None, bool]]:
    """Created and removed objects that a notice names."""
    for r in json.loads(body).get("Records", []):
        kind, key = r.get("eventName", ""), unquote_plus(r.get("s3", {}).get("object", {}).get("key", ""))  # notices encode keys
        if key.startswith(prefix) and kind.startswith(("ObjectCreated", "ObjectRemoved", "ObjectDelete")):
            yield json.dumps({"filename": key.removeprefix(prefix).lstrip("/")}), None, not kind.startswith("ObjectCreated")


class TableFeed(Feed):
    """Rows changed in a database, by a trigger that notifies. `statements` sets it up: insertions and updates carry key and
    ordinal, deletions the key. The client has notifications() -> [payload]."""

    def __init__(self, client: Any, ordinal: str | None = None):
        self.client, self.ordinal, self.n = client, ordinal, 0

    @staticmethod
    def statements(table: str, keys: list[str], ordinal: str | None, channel: str) -> list[str]:
        """A function and a trigger that notify a channel of every change."""
        columns = [*keys, *([ordinal] if ordinal else [])]

        def built(row: str, names: list[str]) -> str:
            return "json_build_object(" + ", ".join(f"'{c}', {row}.\"{c}\"" for c in names) + ")"

        name = f"{channel}_notify"
        body = f"BEGIN IF TG_OP = 'DELETE' THEN PERFORM pg_notify('{channel}', json_build_object('op', TG_OP, 'fields', {built('OLD', keys)})::text); RETURN OLD; END IF; "
        body += f"PERFORM pg_notify('{channel}', json_build_object('op', TG_OP, 'fields', {built('NEW', columns)})::text); RETURN NEW; END;"
        return [
            f"CREATE OR REPLACE FUNCTION {name}() RETURNS TRIGGER AS $$ {body} $$ LANGUAGE plpgsql", f"DROP TRIGGER IF EXISTS {name} ON {table}",
            f"CREATE TRIGGER {name} AFTER INSERT OR UPDATE OR DELETE ON {table} FOR EACH ROW EXECUTE FUNCTION {name}()",
        ]

    def poll(self, position: dict) -> tuple[list[tuple[str, int | None, bool]], dict]:
        out = []
        for payload in self.client.notifications():
            said = json.loads(payload)
            ordinal = said["fields"].pop(self.ordinal, None) if self.ordinal else None
            out.append((json.dumps(said["fields"]), ordinal, said["op"] == "DELETE"))
        self.n += len(out)
        return out, {"n": self.n}


class RecentFeed(Feed):
    """Files of a drive by time of change, newest first, down to the last time seen. The client has recent(page) -> [(id,
    modified)], an empty page at the end; covered(id) says whether the flow's folders hold it."""

    def __init__(self, client: Any):
        self.client = client

    def poll(self, position: dict) -> tuple[list[tuple[str, int | None, bool]], dict]:
        last, out, page, newest = position.get("modified", 0), [], 0, position.get("modified", 0)
        while found := self.client.recent(page):
            newest = max([newest, *(m for _, m in found)])
            out += [(json.dumps({"file_id": i}), m, False) for i, m in found if m > last and self.client.covered(i)]
            if min(m for _, m in found) <= last:
                break
            page += 1
        return out, {"modified": newest}


def told(spark: SparkSession, changes: list[tuple[str, Any, bool]], kind: T.StructType) -> DataFrame:
    """Changes as an indexer takes them: the key's columns, `_ordinal` and `_gone`, of each key that with the largest ordinal,
    or the last. Ordinals are integers or times as text."""
    rows = [(i, k, None if o is None else str(o), g) for i, (k, o, g) in enumerate(changes)]
    said = spark.createDataFrame(rows, "i long, k string, o string, _gone boolean")
    said = said.withColumn("_ordinal", F.coalesce(F.expr("try_cast(o AS bigint)"), F.unix_micros(F.expr("try_cast(o AS timestamp)")))).withColumn("k", F.from_json("k", kind))
    last = said.groupBy("k").agg(F.max_by(F.struct("_ordinal", "_gone"), F.struct(F.coalesce("_ordinal", F.lit(2**63 - 1)), "i")).alias("r"))
    return last.select("k.*", "r.*")
