"""Flows over HTTP: what `service` answers, as JSON, from the standard library's server.

GET /healthz, /api/flows, /api/flows/NAME, .../schema, .../keys?source=, .../data?source=&key=, .../queryHandlers/HANDLER?query=,
.../rowStatus?source=&key=; POST .../update. One request runs at a time for each flow's update; others are answered beside it.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from rillspark import service
from rillspark.operators.incremental import Indexer
from rillspark.settings import Settings, full_name

#: Rows of keys in one answer; `offset` of the next ones is in the answer.
PAGE = 1000


class Api:
    """Routes without the network, so that they can be called in tests and elsewhere."""

    def __init__(self, spark: SparkSession, store: str | None = None, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, store, settings or Settings.from_env()
        self.indexers: dict[str, Indexer] = {}
        self.lock = threading.Lock()

    def indexer(self, name: str) -> Indexer:
        if not self.store:
            raise ValueError("the server has no store")
        with self.lock:
            if name not in self.indexers:
                self.indexers[name] = Indexer(service.named(name), self.spark, f"{self.store.rstrip('/')}/{full_name(self.settings, name)}")
            return self.indexers[name]

    def rows(self, df: DataFrame) -> list[dict]:
        return [json.loads(r) for r in df.toJSON().collect()]

    def answer(self, method: str, path: str, given: dict[str, str]) -> tuple[int, Any]:
        """Status and body of a request."""
        parts = [unquote(p) for p in path.strip("/").split("/")]
        try:
            if method == "GET" and parts == ["healthz"]:
                return 200, {"status": "ok"}
            if parts[:2] != ["api", "flows"]:
                return 404, {"error": "no such path"}
            if method == "GET" and len(parts) == 2:
                return 200, service.flows()
            return self.of_flow(method, parts[2], parts[3:], given)
        except KeyError as e:
            return 404, {"error": f"not found: {e}"}
        except (ValueError, TypeError) as e:
            return 400, {"error": str(e)}

    def of_flow(self, method: str, name: str, rest: list[str], given: dict[str, str]) -> tuple[int, Any]:
        flow = service.named(name)
        if method == "POST":
            return (200, self.indexer(name).update(given.get("mode", "normal")).stats) if rest == ["update"] else (404, {"error": "no such path"})
        match rest:
            case []:
                return 200, {"name": name, "lines": service.describe(flow)}
            case ["schema"]:
                none = {n: s.source.read(self.spark).where("false") for n, s in flow.sources.items()}
                return 200, {n: json.loads(df.schema.json()) for n, df in flow.compile(self.spark, none).items()}
            case ["keys"]:
                start = int(given.get("offset", 0))
                found = self.rows(service.keys(flow, self.spark, given["source"]).orderBy(*flow.sources[given["source"]].source.keys).offset(start).limit(PAGE))
                return 200, {"keys": found, "next": start + PAGE if len(found) == PAGE else None}
            case ["data"]:
                return 200, {n: self.rows(df) for n, df in service.evaluated(flow, self.spark, given["source"], given["key"]).items()}
            case ["queryHandlers", handler]:
                out = service.ask(flow, self.spark, handler, given["query"])
                return 200, {"results": self.rows(out.results) if isinstance(out.results, DataFrame) else out.results, "query_info": out.query_info}
            case ["rowStatus"]:
                found = service.row_status(self.indexer(name), given["source"], given["key"])
                return (200, found) if found else (404, {"error": "no such row"})
        return 404, {"error": "no such path"}


def serve(api: Api, address: str = "127.0.0.1:8741", origins: tuple[str, ...] = ()) -> ThreadingHTTPServer:
    """A server in threads of its own; `shutdown` ends it. origins: pages of other hosts that may ask."""

    class Handler(BaseHTTPRequestHandler):
        def respond(self, method: str) -> None:
            at = urlsplit(self.path)
            status, body = api.answer(method, at.path, {k: v[-1] for k, v in parse_qs(at.query).items()})
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            if self.headers.get("Origin") in origins:
                self.send_header("Access-Control-Allow-Origin", self.headers["Origin"])
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self.respond("GET")

        def do_POST(self) -> None:  # noqa: N802
            self.respond("POST")

        def log_message(self, *_: Any) -> None:
            return None

    host, _, port = address.rpartition(":")
    server = ThreadingHTTPServer((host, int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
