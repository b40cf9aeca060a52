import pytest
from pyspark.sql import functions as F

from rillspark import __main__ as cli
from rillspark import service, settings
from rillspark.flow import QueryOutput, open_flow, remove_flow
from rillspark.operators.incremental import Indexer
from rillspark.sinks.targets import Stored
from rillspark.sources.files import DriveFolders
from rillspark.sources.tables import Table, source_connector


@pytest.fixture
def flow(spark):
    def define(f, root):
        out = f.add_collector("out")
        with f.add_source(Table(lambda s: s.createDataFrame([(1, "a b"), (2, "c")], "id long, t string"), ["id"]), name="src").row() as r:
            r["ws"] = r["t"].transform(lambda t: F.split(t, " "))
            with r["ws"].row() as w:
                out.collect(id=r["id"], at=w["index"], w=w["value"])
        out.export("words", Stored(), primary_key_fields=["id", "at"])

        @f.query_handler()
        def find(s, q):
            return s.createDataFrame([(q,)], "q string")

    remove_flow("svc")
    yield open_flow("svc", define)
    remove_flow("svc")


def test_service(spark, flow, tmp_path):
    assert "svc" in service.flows() and any("export words" in line for line in service.describe(flow))
    assert service.keys(flow, spark, "src").columns == ["id", "_ordinal"]
    assert [r.w for r in service.evaluated(flow, spark, "src", '{"id":1}')["out"].collect()] == ["a", "b"]
    indexer = Indexer(flow, spark, str(tmp_path / "s"))
    assert service.row_status(indexer, "src", '{"id":1}')["action"] == "insert"
    indexer.update()
    assert service.row_status(indexer, "src", '{"id":1}') == {"action": "no_change", "ordinal": None, "process_ordinal": 1}
    assert service.row_status(indexer, "src", '{"id":9}') is None
    out = service.ask(flow, spark, "find", "x")
    assert isinstance(out, QueryOutput) and out.results.first().q == "x"


def test_command_line(spark, flow, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli.main(["ls", "json:svc"]) == 0 and cli.main(["show", "json:svc"]) == 0
    assert cli.main(["update", "json:svc", "--store", store]) == 0 and "2 insert" in capsys.readouterr().out
    assert cli.main(["evaluate", "json:svc", "--out", str(tmp_path / "e")]) == 0
    assert cli.main(["drop", "json:svc", "--store", store]) == 0


def test_settings(monkeypatch):
    key = settings.add_transient_auth_entry("secret")
    assert key.get() == "secret" and "secret" not in repr(key)
    with pytest.raises(KeyError):
        settings.ref_auth_entry("none")
    monkeypatch.setenv("RILLSPARK_APP_NAMESPACE", "ns")
    s = settings.Settings.from_env()
    assert settings.full_name(s, "f") == "ns.f" and settings.target_name(s, "f", "t") == "ns__f__t"


class Drive:
    TREE = {"root": [("a", "a.txt", "text/plain", 5, False), ("sub", "sub", "folder", 1, True)], "sub": [("b", "b", "application/vnd.google-apps.document", 6, False)]}

    def children(self, folder):
        return self.TREE.get(folder, [])

    def content(self, file_id, kind):
        return f"{file_id} as {kind}".encode()


def test_drive(spark):
    source = DriveFolders(Drive, ["root"])
    assert sorted(map(tuple, source.read(spark).select("file_id", "content").collect())) == [("a", "a as None"), ("b", "b as text/markdown")]
    assert sorted(map(tuple, source.listing(spark).collect())) == [("a", 5), ("b", 6)]


def test_source_connector(spark):
    @source_connector(["k"])
    class Mine:
        def __init__(self, n):
            self.n = n

        def list_rows(self, s):
            return s.range(self.n).selectExpr("id as k", "id * 10 as _ordinal")

        def get_value(self, s, keys):
            return keys.selectExpr("k", "k + 1 as v")

    made = Mine(3)
    assert [tuple(r) for r in made.read(spark).collect()] == [(0, 1), (1, 2), (2, 3)]
    assert [r._ordinal for r in made.listing(spark).collect()] == [0, 10, 20]


def test_http(spark, flow, tmp_path):
    import json
    import urllib.error
    import urllib.request
    from urllib.parse import quote

    from rillspark.server import Api, serve

    running = serve(Api(spark, str(tmp_path / "s")), "127.0.0.1:0", ("http://page",))
    base = f"http://127.0.0.1:{running.server_address[1]}"

    def ask(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{base}{path}", method=method, headers={"Origin": "http://page"})) as r:
                assert r.headers["Access-Control-Allow-Origin"] == "http://page"
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    key = quote('{"id":1}')
    try:
        assert ask("/healthz") == (200, {"status": "ok"}) and "svc" in ask("/api/flows")[1]
        assert ask("/api/flows/svc")[1]["name"] == "svc" and ask("/api/flows/svc/schema")[1]["out"]["fields"][0]["name"] == "id"
        assert ask("/api/flows/svc/keys?source=src") == (200, {"keys": [{"id": 1}, {"id": 2}], "next": None})
        assert [r["w"] for r in ask(f"/api/flows/svc/data?source=src&key={key}")[1]["out"]] == ["a", "b"]
        assert ask("/api/flows/svc/queryHandlers/find?query=x")[1] == {"results": [{"q": "x"}], "query_info": {}}
        assert ask(f"/api/flows/svc/rowStatus?source=src&key={key}")[1]["action"] == "insert"
        assert ask("/api/flows/svc/update", "POST") == (200, {"src": {"insert": 2}})
        assert ask(f"/api/flows/svc/rowStatus?source=src&key={key}")[1]["action"] == "no_change"
        assert [ask(p)[0] for p in ("/api/flows/none", "/api/flows/svc/keys", "/other", "/api/flows/svc/x")] == [404] * 4
    finally:
        running.shutdown()


def test_server_command(spark, flow, tmp_path, capsys):
    assert cli.main(["server", "json:svc", "--store", str(tmp_path / "s"), "--address", "127.0.0.1:0", "--for-seconds", "0.2"]) == 0
    assert cli.main(["setup", "json:svc", "--store", str(tmp_path / "s")]) == 0 and "words is new" in capsys.readouterr().out
