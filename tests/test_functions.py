import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from rillspark.functions.providers import Client
from rillspark.functions import model, text
from rillspark.functions.udf import Options, executor_class, function, runs_before
from rillspark.operators import search as S
from rillspark.sources.files import Files, decode_text, glob_regex, matches


def test_null_arguments_skip_the_function(spark):
    @function()
    def total(a: int, b: int | None, c: int, d: int | None) -> int:
        return a + (b or 0) + c + (d or 0)

    df = spark.createDataFrame([(1, 2, 4, 8), (1, None, 4, None), (None, 2, 4, 8), (1, 2, None, None)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(total(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [15, 5, None, None]


def test_structs_and_batches(spark):
    @dataclass
    class Point:
        x: int
        name: str

    @function()
    def point(x: int) -> Point:
        return Point(x, str(x))

    @function(batching=True, max_batch_size=2)
    def sizes(xs: list[str]) -> list[int]:
        assert len(xs) <= 2
        return [len(x) for x in xs]

    df = spark.createDataFrame([(1, "a"), (None, "bb"), (3, None)], "x long, s string")
    got = df.select(point(F.col("x")).alias("p"), sizes(F.col("s")).alias("n")).collect()
    assert got[0].p.name == "1" and [r.n for r in got] == [1, 2, None]


def test_executor_is_prepared_once_per_spec(spark):
    @executor_class()
    class Add:
        def prepare(self):
            self.n = self.spec * 10

        def __call__(self, x: int) -> int:
            return x + self.n

    assert [r[0] for r in spark.range(3).select(Add(2)(F.col("id"))).collect()] == [20, 21, 22]


def test_options_and_deadline():
    import time

    with pytest.raises(ValueError):
        Options(cache=True)
    assert Options(cache=True, behavior_version=1).cache
    assert runs_before(5, "f", lambda: 3) == 3
    with pytest.raises(TimeoutError):
        runs_before(0.2, "f", lambda: time.sleep(1))


def test_text(spark):
    df = spark.createDataFrame([("SSN 123-45-6789, call (555) 123-4567 or a.b@c.org",), (None,), ("Data BREACH and carbon",)], "t string")
    got = df.select(text.scrub_pii(F.col("t")), text.extract_topics(F.col("t"))).collect()
    assert got[0][0] == "SSN [SSN REDACTED], call [PHONE REDACTED] or [EMAIL REDACTED]"
    assert got[1][0] is None and got[1][1] is None and got[2][1] == ["RISK:CYBER", "RISK:CLIMATE"]


def test_json(spark):
    df = spark.createDataFrame([('{"city": "Magdeburg"}',)], "t string")
    assert df.select(text.json_field(F.col("t"), "$.city", "string")).first()[0] == "Magdeburg"
    with pytest.raises(Exception):
        spark.createDataFrame([("{bad",)], "t string").select(text.parse_json(F.col("t")).cast("string")).collect()


def test_embedding_and_extraction(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("hello world",)], "t string")
    got = [r[0] for r in df.select(model.embed_text(F.col("t"), dimension=8)).collect()]
    assert got[0] == got[2] and len(got[0]) == 8 and got[1] is None
    with pytest.raises(ValueError):
        model.client_factory("Voyage", "generation")

    class Client:
        def __init__(self, model=""):
            pass

        def generate(self, prompt, schema, image=None):
            return '{"value": [1, 2]}'

    assert [r[0] for r in df.select(model.extract(list[int], Client, F.col("t"))).collect()] == [[1, 2], None, [1, 2]]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "skip").mkdir()
    for name, data in {"a/x.txt": b"plain", "a/bom8.txt": b"\xef\xbb\xbfh\xc3\xa9", "a/bom16.txt": "hé".encode("utf-16"), "bad.txt": b"a\xffb", "big.txt": b"x" * 100, "y.md": b"#", "skip/z.txt": b"z"}.items():
        (tmp_path / name).write_bytes(data)
    files = Files(str(tmp_path), included_patterns=["*.txt"], excluded_patterns=["skip"], max_file_size=50)
    assert dict(map(tuple, files.read(spark).collect())) == {"a/x.txt": "plain", "a/bom8.txt": "hé", "a/bom16.txt": "hé", "bad.txt": "a�b"}
    assert all(r._ordinal > 10**15 for r in files.listing(spark).collect())
    assert decode_text(None) is None


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.py", ["a.py", "d/a.py"], ["a.pyc"]), ("**/t/*.md", ["t/a.md", "x/t/a.md"], ["tt/a.md"]), ("{a,b}?.c", ["a1.c", "b2.c"], ["c1.c", "a.c"]), ("[!a]x", ["bx"], ["ax"])])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(n,) for n in yes + no], "n string")
    assert [r[0] for r in df.where(matches(F.col("n"), [glob], None)).collect()] == yes
    assert glob_regex(glob)


def test_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<float>")
    q = S.vector([1.0, 0.0])
    assert [r.id for r in S.knn(rows, "v", q, 2).collect()] == [1, 3]
    assert [r.id for r in S.knn(rows, "v", q, 3, "ip").collect()] == [1, 3, 2]
    assert [r.id for r in S.knn(rows, "v", q, 3, "l2", F.col("id") > 1).collect()] == [3, 2]
    two = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[0.5, 0.5], [1.0, 0.0]])], "q array<array<float>>, d array<array<float>>")
    assert two.select(S.maxsim(F.col("q"), F.col("d"))).first()[0] == 2.0
    cells, _ = S.ivf_cells(rows, "v", 2)
    assert cells.where("cell IS NULL").count() == 0 and cells.count() == 3
    t = spark.createDataFrame([("The quick brown fox",), ("brown quick",), ("",)], "t string")
    c = F.col("t")
    got = t.select(S.match_any(c, ["fox", "zzz"]), S.match_all(c, ["quick", "brown"]), S.match_phrase(c, "quick brown")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, False), (False, False, False)]


def test_provider_requests():
    sent = []

    def client(kind, answer, **more):
        return Client(kind, "m", api_key="k", send=lambda url, body, headers: sent.append((url, body, headers)) or answer, **more)

    chat = {"choices": [{"message": {"content": "{}"}}]}
    made = {
        "OpenAi": (chat, {}, "https://api.openai.com/v1/chat/completions", "Authorization"), "AzureOpenAi": (chat, {"address": "https://x"}, "https://x/openai/deployments/m/chat/completions?api-version=2024-10-21", "api-key"),
        "Ollama": ({"response": "{}"}, {}, "http://127.0.0.1:11434/api/generate", "Authorization"), "Anthropic": ({"content": [{"type": "tool_use", "input": {}}]}, {}, "https://api.anthropic.com/v1/messages", "x-api-key"),
        "Gemini": ({"candidates": [{"content": {"parts": [{"text": "{}"}]}}]}, {}, "https://generativelanguage.googleapis.com/v1beta/models/m:generateContent", "x-goog-api-key"),
        "Bedrock": ({"output": {"message": {"content": [{"toolUse": {"input": {}}}]}}}, {"region": "r"}, "https://bedrock-runtime.r.amazonaws.com/model/m/converse", "Authorization"),
    }
    for kind, (answer, more, url, header) in made.items():
        assert client(kind, answer, **more).generate("p", {"type": "object"}, b"\x89PNG") == "{}"
        assert sent[-1][0] == url and header in sent[-1][2] and "iVBORw" in str(sent[-1][1])
    data = {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
    assert client("Voyage", data, dimension=1).embed(["a", "b"]) == [[1.0], [2.0]] and sent[-1][1]["output_dimension"] == 1
    assert client("Gemini", {"embeddings": [{"values": [1.0]}]}).embed(["a"]) == [[1.0]] and client("Ollama", {"embeddings": [[1.0]]}).embed(["a"]) == [[1.0]]
    assert client("VertexAi", {"predictions": [{"embeddings": {"values": [1.0]}}]}, project="p", location="l").embed(["a"]) == [[1.0]]
    with pytest.raises(ValueError):
        Client("AzureOpenAi", "m")


def test_providers_by_name(spark, monkeypatch):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        failed = []

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            status = 200 if self.failed else 503
            self.failed.append(1)
            answer = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]} if "input" in body else {"choices": [{"message": {"content": json.dumps({"value": [len(body["messages"][0]["content"][0]["text"])]})}}]}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            return None

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_address[1]}"
    df = spark.createDataFrame([("abc",), (None,), ("de",)], "t string")
    assert [r[0] for r in df.select(model.embed_text(F.col("t"), "OpenAi", "m", address=address)).collect()] == [[3.0], None, [2.0]]
    assert [r[0] for r in df.select(model.extract(list[int], "Vllm", F.col("t"), model="m", address=address)).collect()] == [[3], None, [2]]
    server.shutdown()


def test_query_vectors_and_missing_libraries(spark):
    class Late:
        def __init__(self, model):
            pass

        def embed_query(self, text):
            return [[float(len(w))] for w in text.split()]

    df = spark.createDataFrame([("a bc",), (None,)], "t string")
    assert [r[0] for r in df.select(model.embed_queries(F.col("t"), Late)).collect()] == [[[1.0], [2.0]], None]
    with pytest.raises(ModuleNotFoundError):
        model.SentenceTransformer("m")
