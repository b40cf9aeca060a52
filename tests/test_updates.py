import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from rillspark.flow import Flow
from rillspark.functions.udf import function
from rillspark.operators.incremental import Indexer, action, latest, memoized
from rillspark.sinks import graph as G
from rillspark.sinks import keyed
from rillspark.sinks.keyed import Folder, KeyedTarget
from rillspark.plans import updates
from rillspark.sinks.targets import CustomTarget, JdbcTable, Stored, evaluate_and_dump, vector_points, yaml_of
from rillspark.sources.files import Files
from rillspark.sources.tables import CustomSource, Table
from rillspark.streaming.changes import ChannelFeed, QueueFeed, RecentFeed, TableFeed
from rillspark.streaming.live import LiveUpdater


def test_actions(spark):
    rows = [  # listed, tracked, ordinal, old ordinal, same logic, same content
        (False, True, None, 1, True, None, "delete"), (True, False, 1, None, False, None, "insert"), (True, True, 1000, 2000, True, False, "no_change"),
        (True, True, 2000, 1000, True, False, "update"), (True, True, 1000, 1000, True, False, "no_change"), (True, True, 1000, 1000, False, True, "reprocess"),
        (True, True, None, 1000, True, False, "update"), (True, True, None, None, True, True, "no_change"), (True, True, 2000, 1000, True, True, "no_change"),
        (True, True, 2000, 1000, False, True, "reprocess"), (True, True, 500, 1000, False, False, "no_change"),
    ]
    df = spark.createDataFrame(rows, "l boolean, t boolean, o long, p long, g boolean, c boolean, e string")
    got = df.select(action(F.col("l"), F.col("t"), F.col("o"), F.col("p"), F.col("g"), F.col("c")).alias("a"), "e").collect()
    assert [r.a for r in got] == [r.e for r in got]


def test_latest(spark):
    changes = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (3, None, "d"), (4, 3, "e")], "k long, o long, v string")
    tracked = spark.createDataFrame([(2, 1), (3, 9), (4, 2)], "k long, o long")
    assert sorted((r.k, r.v) for r in latest(changes, ["k"], "o", tracked).collect()) == [(1, "b"), (3, "d"), (4, "e")]


SCHEMA = "id long, text string, version long"


def build(current, ordinal=None, fn=None):
    flow = Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(Table(lambda s: s.createDataFrame(current["rows"], SCHEMA), ["id"], ordinal_column=ordinal), name="s").row() as r:
        r["words"] = r["text"].transform(lambda t: F.split(t, " "))
        with r["words"].row() as w:
            out.collect(id=r["id"], at=w["index"], word=w["value"].transform(fn or F.upper))
    out.export("words", current.get("target") or Stored(), primary_key_fields=["id", "at"])
    return flow


def rows_of(indexer):
    return sorted(map(tuple, indexer.target(indexer.flow.collectors[0].exports[0]).read().select("id", "at", "word").collect()))


def expected(rows):
    return sorted((i, n, w.upper()) for i, t, _ in rows for n, w in enumerate(t.split(" ")))


def test_updates_equal_a_rebuild_and_repeat_without_change(spark, tmp_path):
    rng = random.Random(3)
    current = {"rows": [(i, " ".join(rng.choices("abcd", k=rng.randint(1, 4))), 1) for i in range(12)]}
    indexer = Indexer(build(current), spark, str(tmp_path / "x"))
    indexer.update()
    assert rows_of(indexer) == expected(current["rows"])
    for _ in range(2):
        kept = [r for r in current["rows"] if rng.random() > 0.2]
        kept = [(i, t if rng.random() > 0.4 else t + " z", v) for i, t, v in kept]
        current["rows"] = kept + [(100 + rng.randint(0, 999), "new one", 1)]
        indexer.update()
        assert rows_of(indexer) == expected(current["rows"])
    again = indexer.update()
    assert again.stats == {"s": {"no_change": len(current["rows"])}}


def test_ordinals_skip_and_logic_reprocesses(spark, tmp_path):
    current = {"rows": [(1, "a b", 10), (2, "c", 10)]}
    indexer = Indexer(build(current, "version"), spark, str(tmp_path / "x"))
    assert indexer.update().stats["s"] == {"insert": 2}
    current["rows"] = [(1, "changed", 9), (2, "d", 11)]
    assert indexer.update().stats["s"] == {"no_change": 1, "update": 1}
    assert rows_of(indexer) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "D")]
    other = Indexer(build(current, "version", F.lower), spark, str(tmp_path / "x"))
    current["rows"] = [(1, "x", 10), (2, "d", 11)]
    assert other.update().stats["s"] == {"reprocess": 1, "update": 1}
    assert rows_of(other) == [(1, 0, "x"), (2, 0, "d")]


def test_stale_source_and_drop(spark, tmp_path):
    current = {"rows": [(1, "a", 1)]}
    path = str(tmp_path / "x")
    Indexer(build(current), spark, path).update()
    flow = Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(Table(lambda s: s.createDataFrame([(7, "q", 1)], SCHEMA), ["id"]), name="other").row() as r:
        out.collect(id=r["id"], at=r["version"], word=r["text"])
    out.export("words", Stored(), primary_key_fields=["id", "at"])
    indexer = Indexer(flow, spark, path)
    indexer.update()
    assert rows_of(indexer) == [(7, 1, "q")]
    indexer.drop()
    with pytest.raises(FileNotFoundError):
        rows_of(indexer)


def test_shared_keys_and_merge(spark, tmp_path):
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], 4)
    gone = lambda rows: spark.createDataFrame(rows, "_key string, _source string, _owner string")
    up = lambda rows: spark.createDataFrame(rows, "k long, v string, _source string, _owner string")
    target.merge(up([(1, "one", "s", "a"), (2, "two", "s", "a")]), gone([]))
    target.merge(up([(1, "uno", "s", "b")]), gone([]))
    assert sorted(map(tuple, target.read().collect())) == [(1, "uno"), (2, "two")]
    target.merge(up([]), gone([('{"k":1}', "s", "b")]))
    assert sorted(map(tuple, target.read().collect())) == [(1, "one"), (2, "two")]
    target.merge(up([]), gone([('{"k":1}', "s", "a")]))
    assert list(map(tuple, target.read().collect())) == [(2, "two")]


def test_custom_target_gets_changes(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def mutate(_, changes, folder=str(log)):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(f"{k['id']},{k['at']}={'-' if v is None else v['word']}" for k, v in changes))

    current = {"rows": [(1, "a b", 1), (2, "c", 1)], "target": CustomTarget(mutate)}
    indexer = Indexer(build(current), spark, str(tmp_path / "x"))
    take = lambda: sorted(line for p in log.iterdir() for line in [p.read_text(), p.unlink()][0].splitlines())
    indexer.update()
    assert take() == ["1,0=A", "1,1=B", "2,0=C"]
    current["rows"] = [(1, "a", 1), (3, "d", 1)]
    indexer.update()
    assert take() == ["1,1=-", "2,0=-", "3,0=D"]


def test_custom_target_query_reads_what_its_connector_wrote(spark, sf, monkeypatch):
    rows = lambda name: sorted((r.o_orderkey, r.cents) for r in updates.QUERIES[name][0](spark, sf).collect())
    right, write = rows("export_delete"), updates.json_changes
    assert rows("custom_target") == right
    monkeypatch.setattr(updates, "json_changes", lambda ready, changes: write(ready, changes[1:]))
    assert rows("custom_target") != right


def test_sql_statements():
    t = JdbcTable(lambda: None, "tab")
    assert t.statements(["a", "b"], ["a"])[0] == 'INSERT INTO tab ("a", "b") VALUES (%s, %s) ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'
    assert t.statements(["a"], ["a"])[0].endswith("DO NOTHING")


def test_memo(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def slow(t):
        calls.add(1)
        return len(t)

    compute = lambda df: df.withColumn("output", slow("t"))
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b")], "id long, t string")
    out, memo = memoized(df, None, ["t"], "v1", compute)
    memo = spark.createDataFrame(memo.collect(), memo.schema)
    done = calls.value
    assert done == 2
    out, _ = memoized(df, memo, ["t"], "v1", compute)
    assert sorted((r.id, r.output) for r in out.collect()) == [(1, 2), (2, 2), (3, 1)] and calls.value == done


def test_graph(spark):
    own = spark.createDataFrame([("p", "P")], "id string, name string")
    ends = spark.createDataFrame([("q", None, 1), ("q", "Q", 0), ("p", "other", 5)], "id string, name string, _order long")
    nodes = {r.id: (r.name, r._own) for r in G.nodes(own, [ends], ["id"]).collect()}
    assert nodes == {"p": ("P", True), "q": ("Q", False)}
    edges = spark.createDataFrame([("p", "x")], "a string, b string")
    assert [r.id for r in G.orphans(G.nodes(own, [ends], ["id"]), [(edges, ["a"])], ["id"]).collect()] == ["q"]


def test_points_and_dump(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0], None, 3), ("b", None, [[1.0]], 4)], "id string, v array<float>, m array<array<float>>, n long")
    got = {r.id: (r.vectors, r.multi_vectors, r.payload) for r in vector_points(rows, "id").collect()}
    assert got["a"] == ({"v": [1.0, 2.0]}, {}, '{"n":3}') and got["b"][0] == {} and got["b"][1] == {"m": [[1.0]]}
    current = {"rows": [(1, "a b", 1)]}
    assert evaluate_and_dump(build(current), spark, str(tmp_path / "d")) == ["s"]
    (text,) = [p.read_text() for p in (tmp_path / "d").rglob("part-*")]
    assert text.strip() == """---
"key":
  "id": 1
"exports":
  "out":
    -
      "id": 1
      "at": 0
      "word": "A"
    -
      "id": 1
      "at": 1
      "word": "B\""""


def test_yaml():
    assert yaml_of({"a": [], "b": {}, "c": None, "d": ["x", [1, True]], "e": "two\n\nlines", "f": " lead\n"}) == (
        '"a": []\n"b": {}\n"c": null\n"d":\n  - "x"\n  -\n    - 1\n    - true\n"e": |-\n  two\n\n  lines\n"f": " lead\\n"\n'
    )


def test_live(spark, tmp_path):
    current = {"rows": [(1, "a", 1)]}
    indexer = Indexer(build(current), spark, str(tmp_path / "x"))
    with LiveUpdater(indexer, refresh_interval=0.5) as live:
        assert live.next_status_updates()[0].stats["s"] == {"insert": 1}
        current["rows"] = [(1, "b", 2)]
        for _ in range(20):
            if any("update" in s.stats["s"] for s in live.next_status_updates()):
                break
    assert rows_of(indexer) == [(1, 0, "B")]


def test_scan_lists_all_files(spark, sf):
    import pathlib

    got = updates.scan_local_file(spark, sf)
    assert got.count() == len([*pathlib.Path(sf).rglob("*.parquet")]) > 2


def plain_flow(source, name="s"):
    flow = Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(source, name=name).row() as r:
        out.collect(**{f: r[f] for f in source.schema().names})
    out.export("rows", Stored(), primary_key_fields=source.keys)
    return flow


def test_only_changed_files_are_opened(spark, tmp_path, monkeypatch):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(5):
        (folder / f"f [{i}]*.txt").write_text(f"text {i}")
    opened = []
    contents = Files.contents
    monkeypatch.setattr(Files, "contents", lambda self, df: opened.append(sorted(r.filename for r in df.select("filename").collect())) or contents(self, df))
    source = Files(str(folder))
    source.schema()
    indexer = Indexer(plain_flow(source), spark, str(tmp_path / "x"))
    opened.clear()
    assert indexer.update().stats["s"] == {"insert": 5} and [len(o) for o in opened] == [5]
    opened.clear()
    (folder / "f [3]*.txt").write_text("other")
    os.utime(folder / "f [3]*.txt", (2e9, 2e9))
    (folder / "f [0]*.txt").unlink()
    assert indexer.update().stats["s"] == {"update": 1, "delete": 1, "no_change": 3} and opened == [["f [3]*.txt"]]
    opened.clear()
    indexer.update()
    assert opened in ([], [[]])
    got = {r.filename: r.content for r in indexer.target(indexer.flow.collectors[0].exports[0]).read().collect()}
    assert got == {"f [3]*.txt": "other", **{f"f [{i}]*.txt": f"text {i}" for i in (1, 2, 4)}}


def test_connectors_are_asked_for_changed_keys_once(spark, tmp_path):
    rows, asked = {1: ("a", 1), 2: ("b", 1), 3: ("c", 1)}, []

    def get_value(s, keys):
        wanted = sorted(r.id for r in keys.select("id").collect())
        asked.append(wanted)
        return s.createDataFrame([(i, rows[i][0]) for i in wanted], "id long, text string")

    source = CustomSource(["id"], lambda s: s.createDataFrame([(i, o) for i, (_, o) in rows.items()], "id long, _ordinal long"), get_value)
    indexer = Indexer(plain_flow(source), spark, str(tmp_path / "x"))
    asked.clear()
    indexer.update()
    assert asked == [[1, 2, 3]]
    asked.clear()
    rows[2] = ("new", 2)
    rows[4] = ("d", 1)
    del rows[1]
    assert indexer.update().stats["s"] == {"update": 1, "insert": 1, "delete": 1, "no_change": 1} and asked == [[2, 4]]
    got = indexer.target(indexer.flow.collectors[0].exports[0]).read()
    assert sorted(map(tuple, got.collect())) == [(2, "new"), (3, "c"), (4, "d")]


def test_a_crash_before_the_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    current = {"rows": [(1, "a", 1), (2, "b", 1)]}
    indexer = Indexer(build(current), spark, str(tmp_path / "x"))
    indexer.update()
    before, write = rows_of(indexer), Folder.write
    current["rows"] = [(1, "z", 2)]
    for name in ("state", "tracking"):
        def broken(self, what, value, after=None, name=name):
            if what == name:
                raise OSError("gone")
            write(self, what, value)

        monkeypatch.setattr(Folder, "write", broken)
        with pytest.raises(OSError, match="gone"):
            indexer.update()
        monkeypatch.setattr(Folder, "write", write)
        assert rows_of(indexer) == (before if name == "state" else [(1, 0, "Z")])
    indexer.update()
    assert rows_of(indexer) == [(1, 0, "Z")] and indexer.update().stats == {"s": {"no_change": 1}}


def test_states_are_never_replaced(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    for i in range(4):
        folder.write("state", {"n": i})
    assert folder.read("state") == {"n": 3} and len(folder.numbered("state")) == 2
    late = Folder(spark, str(tmp_path / "f"))
    late.numbered = lambda name: {2: "state-2.json", 3: "state-3.json"}
    with pytest.raises(OSError, match="another update"):
        late.write("state", {"n": 9})
    assert folder.read("state") == {"n": 3}


def test_versions_are_compacted_and_buckets_grow(spark, tmp_path, monkeypatch):
    rng, held = random.Random(2), {}
    monkeypatch.setattr(keyed, "LARGE", 40)
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], 2)
    for step in range(9):
        up = {rng.randrange(200): f"v{step}" for _ in range(25)}
        out = rng.sample(sorted(set(held) - set(up)), min(4, len(set(held) - set(up))))
        target.merge(spark.createDataFrame([(k, v, "s", "o") for k, v in up.items()], "k long, v string, _source string, _owner string"), spark.createDataFrame([(f'{{"k":{k}}}', "s", "o") for k in out], "_key string, _source string, _owner string"))
        held = {k: v for k, v in held.items() if k not in out} | up
        assert dict(map(tuple, target.read().collect())) == held
    state = target.state()
    assert state["buckets"] == 8 and max(state["deltas"]) < keyed.DELTAS and sum(state["rows"]) >= len(held)
    assert target.merge(spark.createDataFrame([], "k long, v string, _source string, _owner string"), spark.createDataFrame([], "_key string, _source string, _owner string")) == state["version"]


def test_two_passes_at_once_wait_for_each_other(spark, tmp_path):
    current = {"rows": [(i, "a b", 1) for i in range(5)]}
    indexer = Indexer(build(current), spark, str(tmp_path / "x"))
    found = []
    threads = [threading.Thread(target=lambda: found.append(indexer.update().stats["s"])) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, found)) == ["{'insert': 5}", "{'no_change': 5}"] and rows_of(indexer) == expected(current["rows"])


def test_failing_passes_are_repeated(spark, tmp_path):
    current, calls, errors = {"rows": [(1, "a", 1)]}, [], []
    indexer = Indexer(build(current), spark, str(tmp_path / "x"))
    update = indexer.update

    def flaky(*args):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not now")
        return update(*args)

    indexer.update = flaky
    indexer.flow.sources["s"].refresh_interval = 300
    with LiveUpdater(indexer, retry=0.01, on_status=errors.append) as live:
        assert live.refresh_interval == 300 and live.next_status_updates()[0].stats["s"] == {"insert": 1}
    assert len(calls) == 3 and [type(e) for e in errors[:2]] == [OSError, OSError]


def test_limits_bound_what_python_gets(spark, tmp_path):
    current = {"rows": [(i, "a", 1) for i in range(50)]}
    flow, sizes = build(current), []
    flow.sources["s"].limits = (7, None)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    indexer, before = Indexer(flow, spark, str(tmp_path / "x")), spark.conf.get(name)
    passed = indexer.passed
    indexer.passed = lambda mode, told: sizes.append(spark.conf.get(name)) or passed(mode, told)
    indexer.update()
    assert sizes == ["7"] and spark.conf.get(name) == before


def test_cached_functions_are_evaluated_once_per_input(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    @function(cache=True, behavior_version=1)
    def shout(text: str, mark: str = "!") -> str:
        import pathlib
        import uuid

        (pathlib.Path(str(log)) / uuid.uuid4().hex).write_text(text)
        return text.upper() + mark

    calls = lambda: sorted(p.read_text() for p in log.iterdir() if p.is_file())
    current = {"rows": [(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, None, 1)]}
    flow = Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(Table(lambda s: s.createDataFrame(current["rows"], SCHEMA), ["id"]), name="s").row() as r:
        out.collect(id=r["id"], at=r["version"], word=r["text"].transform(shout))
    out.export("words", Stored(), primary_key_fields=["id", "at"])
    indexer = Indexer(flow, spark, str(tmp_path / "x"))
    indexer.update()
    assert rows_of(indexer) == [(1, 1, "A!"), (2, 1, "A!"), (3, 1, "B!"), (4, 1, None)] and calls() == ["a", "b"]
    current["rows"] = [(1, "a", 2), (2, "c", 1), (5, "b", 1)]
    indexer.update()
    assert rows_of(indexer) == [(1, 2, "A!"), (2, 1, "C!"), (5, 1, "B!")] and calls() == ["a", "b", "c"]
    indexer.update("full_reprocess")
    assert rows_of(indexer) == [(1, 2, "A!"), (2, 1, "C!"), (5, 1, "B!")] and calls() == ["a", "a", "b", "b", "c", "c"]


class Says:
    def __init__(self, **lists):
        self.lists, self.deleted = lists, []

    def receive(self, most):
        return self.lists.pop("receive", [])

    def notifications(self):
        return self.lists.pop("notifications", [])

    def messages(self):
        return self.lists.pop("messages", [])

    def delete(self, receipt):
        self.deleted.append(receipt)

    def recent(self, page):
        return self.lists["pages"][page] if page < len(self.lists["pages"]) else []

    def covered(self, i):
        return i != "other"


def test_feeds():
    body = json.dumps({"Records": [{"eventName": f"Object{k}:x", "s3": {"object": {"key": f"{p}/f{k}"}}} for k, p in (("Created", "in"), ("Removed", "in"), ("Created", "out"))]})
    created = [('{"filename": "fCreated"}', None, False), ('{"filename": "fRemoved"}', None, True)]
    queue = QueueFeed(Says(receive=[("r1", body), ("r2", "{}")]), "in")
    found, after = queue.poll({})
    assert found == created and queue.client.deleted == []
    queue.done(after)
    assert queue.client.deleted == ["r1", "r2"] and ChannelFeed(Says(messages=[body]), "in").poll({})[0] == created
    rows = TableFeed(Says(notifications=['{"op": "UPDATE", "fields": {"id": 1, "at": 5}}', '{"op": "DELETE", "fields": {"id": 2}}']), "at")
    assert rows.poll({})[0] == [('{"id": 1}', 5, False), ('{"id": 2}', None, True)]
    made = TableFeed.statements("t", ["id"], "at", "ch")
    assert "json_build_object('id', NEW.\"id\", 'at', NEW.\"at\")" in made[0] and made[2].endswith("EXECUTE FUNCTION ch_notify()")
    drive = RecentFeed(Says(pages=[[("a", 9), ("other", 8)], [("b", 7), ("c", 3)], [("d", 1)]]))
    found, after = drive.poll({"modified": 3})
    assert found == [('{"file_id": "a"}', 9, False), ('{"file_id": "b"}', 7, False)] and after == {"modified": 9} and drive.poll(after)[0] == []


def test_a_feed_is_told_after_the_pass(spark, tmp_path):
    current = {"rows": [(1, "a", 1)]}
    indexer = Indexer(build(current), spark, str(tmp_path / "x"))
    feed = QueueFeed(Says(), "")
    with LiveUpdater(indexer, feeds=[feed], poll=0.05, retry=0.01) as live:
        live.next_status_updates()
        update, failed = indexer.update, []
        indexer.update = lambda **a: failed.append(feed.client.deleted[:]) or (update(**a) if len(failed) > 1 else 1 / 0)
        current["rows"] = [(1, "b", 2), (2, "not told", 1)]
        feed.poll = lambda position, poll=feed.poll: ([('{"id": 1}', None, False)] * len((found := poll(position))[0]), found[1])
        feed.client.lists["receive"] = [("r", json.dumps({"Records": [{"eventName": "ObjectCreated:Put", "s3": {"object": {"key": "k"}}}]}))]
        assert live.next_status_updates()[0].stats["s"] == {"update": 1} and failed == [[], []]
        for _ in range(100):
            if feed.client.deleted:
                break
            threading.Event().wait(0.05)
    assert feed.client.deleted == ["r"]
