"""Identities of sources and resources, writers that meet, ordinals over batches, whole integers."""

import json
import pathlib
import random
import uuid
from functools import partial

import pytest
from pyspark.sql import functions as F

from rillspark.flow import Flow
from rillspark.functions.udf import function
from rillspark.operators.incremental import Indexer
from rillspark.plans.updates import JsonStore
from rillspark.sinks import keyed
from rillspark.sinks.keyed import Conflict, Folder, KeyedTarget
from rillspark.sinks.stores import Doris, Postgres
from rillspark.sinks.targets import CustomTarget, FtsIndexDef, Stored
from rillspark.sources.tables import Table


class Kept(JsonStore):
    """Columns are dropped and added in place, but for an index's or keys' change."""

    def change(self, old, new):
        if old and new and (old["index"], old["keys"]) == (new["index"], new["keys"]):
            return [("alter", {"gone": [c for c in old["columns"] if new["columns"].get(c) != old["columns"][c]]})] if old != new else []
        return super().change(old, new)

    def run(self, client, steps):
        for name, given in steps:
            if name != "alter":
                super().run(client, [(name, given)])
                continue
            for p in pathlib.Path(client).iterdir():
                rows = [json.loads(line) for line in p.read_text().splitlines()]
                p.write_text("".join(json.dumps({k: v for k, v in r.items() if k not in given["gone"]}) + "\n" for r in rows))


def stored(store, keys, columns):
    """What the store holds of some columns."""
    last = {}
    for line in sorted((json.loads(x) for p in pathlib.Path(store.folder).glob("*.json") for x in p.read_text().splitlines()), key=lambda r: r["at"]):
        last[tuple(line[k] for k in keys)] = None if line["deleted"] else tuple(line.get(c) for c in columns)
    return {k: v for k, v in last.items() if v is not None}


def flow_of(rows, store, columns, keys=("id",), name="rows", **options):
    flow = Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(Table(lambda s: s.createDataFrame(rows, "id long, a string, b long"), ["id"]), name="s").row() as r:
        given = {"id": r["id"], "a": r["a"], "b": r["b"], "c": r["b"].transform(lambda b: b.cast("string")), "twice": r["b"].transform(lambda b: b * 2)}
        out.collect(**{c: given[c] for c in columns})
    out.export(name, store, primary_key_fields=list(keys), **options)
    return flow


def test_random_definitions_leave_what_a_rebuild_gives(spark, tmp_path):
    rng, folder = random.Random(5), str(tmp_path / "store")
    rows = [(i, f"t{i}", i * 10) for i in range(6)]
    for step in range(7):
        columns = ["id", *sorted(rng.sample(["a", "b", "c", "twice"], rng.randint(1, 3)))]
        store = Kept(folder, rng.choice("xy"))
        if rng.random() < 0.5:
            rows = [r for r in rows if rng.random() > 0.2] + [(100 + step, "new", step)]
        indexer = Indexer(flow_of(rows, store, columns, name=rng.choice(["one", "two"])), spark, str(tmp_path / "x"))
        if rng.random() < 0.4:
            indexer.setup()
        indexer.update()
        expected = {(i,): tuple({"id": i, "a": a, "b": b, "c": str(b), "twice": 2 * b}[c] for c in columns) for i, a, b in rows}
        assert stored(store, ["id"], columns) == expected, step
    assert Indexer(indexer.flow, spark, str(tmp_path / "x")).update().stats == {"s": {"no_change": len(rows)}}


def test_a_definition_that_changes_and_changes_back_between_updates(spark, tmp_path):
    rows, folder = [(1, "a", 1), (2, "b", 2)], str(tmp_path / "store")
    make = lambda index: Indexer(flow_of(rows, JsonStore(folder, index), ["id", "a"]), spark, str(tmp_path / "x"))
    make("x").update()
    make("y").setup()
    assert stored(JsonStore(folder, ""), ["id"], ["a"]) == {}
    make("x").setup()
    assert make("x").update().stats["s"] == {"reprocess": 2} and stored(JsonStore(folder, ""), ["id"], ["a"]) == {(1,): ("a",), (2,): ("b",)}


def test_a_new_name_of_an_export_keeps_its_rows_and_what_users_set_up_is_another_resource(spark, tmp_path):
    rows, folder = [(1, "a", 1)], str(tmp_path / "store")
    make = lambda name, **o: Indexer(flow_of(rows, JsonStore(folder, "x"), ["id", "a"], name=name, **o), spark, str(tmp_path / "x"))
    make("one").update()
    sent = sorted(pathlib.Path(folder).iterdir())
    assert make("two").update().stats["s"] == {"no_change": 1} and sorted(pathlib.Path(folder).iterdir()) == sent
    assert make("two", setup_by_user=True).update().stats["s"] == {"reprocess": 1} and len(list(pathlib.Path(folder).iterdir())) == len(sent) + 1


def test_setup_that_drops_a_table_is_told_from_one_that_alters_it():
    from tests.test_stores import SCHEMA, Export

    doris, postgres = Doris(None, "t"), Postgres(None, "t")
    plain, indexed = (doris.wanted(SCHEMA, ["id"], Export(fts_indexes=x)) for x in ([], [FtsIndexDef("text")]))
    assert doris.rebuilds(plain, indexed) and not doris.rebuilds(plain, plain) and not doris.rebuilds(None, plain)
    plain, indexed = (postgres.wanted(SCHEMA, ["id"], Export(fts_indexes=x)) for x in ([], [FtsIndexDef("text")]))
    assert not postgres.rebuilds(plain, indexed) and postgres.rebuilds(plain, postgres.wanted(SCHEMA, ["text"], Export()))


NONE = "_key string, _source string, _owner string"


def up(spark, rows):
    return spark.createDataFrame([(*r, "s", str(r[0])) for r in rows], "k long, v string, _source string, _owner string")


def gone(spark, keys=()):
    return spark.createDataFrame([(f'{{"k":{k}}}', "s", str(k)) for k in keys], NONE)


def content(target):
    return dict(map(tuple, target.read().collect()))


def test_a_writer_that_breaks_off_changes_nothing_for_another(spark, tmp_path, monkeypatch):
    a, b = (KeyedTarget(spark, str(tmp_path / "t"), ["k"], 2) for _ in range(2))
    a.merge(up(spark, [(1, "old"), (2, "old")]), gone(spark))
    commit = KeyedTarget.commit

    def between(self, *given):
        monkeypatch.setattr(KeyedTarget, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):  # b writes the same version and breaks off before its commit
            b.merge(up(spark, [(1, "b")]), gone(spark))
        monkeypatch.setattr(KeyedTarget, "commit", commit)
        return commit(self, *given)

    monkeypatch.setattr(KeyedTarget, "commit", between)
    a.merge(up(spark, [(1, "a")]), gone(spark))
    assert content(a) == {1: "a", 2: "old"} and content(b) == content(a)


@pytest.mark.parametrize("other, fails", [([(3, "b")], False), ([(1, "b")], True)])
def test_of_two_writers_both_commit_unless_they_have_keys_in_common(spark, tmp_path, monkeypatch, other, fails):
    a, b = (KeyedTarget(spark, str(tmp_path / "t"), ["k"], 2) for _ in range(2))
    a.merge(up(spark, [(1, "old"), (2, "old")]), gone(spark))
    commit = KeyedTarget.commit

    def between(self, *given):
        monkeypatch.setattr(KeyedTarget, "commit", commit)
        b.merge(up(spark, other), gone(spark, [2]))
        return commit(self, *given)

    monkeypatch.setattr(KeyedTarget, "commit", between)
    if fails:
        with pytest.raises(Conflict):
            a.merge(up(spark, [(1, "a")]), gone(spark))
        assert content(a) == {1: "b"}
        a.merge(up(spark, [(1, "a")]), gone(spark))
    else:
        a.merge(up(spark, [(1, "a")]), gone(spark))
    assert content(a) == {1: "a", **({} if fails else {3: "b"})}


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    import threading

    folder, won = str(tmp_path / "f"), []
    Folder(spark, folder).write("state", {"n": 0})

    def write(i):
        try:
            Folder(spark, folder).write("state", {"n": i}, 1)
            won.append(i)
        except Conflict:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and Folder(spark, folder).read("state") == {"n": won[0]}


def test_what_a_compaction_replaces_stays_for_readers_of_the_state_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "DELTAS", 2)
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], 1)
    target.merge(up(spark, [(1, "a"), (2, "a")]), gone(spark))
    target.merge(up(spark, [(1, "b")]), gone(spark))
    before = target.read()
    target.merge(up(spark, [(3, "c")]), gone(spark, [2]))  # compacts
    assert dict(map(tuple, before.collect())) == {1: "b", 2: "a"} and content(target) == {1: "b", 3: "c"}
    for i in range(2):
        target.merge(up(spark, [(9 + i, "x")]), gone(spark))
    assert content(target) == {1: "b", 3: "c", 9: "x", 10: "x"} and len(Folder(spark, str(tmp_path / "t")).names("rows")) <= 5


def test_ordinals_decide_in_any_order_of_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "DELTAS", 3)
    rng = random.Random(4)
    changes = [(k, o, None if rng.random() < 0.3 else f"v{o}") for o in range(40) for k in [rng.randrange(6)]]
    expected = {}
    for k, _, v in changes:
        expected[k] = v
    rng.shuffle(changes)
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], 2)
    parts = [changes[i : i + 8] for i in range(0, 40, 8)]
    for part in [*parts, parts[1]]:  # one comes twice
        rows = [(k, v, o, "s", "") for k, o, v in part if v is not None]
        marks = [(f'{{"k":{k}}}', "s", "", o) for k, o, v in part if v is None]
        target.merge(spark.createDataFrame(rows, "k long, v string, o long, _source string, _owner string"), spark.createDataFrame(marks, NONE + ", o long"), "o")
    assert {r.k: r.v for r in target.read().collect()} == {k: v for k, v in expected.items() if v is not None}


def test_columns_come_go_and_change_without_a_row_written(spark, tmp_path, monkeypatch):
    from pyspark.sql import types as T

    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], 2)
    rows = lambda given, schema: target.merge(spark.createDataFrame([(*r, "s", str(r[0])) for r in given], schema + ", _source string, _owner string"), gone(spark))
    kind = lambda text: T.StructType.fromDDL(text)
    got = lambda: {r.k: tuple(r)[1:] for r in target.read().select("k", *sorted(c for c in target.read().columns if c != "k")).collect()}
    rows([(1, "a", 7), (2, "b", None)], "k long, v string, n long")
    files = sorted((tmp_path / "t").rglob("*.parquet"))
    target.evolve(kind("k long, n string, w double"))  # v goes, n changes, w comes
    assert got() == {1: ("7", None), 2: (None, None)}
    target.evolve(kind("k long, n string, v string"))  # another v, which has none of the old one's values
    assert got() == {1: ("7", None), 2: (None, None)} and sorted((tmp_path / "t").rglob("*.parquet")) == files
    rows([(2, "x", "new"), (3, None, "c")], "k long, n string, v string")
    assert got() == {1: ("7", None), 2: ("x", "new"), 3: (None, "c")}
    monkeypatch.setattr(keyed, "DELTAS", 1)
    rows([(4, "y", "d")], "k long, n string, v string")  # compacts
    assert got() == {1: ("7", None), 2: ("x", "new"), 3: (None, "c"), 4: ("y", "d")}
    target.evolve(kind("k long, n long"))
    assert got()[1] == (7,) if spark.conf.get("spark.sql.ansi.enabled") == "false" else True


BIG = 2**53 + 1


def test_integers_stay_whole_beside_nulls(spark, tmp_path):
    @function()
    def same(x: int | None) -> int | None:
        assert x is None or type(x) is int
        return x

    @function()
    def first(xs: list[int]) -> int:
        return xs[0]

    df = spark.createDataFrame([(1, BIG, [BIG, 1]), (2, None, None), (3, -BIG, [3])], "id long, x long, xs array<long>")
    assert sorted(map(tuple, df.select("id", same(F.col("x")).alias("y"), first(F.col("xs")).alias("z")).collect())) == [(1, BIG, BIG), (2, None, None), (3, -BIG, 3)]
    log = str(tmp_path / "log")
    pathlib.Path(log).mkdir()

    def mutate(_, changes):
        pathlib.Path(log, uuid.uuid4().hex).write_text("\n".join(repr((k, v)) for k, v in changes))

    CustomTarget(mutate).apply(df, df.where("false").select("id"), ["id"])
    got = sorted(line for p in pathlib.Path(log).iterdir() for line in p.read_text().splitlines())
    assert got[0] == f"({{'id': 1}}, {{'x': {BIG}, 'xs': [{BIG}, 1]}})" and got[1] == "({'id': 2}, {'x': None, 'xs': None})"
    import sqlite3

    path = str(tmp_path / "db")
    sqlite3.connect(path).execute("CREATE TABLE t (id INTEGER PRIMARY KEY, x INTEGER)")
    Postgres(partial(sqlite3.connect, path, timeout=30), "t", mark="?").apply(df.select("id", "x"), df.where("false").select("id"), ["id"])
    assert sqlite3.connect(path).execute("SELECT x FROM t ORDER BY id").fetchall() == [(BIG,), (None,), (-BIG,)]


def test_told_keys_alone_are_looked_at(spark, tmp_path):
    from rillspark.sources.tables import CustomSource

    rows, asked, listed = {i: (f"t{i}", 1) for i in range(5)}, [], []

    def get_value(s, keys):
        wanted = sorted(r.id for r in keys.select("id").collect())
        asked.append(wanted)
        return s.createDataFrame([(i, rows[i][0]) for i in wanted if i in rows], "id long, text string")

    source = CustomSource(["id"], lambda s: listed.append(1) or s.createDataFrame([(i, o) for i, (_, o) in rows.items()], "id long, _ordinal long"), get_value)
    flow = Flow("f")
    out = flow.add_collector("out")
    with flow.add_source(source, name="s").row() as r:
        out.collect(id=r["id"], text=r["text"])
    out.export("rows", Stored(), primary_key_fields=["id"])
    indexer = Indexer(flow, spark, str(tmp_path / "x"))
    indexer.update()
    asked.clear(), listed.clear()
    rows[2], rows[9] = ("new", 2), ("nine", 7)
    del rows[3]
    rows[4] = ("not told", 5)
    told = spark.createDataFrame([(2, 2, False), (3, 3, False), (9, 7, False)], "id long, _ordinal long, _gone boolean")
    assert indexer.update(told={"s": told}).stats == {"s": {"update": 1, "delete": 1, "insert": 1}} and asked == [[2, 3, 9]] and not listed
    got = lambda: dict(map(tuple, indexer.target(flow.collectors[0].exports[0]).read().collect()))
    assert got() == {0: "t0", 1: "t1", 2: "new", 4: "t4", 9: "nine"}
    asked.clear()
    assert indexer.update(told={"s": told.limit(1)}).stats == {"s": {"no_change": 1}}  # told again, with the same ordinal
    assert indexer.update(told={"s": spark.createDataFrame([(0, 9, True)], told.schema)}).stats == {"s": {"delete": 1}} and asked == [[2], []]
    assert indexer.update().stats == {"s": {"insert": 1, "no_change": 3, "update": 1}}  # a listing finds what wasn't told


def read_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_many_owners_can_be_named(spark, tmp_path):
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], 2)
    target.merge(up(spark, [(i, "a") for i in range(700)]), gone(spark))
    assert target.rows(owners=[("s", str(i)) for i in range(keyed.NAMED)]).count() == keyed.NAMED and target.rows(owners=[]).count() == 0
    source = Table(lambda s: s.range(900).withColumnRenamed("id", "k"), ["k"])
    assert source.told(spark, spark.range(150, 340).withColumnRenamed("id", "k")).count() == 190


def test_an_update_reads_what_it_changes(spark, tmp_path):
    n = 300_000
    target = KeyedTarget(spark, str(tmp_path / "t"), ["k"], 4)
    rows = spark.range(n).selectExpr("id AS k", "repeat(md5(string(id)), 4) AS v", "'s' AS _source", "string(id) AS _owner")
    target.merge(rows, gone(spark))
    whole = sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet"))
    before = read_bytes(spark)
    owners = [("s", str(k)) for k in range(5, n, n // 9)]
    old = target.rows(columns=[], owners=owners).select("_key", "_source", "_owner", "_fp")
    assert sorted(int(r._owner) for r in old.collect()) == sorted(int(o) for _, o in owners)
    narrow = read_bytes(spark) - before
    assert narrow < whole / 4, (narrow, whole)


def test_rows_are_written_in_few_bytes(spark, tmp_path):
    n, path = 20_000, tmp_path / "t"
    rows = spark.range(n).selectExpr("id AS k", "id % 7 AS v", "'s' AS _source", "concat('{\"k\":', id, '}') AS _owner")
    KeyedTarget(spark, str(path), ["k"], 1).merge(rows)
    assert sum(f.stat().st_size for f in path.rglob("*.parquet")) < 40 * n
