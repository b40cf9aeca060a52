import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark import flow as W
from rillspark.sources.tables import Table


def table(spark, rows, schema, *keys, **kw):
    return Table(lambda s: s.createDataFrame(rows, schema), list(keys), **kw)


def test_scopes_and_ancestors(spark):
    flow = W.Flow("f")
    out = flow.add_collector()
    with flow.add_source(table(spark, [(1, ["a", "b"]), (2, []), (3, None)], "id long, xs array<string>", "id")).row() as r:
        with r["xs"].row() as x:
            x["up"] = x["value"].transform(F.upper)
            tag = flow.transform(lambda i, u: F.concat(i.cast("string"), u), r["id"], x["up"])
            out.collect(id=r["id"], tag=tag, at=x["index"])
    got = flow.compile(spark)[out.name].collect()
    assert sorted(map(tuple, got)) == [(1, "1A", 0), (1, "1B", 1)]


def test_write_back_into_nested_tables(spark):
    rows = [(1, [{"value": 1}, {"value": 2}]), (2, []), (3, None)]
    flow = W.Flow("f")
    with flow.add_source(table(spark, rows, "id long, children array<struct<value:long>>", "id")).row() as r:
        with r["children"].row() as c:
            c["new_field"] = c["value"].transform(lambda v: v + 10)
    got = {x[0]: x[1] for x in c.folded(spark).select(r["id"].col(), r["children"].col()).collect()}
    assert [(e.value, e.new_field) for e in got[1]] == [(1, 11), (2, 12)] and got[2] == [] and got[3] is None


def test_errors(spark):
    flow = W.Flow("f")
    a = flow.add_source(table(spark, [(1,)], "id long", "id"), name="a").scope
    b = flow.add_source(table(spark, [(1,)], "id long", "id"), name="b").scope
    with pytest.raises(ValueError):
        flow.transform(lambda x, y: x + y, a["id"], b["id"])
    with pytest.raises(KeyError):
        a["nope"]
    a["x"] = a["id"]
    with pytest.raises(ValueError):
        a["x"] = a["id"]
    with pytest.raises(ValueError):
        flow.add_source(table(spark, [(1,)], "id long", "id"), name="a")
    with pytest.raises(ValueError):
        Table(lambda s: None, [])
    out = flow.add_collector()
    with pytest.raises(ValueError):
        out.export("e", None, primary_key_fields=[])


def test_generated_uuid_is_stable_and_distinct(spark):
    def build(rows):
        flow = W.Flow("f")
        out = flow.add_collector()
        with flow.add_source(table(spark, rows, "id long, xs array<string>", "id"), name="s").row() as r:
            with r["xs"].row() as x:
                out.collect(uid=W.GeneratedField.UUID, id=r["id"], x=x["value"])
        return {(i.id, i.x, i.uid) for i in flow.compile(spark)[out.name].collect()}

    one, two = build([(1, ["a", "a", "b"])]), build([(1, ["a", "a", "b", "c"])])
    assert len({u for _, _, u in one}) == 3 and one < two and all(len(u) == 36 for _, _, u in one)


def test_merge_of_collects_checks_types(spark):
    flow = W.Flow("f")
    out = flow.add_collector()
    with flow.add_source(table(spark, [(1, "x")], "id long, t string", "id")).row() as r:
        out.collect(k=r["id"], a=r["t"])
        out.collect(k=r["t"])
    with pytest.raises(ValueError):
        flow.compile(spark)


def test_transform_flow_and_registry(spark):
    shared = W.transform_flow("long")(lambda x: x * 2)
    assert shared.eval(spark, 21) == 42
    W.remove_flow("reg")
    made = W.open_flow("reg", lambda f, s: None)
    assert W.flow_by_name("reg") is made and "reg" in W.flow_names()
    with pytest.raises(KeyError):
        W.open_flow("reg", lambda f, s: None)
    W.remove_flow("reg")


def test_table_source_checks(spark):
    with pytest.raises(ValueError):
        table(spark, [(1.5,)], "k double", "k").read(spark)
    with pytest.raises(ValueError):
        table(spark, [(1, "x")], "k long, o string", "k", ordinal_column="o").read(spark)
    t = table(spark, [(1, 2, 3)], "k int, a int, b int", "k", included_columns=["a"], filter="a > 1")
    assert t.read(spark).schema == T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.LongType())])
