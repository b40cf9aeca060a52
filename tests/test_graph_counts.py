"""Counts of relationships by node, kept by what changes, against a count of all."""

import random
import time
from collections import Counter

import pytest

from rillspark.sinks.graph import EndpointCounts
from tests.test_keyed import read_bytes

SCHEMA = "e long, a long, b long"


def counts_of(edges):
    return dict(Counter(x for ends in edges.values() for x in ends if x is not None))


def test_random_updates_equal_a_rebuild(spark, tmp_path):
    rng, edges = random.Random(4), {}
    kept = EndpointCounts(spark, str(tmp_path / "g"), ["e"], [["a"], ["b"]], ["id"], buckets=4)
    end = lambda: rng.choice([None, *range(6)])
    for _ in range(3):
        new = {rng.randrange(30): (end(), end()) for _ in range(10)}
        gone = [k for k in rng.sample(range(30), 6) if k not in new]
        kept.update(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA), spark.createDataFrame([(k,) for k in gone], "e long"))
        edges = {k: v for k, v in (edges | new).items() if k not in gone}
        assert {r.id: r.n for r in kept.read().collect()} == counts_of(edges)


def test_an_update_that_broke_off_is_counted_again(spark, tmp_path, monkeypatch):
    kept = EndpointCounts(spark, str(tmp_path / "g"), ["e"], [["a"], ["b"]], ["id"], buckets=2)
    kept.update(spark.createDataFrame([(1, 5, 6), (2, 5, 5)], SCHEMA))
    monkeypatch.setattr(kept, "add", lambda given: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.update(spark.createDataFrame([(3, 6, 7)], SCHEMA), spark.createDataFrame([(1,)], "e long"))
    monkeypatch.undo()
    assert {r.id: r.n for r in kept.read().collect()} == {5: 2, 6: 1, 7: 1}


def test_a_small_change_reads_little(spark, tmp_path):
    kept = EndpointCounts(spark, str(tmp_path / "g"), ["e"], [["a"]], ["id"], buckets=4)
    kept.update(spark.range(300_000).selectExpr("id AS e", "id AS a", "id AS b"))
    whole = sum(p.stat().st_size for p in (tmp_path / "g").rglob("*.parquet"))
    time.sleep(2)  # until the last stage's bytes are counted
    before = read_bytes(spark)
    kept.update(spark.createDataFrame([(7, 8, 0), (900_000, 8, 0)], SCHEMA))
    time.sleep(2)
    read = read_bytes(spark) - before
    assert read < whole / 3, (read, whole)
    assert {r.id: r.n for r in kept.read().where("id < 10").collect()} == {i: 3 if i == 8 else 1 for i in range(10) if i != 7}
