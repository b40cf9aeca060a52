"""Every query of the package against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from rillspark import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return made


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, sf, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    expected = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and got == expected


@pytest.mark.parametrize("name", ["chunk_index", "embed_text", "vector_store", "extract_struct", "evaluate_dump", "live_stream", "scan_local_file"])
def test_without_sql(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    assert df.count() > 0


def test_chunks_of_the_flagship_flow_are_their_places(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.queries()["chunk_index"](spark, sf).collect()
    assert rows and all(docs[r.doc_id][r.start : r.end] == r.text for r in rows)
    assert {r.doc_id for r in rows} == {i for i, t in docs.items() if t.strip()}
