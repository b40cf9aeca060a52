"""The source divergence audit against brute force."""

import collections
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillspark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (None, None, None), ("", "en", "empty"), (None, "en", "null"), ("The THE the", "xx", "a"), ("the The", "xx", "b"), ("other", "xx", "b"), ("the", "xx", "c"),
    ("1 2 3 .", "yy", "a"), ("only", "yy", "b"), ("é É ÉÉ straße_Straße", "zz", "a"), ("é É straße", "zz", "b"), ("é É straße", "zz", "b"), ("long " * 50_000, "zz", "c"), ("alone alone", "one", "s"),
    ("alone", "one", "s"), ("alone", "one", "s"),
]
SCHEMA = "text string, lang string, source string"


def plain(rows, least=3, top=200):
    counts, documents, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
        groups[lang].add(source)
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        shares = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        for s in sources:
            p = shares[s]
            pairs = [(-sum((p[t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                for rank, (value, item) in enumerate(found, 1):
                    yield lang, s, part, item.decode(), -value, rank


def got(df):
    return sorted(map(tuple, df.collect()))


def test_given_documents_and_odd_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source")
    rows = [*map(tuple, docs.collect()), *ODD]
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert got(divergence.audit(docs.union(odd).selectExpr("*", "1 AS n", "'x' AS term", "2 AS shard"))) == sorted(plain(rows))


def test_many_shards_and_seats_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source")
    assert got(divergence.audit(docs, least=2, top=7, seats=6, cells=2_000)) == sorted(plain(map(tuple, docs.collect()), 2, 7))


def test_empty_table_and_bad_seats(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert got(divergence.audit(docs)) == []
    with pytest.raises(ValueError):
        divergence.audit(docs, seats=3)


@pytest.mark.parametrize("seats", [2, 4, 6, 10])
def test_tournament_meets_each_pair_once(spark, seats):
    from pyspark.sql import functions as F

    rounds = [divergence.partner(F.col("id"), r, seats).alias(f"r{r}") for r in range(seats - 1)]
    rows = spark.range(seats).select("id", *rounds).collect()
    assert all(sorted(v for k, v in r.asDict().items() if k != "id") == sorted(set(range(seats)) - {r.id}) for r in rows)
    assert all(rows[r[f"r{k}"]][f"r{k}"] == r.id for r in rows for k in range(seats - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 10**9), max_size=12), min_size=2, max_size=5))
def test_meetings_against_dense_sums(counts):
    import numpy as np

    size, v = 31, 31
    groups = []
    for i, c in enumerate(counts):
        at = np.array(sorted(c), np.int64)
        groups.append(divergence.Vector(str(i), divergence.packed(at, np.array([c[k] for k in sorted(c)], np.int64)), sum(c.values()), v))
    dense = [[1 + 10**9 * (c.get(t, 0) + 1) // (sum(c.values()) + v) for t in range(size)] for c in counts]
    for a, b, value in divergence.meeting(groups[:1], groups[1:], size):
        assert value == sum((p - q) ** 2 // q for p, q in zip(dense[int(a)], dense[int(b)]))


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    counts = [10**10, 7, 3 * 10**12, 0]
    assert divergence.share(np.array(counts), sum(counts), 4).tolist() == [1 + 10**9 * (c + 1) // (sum(counts) + 4) for c in counts]
