"""Cross-tokenizer alignment against the libraries' encodings of whole texts."""

import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillspark.llm import align

ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b \n c"), (5, "tab\tand\r\n lines\n\nend\n"), (6, "▁x y"), (7, "<|endoftext|> <s> </s>"), (8, "é é ﬁ ① 　x"), (None, "no id"), (9, "q" * 3000), (9, "q" * 3000),
    (10, "word " * 9000), (11, "a\x00b c"), (12, "​q﻿ \U0001f600\U0001f600 ok"), (13, " lead"), (14, "trail "), (15, "x   y\n   z"), (16, "ab/" * 400), (17, "न क्षे ١   x"), (18, "a\x1cb \x1c c"),
]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*align.default_paths())


def plain_groups(pair, text):
    """Groups by walking both lists of tokens, from the libraries' encodings of the whole text."""
    if not text:
        return []
    a, b = pair.file.encode(" " + text, add_special_tokens=False).ids, pair.model.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[k] for k in a) != raw or b"".join(pair.bytes_b[k] for k in b) != raw:
        return []
    groups, i, j, at_a, at_b, now = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            now[0].append(a[i])
            at_a += len(pair.bytes_a[a[i]])
            i += 1
        else:
            now[1].append(b[j])
            at_b += len(pair.bytes_b[b[j]])
            j += 1
        if at_a == at_b and now[0] and now[1]:
            groups.append(now)
            now = ([], [])
    return groups


def plain(pair, rows):
    found = [(i, plain_groups(pair, t)) for i, t in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = collections.Counter(k for c in links for k in c)
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (i, groups), c in zip(found, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), sum(n for k, n in c.items() if count[k] == best[k[0]]),
               sum(n * count[k] for k, n in c.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else "")


@pytest.fixture(scope="module")
def table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.union(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "'x' AS key", "1 AS n", "2 AS row")


@pytest.mark.parametrize("most", [align.BROADCAST, 10])
def test_given_documents_and_odd_ones(spark, table, pair, most):
    expected = sorted(plain(pair, [(r.doc_id, r.text) for r in table.collect()]), key=repr)
    df = align.aligned(table, most=most)
    assert df.columns == [n for n, _, _ in align.COLUMNS]
    assert sorted(map(tuple, df.collect()), key=repr) == expected
    assert any(r[1] for r in expected) and sum(not r[1] for r in expected) >= 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(empty).collect() == [] and align.aligned(empty, most=-1).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab the\n\t .,'12▁é한😀 ")), max_size=40), min_size=1, max_size=5))
def test_segments_give_what_whole_texts_give(texts):
    p = align.pair_of(align.default_paths())
    e = align.Aligner(p)
    slots, counts = e.slots_of(texts)
    shown = [hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else "" for g in (plain_groups(p, t) for t in texts)]
    assert e.digests(slots, counts) == shown


def test_forgotten_segments_are_learned_again(pair, monkeypatch):
    monkeypatch.setattr(align, "MEMORY", 5)
    e, r = align.Aligner(pair), random.Random(3)
    for _ in range(20):
        texts = [" ".join(r.choice(["alpha", "beta", "gam▁ma", "délta", "x" * 50]) for _ in range(r.randrange(6))) for _ in range(3)]
        slots, counts = e.slots_of(texts)
        assert e.sums(slots, counts)[2].tolist() == [len(plain_groups(pair, t)) for t in texts]


def test_large_groups_are_counted_without_listing_links(pair, monkeypatch):
    texts = ["antidisestablishmentarianism", "supercalifragilistic" * 5, "a b c"]
    one = align.Aligner(pair)
    listed = [x.tolist() for x in one.links(*one.slots_of(texts))]
    monkeypatch.setattr(align, "PLAIN", 0)
    two = align.Aligner(pair)
    assert [x.tolist() for x in two.links(*two.slots_of(texts))] == listed


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 300), min_size=1))
def test_packed_sets(ends):
    import numpy as np

    words = align.bits(np.array(sorted(ends)), 300)
    assert align.members(words).tolist() == sorted(e - 1 for e in ends)
    assert align.rank(words, np.arange(300)).tolist() == [sum(e - 1 <= k for e in ends) for k in range(300)]
