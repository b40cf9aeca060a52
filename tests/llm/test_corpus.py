"""Operators that compare documents, held against brute force on small and on given tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from rillspark.llm import decontaminate, quality, secrets, simhash, suffixes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(90001, "ab" * 300), (90002, None), (90003, ""), (90004, "q" * 450), (90005, "xyz " * 200), (None, "m" * 100), (None, None), (90001, "ab" * 300), (90006, "éè " * 150), (90007, "The the"), (90008, "x the THE y")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    given_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return given_.union(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "'x' AS n_words", "1 AS fp", "2 AS h", "3 AS spans")


def by_repr(rows):
    return sorted(rows, key=repr)


# decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_contamination(docs, items):
    windows, sizes = collections.defaultdict(set), set()
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        sizes |= {n} - {0}
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(i)
    for doc_id, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    found |= windows[tuple(w[a : a + n])]
                    hit |= set(range(a, a + n))
        names = sorted(str(i) for i in found if i is not None)
        yield doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    items = items.union(spark.createDataFrame([(901, "The the"), (902, None), (903, " -- "), (904, "and of in"), (None, "y z"), (905, "The the"), (906, "w " * 40)], "item_id long, text string"))
    docs = docs.union(spark.createDataFrame([(90010, "w " * 13 + "y z"), (90011, "w " * 12)], "doc_id long, text string").selectExpr("*", "'x'", "1", "2", "3"))
    got = decontaminate.with_contamination(docs, items).collect()
    expected = plain_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert by_repr(tuple(r[c] for c in CONTAMINATION) for r in got) == by_repr(expected)


def test_contamination_of_empty_tables(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.with_contamination(docs.where("false"), items).count() == 0
    assert decontaminate.with_contamination(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    rng = random.Random(1)
    text = " ".join(rng.choices("abc", k=400))
    import pyarrow as pa

    kept = set(decontaminate.words_of(pa.array([text])).kept()[0].tolist())
    assert all(any(a <= k <= a + 8 for k in kept) for a in range(400 - 12))


# suffix sorting


def plain_removed(rows, length=200):
    seen = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    for doc_id, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield doc_id, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_removed_bytes(docs):
    got = suffixes.with_removed(docs, text=True).collect()
    expected = plain_removed([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    assert by_repr(tuple(r)[:5] for r in got) == by_repr(expected)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffixes.with_removed(docs.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40) | st.text("ab", max_size=60).map(str.encode) | st.text("a", max_size=30).map(str.encode), max_size=8), st.integers(1, 9), st.sampled_from([4, 50, 1 << 20]), st.sampled_from([2, 1 << 10]))
def test_induced_sorting(texts, length, held, symbols):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    before, suffixes.SYMBOLS = suffixes.SYMBOLS, symbols
    try:
        got = [x.tolist() for x in suffixes.repeated(texts, length, held)]
    finally:
        suffixes.SYMBOLS = before
    assert got == [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]


def hot_batches(contexts):
    import pyarrow as pa

    rows = sorted((7, hashlib.md5(c).digest(), c) for c in contexts)
    for i in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_pylist([dict(zip(("h", "key", "context"), r)) for r in rows[i : i + 1000]])


@pytest.mark.parametrize("same_hash", [False, True])
def test_hot_anchor_is_dealt_on_disk(monkeypatch, same_hash):
    """More contexts of one anchor than are sorted together: none is held, and what is found equals brute force."""
    monkeypatch.setattr(suffixes, "HOT", 1000)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    monkeypatch.setattr(suffixes, "DEALT", 100)
    if same_hash:
        monkeypatch.setattr(suffixes, "mixed", lambda h: h & np.uint64(3))
    rng, length = random.Random(3), 40
    word = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    passage, near = word(38), [word(20) for _ in range(3)]
    contexts = [rng.choice([word(20), *near]) + passage + rng.choice([word(20), *near]) for _ in range(150)]
    contexts += contexts[:5]
    got, held = {}, 0
    for sort, alone, hot in suffixes.blocks(hot_batches(contexts)):
        held = max(held, len(sort[0]) + len(alone[0]))
        for keys, runs in hot.found(length) if hot else ():
            got |= {k: [i for a, b in r for i in range(a, b + 1)] for k, r in zip(keys, runs)}
    seen = collections.Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
    assert held == 0 and got == {hashlib.md5(c).digest(): [i for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1] for c in contexts}


def test_removed_bytes_of_a_hot_anchor(spark):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefghijklmnop ", k=150))
    word = lambda: "".join(rng.choices("abcdefghijklmnop ", k=180))
    rows = [(i, word() + passage + word()) for i in range(7000)]
    rows += [(7000 + i, rows[i][1][30:470]) for i in range(20)]
    got = suffixes.with_removed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()
    assert by_repr(tuple(r)[:5] for r in got) == by_repr(plain_removed([(i, t.encode()) for i, t in rows]))


# simhash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points):
    """Smallest id reachable over links of at most 2 bits; ids may repeat and be null."""
    group = list(range(len(points)))
    for i, (_, a) in enumerate(points):
        for j, (_, b) in enumerate(points[:i]):
            if (a ^ b).bit_count() <= 2:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    ids = collections.defaultdict(list)
    for g, (i, _) in zip(group, points):
        ids[g] += [i] if i is not None else []
    return [min(ids[g], default=None) for g in group]


def test_components(docs):
    points = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    expected = [(i, f"{f:016x}", c) for (i, f), c in zip(points, plain_components(points))]
    got = simhash.with_components(docs).select("doc_id", simhash.hexadecimal(simhash.F.col("fp")).alias("f"), "component_id").collect()
    assert by_repr(map(tuple, got)) == by_repr(expected)
    assert simhash.with_components(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_trie_join(seed, monkeypatch):
    monkeypatch.setattr(simhash, "FRONT", 64 if seed % 2 else 1 << 19)
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64) << np.uint64(rng.integers(0, 40)) | np.uint64(1 << 62))
    root = simhash.linked(x, 2).root
    points = [(i, int(v)) for i, v in enumerate(x)]
    assert root.tolist() == plain_components(points)


def test_links_across_blocks_and_chains(spark):
    a = 0x0123456789ABCDEF
    chain = [a]
    for b in (0, 63, 22, 43, 21, 42, 5, 33):
        chain.append(chain[-1] ^ (1 << b) ^ (1 << ((b + 30) % 64)))
    nodes = [v - (1 << 64) if v >> 63 else v for v in {*chain, a ^ (0xFF << 20)}]
    edges = simhash.links(spark.createDataFrame([(v,) for v in nodes], "fp long"))
    roots = simhash.components(edges).collect()
    assert len({r.root for r in roots}) == 1 and len(roots) == len(set(chain)) - 1


# pipeline


def test_pipeline_stages(spark, tmp_path, sf):
    names = corpus_pipeline.COLUMNS
    source = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (None, "few words", None, None, None)], source.schema)
    docs = source.union(extra).union(source.where("doc_id = 1"))
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "token_ids"]

    judged = {(r.doc_id, r.text): r for r in quality.with_quality(docs).collect()}
    kept = stages["quality_rules"](spark, docs, sf)
    assert kept.columns == names and by_repr((r.doc_id, r.text) for r in kept.collect()) == by_repr((r.doc_id, judged[r.doc_id, r.text].clean_text) for r in rows if judged[r.doc_id, r.text].kept)

    single = stages["near_dedup"](spark, docs, sf)
    points = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    groups = {c for c in plain_components(points)}
    assert single.columns == names and single.count() == len(groups) and {r.doc_id for r in single.collect()} == groups

    clean = stages["decontamination"](spark, docs, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    verdicts = [x[5] for x in plain_contamination([(r.doc_id, r.text) for r in rows], items)]
    assert any(verdicts) and by_repr(r.doc_id for r in clean.collect()) == by_repr(r.doc_id for r, v in zip(rows, verdicts) if not v)

    hidden = stages["secret_scans"](spark, docs, sf)
    assert hidden.columns == names and by_repr((r.doc_id, r.text) for r in hidden.collect()) == by_repr((r.doc_id, secrets.redact(r.text)) for r in rows)
    assert stages["token_ids"](spark, docs, sf).count() == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_pipeline_deletes_what_it_wrote(spark, tmp_path, sf):
    import os

    from rillspark.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "ids", "decoded", "lang").collect()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert len(got) and all(r.ids is not None and r.decoded is not None for r in got) and left == {"secret_scans"}


def test_stages_keep_columns_named_like_their_own(spark):
    docs = spark.createDataFrame([(1, "one two three four", "a", 1), (2, "one two three four", "b", 2), (1, "one two three four", "c", 3)], "doc_id long, text string, __key string, key int")
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 1
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontaminate.without_contaminated(docs, items.where("false")).columns == docs.columns
    assert decontaminate.without_contaminated(docs, items).count() == 0


def test_symbols_decide_where_hashes_agree(monkeypatch):
    """With a hash that is the same for all strings, names and prefixes come from the symbols."""
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(0, 80))) for _ in range(30)]
    right = [x.tolist() for x in suffixes.repeated(texts, 8)]
    assert any(right)
    monkeypatch.setattr(suffixes.Shard, "hashes", lambda self, at, length: np.zeros(len(at), np.uint64))
    assert [x.tolist() for x in suffixes.repeated(texts, 8)] == right
    monkeypatch.undo()
    text = np.array([1, 2, 1, 2, 1, 3], np.int16)
    assert suffixes.same_strings(text, np.array([0, 0, 1]), np.array([2, 2, 3]), np.array([3, 4, 1]), 2).tolist() == [True, False, True]
    assert suffixes.same_windows(text, np.array([0, 0, 4]), np.array([2, 2, 0]), 3).tolist() == [True, True, False]
    assert suffixes.same_windows(text, np.array([0, 1]), np.array([2, 2]), 4).tolist() == [False, False]


def test_anchors_of_long_texts_are_found_in_parts():
    rng = random.Random(9)
    texts = [bytes(rng.choices(b"abc", k=k)) for k in (900, 0, 50, 1700, 300)]
    flat, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts = lambda found: sorted((int(h), int(d), i) for h, d, a, b in zip(*found) for i in range(a, b + 1))
    whole = suffixes.anchors(flat, offsets, 60)
    assert starts(suffixes.anchors(flat, offsets, 60, 500)) == starts(whole) and len(whole[0])


@pytest.mark.parametrize("many", [0, 1 << 20])
def test_components_of_stars_and_paths(spark, many):
    rng = random.Random(6)
    edges = [(1000, i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(70)] + [(rng.randrange(4000, 4060), rng.randrange(4000, 4060)) for _ in range(40)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), many=many).collect()}
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: top(x) for e in edges for x in e if top(x) != x}
