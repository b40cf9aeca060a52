"""SimHash near-duplicates by a self-join of binary tries.

Texts become 64-bit fingerprints; two link if at most `BUDGET` bits differ. Of three blocks of bits at least one is then
equal, so each distinct fingerprint is sent to three places, by the value of each block, and every partition joins the
trie of its fingerprints, rotated to begin with that block, with itself: pairs of nodes go down together, add up the
bits in which they part and end when the budget is exceeded. A partition returns a spanning forest of its links; the
forests are joined into components by alternating stars on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import col, forget, fresh, later, slices, table, temporary, workers_find_us, written

BITS, BUDGET, SHINGLE, SEED = 64, 2, 3, 42
#: First bit and width of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Node pairs that are taken down together; more are put off, so that memory stays bounded.
FRONT = 1 << 19
#: Edges from which on a node may have more of them than a task should.
MANY = 1 << 20


def fingerprint(text: str | None) -> int:
    """Bits set in over half the hashes of 3-word shingles, repeats included; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    shingles = zip(words, words[1:], words[2:]) if len(words) >= SHINGLE else [words]
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64, n)
    sums = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a signed long) of each row of docs (doc_id, text)."""
    workers_find_us(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t) for t in part["text"].to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(fp)], names=["doc_id", "text_key", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(scan, "doc_id bigint, text_key bigint, fp bigint")


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    """Bits moved to the left by `by`, those that fall out returning at the right."""
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


class Forest:
    """Places joined into trees, each known by its smallest place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def linked(x: np.ndarray, fixed: int, budget: int = BUDGET) -> Forest:
    """The forest of links of x (sorted, distinct) between values with the first `fixed` bits equal and at most `budget`
    others different. A node is a range of x; at each bit a pair of nodes becomes up to four pairs of their halves."""
    n, forest = len(x), Forest(len(x))
    heads = x >> np.uint64(BITS - fixed) if fixed else np.zeros(n, np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]])) if n else np.zeros(1, np.int64)
    lo, hi = cuts[:-1], cuts[1:]
    some = hi - lo > 1
    ones = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - bit)) & np.uint64(1)).astype(np.int64)])
        return ones[bit]

    stack = [(fixed, lo[some], hi[some], lo[some], hi[some], np.zeros(some.sum(), np.int8))]
    while stack:
        bit, a, b, c, d, err = stack.pop()
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(bit, *(v[:half] for v in (a, b, c, d, err))), (bit, *(v[half:] for v in (a, b, c, d, err)))]
            continue
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():  # no more halves: what is left of the budget against what is left of the bits
            i, j = a[leaf], c[leaf]
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            forest.join(i[near], j[near])
            a, b, c, d, err = (v[~leaf] for v in (a, b, c, d, err))
        if not len(a):
            continue
        before = ones_before(bit)
        m, k = b - (before[b] - before[a]), d - (before[d] - before[c])
        own = a == c
        parts = [(a, m, c, k, err, np.ones(len(a), bool)), (m, b, k, d, err, np.ones(len(a), bool)), (a, m, k, d, err + 1, np.ones(len(a), bool)), (m, b, c, k, err + 1, ~own)]
        e, f, g, h, err, ok = (np.concatenate(v) for v in zip(*parts))
        ok &= (f > e) & (h > g) & (err <= budget) & ~((e == g) & (f - e == 1))
        if ok.any():
            stack.append((bit + 1, *(v[ok] for v in (e, f, g, h, err))))
    return forest


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that join the same ones as all links do, b the tree's root."""
    workers_find_us(nodes.sparkSession)
    value = F.col("fp")
    keys = [F.shiftrightunsigned(F.shiftleft(value, at), BITS - width) for at, width in BLOCKS]
    places = nodes.select("fp", F.posexplode(F.array(*keys)).alias("block", "value")).repartition("block", "value")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["fp"].to_numpy(), b["block"].to_numpy()) for b in batches]
        if not held:
            return
        fp, block = (np.concatenate(c) for c in zip(*held))
        for k, (at, width) in enumerate(BLOCKS):
            x = np.sort(rotated(fp[block == k].view(np.uint64), at))
            root = linked(x, width).root
            back = rotated(x, (BITS - at) % BITS).view(np.int64)
            own = np.flatnonzero(root != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(back[own]), pa.array(back[root[own]])], names=["a", "b"])

    return places.mapInArrow(join, "a bigint, b bigint")


def components(edges: DataFrame, most: int = 60, many: int = MANY) -> DataFrame:
    """node, root (the smallest node reachable) of each node with an edge (a, b), root left out.

    Alternating large and small stars, until nothing changes; every round is a written table, so that no lineage grows, and
    the one before is deleted. The smallest neighbours of more than `many` edges are written too: Spark splits a join at a
    node of very many edges only where both sides are plain shuffles. A round about halves the longest path, so that `most`
    rounds are enough for any number of nodes; if not, an error is raised."""
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool, hold) -> DataFrame:
        """Each node's neighbours (large: the larger ones; else the smaller ones and itself) joined to its smallest."""
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = hold(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last: list[str] = []
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges", last)
    before = state(now)
    for _ in range(most):
        hold = written if before[0] > many else lambda df, name: df
        kept: list[str] = []
        with temporary(spark):
            new = written(star(hold(star(now, True, hold), "large-star"), False, hold), "stars", kept)
        forget(spark, last)
        now, last, after = new, kept, state(new)
        if after == before:
            later(last)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")


def with_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_key (the text's hash), fp, root (the component's smallest
    fingerprint), component_id.

    Null and empty texts, and those of white space, have fingerprint zero and link like any other. Repeated rows have
    the same fingerprint and so one component. component_id is the smallest doc_id of the component, null only where
    all its doc_ids are. Fingerprints are reduced to distinct ones before anything is paired."""
    base = written(fingerprints(docs), "fingerprints")
    nodes = written(base.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    classes = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return base.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of those with the smallest doc_id (null if none has one) that with the
    smallest hash of its text; of those equal in both that with the smallest hash of all its columns."""
    found = written(with_components(docs), "components")
    lowest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    named = found.where(lowest)  # more than one of a component only for repeated or missing ids
    first = named.groupBy("root").agg(F.min("text_key").alias("first_key"))
    named = named.join(first, "root")
    others = named.where("text_key != first_key").select("doc_id", "text_key")
    dropped = found.where(~lowest).select("doc_id", "text_key").union(others).distinct()
    (key,) = fresh([*docs.columns, "text_key"], "key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(dropped, keyed["doc_id"].eqNullSafe(dropped["doc_id"]) & (keyed[key] == dropped["text_key"]), "left_anti").drop(key)
    equal_rows = not named.where("text_key = first_key").groupBy("root").count().where("count > 1").isEmpty()
    if not equal_rows:
        return kept
    row = F.struct(*map(col, docs.columns))
    return kept.groupBy(F.col("doc_id").alias("i"), F.col("text").alias("t")).agg(F.min_by(row, F.xxhash64(*map(col, docs.columns))).alias("row")).select("row.*")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4(spark, sf_dir: str) -> DataFrame:
    found = with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
