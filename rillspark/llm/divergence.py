"""Source divergence audit: how the words of each source of a language differ from its other sources and from the whole.

Counts of terms are cut into shards by the term's hash, so that a shard of a language holds all of its sources' counts of
some terms, as one compressed vector each. A language's sources are dealt to seats. A seat's vectors stay in the partition
of (language, shard, seat), which is shuffled once and read in every round; the vectors of the other seats circulate in a
round-robin tournament in which each two seats meet once, and a meeting evaluates both directions of all its pairs. What a
pair has in a shard is a sum over terms, so that shards add up. Terms are ranked by heaps in each shard and then over all.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import slices, table, workers_find_us, written

SCALE = 1_000_000_000
#: Letters of terms in lower case (A-Z only), all else as a space: terms are what stands between spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: (term, count) entries that a counting task holds before it sends them on.
HELD = 300_000
COUNTS = "lang string, source string, term string, n bigint, df bigint"
VECTORS = "lang string, shard int, source string, terms bigint, total bigint, payload binary"
SUMS = "lang string, source string, item string, value bigint"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, added up in the task; an empty term marks a group that occurs."""
    n: dict[tuple[str, str], Counter] = {}
    df: dict[tuple[str, str], Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for key in n:
            terms = [b"", *n[key]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(terms)), pa.array([key[1]] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n[key].values()], pa.int64()),
                 pa.array([0, *map(df[key].__getitem__, n[key])], pa.int64())], names=["lang", "source", "term", "n", "df"])
        n.clear()
        df.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), part["text"].cast(pa.binary()).to_pylist()):
                terms, key = text.translate(LETTERS).split(), (lang, source)
                if key not in n:
                    n[key], df[key] = Counter(), Counter()
                n[key].update(terms)
                df[key].update(set(terms))
            if sum(map(len, n.values())) > HELD:
                yield from sent()
    yield from sent()


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: places as differences, and counts, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(payload)
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64)), np.frombuffer(raw, "<i8", k, 4 * k)


def share(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (n + v)), exact beyond 64 bits as well."""
    x, d = np.asarray(count, np.int64) + 1, max(1, n + v)
    if x.size and int(x.max()) > (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * k // d for k in x.tolist()], np.int64)
    return 1 + x * SCALE // d


def vectors(least: int):
    def make(key: tuple, t: pa.Table) -> pa.Table:
        """The vectors of one shard, of every source of the language, and a row without source with the terms kept."""
        lang, shard = (k.as_py() for k in key)
        sources = t["source"].combine_chunks().dictionary_encode()
        who, names = sources.indices.to_numpy(), sources.dictionary.to_pylist()
        real = pc.is_valid(t["term"]).to_numpy(zero_copy_only=False)
        terms = t["term"].combine_chunks().dictionary_encode()
        of, words = terms.indices.drop_null().to_numpy(), terms.dictionary
        n, df, who_real = t["n"].to_numpy()[real], t["df"].to_numpy()[real], who[real]
        documents = np.zeros(len(words), np.int64)
        np.add.at(documents, of, df)
        order = pc.sort_indices(words.cast(pa.binary())).to_numpy()
        order = order[documents[order] >= least]
        place = np.full(len(words), -1, np.int64)
        place[order] = np.arange(len(order))
        at = place[of]
        stays = at >= 0
        at, n, by = at[stays], n[stays], who_real[stays]
        sort = np.lexsort((at, by))
        at, n, by = at[sort], n[sort], by[sort]
        cuts = np.searchsorted(by, np.arange(len(names) + 1))
        rows = [(lang, shard, s, len(order), int(n[a:b].sum()), packed(at[a:b], n[a:b])) for s, a, b in zip(names, cuts, cuts[1:])]
        rows.append((lang, shard, None, len(order), 0, zlib.compress(b" ".join(words.take(pa.array(order)).cast(pa.binary()).to_pylist()), 1)))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "shard", "source", "terms", "total", "payload"])

    return make


class Vector:
    """A group's shares in a shard: p at the places where it has counts, p0 elsewhere."""

    def __init__(self, source: str, payload: bytes, n: int, v: int):
        self.source = source
        self.at, count = unpacked(payload)
        self.p, self.p0 = share(count, n, v), int(share(np.zeros(1), n, v)[0])

    def spread(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """p at all places, and which of them have counts."""
        p, has = np.full(size, self.p0, np.int64), np.zeros(size, bool)
        p[self.at], has[self.at] = self.p, True
        return p, has


def both(p: np.ndarray, q: np.ndarray | int) -> tuple[int, int]:
    """The sums of floor((p - q)^2 / q) and of floor((p - q)^2 / p)."""
    square = (p - q) ** 2
    return int((square // q).sum()), int((square // p).sum())


def meeting(hosts: list[Vector], guests: list[Vector], size: int) -> Iterator[tuple[str, str, int]]:
    """(source, item, value) of each host with each guest and back. Work follows the places with counts: where neither
    has any, all terms give the same."""
    for g in hosts:
        p, has = g.spread(size)
        for h in guests:
            shared = has[h.at]
            a, b = both(p[h.at], h.p)
            c, d = both(g.p, h.p0)  # of all places of g, less those counted before
            e, f = both(p[h.at[shared]], h.p0)
            x, y = both(np.array([g.p0]), h.p0)
            rest = size - len(g.at) - len(h.at) + int(shared.sum())
            yield g.source, h.source, a + c - e + rest * x
            yield h.source, g.source, b + d - f + rest * y


def opened(t: pa.Table) -> tuple[list[Vector], int]:
    rows = t.select(["source", "payload", "n", "v", "terms"]).to_pylist()
    return [Vector(r["source"], r["payload"], r["n"], r["v"]) for r in sorted(rows, key=lambda r: r["source"])], rows[0]["terms"] if rows else 0


def sums(lang: str, rows: list[tuple[str, str, int]]) -> pa.Table:
    source, item, value = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array([lang] * len(rows), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def at_home(key: tuple, t: pa.Table) -> pa.Table:
    """The pairs of one seat."""
    own, size = opened(t)
    return sums(key[0].as_py(), [row for i, g in enumerate(own) for row in meeting([g], own[i + 1 :], size)])


def visited(key: tuple, host: pa.Table, guest: pa.Table) -> pa.Table:
    """The pairs of two seats that meet."""
    if not host.num_rows or not guest.num_rows:
        return sums("", [])
    (own, size), (others, _) = opened(host), opened(guest)
    return sums(key[0].as_py(), list(meeting(own, others, size)))


def ranked(top: int):
    def rank(key: tuple, t: pa.Table) -> pa.Table:
        """The first terms of each source in one shard, by its share beyond the language's."""
        rows = t.to_pylist()
        words = zlib.decompress(next(r["payload"] for r in rows if r["source"] is None)).decode().split(" ")
        size, out = rows[0]["terms"], []
        whole = np.zeros(size, np.int64)
        own = [(r, *unpacked(r["payload"])) for r in rows if r["source"] is not None]
        for _, at, count in own:
            whole[at] += count
        for r, at, count in own:
            p, q = share(count, r["n"], r["v"]), share(whole[at], r["lang_n"], r["v"])
            value = (p - q) ** 2 // q
            good = np.flatnonzero(p > q)
            if len(good) > top:  # those below the last one's value can't come in
                good = good[value[good] >= np.partition(value[good], -top)[-top]]
            for v, i in heapq.nsmallest(top, zip((-value[good]).tolist(), at[good].tolist())):
                out.append((r["source"], words[i], -v))
        return sums(key[0].as_py(), out)

    return rank


def partner(seat: Column, round_: int, seats: int) -> Column:
    """Whom a seat meets in a round of the tournament: the last seat stays, the others turn around it."""
    return F.when(seat == seats - 1, round_).when(seat == round_, seats - 1).otherwise(F.pmod(2 * round_ - seat, F.lit(seats - 1)))


def audit(docs: DataFrame, least: int = 3, top: int = 200, seats: int = 4, cells: int = 500_000) -> DataFrame:
    """lang, source, part, item, value, rank for each (lang, source) of docs (text, lang, source).

    Part `pair` has each other source of the language, part `term` the first `top` terms that the source has more of than
    the language. Terms of at least `least` documents of a language count. Nulls are empty strings; a group without terms
    takes part with counts of zero, and a language without kept terms has pairs of value 0. Repeated rows count as often
    as they come; of equal values the smaller item in UTF-8 ranks first; other columns aren't read; an empty table gives
    an empty result. seats (even): parts that the sources of a language are dealt to; cells: counts in a shard, on the
    whole, so that memory of a task is bounded by it."""
    if seats < 2 or seats % 2:
        raise ValueError("seats must be even")
    spark = docs.sparkSession
    workers_find_us(spark)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = rows.mapInArrow(counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = written(counts, "divergence-counts")
    shards = 1 + counts.count() // cells
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    groups = counts.filter("term = ''").select("lang", "source")
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("df"))
    parts = counts.filter("term <> ''").select("lang", shard, "source", "term", "n", "df").unionByName(marks)
    stored = written(parts.groupBy("lang", "shard").applyInArrow(vectors(least), VECTORS), "divergence-vectors")

    by_lang = stored.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.sum(F.when(F.col("source").isNull(), F.col("terms"))).alias("v"))
    by_group = stored.filter("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("n"))
    seated = by_group.withColumn("seat", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) % seats).join(by_lang, "lang")
    seated = written(seated, "divergence-groups")
    resident = stored.join(seated, ["lang", "source"]).select("lang", "shard", "seat", "source", "terms", "payload", "n", "v")

    keys = ["lang", "shard", "seat"]
    found = resident.groupBy(*keys).applyInArrow(at_home, SUMS)
    for r in range(seats - 1):
        meets = partner(F.col("seat"), r, seats)
        guests = resident.filter(meets < F.col("seat")).select(*((meets.cast("int") if c == "seat" else F.col(c)).alias(c) for c in resident.columns))
        found = found.unionByName(resident.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(visited, SUMS))
    pairs = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    named = stored.join(seated.select("lang", "source", "n", "lang_n", "v"), ["lang", "source"], "left")
    terms = named.groupBy("lang", "shard").applyInArrow(ranked(top), SUMS)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return out(pairs, "pair").unionByName(out(terms, "term").filter(F.col("rank") <= top))


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
