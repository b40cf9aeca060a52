"""Benchmark decontamination by winnowing.

Of every 13 consecutive words, whose 5-word grams make one window of 9, the gram with the smallest hash (the rightmost
of equal ones) is kept as a fingerprint. Equal passages of 13 words keep the same gram, so that every shared passage
of that length is found by joining the fingerprints of documents and items. A hit is then extended word by word to both
sides; if 13 words agree, they are hit. Fingerprints carry the 8 words to each side, all that a window around them can
hold, so that neither side is read again. An item of fewer words is one gram of its own, looked up at every word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import fresh, raw_bytes, slices, table, workers_find_us, written

SPAN = 13  # words of a window
GRAM = 5  # words of a gram; a window holds SPAN - GRAM + 1 of them
#: Slots of 64 bits in the filter that documents are probed with before the join: 2 MB, however large the benchmark.
SLOTS = 1 << 18

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xFF51AFD7ED558CCD)

FOUND = "array<struct<h:bigint,k:int,at:int,before:int,context:string>>"
FOUND_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.string())]))


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for b in (BASE, INVERSE):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


#: Powers of a place are products of one for its row of 2^ROW places and one for its place in the row.
ROW = 12


def steps_of(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base for the first places of rows up to place n, and for the places of a row."""
    last = np.full(1 << ROW, base, np.uint64)
    last[0] = 1
    last = np.multiply.accumulate(last)
    high = np.full((n >> ROW) + 1, (last[-1:] * base)[0], np.uint64)
    high[0] = 1
    return np.multiply.accumulate(high), last


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of several texts: their bytes in lower case, places, hashes; text i has words first[i] .. first[i + 1]."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.bytes = low = LOWER[flat]
        n = len(low)
        inside = np.zeros(n + 1, bool)
        inside[:n] = WORD[low]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        self.start = np.flatnonzero(inside & (~before | begins))
        self.end = np.flatnonzero(before & (~inside | begins))
        self.first = np.searchsorted(self.start, offsets)
        total = np.zeros((n >> ROW) + 1 << ROW, np.uint64)
        total[1 : n + 1] = low[: len(total) - 1]
        total[1 : n + 1] += np.uint64(1)
        high, last = steps_of(BASE, n)
        rows = total.reshape(-1, 1 << ROW)
        rows *= high[:, None]
        rows *= last
        np.cumsum(total, out=total)
        high, last = steps_of(INVERSE, n)
        inverse = high[self.start >> ROW] * last[self.start & ((1 << ROW) - 1)]
        self.hash = mixed((total[self.end] - total[self.start]) * inverse + (self.end - self.start).astype(np.uint64))
        self.text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each place; what crosses the end of a text is meaningless."""
        n = max(0, len(self.hash) - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * BASE + self.hash[j : j + n]
        return mixed(h)

    def fits(self, n: int, k: int) -> np.ndarray:
        """Whether k words from each of the first n places lie in one text."""
        return self.text_of[:n] == self.text_of[k - 1 : k - 1 + n]

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the grams that winnowing keeps."""
        g = self.grams(GRAM)
        width = SPAN - GRAM + 1
        n = len(g) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = g[:n].copy()
        for j in range(1, width):
            np.minimum(least, g[j : j + n], out=least)
        open_, keep = self.fits(n, SPAN), np.zeros(len(g), bool)
        for j in range(width - 1, -1, -1):
            here = open_ & (g[j : j + n] == least)
            keep[j : j + n] |= here
            open_ &= ~here
        at = np.flatnonzero(keep)
        return at, g[at]

    def context(self, at: int, k: int, reach: int) -> tuple[int, str]:
        """How many words stand before the gram in its context, and the context's words joined by spaces."""
        t = self.text_of[at]
        a, b = max(at - reach, int(self.first[t])), min(at + k + reach, int(self.first[t + 1]))
        return at - a, b" ".join(self.bytes[self.start[i] : self.end[i]].tobytes() for i in range(a, b)).decode("utf-8", "replace")

    def found(self, at: np.ndarray, h: np.ndarray, k: int, reach: int) -> Iterator[tuple[int, tuple]]:
        for i, x in zip(at.tolist(), h.view(np.int64).tolist()):
            t = int(self.text_of[i])
            yield t, (x, k, i - int(self.first[t]), *self.context(i, k, reach))


def words_of(column: pa.Array) -> Words:
    return Words(*raw_bytes(column))


def item_prints(items: DataFrame) -> DataFrame:
    """item_id, h, k, before, context, need of each fingerprint; need: how many words must agree."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w, ids = words_of(part["text"]), part["item_id"].to_pylist()
                rows = [(ids[t], f, SPAN) for t, f in w.found(*w.kept(), GRAM, SPAN - GRAM)]
                sizes = np.diff(w.first)
                for k in np.unique(sizes[(sizes > 0) & (sizes < SPAN)]).tolist():
                    at = w.first[:-1][sizes == k]
                    rows += [(ids[t], f, k) for t, f in w.found(at, w.grams(k)[at], k, 0)]
                columns = zip(*((i, f[0], f[1], f[3], f[4], need) for i, f, need in rows)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item_id", "h", "k", "before", "context", "need"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(scan, "item_id bigint, h bigint, k int, before int, context string, need int")


def bit_filter(prints: DataFrame) -> np.ndarray:
    """SLOTS longs with a bit for each fingerprint; documents' fingerprints without one can't join. A full filter lets
    all pass, and the join still decides."""
    slot = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    bits = np.zeros(SLOTS, np.uint64)
    for r in prints.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        bits[r.slot] = np.int64(r.bits).view(np.uint64)
    return bits


def doc_prints(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """doc_id, text_key, n_words and the fingerprints that pass the filter, of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # SLOTS longs

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = shared.value
            yes = (own[((h >> np.uint64(6)) & np.uint64(SLOTS - 1)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
            return at[yes], h[yes]

        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part["text"])
                found: list[list] = [[] for _ in range(part.num_rows)]
                for t, f in w.found(*passing(*w.kept()), GRAM, SPAN - GRAM):
                    found[t].append(f)
                for k in short:
                    g = w.grams(k)
                    at = np.flatnonzero(w.fits(len(g), k))
                    for t, f in w.found(*passing(at, g[at]), k, 0):
                        found[t].append(f)
                rows = [[dict(zip(("h", "k", "at", "before", "context"), f)) for f in x] for x in found]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(np.diff(w.first), pa.int64()), pa.array(rows, FOUND_TYPE)], names=["doc_id", "text_key", "n_words", "found"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(scan, f"doc_id bigint, text_key bigint, n_words bigint, found {FOUND}")


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined fingerprints whose words agree far enough: the words hit, from start to end."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            d, i, a, b, k = r["context"].split(" "), r["item_context"].split(" "), r["before"], r["item_before"], r["k"]
            if d[a : a + k] != i[b : b + k]:
                continue
            left = right = 0
            while left < min(a, b) and d[a - left - 1] == i[b - left - 1]:
                left += 1
            while right < min(len(d) - a, len(i) - b) - k and d[a + k + right] == i[b + k + right]:
                right += 1
            if left + k + right >= r["need"]:
                rows.append((r["doc_id"], r["text_key"], r["at"] - left, r["at"] + k + right, r["context_id"]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "text_key", "start", "end", "context_id"])


def with_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), held against items (item_id, text): doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, and text_key, the text's hash.

    Null and empty texts have no words and no hits; an item without words is no window; items without an id hit words
    but aren't listed. Rows with the same doc_id and text are answered alike, each by a row; other columns are ignored.
    The documents' fingerprints go through a filter of fixed size and one join, which Spark splits where a key is hot;
    contexts that items share are compared once."""
    workers_find_us(docs.sparkSession)
    prints = written(item_prints(items), "item-prints").withColumn("context_id", F.md5(F.concat_ws("|", "h", "k", "need", "before", "context")))
    contexts = prints.groupBy("context_id").agg(*[F.first(c).alias(n) for c, n in (("h", "h"), ("k", "k"), ("need", "need"), ("before", "item_before"), ("context", "item_context"))])
    short = sorted(r.k for r in prints.where(F.col("need") < SPAN).select("k").distinct().collect())  # at most SPAN - 1
    base = written(doc_prints(docs, bit_filter(prints), short), "doc-prints")
    hits = base.select("doc_id", "text_key", F.inline("found")).join(contexts, ["h", "k"]).mapInArrow(extend, "doc_id bigint, text_key bigint, start int, end int, context_id string")
    hits = written(hits, "hits")
    keys = ["doc_id", "text_key"]
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    reach = F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n")))["n"]
    by_words = hits.groupBy(keys).agg(reach.alias("n_hit"))
    listed = hits.select(*keys, "context_id").distinct().join(prints.select("context_id", "item_id").distinct(), "context_id").where("item_id IS NOT NULL")
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    by_items = listed.groupBy(keys).agg(F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    found = by_words.join(by_items, keys_equal(by_words, by_items), "left").select(*[by_words[c] for c in keys], "n_hit", "n_items", "items_sha256")
    base = base.select(*keys, "n_words")
    out = base.join(found, keys_equal(base, found), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        base["doc_id"], base["n_words"], n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= base["n_words"])).alias("contaminated"), base["text_key"],
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated by items, with all their columns."""
    hit = with_contamination(docs, items).where("contaminated").select("doc_id", "text_key").distinct()
    (key,) = fresh([*docs.columns, "text_key"], "key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(hit, keyed["doc_id"].eqNullSafe(hit["doc_id"]) & (keyed[key] == hit["text_key"]), "left_anti").drop(key)


def keys_equal(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def op1(spark, sf_dir: str) -> DataFrame:
    return with_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
