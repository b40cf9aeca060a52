"""Stupid-backoff scores of documents, computed relationally on the corpus itself.

Every word of a document is an n-gram with the `order` - 1 words before it (start marks before the first). Documents'
n-grams go by hash to the bucket of their history, where the table of counts of that hash is made, joined to them and
summed per document: the relative frequency of the word after its history if the n-gram occurs at least `min_count` times
in the corpus, else `alpha` times the score with a history that is one word shorter, for which the n-gram goes on to that
table's bucket, down to the word's own relative frequency. Plain stupid backoff has a min_count of 1; the default of 2
departs from it, as the query's SQL does, so that what only the scored document holds doesn't count as seen.

N-grams travel as blocks: the words of a block as a sorted list, and per n-gram places in it, the document's number and
how often it has the n-gram, as byte planes, compressed. That is 5 to 6 bytes for each, and each is sent once per table it
is looked up in; only sums per document and bucket come back.

Hot keys: counts that would unbalance buckets are found first (there are at most 1 / share of a kind) and sent to all tasks.
N-grams that are hot themselves are scored where they are read; those of a hot history are dealt by the whole n-gram.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import slices, table, workers_find_us, written
from rillspark.llm.decontaminate import BASE, Words, mixed, words_of

START = np.uint64(0x2545F4914F6CDD1D)
#: Bytes of text whose n-grams are sent together.
CHUNK = 4 << 20
#: Words a bucket has on average, which a task holds at once (about 60 bytes each). At 100 TB 16 times as many, with
#: executors to match, keep blocks large.
BUCKET = 4 << 20
#: Slots of the table of words for each shuffle partition: buckets of words are unions of slots.
SLOTS = 64
#: A count is hot above a quarter of a bucket, or above FEW of all words where that is less; never below SHARE of all words,
#: so that there are at most 1 / SHARE hot ones of a kind, nor below LEAST_HOT.
SHARE, FEW, LEAST_HOT = 2.0**-16, 2.0**-10, 1 << 12
DOCS, SUMS, COUNT, ASK = range(4)
ROWS = "kind int, bucket int, chunk bigint, data binary"
ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])
CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers or doubles as byte planes, as many as the largest number needs, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        real = a.dtype.kind == "f"
        width = 8 if real else max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = np.ascontiguousarray(a if real else a.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width].T
        out += [struct.pack("<BBq", real, width, len(a)), planes.tobytes()]
    raw = b"".join(out)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec=CODEC, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<q", data)[0], codec=CODEC, asbytes=True)
    out, at = [], 1
    for _ in range(raw[0]):
        real, width, n = struct.unpack_from("<BBq", raw, at)
        at += 10
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(wide.reshape(-1).view(np.float64 if real else np.uint64))
        at += n * width
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, of which np.cumsum makes them again."""
    return np.diff(values, prepend=values.dtype.type(0))


def joint(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One number for each row of several columns of numbers below sizes, in the order of the rows."""
    code, size = columns[0].astype(np.uint64), max(1, sizes[0])
    for c, s in zip(columns[1:], sizes[1:]):
        if size * max(1, s) >= 1 << 63:
            known, code = np.unique(code, return_inverse=True)
            code, size = code.astype(np.uint64), len(known)
        code, size = code * np.uint64(max(1, s)) + c.astype(np.uint64), size * max(1, s)
    return code


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of words."""
    h = columns[0]
    for c in columns[1:]:
        h = mixed(h * BASE + c)
    return h


class Counts:
    """Sorted hashes and how often each occurs."""

    def __init__(self, keys: Iterable[int] = (), n: Iterable[int] = ()):
        keys, n = np.array(list(keys), np.int64).view(np.uint64), np.array(list(n), np.int64)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The count of each, 0 for those that aren't here."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.n[at], 0)


class Plan:
    """What all tasks know: buckets of a table, and what is hot: words, and histories and n-grams of each order."""

    def __init__(self, order: int, alpha: float, min_count: int, total: int, slots: int, buckets: int, words: Counts):
        self.order, self.alpha, self.min_count, self.total = order, alpha, min_count, max(1, total)
        self.slots, self.buckets, self.words = slots, {j: buckets for j in range(2, order + 1)} | {1: min(buckets, slots)}, words
        self.histories, self.grams = {j: Counts() for j in range(2, order + 1)}, {j: Counts() for j in range(2, order + 1)}

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        """The bucket of n-grams, given as columns of words."""
        j = len(columns)
        if j == 1:
            return slot(columns[0], self.slots) % np.uint64(self.buckets[1])
        history = folded(columns[:-1])
        hot = self.histories[j].find(history) > 0
        return (np.where(hot, mixed(history * BASE + columns[-1]), history) >> np.uint64(24)) % np.uint64(self.buckets[j])

    def known(self, columns: list[np.ndarray]) -> np.ndarray:
        """The logarithm of the score of hot n-grams; NaN for the others, which a bucket scores."""
        j = len(columns)
        if j == 1:
            n, of = self.words.find(columns[0]), np.int64(self.total)
        else:
            n, of = self.grams[j].find(folded(columns)), self.histories[j].find(folded(columns[:-1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, np.log(n / of) + (self.order - j) * np.log(self.alpha), np.nan)


def slot(words: np.ndarray, slots: int) -> np.ndarray:
    return (words >> np.uint64(24)) % np.uint64(slots)


def home(chunk: int, buckets: int) -> int:
    """The bucket that adds up what comes back for a chunk."""
    return (chunk * int(BASE) >> 24 & 0xFFFFFFFF) % buckets


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Words]]:
    """A number, the same in every attempt of a task, rows and words of each chunk."""
    n = TaskContext.get().partitionId() << 24
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            yield n, part, words_of(part["text"])
            n += 1


def columns_of(w: Words, order: int) -> list[np.ndarray]:
    """The words of each place's n-gram, the place's own last."""
    place = np.arange(len(w.hash)) - np.asarray(w.first)[w.text_of]
    return [*(np.where(place < k, START, np.roll(w.hash, k)).astype(np.uint64) for k in range(order - 1, 0, -1)), w.hash]


def distinct(columns: list[np.ndarray], of: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray | None]:
    """Distinct rows of words (and `of`): the sorted words of each column, codes of them, n, and `of`."""
    known, codes = zip(*(np.unique(c, return_inverse=True) for c in columns))
    parts, sizes = list(codes), [len(k) for k in known]
    if of is not None:
        parts, sizes = [*parts, of], [*sizes, int(of.max()) + 1 if len(of) else 1]
    _, first, n = np.unique(joint(parts, sizes), return_index=True, return_counts=True)
    return list(known), [c[first] for c in codes], n, None if of is None else of[first]


def cut(numbers: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by number that keeps the order of equal ones, and (number, start, end) of each run in it."""
    kind = np.uint16 if len(numbers) and int(numbers.max()) < 1 << 16 else np.uint64
    order = np.argsort(numbers.astype(kind), kind="stable")
    found = numbers[order]
    heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return order, list(zip(found[heads].astype(np.int64).tolist(), heads.tolist(), [*heads[1:].tolist(), len(found)]))


def sent(kind: int, chunk: int, bucket: np.ndarray, known: list[np.ndarray], codes: list[np.ndarray], *more: np.ndarray) -> Iterator[tuple]:
    """A row for each bucket: for each column the words that occur there and codes of them, then the other columns."""
    order, runs = cut(bucket)
    for b, i, j in runs:
        at, out = order[i:j], []
        for k, c in zip(known, codes):
            some, code = np.unique(c[at], return_inverse=True)
            out += [steps(k[some]), code]
        yield kind, b, chunk, pack(*out, *(m[at] for m in more))


def summed(chunk: int, idx: np.ndarray, n: np.ndarray, unseen: np.ndarray, s: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A row of sums per document of one chunk: document, words, words scored by less than the whole history, score."""
    if len(idx):
        docs = np.flatnonzero(np.bincount(idx))
        add = lambda x: np.bincount(idx, x)[docs]
        yield SUMS, home(chunk, buckets), chunk, pack(steps(docs), add(n).astype(np.int64), add(unseen).astype(np.int64), add(s))


def batches_of(rows: Iterable[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ROW.types)], schema=ROW)
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > most:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def word_table(docs: DataFrame, least_hot: int = LEAST_HOT) -> tuple[DataFrame, int]:
    """slot, tokens (words), data (sorted words and their counts), hot (those that might be) of all documents, written; and
    the number of slots. A start mark counts for each document with words."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = parts * SLOTS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, w in chunks(batches):
            begins = np.full(int((np.diff(w.first) > 0).sum()), START)
            known, n = np.unique(np.concatenate([w.hash, begins]), return_counts=True)
            order, runs = cut(slot(known, slots) % np.uint64(parts))
            yield from batches_of((COUNT, p, 0, pack(steps(known[order[i:j]]), n[order[i:j]])) for p, i, j in runs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            known, code = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return known, np.bincount(code, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for data in batch["data"]:
                delta, n = unpack(data.as_py())
                held.append((np.cumsum(delta), n))
                if sum(len(k) for k, _ in held[1:]) > 2 * len(held[0][0]) + (1 << 18):
                    held = [merged()]
        if not held:
            return
        known, n = merged()
        order, runs = cut(slot(known, slots))
        out = []
        for s, i, j in runs:
            k, c = known[order[i:j]], n[order[i:j]]
            hot = np.flatnonzero(c >= least_hot)
            out.append((s, int(c[k != START].sum()), pack(steps(k), c), [{"w": int(a), "n": int(b)} for a, b in zip(k[hot].view(np.int64), c[hot])]))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["slot", "tokens", "data", "hot"])

    rows = docs.mapInArrow(scan, ROWS).repartitionById(parts, F.col("bucket"))
    return written(rows.mapInArrow(add, "slot int, tokens bigint, data binary, hot array<struct<w:bigint,n:bigint>>"), "words"), slots


def hot_grams(docs: DataFrame, words: Counts, order: int, above: float) -> list:
    """level, whole (a history if false), key and n of the n-grams and histories of hot words that occur more often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, w in chunks(batches):
            columns = columns_of(w, order)
            hot = [(words.find(c) > 0) | (c == START) for c in columns]
            for j in range(2, order + 1):
                for whole in (False, True):
                    last = order if whole else order - 1
                    yes = np.logical_and.reduce(hot[order - j : last])
                    keys, n = np.unique(folded([c[yes] for c in columns[order - j : last]]), return_counts=True)
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, j, np.int32)), pa.array(np.full(m, whole, bool)), pa.array(keys.view(np.int64)), pa.array(n)], names=["level", "whole", "key", "n"])

    found = docs.mapInArrow(scan, "level int, whole boolean, key bigint, n bigint").groupBy("level", "whole", "key").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") > above).collect()  # at most 1 / SHARE of each level, as each has that share of all words


def first_rows(docs: DataFrame, plan) -> DataFrame:
    """Documents' numbers and ids, the sums of what is hot, and the other n-grams by bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        buckets = p.buckets[p.order]

        def rows(chunk: int, part: pa.RecordBatch, w: Words) -> Iterator[tuple]:
            ids = part["doc_id"]
            yield DOCS, home(chunk, buckets), chunk, pack(ids.fill_null(0).to_numpy().view(np.uint64), ids.is_valid().to_numpy(zero_copy_only=False), np.diff(w.first))
            if not len(w.hash):
                return
            known, codes, n, of = distinct(columns_of(w, p.order), w.text_of)
            yield from sent_or_summed(p, chunk, known, codes, n, of)

        for chunk, part, w in chunks(batches):
            yield from batches_of(rows(chunk, part, w))

    return docs.mapInArrow(scan, ROWS)


def sent_or_summed(p: Plan, chunk: int, known: list[np.ndarray], codes: list[np.ndarray], n: np.ndarray, idx: np.ndarray) -> Iterator[tuple]:
    columns = [k[c] for k, c in zip(known, codes)]
    s = p.known(columns)
    hot = np.flatnonzero(~np.isnan(s))
    yield from summed(chunk, idx[hot], n[hot], np.zeros(len(hot), np.int64), n[hot] * s[hot], p.buckets[p.order])
    rest = np.flatnonzero(np.isnan(s))
    bucket = p.bucket([c[rest] for c in columns])
    yield from sent(ASK, chunk, bucket, known, [c[rest] for c in codes], idx[rest], n[rest])


def count_rows(docs: DataFrame, plan, j: int) -> DataFrame:
    """Counts of the n-grams of a lower order, those that aren't hot, by bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for chunk, _, w in chunks(batches):
            if len(w.hash):
                known, codes, n, _ = distinct(columns_of(w, j))
                columns = [k[c] for k, c in zip(known, codes)]
                rest = np.flatnonzero(np.isnan(p.known(columns)))
                yield from batches_of(sent(COUNT, chunk, p.bucket([c[rest] for c in columns]), known, [c[rest] for c in codes], n[rest]))

    return docs.mapInArrow(scan, ROWS)


class Bucket:
    """The n-grams of one order in a bucket: counted, joined to documents' and scored, or sent to a shorter history's."""

    def __init__(self, plan: Plan, level: int):
        self.plan, self.level = plan, level
        self.words: list[list[np.ndarray]] = [[] for _ in range(level)]
        self.codes: list[list[np.ndarray]] = [[] for _ in range(level)]
        self.n, self.idx, self.chunk = [], [], []  # chunk: numbers, and places in them (none: the first of them for all)

    def add(self, kind: int, chunk: int, data: bytes) -> None:
        arrays, k = unpack(data), 2 * self.level
        for c in range(self.level):
            self.words[c].append(np.cumsum(arrays[2 * c]))
            self.codes[c].append(arrays[2 * c + 1].astype(np.uint32))
        if kind == COUNT:
            self.n.append(arrays[k].astype(np.int64))
            return
        self.idx.append(arrays[k].astype(np.uint32))
        self.n.append(arrays[k + 1].astype(np.uint32))
        self.chunk.append((np.cumsum(arrays[k + 2]), arrays[k + 3].astype(np.uint32)) if len(arrays) > k + 2 else (np.array([chunk], np.uint64), np.zeros(len(arrays[k]), np.uint32)))

    def taken(self) -> tuple:
        """Sorted words and codes of each column, sorted numbers of chunks and codes; what was added is let go."""
        known, codes = [], []
        for c in range(self.level):
            words, self.words[c] = self.words[c], None
            known.append(np.unique(np.concatenate(words)))
            parts, self.codes[c] = self.codes[c], None
            codes.append(np.concatenate([np.searchsorted(known[-1], w).astype(np.uint32)[x] for w, x in zip(words, parts)]))
        numbers = np.unique(np.concatenate([x for x, _ in self.chunk]))
        chunk = np.concatenate([np.searchsorted(numbers, x).astype(np.uint32)[c] for x, c in self.chunk])
        n, idx = np.concatenate(self.n), np.concatenate(self.idx)
        self.n = self.idx = self.chunk = None
        return known, codes, numbers, chunk, n, idx

    def scored(self) -> Iterator[tuple]:
        """COUNT rows come before ASK rows, whose n-grams are those they count; without any the ASK rows count. Rows are
        ordered by n-gram, so that those of a history are neighbours."""
        p, j = self.plan, self.level
        if not self.idx:
            return
        known, codes, numbers, chunk, n, idx = self.taken()
        asked = len(n) - len(idx)
        key = joint(codes, list(map(len, known)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        del key
        counts = n[order].astype(np.int64)
        if j < p.order:
            counts[order >= asked] = 0
        c = np.add.reduceat(counts, heads)
        del counts
        first = order[heads]
        if j == 1:
            of = np.full(len(c), p.total)
        else:
            own = [x[first] for x in codes[:-1]]
            new = np.logical_or.reduce([np.diff(x.astype(np.int64), prepend=-1) != 0 for x in own])
            at = np.flatnonzero(new)
            hot = p.histories[j].find(folded([k[x[at]] for k, x in zip(known, own)]))
            of = np.where(hot > 0, hot, np.add.reduceat(c, at))[np.cumsum(new) - 1]
        seen = (c >= p.min_count) if j > 1 else np.ones(len(c), bool)
        with np.errstate(divide="ignore"):
            s = np.log(c / of) + (p.order - j) * np.log(p.alpha)
        gram = np.repeat(np.arange(len(heads), dtype=np.uint32), np.diff(heads, append=len(order)))
        ask = order >= asked
        mine = np.flatnonzero(ask & seen[gram])
        at = order[mine] - asked
        yield from self.sums(numbers, chunk[at], idx[at], n[asked + at], s[gram[mine]])
        rest = order[ask & ~seen[gram]] - asked
        del order, gram, ask, mine, at
        if not len(rest):
            return
        codes, n, idx, chunk = [x[asked + rest] for x in codes[1:]], n[asked + rest], idx[rest], chunk[rest]
        columns = [k[x] for k, x in zip(known[1:], codes)]
        s = p.known(columns)
        hot = ~np.isnan(s)
        yield from self.sums(numbers, chunk[hot], idx[hot], n[hot], s[hot], True)
        cold = np.flatnonzero(~hot)
        bucket = p.bucket([x[cold] for x in columns])
        del columns
        order = np.lexsort((chunk[cold], codes[-1][cold], bucket))
        for b, start, end in cut(bucket[order])[1]:
            at, out = cold[order[start:end]], []
            for k, x in zip(known[1:], codes):
                some, code = np.unique(x[at], return_inverse=True)
                out += [steps(k[some]), code]
            some, code = np.unique(chunk[at], return_inverse=True)
            yield ASK, b, 0, pack(*out, idx[at], n[at], steps(numbers[some]), code)

    def sums(self, numbers: np.ndarray, chunk: np.ndarray, idx: np.ndarray, n: np.ndarray, s: np.ndarray, unseen: bool | None = None) -> Iterator[tuple]:
        unseen = self.level < self.plan.order if unseen is None else unseen
        buckets = self.plan.buckets[max(1, self.level - 1)]
        order, runs = cut(chunk)
        for k, start, end in runs:
            at = order[start:end]
            yield from summed(int(numbers[k]), idx[at], n[at], n[at] * np.uint32(unseen), n[at] * s[at], buckets)


def added(data: Iterable[bytes]) -> tuple[np.ndarray, ...]:
    """Sums of rows of one chunk: documents, words, unseen, score."""
    idx, n, unseen, s = (np.concatenate(c) for c in zip(*((np.cumsum(a[0]).astype(np.int64), *a[1:]) for a in map(unpack, data))))
    return idx, n, unseen, s


def judged(rows: DataFrame, plan, level: int, buckets: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        last = p.buckets[max(1, level - 1)]

        def out() -> Iterator[tuple]:
            bucket = Bucket(p, level)
            each = ((k.as_py(), c.as_py(), d) for b in batches for k, c, d in zip(b["kind"], b["chunk"], b["data"]))
            for (kind, chunk), group in groupby(each, lambda r: r[:2]):
                if kind == DOCS:
                    yield from ((DOCS, home(chunk, last), chunk, d.as_py()) for _, _, d in group)
                elif kind == SUMS:
                    yield from summed(chunk, *added(d.as_py() for _, _, d in group), last)
                else:
                    for _, _, d in group:
                        bucket.add(kind, chunk, d.as_py())
            yield from bucket.scored()

        yield from batches_of(out())

    placed = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind", "chunk")
    return placed.mapInArrow(scan, ROWS)


def answered(rows: DataFrame) -> DataFrame:
    """A row for each document of each chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((c.as_py(), k.as_py(), d) for b in batches for k, c, d in zip(b["kind"], b["chunk"], b["data"]))
        for chunk, group in groupby(each, lambda r: r[0]):
            (_, _, docs), *sums = list(group)
            ids, there, n_words = unpack(docs.as_py())
            n, unseen, s = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
            if sums:
                idx, *found = added(d.as_py() for _, _, d in sums)
                n, unseen, s = (np.bincount(idx, x, len(ids)) for x in found)
            if not np.array_equal(n.astype(np.int64), n_words.astype(np.int64)):
                raise RuntimeError(f"chunk {chunk}: words without a score; docs must give the same rows in the same order whenever it is read")
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64), mask=there == 0), pa.array(n_words.view(np.int64)), pa.array(unseen.astype(np.int64)), pa.array(s)], names=["doc_id", "n_words", "n_backoff", "score"])

    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(scan, "doc_id bigint, n_words bigint, n_backoff bigint, score double")


def with_scores(docs: DataFrame, alpha: float = 0.4, min_count: int = 2, order: int = 2, share: float = SHARE, least_hot: int = LEAST_HOT, words_of_bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_backoff (words scored by less than the whole history), score (sum of natural logs; 0 without
    words), mean_score (null without words), a row for each row of docs (doc_id, text).

    Null and empty texts have no words. Repeated rows count in the corpus once each and are answered each. A null doc_id
    stays null; other columns are not read. Words are told apart by 64-bit hashes; no n-gram is left out of the tables.
    docs is read two or three times and must give the same rows in the same order, as files do; if a lost task finds
    others, the job fails rather than answer wrongly."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    workers_find_us(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    words, slots = word_table(docs, least_hot)
    total = words.agg(F.sum("tokens")).first()[0] or 0
    above = max(total * share, min(total * FEW, words_of_bucket / 4), least_hot)
    hot = words.select(F.explode("hot").alias("x")).select("x.*").where(F.col("n") > above).collect()  # at most 2 / share
    cores = spark.sparkContext.defaultParallelism
    buckets = max(1, -(-total // words_of_bucket), min(cores, total >> 18))
    plan = Plan(order, alpha, min_count, total, slots, buckets, Counts([r.w for r in hot], [r.n for r in hot]))
    found = hot_grams(docs, plan.words, order, above) if hot else []
    for j in range(2, order + 1):
        for whole, into in ((False, plan.histories), (True, plan.grams)):
            own = [r for r in found if r.level == j and r.whole == whole]
            into[j] = Counts([r.key for r in own], [r.n for r in own])
    shared = spark.sparkContext.broadcast(plan)
    flow = judged(first_rows(docs, shared), shared, order, buckets)
    for j in range(order - 1, 1, -1):
        flow = judged(flow.unionByName(count_rows(docs, shared, j)), shared, j, buckets)
    lists = words.select(F.lit(COUNT).alias("kind"), (F.col("slot") % plan.buckets[1]).alias("bucket"), F.lit(0).cast("long").alias("chunk"), "data")
    found = answered(judged(flow.unionByName(lists_as_rows(lists)), shared, 1, plan.buckets[1]))
    return found.select("doc_id", "n_words", "n_backoff", F.round("score", 6).alias("score"), F.round(F.col("score") / F.nullif("n_words", F.lit(0)), 6).alias("mean_score"))


def lists_as_rows(lists: DataFrame) -> DataFrame:
    """Rows of the table of words in the form of rows of counts: words, codes of them, counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["bucket"].to_pylist(), batch["data"].to_pylist())
            arrays = ((b, unpack(d)) for b, d in rows)
            yield from batches_of((COUNT, b, 0, pack(k, np.arange(len(k)), n)) for b, (k, n) in arrays)

    return lists.mapInArrow(scan, ROWS)


def op6(spark, sf_dir: str) -> DataFrame:
    return with_scores(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, ws FROM d WHERE len(ws) > 0),
g AS (SELECT doc_id, w, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS h FROM p),
c AS (SELECT h, w, count(*) AS c FROM g GROUP BY h, w),
ch AS (SELECT h, sum(c) AS ch FROM c GROUP BY h), cw AS (SELECT w, sum(c) AS cw FROM c GROUP BY w), t AS (SELECT sum(c) AS t FROM c),
s AS (SELECT h, w, c < 2 AS b, CASE WHEN c >= 2 THEN ln(c / ch) ELSE ln(0.4::DOUBLE * cw / t) END AS s FROM c JOIN ch USING (h) JOIN cw USING (w), t),
r AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN b THEN 1 ELSE 0 END) AS n_backoff, sum(s) AS score FROM g JOIN s USING (h, w) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(score, 0), 6) AS score, round(score / n_words, 6) AS mean_score
FROM d LEFT JOIN r USING (doc_id)
"""
