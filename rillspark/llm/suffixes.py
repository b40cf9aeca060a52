"""Suffix-array deduplication by external induced sorting.

`repeated` sorts the suffixes of a shard of texts: positions are classed as L or S, the leftmost S ones (LMS) are sorted
first, by recursion on the names of the strings between them, and all others are induced from them. Each first symbol
has a priority queue: suffixes with their common prefix lengths enter it in the order of what induced them, which is
their own order, and leave it from the front. Queues move to disk when they hold too much; the text, types, names and
LMS order of a shard stay in memory, so that shards are kept small. Common prefix lengths are carried along, so that
neighbours that share `length` bytes are known when the last queue is read. Those of LMS positions come from hashes, and
bytes are compared wherever a wrong one could make a string seem repeated.

`with_removed` finds bytes in strings of `length` that start at more than one place in all documents. Each such string
keeps an anchor, the gram with the smallest hash in it (the rightmost of equal ones); equal strings have equal anchors
at the same offset. Anchors that occur once cannot matter. The strings of every other anchor, one context of text, go to
the shard of the anchor's hash, copies reduced to two per task before they are sent. An anchor with more contexts than
are sorted together has its strings dealt further, by their own hashes, in files: `Hot`.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import raw_bytes, slices, table, workers_find_us, written
from rillspark.llm.decontaminate import keys_equal, mixed, powers

LENGTH, GRAM = 200, 24
#: Slots of 64 bits in the filter of anchors met twice: 16 MB, however many there are. When it is full, all contexts are
#: sent and sorted; the result is the same.
SLOTS = 1 << 21
PLACE = np.uint64((1 << 28) - 1)
#: Bytes of text hashed at once; the tables of powers are as long.
PIECE = 1 << 20
#: Bytes of contexts sorted together, cut where the anchor changes; one anchor may add up to HOT to them.
BLOCK = 1 << 20
#: Bytes of distinct contexts of one anchor from which on they go to files.
HOT = 1 << 21
#: Strings of a hot anchor in memory at once, files that they are dealt to, and ranges of places that results are dealt to.
DEALT, PARTS, RANGES = 1 << 17, 64, 256
#: Items that all queues of one sort hold in memory.
HELD = 1 << 23
#: Above so many symbols a reduced text is sorted by doubling instead of by a further induction.
SYMBOLS = 1 << 10


class Store:
    """A temporary file that queues of one sort spill to; its room goes back when the sort ends."""

    def __init__(self, held: int = HELD):
        self.held, self.now, self.file = held, 0, None

    def put(self, arrays: tuple[np.ndarray, ...]):
        n = len(arrays[0])
        if self.now + n <= self.held:
            self.now += n
            return arrays
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(0, 2)
        at = self.file.tell()
        for a in arrays:
            self.file.write(np.ascontiguousarray(a).data)
        return at, n, [a.dtype for a in arrays]

    def get(self, kept, take: bool):
        if isinstance(kept[0], np.ndarray):
            self.now -= len(kept[0]) if take else 0
            return kept
        at, n, kinds = kept
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)


class Queue:
    """Chunks of (position, common prefix with the one before) in order; in memory or in the store."""

    def __init__(self, store: Store):
        self.store, self.chunks = store, []

    def push(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.chunks.append(self.store.put(arrays))

    def pop(self, most: int = 1 << 20):
        """The front of the queue: chunks with about `most` items together, as many waits as one for as many small ones."""
        taken, n = [], 0
        while len(taken) < len(self.chunks) and (not taken or n < most):
            taken.append(self.store.get(self.chunks[len(taken)], True))
            n += len(taken[-1][0])
        del self.chunks[: len(taken)]
        return taken[0] if len(taken) == 1 else tuple(map(np.concatenate, zip(*taken)))

    def each(self, backwards: bool = False):
        for kept in reversed(self.chunks) if backwards else self.chunks:
            yield self.store.get(kept, False)


def range_minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min of x[a[i]] .. x[b[i]], both included, by a table of minima of powers of two."""
    out = np.zeros(len(a), x.dtype)
    level = np.frexp((b - a + 1).astype(float))[1] - 1
    t, width = x, 1
    for k in range(int(level.max()) + 1 if len(a) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(t[a[at]], t[b[at] - width + 1])
        if len(t) > width:
            t = np.minimum(t[:-width], t[width:])
        width *= 2
    return out


class Inducer:
    """One direction of induction: takes sorted chunks and pushes predecessors of the wanted type to their queues."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: list[Queue], cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.since = np.full(len(queues), -1, np.int32)  # least common prefix since the last push; -1 before the first

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        p = at - 1
        yes = np.flatnonzero((p >= 0) & self.wanted[p])
        symbol = self.text[p[yes]]
        own = symbol > 0
        yes, symbol = yes[own], symbol[own]
        order = np.argsort(symbol.astype(np.uint16) if len(self.queues) < 1 << 16 else symbol, kind="stable")
        yes, symbol = yes[order], symbol[order]
        least = int(lcp.min())
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]]) if len(yes) else np.zeros(0, bool)
        heads = np.flatnonzero(first)
        begin = np.where(first, 0, np.concatenate([[0], yes[:-1] + 1])) if len(yes) else yes
        low = range_minima(lcp, begin, yes).astype(np.int32)
        groups = symbol[heads]
        before = self.since[groups]
        low[heads] = np.where(before < 0, -1, np.minimum(before, low[heads]))
        carried = np.minimum(low + 1, self.cap).astype(np.uint16)
        tails = np.concatenate([heads[1:], [len(yes)]]) if len(heads) else heads
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, least))
        if len(heads):
            last = yes[tails - 1]
            rest = np.full(len(groups), self.cap, np.int32)
            more = last + 1 < len(lcp)
            rest[more] = range_minima(lcp, last[more] + 1, np.full(more.sum(), len(lcp) - 1))
            self.since[groups] = rest
        for g, a, b in zip(groups.tolist(), heads.tolist(), tails.tolist()):
            self.queues[g].push(p[yes[a:b]], carried[a:b])


def same_strings(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the strings of `length` at a and b are equal, symbol by symbol, about `most` symbols at a time."""
    out, ends = np.zeros(len(a), bool), np.cumsum(length)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        n = length[start:stop]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        differ = text[np.repeat(a[start:stop], n) + within] != text[np.repeat(b[start:stop], n) + within]
        out[start:stop] = ~np.logical_or.reduceat(differ, first) if len(n) else out[start:stop]
        start = stop
    return out


def same_windows(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of one length at a and b are equal; by words of 64 bits where the length allows."""
    words = length * text.itemsize // 8 if length * text.itemsize % 8 == 0 else 0
    if words:
        view = np.lib.stride_tricks.as_strided(text.view(np.uint8)[:8].view(np.uint64), (len(text) - length + 1, words), (text.itemsize, 8), writeable=False)
    else:
        view = np.lib.stride_tricks.sliding_window_view(text, length)
    inside = (a <= len(text) - length) & (b <= len(text) - length)
    out = np.zeros(len(a), bool)
    out[inside] = (view[a[inside]] == view[b[inside]]).all(axis=1)
    return out


class Shard:
    """Symbols of texts, each ended by 0. A 0 is less than all else and differs from every other 0."""

    def __init__(self, text: np.ndarray, cap: int, held: int = HELD):
        self.text, self.cap, self.held = text, cap, held
        n = self.n = len(text)
        step = np.sign(np.diff(text, append=text[:0].dtype.type(0))).astype(np.int8)
        places = np.where(step != 0, np.arange(n, dtype=np.int64), n - 1)
        self.turn = np.minimum.accumulate(places[::-1])[::-1]  # where the run of equal symbols from a place ends
        self.small = step[self.turn] > 0  # S
        self.small[text == 0] = True
        self.lms = self.small & np.concatenate([[False], ~self.small[:-1]])
        self.lms[text == 0] = True
        self.stop = np.flatnonzero(text == 0)  # place of the end of each text

    def runs(self, at: np.ndarray) -> np.ndarray:
        return np.minimum(self.turn[at] - at + 1, self.cap)

    @cached_property
    def hashes(self):
        power, inverse = powers(1 << max(21, self.n.bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * power[: self.n])])
        return lambda at, length: (total[at + length] - total[at]) * inverse[at]

    def induce(self, lms: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """All suffixes but those of ends, in descending order of first symbols: chunks in order with their common
        prefixes. lms: LMS positions, not ends, in order, with common prefixes to the one before."""
        symbols, store = int(self.text.max()) + 1, Store(self.held)
        large = [Queue(store) for _ in range(symbols)]
        passed = [Queue(store) for _ in range(symbols)]
        scan = Inducer(self.text, ~self.small, large, self.cap)
        cuts = np.searchsorted(self.text[lms], np.arange(symbols + 1))
        scan.feed(self.stop, np.zeros(len(self.stop), np.uint16))
        for c in range(1, symbols):
            last = None
            while large[c].chunks:
                at, common = large[c].pop()
                passed[c].push(at, common)
                scan.feed(at, common)
                last = at[-1:]
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                common = lcp[a:b].copy()
                common[0] = 0 if last is None else min(self.runs(last)[0], self.runs(lms[a : a + 1])[0])
                scan.feed(lms[a:b], common)
        small = [Queue(store) for _ in range(symbols)]
        scan = Inducer(self.text, self.small, small, self.cap)
        for c in range(symbols - 1, 0, -1):
            last = None
            while small[c].chunks:
                at, common = small[c].pop()
                scan.feed(at, common)
                last = at[-1:]
                yield at, common, True
            after = None
            for at, common in passed[c].each(backwards=True):
                # going down, an item's common prefix is that with the next larger one
                if after is None:
                    head = 0 if last is None else min(self.runs(last)[0], self.runs(at[-1:])[0])
                else:
                    head = after
                down = np.concatenate([[head], common[:0:-1]]).astype(np.uint16)
                scan.feed(at[::-1], down)
                after = int(common[0])
                yield at[::-1], down, False

    def sorted_lms(self) -> np.ndarray:
        """LMS positions, not ends, in the order of their suffixes."""
        all_ = np.flatnonzero(self.lms)
        some = all_[self.text[all_] > 0]
        if not len(some):
            return some
        some = some[np.argsort(self.text[some], kind="stable")]
        chunks = [at[self.lms[at]] for at, _, small in self.induce(some, np.zeros(len(some), np.uint16)) if small]
        order = np.concatenate(chunks)[::-1]
        following = np.full(self.n, 0)
        following[all_[:-1]] = all_[1:]
        length = following[order] - order + 1
        h = self.hashes(order, length)
        new = np.concatenate([[True], (length[1:] != length[:-1]) | (h[1:] != h[:-1])])
        alike = np.flatnonzero(~new)  # equal hashes: the symbols decide
        new[alike] = ~same_strings(self.text, order[alike - 1], order[alike], length[alike])
        names = np.zeros(self.n, np.int32)
        names[order] = np.cumsum(new)
        if new.all():
            return order
        reduced = names[all_]
        return all_[suffix_order(reduced, self.held)]

    def common(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each position with the one before it, up to cap, by binary search over hashes of prefixes."""
        if not len(order):
            return np.zeros(0, np.uint16)
        h, a, b = self.hashes, order[:-1], order[1:]
        end = self.stop[np.searchsorted(self.stop, order)] - order
        most = np.minimum(np.minimum(end[:-1], end[1:]), self.cap)
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = h(a, mid) == h(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        for i in np.flatnonzero(~self.confirmed(a, b, low)):  # the hashes of different prefixes are equal
            low[i] = int(np.flatnonzero(self.text[a[i] : a[i] + low[i]] != self.text[b[i] : b[i] + low[i]])[0])
        return np.concatenate([[0], low]).astype(np.uint16)

    def confirmed(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Whether prefixes are equal, looked up in the text where it can matter: a common prefix of `cap` symbols is induced
        from one that is less by the distance to an LMS position at most."""
        far = int(np.diff(np.flatnonzero(self.lms), prepend=-1).max())
        out = np.ones(len(a), bool)
        whole, part = np.flatnonzero(common == self.cap), np.flatnonzero((common >= self.cap - far) & (common < self.cap) & (common > 0))
        for i in range(0, len(whole), 1 << 14):
            at = whole[i : i + (1 << 14)]
            out[at] = same_windows(self.text, a[at], b[at], self.cap)
        out[part] = same_strings(self.text, a[part], b[part], common[part])
        return out

    def near(self, length: int) -> np.ndarray:
        """Whether each position's suffix shares `length` symbols with another suffix."""
        order = self.sorted_lms()
        found, previous = np.zeros(self.n, bool), None
        for at, common, _ in self.induce(order, self.common(order)):
            long = np.flatnonzero(common >= length)
            found[at[long]] = True
            found[at[long[long > 0] - 1]] = True
            if previous is not None and common[0] >= length:
                found[previous] = True
            previous = at[-1]
        return found


def suffix_order(text: np.ndarray, held: int = HELD) -> np.ndarray:
    """Places of a text over names, ends left out, in the order of their suffixes: by induction again while there are
    few names, else by doubling the length that ranks stand for."""
    if int(text.max()) <= SYMBOLS:
        s = Shard(text, 1, held)
        order = s.sorted_lms()
        return np.concatenate([at for at, _, _ in s.induce(order, np.zeros(len(order), np.uint16))] or [order])[::-1]
    stop = np.flatnonzero(text == 0)
    end = stop[np.searchsorted(stop, np.arange(len(text)))]
    at = np.flatnonzero(text > 0)
    rank, k = text.astype(np.int64), 1
    while True:
        second = np.where(at + k < end[at], rank[np.minimum(at + k, len(text) - 1)], 0)
        distinct, inverse = np.unique(rank[at] << 32 | second, return_inverse=True)
        rank[at] = inverse + 1
        k *= 2
        if len(distinct) == len(at) or k >= (end[at] - at).max():
            return at[np.argsort(rank[at], kind="stable")]


def repeated(texts: list[bytes], length: int = LENGTH, held: int = HELD) -> list[np.ndarray]:
    """For each text the offsets at which a string of `length` starts that starts elsewhere in these texts too."""
    if not texts:
        return []
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    text = np.insert(flat.astype(np.int16) + 1, ends, 0)
    found = Shard(text, length, held).near(length)
    starts = np.concatenate([[0], ends[:-1] + np.arange(1, len(texts))])
    return [np.flatnonzero(found[a : a + len(t)]) for a, t in zip(starts, texts)]


def runs_of(offsets: np.ndarray) -> list[tuple[int, int]]:
    """First and last of maximal runs of consecutive numbers."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return list(zip(offsets[np.concatenate([[0], cut + 1])].tolist(), offsets[np.concatenate([cut, [len(offsets) - 1]])].tolist()))


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int, most: int = 1 << 26) -> tuple[np.ndarray, ...]:
    """hash, text, and first and last start (in the text) of the strings that have it, of each anchor. Of more than `most`
    bytes so many starts are taken at a time; an anchor on both sides of a cut is returned for each."""
    if len(flat) > most + length:
        parts = []
        for a in range(0, len(flat), most):
            b = min(len(flat), a + most + length - 1)
            inner = np.unique(np.concatenate([[a], offsets[(offsets > a) & (offsets < b)], [b]])) - a
            h, d, low, high = anchors(flat[a:b], inner, length, most + length)
            begin = inner[d] + a
            text = np.searchsorted(offsets, begin, "right") - 1
            shift = begin - offsets[text]
            parts.append((h, text, low + shift, high + shift))
        return tuple(map(np.concatenate, zip(*parts)))
    n = len(flat) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    power, inverse = powers(1 << max(21, len(flat).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)])])
    g = mixed((total[GRAM:] - total[:-GRAM]) * inverse[: len(flat) - GRAM + 1])
    t = (g & ~PLACE) | (PLACE - np.arange(len(g), dtype=np.uint64))
    width, want = 1, length - GRAM + 1
    while width * 2 <= want:
        t = np.minimum(t[:-width], t[width:])
        width *= 2
    t = np.minimum(t[: n], t[want - width :][: n])
    at = (PLACE - (t & PLACE)).astype(np.int64)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
    valid = np.arange(n) + length <= offsets[1:][doc]
    i = np.flatnonzero(valid)
    if not len(i):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    at, doc = at[i], doc[i]
    heads = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    tails = np.concatenate([heads[1:], [len(i)]]) - 1
    d = doc[heads]
    return g[at[heads]], d, i[heads] - offsets[d], i[tails] - offsets[d]


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                h, n = np.unique(anchors(*raw_bytes(part["text"]), length)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], names=["h", "twice"])

    return docs.select("text").mapInArrow(scan, "h bigint, twice boolean")


def twice_filter(found: DataFrame) -> np.ndarray:
    """SLOTS longs with a bit for each anchor that occurs twice or more."""
    twice = found.groupBy("h").agg(F.max("twice").alias("twice"), F.count("*").alias("n")).where("twice OR n > 1")
    slot = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(SLOTS - 1))
    bits = np.zeros(SLOTS, np.uint64)
    rows = twice.groupBy(slot.cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    packed = rows.toArrow()  # at most SLOTS rows of 12 bytes
    bits[packed["slot"].to_numpy()] = packed["bits"].to_numpy().view(np.uint64)
    return bits


def contexts(docs: DataFrame, shared, length: int, owners: bool) -> DataFrame:
    """The contexts of anchors that pass the filter. owners: key, doc_id, text_key, low of each; else h, key, context, of
    which a task returns each at most twice, as more tell nothing more."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()] if owners else [pa.int64(), pa.binary(), pa.binary()]
    names = ["key", "doc_id", "text_key", "low"] if owners else ["h", "key", "context"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = set(), set()
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                flat, offsets = raw_bytes(part["text"])
                h, d, low, high = anchors(flat, offsets, length)
                yes = (shared.value[((h >> np.uint64(6)) & np.uint64(SLOTS - 1)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
                h, d, low, high = h[yes], d[yes], low[yes], high[yes]
                begin, data = offsets[d] + low, flat.tobytes()
                pieces = [data[a:b] for a, b in zip(begin.tolist(), (offsets[d] + high + length).tolist())]
                keys = [xxhash.xxh3_128_digest(p) for p in pieces]
                if owners:
                    rows = pa.array(d)
                    columns = [pa.array(keys, pa.binary()), part["doc_id"].take(rows), part["text_key"].take(rows), pa.array(low.astype(np.int32))]
                else:
                    picked = []
                    for i, k in enumerate(keys):
                        if k not in twice:
                            (twice if k in once else once).add(k)
                            picked.append(i)
                    columns = [pa.array(h.view(np.int64)[picked]), pa.array([keys[i] for i in picked], pa.binary()), pa.array([pieces[i] for i in picked], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names=names)

    schema = "key binary, doc_id bigint, text_key bigint, low int" if owners else "h bigint, key binary, context binary"
    return docs.mapInArrow(scan, schema)


class Parts:
    """Records dealt to files by number."""

    def __init__(self, kind: np.dtype):
        self.kind, self.files, self.n, self.low, self.high = kind, {}, {}, {}, {}

    def put(self, part: np.ndarray, records: np.ndarray, by: np.ndarray) -> None:
        order = np.argsort(part, kind="stable")
        heads = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)]):
            p, at = int(part[order[a]]), order[a:b]
            if p not in self.files:
                self.files[p], self.n[p], self.low[p], self.high[p] = tempfile.TemporaryFile(), 0, by[at].min(), by[at].max()  # noqa: SIM115
            self.files[p].write(records[at].tobytes())
            self.n[p] += b - a
            self.low[p], self.high[p] = min(self.low[p], by[at].min()), max(self.high[p], by[at].max())

    def take(self, p: int) -> Iterator[np.ndarray]:
        """The records of a part in chunks; its room goes back at the end."""
        if p in self.files:
            with self.files.pop(p) as file:
                file.seek(0)
                while data := file.read(DEALT * self.kind.itemsize):
                    yield np.frombuffer(data, self.kind)


class Hot:
    """The distinct contexts of an anchor that has too many to be sorted in memory, in files.

    Equal strings have equal hashes, so that strings may be dealt by hash, again by further bits while a part is too
    large. Those whose hash occurs once in a part equal no other; the rest are sorted by their bytes. A part of one hash
    that is still too large is held against its first string, and what differs from that dealt with in the same way."""

    ROW = np.dtype([("key", "V16"), ("size", "<i4"), ("twice", "?")])
    STRING = np.dtype([("hash", "<u8"), ("at", "<i8")])

    def __init__(self):
        self.text, self.rows, self.total = tempfile.TemporaryFile(), tempfile.TemporaryFile(), 0  # noqa: SIM115

    def add(self, keys: list[bytes], contexts: list[bytes], twice: list[bool]) -> None:
        rows = np.zeros(len(keys), self.ROW)
        rows["key"], rows["size"], rows["twice"] = np.frombuffer(b"".join(keys), "V16"), [len(c) for c in contexts], twice
        self.rows.write(rows.tobytes())
        self.text.write(b"".join(contexts))
        self.total += int(rows["size"].sum())

    def each(self) -> Iterator[tuple[int, np.ndarray]]:
        """Rows in chunks, and where in the text each chunk starts."""
        self.rows.seek(0)
        at = 0
        while data := self.rows.read(2048 * self.ROW.itemsize):
            rows = np.frombuffer(data, self.ROW)
            yield at, rows
            at += int(rows["size"].sum())

    def strings(self, length: int) -> Iterator[np.ndarray]:
        for base, rows in self.each():
            flat, ends = self.flat[base : base + int(rows["size"].sum())], np.cumsum(rows["size"])
            power, inverse = powers(1 << max(21, len(flat).bit_length()))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)])])
            left = np.repeat(ends, rows["size"]) - np.arange(len(flat))
            at = np.flatnonzero(left >= length)
            out = np.zeros(len(at), self.STRING)
            out["hash"], out["at"] = mixed((total[at + length] - total[at]) * inverse[at]), at + base
            yield out

    def repeats(self, chunks: Iterator[np.ndarray], n: int, one: bool, shift: int, length: int) -> Iterator[np.ndarray]:
        """Places of those of n strings that equal another of them. one: their hashes are the same."""
        read = lambda at: np.lib.stride_tricks.sliding_window_view(self.flat, length)[at]
        if n <= DEALT:
            s = np.concatenate([np.zeros(0, self.STRING), *chunks])
            _, inverse, counts = np.unique(s["hash"], return_inverse=True, return_counts=True)
            at = s["at"][counts[inverse] > 1]
            if len(at):
                _, inverse, counts = np.unique(read(at).view(f"V{length}").ravel(), return_inverse=True, return_counts=True)
                yield at[counts[inverse] > 1]
        elif one:
            first, alone, others = None, True, Parts(self.STRING)
            for s in chunks:
                if first is None:
                    first, s = s["at"][:1], s[1:]
                    held = read(first)
                for i in range(0, len(s), 1 << 14):
                    part = s[i : i + (1 << 14)]
                    same = (read(part["at"]) == held).all(axis=1)
                    if same.any():
                        yield np.concatenate([first[: int(alone)], part["at"][same]])
                        alone = False
                    if not same.all():
                        others.put(np.zeros((~same).sum(), np.int64), part[~same], part["hash"][~same])
            if others.n:
                yield from self.repeats(others.take(0), others.n[0], True, shift, length)
        else:
            parts = Parts(self.STRING)
            for s in chunks:
                parts.put(((s["hash"] >> np.uint64(shift)) & np.uint64(PARTS - 1)).astype(np.int64), s, s["hash"])
            for p in list(parts.files):
                yield from self.repeats(parts.take(p), parts.n[p], parts.low[p] == parts.high[p], max(0, shift - 6), length)

    def found(self, length: int) -> Iterator[tuple[list[bytes], list[list[tuple[int, int]]]]]:
        """Keys of contexts and the runs of offsets at which repeated strings start in them."""
        self.text.flush()
        self.flat = np.memmap(self.text, np.uint8, "r")
        width = max(BLOCK, self.total // RANGES + 1)
        places, marks = Parts(np.dtype("<i8")), {}
        for at in self.repeats(self.strings(length), self.total, False, 58, length):
            places.put(at // width, at, at)
        for base, rows in self.each():
            ends = base + np.cumsum(rows["size"].astype(np.int64))
            a, b = base // width, int(ends[-1] - 1) // width
            for p in range(a, b + 1):
                if p not in marks:
                    marks[p] = np.zeros(width, bool)
                    for at in places.take(p):
                        marks[p][at - p * width] = True
            marks = {p: m for p, m in marks.items() if p >= a}
            near = np.concatenate([marks[p] for p in range(a, b + 1)])
            own = lambda e, n: np.flatnonzero(near[e - n - a * width : e - a * width])  # noqa: E731, B023
            yield [k.tobytes() for k in rows["key"]], [[(0, n - length)] if both else runs_of(own(e, n)) for e, n, both in zip(ends.tolist(), rows["size"].tolist(), rows["twice"].tolist())]
        self.text.close()
        self.rows.close()


Rows = tuple[list[bytes], list[bytes], list[bool]]


def blocks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[Rows, Rows, Hot | None]]:
    """Keys, contexts and whether they occur twice, of rows sorted by h and key: those to be sorted, cut at about `most`
    bytes where h changes, and those alone with their anchor, which have no other to be held against: strings of one
    context have different places of the anchor and so are never equal. Contexts of one anchor of more than HOT bytes
    are in files."""
    empty = lambda: ([], [], [])
    sort, alone, group, held, last, size, hot, most = empty(), empty(), empty(), 0, None, 0, None, most or BLOCK

    def close() -> int:
        if hot:
            hot.add(*group)
            return 0
        to = alone if len(group[0]) == 1 else sort
        for x, y in zip(to, group):
            x.extend(y)
        return 0 if to is alone else size

    for batch in batches:
        for h, key, context in zip(batch["h"].to_pylist(), batch["key"].to_pylist(), batch["context"].to_pylist()):
            if h != last:
                held += close()
                group, size = empty(), 0
                if hot or held > most or len(alone[0]) > 10_000:
                    yield sort, alone, hot
                    sort, alone, held, hot = empty(), empty(), 0, None
                last = h
            elif key == group[0][-1]:
                group[2][-1] = True
                continue
            elif size > HOT:
                hot = hot or Hot()
                hot.add(*group)
                group, size = empty(), 0
            for x, y in zip(group, (key, context, False)):
                x.append(y)
            size += len(context)
    close()
    yield sort, alone, hot


def found_in_shards(sent: DataFrame, length: int) -> DataFrame:
    """key, runs: the offsets in each distinct context at which repeated strings start, as first and last of runs."""

    def batch_of(keys: list[bytes], runs: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        rows = [(k, [{"first": a, "last": b} for a, b in r]) for k, r in zip(keys, runs) if r]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([r for _, r in rows], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["key", "runs"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, texts, twice), (own_keys, own_texts, own_twice), hot in blocks(batches):
            whole = lambda t: [(0, len(t) - length)]
            runs = [whole(t) if both else runs_of(x) for t, both, x in zip(texts, twice, repeated(texts, length))]
            runs += [whole(t) if both else [] for t, both in zip(own_texts, own_twice)]
            yield batch_of(keys + own_keys, runs)
            if hot:
                yield from (batch_of(*x) for x in hot.found(length))

    return sent.repartition("h").sortWithinPartitions("h", "key").mapInArrow(sort, "key binary, runs array<struct<first:int,last:int>>")


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text_key and the maximal removed runs (start, end) of each document that has any."""
    spark = docs.sparkSession
    workers_find_us(spark)
    bits = twice_filter(anchor_counts(docs, length))
    shared = spark.sparkContext.broadcast(bits)  # SLOTS longs
    found = found_in_shards(contexts(docs, shared, length, False), length)
    owners = contexts(docs, shared, length, True).join(found, "key")
    span = F.transform("runs", lambda r: F.struct((F.col("low") + r["first"]).alias("start"), (F.col("low") + r["last"] + length).alias("end")))
    by_doc = owners.select("doc_id", "text_key", F.explode(span).alias("span")).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return written(by_doc, "spans")


def with_removed(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `text` also the
    bytes that stay.

    Null counts as an empty text. Texts of fewer than `length` bytes keep all. Repeated rows are documents of their own
    and so copies of each other, from `length` bytes on. Matches don't cross documents. Grams of an anchor and copies of
    a context are told apart by hashes of 64 and 128 bits; strings that these or a hash of their symbols make neighbours are
    compared byte by byte."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    spans = removed_spans(keyed, length)
    joined = keyed.join(spans, keys_equal(keyed, spans), "left").select(keyed["doc_id"], keyed["text"], spans["spans"])
    kinds = [("doc_id", pa.int64(), "bigint"), ("n_bytes", pa.int64(), "bigint"), ("n_removed", pa.int64(), "bigint"), ("n_spans", pa.int64(), "bigint"), ("kept_sha256", pa.string(), "string")]
    kinds += [("kept", pa.binary(), "binary")] if text else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                rows = []
                for doc_id, t, found in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["spans"].to_pylist()):
                    data, kept, at, n = (t or "").encode(), [], 0, 0
                    for s in found or []:
                        n += s["start"] > at or at == 0
                        kept.append(data[at : s["start"]])
                        at = max(at, s["end"])
                    left = b"".join([*kept, data[at:]])
                    rows.append((doc_id, len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left)[: len(kinds)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k, _) in zip(zip(*rows), kinds)], names=[n for n, _, _ in kinds])

    return joined.mapInArrow(cut, ", ".join(f"{n} {s}" for n, _, s in kinds))


def op3(spark, sf_dir: str) -> DataFrame:
    return with_removed(table(spark, sf_dir, "documents"))
