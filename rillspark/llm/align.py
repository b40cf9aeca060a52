"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Texts are cut at single spaces between other characters, where both tokenizers end a token whatever stands around. All
segments of a slice that a worker hasn't met yet are encoded together; the ends of both tokenizers' tokens are bits of two
packed sets over their bytes. The sets' intersection holds the shared cuts; counting the bits before a cut (rank) gives the
tokens of each side up to it, and the tokens between two cuts are a group. Groups expand to links. What a document has is
the sum over its segments; how many documents hold a pair is counted over all of them first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.bpe import AGREED, ragged
from rillspark.llm.common import later, slices, table, workers_find_us, written

#: A single space between two other characters that aren't white space.
CUT = re.compile(r" (?=\S)(?<=\S )")
ODD = regex.compile(f"[^{AGREED}]")
#: Segments that a worker keeps; it forgets them all when there are more.
MEMORY = 400_000
#: Characters of segments that go to a tokenizer in one call.
CALL = 1 << 14
#: Links of a group that are listed one by one; beyond, equal ids are joined before.
PLAIN = 1 << 12
#: Counts of id pairs that are sent to all workers, at 16 bytes each; more are joined as tables.
BROADCAST = 4_000_000
COLUMNS = [("doc_id", pa.int64(), "bigint"), *((c, pa.int64(), "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string(), "string")]
#: What a document has without the others.
OWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
#: Where calls can't be told apart by the spaces between segments.
LOOSE = re.compile(r"\s\s|^\s|\s$")


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers. A is byte-level, given as a file of the tokenizers library and as the same vocabulary in ranks: the
    ranks are faster, the file decides on characters whose classes differ between libraries. B is of sentencepiece."""

    def __init__(self, json_path: str, ranks_path: str, model_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        from rillspark.llm.bpe import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = Tokenizer.from_file(json_path)
        self.file.encode_special_tokens = True
        self.file.no_truncation()
        self.file.no_padding()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for word, k in ranks.items():
            self.bytes_a[k] = word
        m = self.model
        self.bytes_b = [bytes([int(m.id_to_piece(k)[1:-1], 16)]) if m.is_byte(k) else b"" if m.is_unknown(k) or m.is_control(k) else m.id_to_piece(k).replace("▁", " ").encode() for k in range(m.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(b) for b in x]) for x in (self.bytes_a, self.bytes_b))
        digits = [b"%d," % k for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits, self.digit_sizes = np.frombuffer(b"".join(digits), np.uint8), np.array([len(d) for d in digits])
        self.digit_starts = np.cumsum(self.digit_sizes) - self.digit_sizes
        self.base = len(self.bytes_b)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of A for a space and text and of B for text; None where the bytes of either differ from a space and text."""
        spaced = " " + text
        a = self.file.encode(spaced, add_special_tokens=False).ids if ODD.search(text) else self.ranks.encode_ordinary(spaced)
        b = self.model.encode(text)
        raw = spaced.encode()
        if len(raw) != int(self.sizes_b[b].sum()) or b"".join(map(self.bytes_b.__getitem__, b)) != raw or b"".join(map(self.bytes_a.__getitem__, a)) != raw:
            return None
        return a, b


@lru_cache(maxsize=2)
def pair_of(paths: tuple[str, str, str]) -> Pair:
    return Pair(*paths)


def bits(ends: np.ndarray, n: int) -> np.ndarray:
    """A packed set of n places that holds the last byte of each token."""
    flags = np.zeros(-(-n // 64) * 64, bool)
    flags[ends - 1] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many members a packed set has up to each place, that one included."""
    before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
    up_to = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (at & 63).astype(np.uint64))
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & up_to)


def members(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


class Units:
    """Groups and links of units of text that are encoded one after the other: a unit is a segment, or a whole text.

    n_a, n_b, n_groups, n_links: of each unit; keys, times: its distinct links as A id x base + B id and how often it has
    each, from starts[unit] to starts[unit + 1]; shown: its groups as text, a semicolon at the end of each."""

    def __init__(self, p: Pair, a: np.ndarray, b: np.ndarray, sizes: np.ndarray):
        ends_a, ends_b, lasts = np.cumsum(p.sizes_a[a]), np.cumsum(p.sizes_b[b]), np.cumsum(sizes) - 1
        n = int(sizes.sum())
        set_a, set_b = bits(ends_a, n), bits(ends_b, n)
        cuts = members(set_a & set_b)
        self.of_cut = np.searchsorted(cuts, lasts)
        if (cuts[np.minimum(self.of_cut, len(cuts) - 1)] != lasts).any():
            raise ValueError("a unit's end is no end of a token")
        hi_a, hi_b = rank(set_a, cuts), rank(set_b, cuts)
        na, nb = np.diff(hi_a, prepend=0), np.diff(hi_b, prepend=0)
        self.n_groups = np.diff(self.of_cut, prepend=-1)
        self.n_a, self.n_b = np.diff(hi_a[self.of_cut], prepend=0), np.diff(hi_b[self.of_cut], prepend=0)
        self.n_links = np.diff(np.cumsum(na * nb)[self.of_cut], prepend=0)
        self.link(p, a, b, hi_a - na, hi_b - nb, na, nb)
        self.show(p, a, b, na, nb, hi_a, hi_b)

    def link(self, p: Pair, a: np.ndarray, b: np.ndarray, lo_a: np.ndarray, lo_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        unit = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        small = np.flatnonzero(na * nb <= PLAIN)
        sizes = na[small] * nb[small]
        within = ragged(np.zeros(len(small), np.int64), sizes)
        nb_of = np.repeat(nb[small], sizes)
        left, right = np.repeat(lo_a[small], sizes) + within // nb_of, np.repeat(lo_b[small], sizes) + within % nb_of
        found, times = [np.repeat(unit[small], sizes) << 40 | a[left].astype(np.int64) * p.base + b[right]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(na * nb > PLAIN):
            (ids_a, many_a), (ids_b, many_b) = (np.unique(x[lo[g] : lo[g] + k[g]], return_counts=True) for x, lo, k in ((a, lo_a, na), (b, lo_b, nb)))
            found.append((int(unit[g]) << 40) | (ids_a.astype(np.int64)[:, None] * p.base + ids_b).ravel())
            times.append((many_a[:, None] * many_b).ravel())
        codes, at = np.unique(np.concatenate(found), return_inverse=True)
        self.times = np.zeros(len(codes), np.int64)
        np.add.at(self.times, at, np.concatenate(times))
        self.keys = codes & ((1 << 40) - 1)
        self.starts = np.searchsorted(codes >> 40, np.arange(len(self.n_groups) + 1))

    def show(self, p: Pair, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, hi_a: np.ndarray, hi_b: np.ndarray) -> None:
        ids, total = np.empty(len(a) + len(b), np.int64), hi_a + hi_b  # of a group: A's tokens, then B's
        ids[np.arange(len(a)) + np.repeat(hi_b - nb, na)] = a
        ids[np.arange(len(b)) + np.repeat(hi_a, nb)] = b
        sizes = p.digit_sizes[ids]
        text, ends = p.digits[ragged(p.digit_starts[ids], sizes)], np.cumsum(sizes)
        text[ends[total - 1] - 1] = ord(";")
        text[ends[total - nb - 1] - 1] = ord("|")
        cuts = [0, *ends[total[self.of_cut] - 1].tolist()]
        raw = text.tobytes()
        self.shown = [raw[x:y] for x, y in zip(cuts, cuts[1:])]


def units(p: Pair, encoded: list[tuple[list[int], list[int], int]]) -> Units:
    """Units of ids of A, ids of B and a number of bytes each, in the order of their calls."""
    a, b = (np.fromiter(chain.from_iterable(x[i] for x in encoded), np.int64, sum(len(x[i]) for x in encoded)) for i in (0, 1))
    return Units(p, a, b, np.array([x[2] for x in encoded]))


class Aligner:
    """Segments that this worker knows, by slot."""

    def __init__(self, p: Pair):
        self.p = p
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.stats = np.zeros((4, 0), np.int64)
        self.keys, self.times, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.bad: set[int] = set()

    def add(self, names: list[str], u: Units) -> None:
        self.slots.update(zip(names, range(len(self.shown), len(self.shown) + len(names))))
        self.shown += u.shown
        self.stats = np.concatenate([self.stats, [u.n_a, u.n_b, u.n_groups, u.n_links]], axis=1)
        self.starts = np.concatenate([self.starts, self.starts[-1] + u.starts[1:]])
        self.keys, self.times = np.concatenate([self.keys, u.keys]), np.concatenate([self.times, u.times])

    def learn(self, new: list[str]) -> None:
        """Segments without white space at their ends and without odd characters are encoded many in one call, as the
        spaces between them are cuts; the others, and those of a call whose bytes differ, one by one."""
        alone, bad, names, encoded, sizes = [], [], [], [], []
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        cuts = [0, *(np.flatnonzero(np.diff(ends // CALL)) + 1).tolist(), len(new)]
        calls = [new[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
        for call in calls:
            joined = " ".join(call)
            if ODD.search(joined) or LOOSE.search(joined):
                odd = [bool(ODD.search(s) or s[0].isspace() or s[-1].isspace()) for s in call]
                alone += [s for s, o in zip(call, odd) if o]
                call = [s for s, o in zip(call, odd) if not o]
                if not call:
                    continue
                joined = " ".join(call)
            if (x := self.p.encode(joined)) is None:
                alone += call
                continue
            names += call
            encoded.append(x)
            sizes += [len(s.encode()) + 1 for s in call]
        for s in alone:
            if (x := self.p.encode(s)) is None:
                bad.append(s)
                continue
            names.append(s)
            encoded.append(x)
            sizes.append(len(s.encode()) + 1)
        if names:
            a, b = (np.fromiter(chain.from_iterable(x[i] for x in encoded), np.int64) for i in (0, 1))
            self.add(names, Units(self.p, a, b, np.array(sizes)))
        first = len(self.shown)
        self.bad.update(range(first, first + len(bad)))
        self.slots.update(zip(bad, range(first, first + len(bad))))
        self.shown += [b""] * len(bad)
        self.stats = np.concatenate([self.stats, np.zeros((4, len(bad)), np.int64)], axis=1)
        self.starts = np.concatenate([self.starts, np.full(len(bad), self.starts[-1])])

    def slots_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all texts in a row and the number of each text's. A text with a segment that doesn't come back as
        it was is encoded as a whole, to be one slot, or none if it doesn't come back either."""
        if len(self.shown) > MEMORY:
            self.forget()
        segments = [CUT.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(segments)).difference(self.slots)
        if new:
            self.learn(sorted(new))
        get = self.slots.__getitem__
        rows = [list(map(get, s)) for s in segments]
        if self.bad:
            for i, row in enumerate(rows):
                if not self.bad.isdisjoint(row):
                    whole = self.p.encode(texts[i])
                    rows[i] = [] if whole is None else [len(self.shown)]
                    if whole is not None:  # under no name, to be met by this row alone
                        self.add([], units(self.p, [(*whole, len(texts[i].encode()) + 1)]))
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts

    def links(self, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, key and times of the distinct links of texts, in order."""
        row = np.repeat(np.arange(len(counts)), counts)
        codes, many = np.unique(row << 32 | slots, return_counts=True)
        row, slots = codes >> 32, codes & 0xFFFFFFFF
        sizes = self.starts[slots + 1] - self.starts[slots]
        at = ragged(self.starts[slots], sizes)
        codes = np.repeat(row, sizes) << 40 | self.keys[at]
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], (np.repeat(many, sizes) * self.times[at])[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first] >> 40, codes[first] & ((1 << 40) - 1), np.add.reduceat(times, first) if len(first) else times

    def digests(self, slots: np.ndarray, counts: np.ndarray) -> list[str]:
        out, at, flat, get = [], 0, slots.tolist(), self.shown.__getitem__
        for n in counts.tolist():
            out.append(hashlib.sha256(b"".join(map(get, flat[at : at + n]))[:-1]).hexdigest() if n else "")
            at += n
        return out

    def sums(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        totals = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(self.stats[:, slots], axis=1)], axis=1)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return totals[:, ends[1:]] - totals[:, ends[:-1]]


@lru_cache(maxsize=1)
def aligner(paths: tuple[str, str, str]) -> Aligner:
    return Aligner(pair_of(paths))


def linked(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """Each row of docs aligned, with its distinct links (keys) and how often it has each (times)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = aligner(paths)
        for batch in batches:
            for part in slices(batch, "text"):
                slots, counts = e.slots_of(part["text"].to_pylist())
                row, keys, times = e.links(slots, counts)
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (keys, times)]
                sums = [pa.array(x, pa.int64()) for x in e.sums(slots, counts)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *sums, pa.array(e.digests(slots, counts), pa.string()), *lists], names=[*OWN, "keys", "times"])

    kinds = {n: s for n, _, s in COLUMNS}
    schema = ", ".join(f"{n} {kinds[n]}" for n in OWN)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"{schema}, keys array<bigint>, times array<bigint>")


def parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about `most` links, a longer row alone."""
    ends = np.cumsum(pa.compute.list_value_length(batch["keys"]).to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([p[i] for p in found]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(own: DataFrame) -> DataFrame:
    """key, n: how many rows hold each linked pair of ids, added up in tasks and then over them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in parts(batch):
                held.append(np.unique(part["keys"].flatten().to_numpy(), return_counts=True))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    held = [merged(held)]
                    if len(held[0][0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["key", "n"])

    return own.select("keys").mapInArrow(scan, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def rating_arrays(counts: DataFrame, p: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their counts, and the highest count of each A id."""
    found = counts.toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    keys, n, best = keys[order], n[order], np.zeros(len(p.bytes_a), np.int64)
    np.maximum.at(best, keys // p.base, n)
    return keys, n, best


def aligned(docs: DataFrame, paths: tuple[str, str, str] | None = None, most: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text).

    A null or empty text, and one whose tokens don't give its bytes back, has no tokens: zeros and an empty digest. Repeated
    rows are each answered and each count as a document that holds its pairs; a text is aligned whole, however long; other
    columns aren't read; an empty table gives an empty table. Documents are encoded once, and their links written. `most`
    pair counts go to all workers to be looked up; more are joined with the links as tables."""
    spark = docs.sparkSession
    workers_find_us(spark)
    paths = paths or default_paths()
    own = written(linked(docs, paths).withColumn("row", F.monotonically_increasing_id()), "align-links")
    kept: list[str] = []
    counts = written(pair_counts(own), "align-counts", kept)
    later(kept)
    base, names = pair_of(paths).base, [n for n, _, _ in COLUMNS]
    if counts.count() > most:
        return joined(own, counts, base)
    rated = spark.sparkContext.broadcast(rating_arrays(counts, pair_of(paths)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = rated.value
        for batch in batches:
            for part in parts(batch):
                lists = part["keys"]
                found, times = lists.flatten().to_numpy(), part["times"].flatten().to_numpy()
                count = n[np.searchsorted(keys, found)]
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * (count == best[found // base]), times * count)]
                made = dict(zip(("n_best", "count_sum"), (pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)))
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part[c] for c in names], names=names)

    return own.drop("row").mapInArrow(scan, ", ".join(f"{n} {s}" for n, _, s in COLUMNS))


def joined(own: DataFrame, counts: DataFrame, base: int) -> DataFrame:
    """The ratings by tables: each document's distinct links, exploded and joined with their counts."""
    of_a = F.expr(f"key div {base}").alias("a")
    rated = counts.withColumn("a", of_a).join(counts.groupBy(of_a).agg(F.max("n").alias("best")), "a").select("key", "n", (F.col("n") == F.col("best")).alias("is_best"))
    flat = own.select("row", F.inline(F.arrays_zip("keys", "times"))).toDF("row", "key", "times")
    sums = flat.join(rated, "key").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = own.drop("keys", "times").join(sums, "row", "left")
    return out.select(*(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) if n in ("n_best", "count_sum") else F.col(n) for n, _, _ in COLUMNS))


def op12(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
