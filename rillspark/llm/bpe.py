"""Byte-level BPE: pre-tokens, a pair occurrence index that merges many of them at once, and whole-token counts.

Encoding follows the file's own rules: special strings are cut out first, the rest is cut into pre-tokens, and in each
the pair of lowest rank merges first, leftmost first among equals. Pre-tokens are independent, so that all new ones of
a partition's slice are laid out in one array, every pair is mapped to all its places, and active ranks are applied in
ascending order to all their places, with the lists of pairs nearby updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillspark.llm.common import col, slices, workers_find_us

#: The pre-tokenizer's expression in a byte-level tokenizer file with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on whose classes the regex module and the tokenizers library agree; texts with others are cut by the library.
AGREED = r"\x00-՗Ḁ-ỿ‐-⁤₠-₿℀-⅏←-⏿─-➿　-ゖ゙-ヿ一-龥가-힣！-ﾾ\U0001f300-\U0001f64f"
#: Slots of pre-tokens that a worker keeps; it forgets them all when there are more.
MEMORY = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level file: itself if printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file: ids, merge ranks, the bytes of each id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model = path, spec["model"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.byte_ids = [ids[c] for c in letters]
        self.rank: dict[int, int] = {}  # of a pair of ids, as one number
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[a] << 20 | ids[b]] = r
            self.made.append(ids[a + b])
        self.pair_of = [(p >> 20, p & 0xFFFFF) for p in self.rank]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for word, k in ids.items():
            self.bytes[k] = bytes(of_letter[c] for c in word) if all(c in of_letter for c in word) else word.encode()
        for word, k in self.special.items():
            self.bytes[k] = word.encode()
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern, self.odd = regex.compile(PATTERN), regex.compile(f"[^{AGREED}]")
        self.letter_bytes = [len(b) for b in self.bytes]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if not self.odd.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens; a special string is one whole element, told by its being in `special`."""
        if not self.cut or not any(s in text for s in self.special):
            return self.pieces(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.pieces(text[at : m.start()]), m[0]]
            at = m.end()
        return [*out, *self.pieces(text[at:])]

    def merged(self, words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and the number of each word's, by one pair occurrence index over all of them.

        cur holds ids (-1: merged away), nxt and prv the neighbours; `gap`, no token's id, stands between words. A place may be
        listed under a pair it no longer has; it is checked when the pair's rank comes up. Ranks come from a heap, as a
        merge can only make pairs with later ranks in a trained file, and earlier ones would still be taken at once."""
        words = list(words)
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        gap, table = 0xFFFFF, self.byte_ids
        cur: list[int] = [gap]
        starts = []
        for w in words:
            starts.append(len(cur))
            cur += [table[b] for b in w]
            cur.append(gap)
        n, rank, made = len(cur), self.rank, self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        ids = np.array(cur, np.int64)
        for at, r in enumerate(map(rank.get, (ids[:-1] << 20 | ids[1:]).tolist())):
            if r is not None:
                if r in index:
                    index[r].append(at)
                else:
                    index[r] = [at]
        pair_of, heap = self.pair_of, sorted(index)
        while heap:
            r = heapq.heappop(heap)
            (a, b), c, places = pair_of[r], made[r], index.pop(r)
            places.sort()
            for i in places:
                j = nxt[i]
                if cur[i] != a or cur[j] != b:
                    continue
                k = nxt[j]
                cur[i], cur[j] = c, -1
                nxt[i] = k
                prv[k] = i
                h = prv[i]
                q = rank.get(cur[h] << 20 | c)
                if q is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heapq.heappush(heap, q)
                q = rank.get(c << 20 | cur[k])
                if q is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(heap, q)
        ids = np.array(cur, np.int32)
        stays = (ids >= 0) & (ids != gap)
        before = np.concatenate([[0], np.cumsum(stays)])
        at = np.array(starts, np.int64)
        return ids[stays], before[at + np.fromiter(map(len, words), np.int64, len(words))] - before[at]

    def whole(self) -> frozenset[str]:
        """The shortcut's table: vocabulary strings proved to be one pre-token that merges to one token.

        Each string of valid UTF-8 is cut by the file's pre-tokenizer and merged by its ranks; it counts only if both
        leave it whole. (A string may be in the vocabulary and still never come out of the merges.)"""
        words = []
        for k, b in enumerate(self.bytes):
            try:
                s = b.decode()
            except UnicodeDecodeError:
                continue
            if b and s not in self.special and self.pieces(s) == [s]:
                words.append((s, k))
        ids, counts = self.merged(s.encode() for s, _ in words)
        firsts = ids[np.cumsum(counts) - counts]
        return frozenset(s for (s, k), x, n in zip(words, firsts.tolist(), counts.tolist()) if n == 1 and x == k)


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    return vocabulary(path).whole()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] of all i in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of pre-tokens, each worked out once per worker: slot s holds ids[starts[s] : starts[s] + lengths[s]]."""

    def __init__(self, path: str, held: int = MEMORY):
        self.vocabulary, self.held = vocabulary(path), held
        self.digits = np.frombuffer("".join(f"{k}," for k in range(len(self.vocabulary.bytes))).encode(), np.uint8)
        self.digit_lengths = np.array([len(str(k)) + 1 for k in range(len(self.vocabulary.bytes))])
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths
        self.chars = np.frombuffer(b"".join(self.vocabulary.bytes), np.uint8)
        self.char_lengths = np.array(self.vocabulary.letter_bytes)
        self.char_starts = np.cumsum(self.char_lengths) - self.char_lengths
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        v = self.vocabulary
        special = [w for w in new if w in v.special]
        new = [w for w in new if w not in v.special]
        ids, lengths = v.merged(w.encode() for w in new)
        new, ids, lengths = new + special, np.concatenate([ids, [v.special[w] for w in special]]), np.concatenate([lengths, np.ones(len(special), np.int64)])
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        tokens = [self.vocabulary.pre_tokens(t) for t in texts]
        if len(self.slots) > self.held:
            self.forget()
        new = {w for x in tokens for w in x}.difference(self.slots)
        if new:
            self.learn(sorted(new))
        get = self.slots.__getitem__
        slots = np.fromiter((s for x in tokens for s in map(get, x)), np.int64, sum(map(len, tokens)))
        sizes = np.concatenate([[0], np.cumsum(self.lengths[slots])])
        counts = np.cumsum([0, *map(len, tokens)])
        return self.ids[ragged(self.starts[slots], self.lengths[slots])], sizes[counts[1:]] - sizes[counts[:-1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, special ones included; not yet read as UTF-8."""
        return self.chars[ragged(self.char_starts[ids], self.char_lengths[ids])].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        return self.digits[ragged(self.digit_starts[ids], self.digit_lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, held: int = MEMORY) -> Encoder:
    return Encoder(path, held)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_ids(docs: DataFrame, path: str | None = None, extra: bool = False, keep: tuple[str, ...] = (), held: int = MEMORY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text), with `extra` the ids and the decoded
    text, and the columns of docs named by `keep`. held: pre-tokens that a worker keeps, all for as long as it lives, or fewer
    for one task, where other stages' workers need the room. Null is encoded as an empty text, which has no ids; repeated rows are each answered; a text is
    encoded whole, however long. No row leaves its partition."""
    workers_find_us(docs.sparkSession)
    path = path or default_path()
    kinds = [("doc_id", pa.int64(), "bigint"), ("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    kinds += [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")] if extra else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, held)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20 if held >= MEMORY else 1 << 20):
                ids, counts = e.encode([t or "" for t in part["text"].to_pylist()])
                chars = np.concatenate([[0], np.cumsum(e.char_lengths[ids])])
                digits = np.concatenate([[0], np.cumsum(e.digit_lengths[ids])])
                decoded, decimals = e.decode(ids), e.decimals(ids)
                ends = np.cumsum(counts)
                cuts = [(int(b - n), int(b)) for n, b in zip(counts, ends)]
                texts = [decoded[chars[a] : chars[b]] for a, b in cuts]
                texts = [t.decode("utf-8", "replace") for t in texts]
                columns = [part["doc_id"], counts, [sha(decimals[digits[a] : max(digits[a], digits[b] - 1)]) for a, b in cuts], [sha(t.encode()) for t in texts]]
                columns += [[ids[a:b] for a, b in cuts], texts] if extra else []
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, k, _) in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, *(part[f"keep{i}"] for i in range(len(keep)))], names=[*(n for n, _, _ in kinds), *keep])
        if held < MEMORY:
            e.forget()

    rows = docs.select(F.col("doc_id").cast("long"), "text", *(col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    schema = StructType.fromDDL(", ".join(f"{n} {s}" for n, _, s in kinds))
    for i, c in enumerate(keep):
        schema.add(c, rows.schema[f"keep{i}"].dataType)
    return rows.mapInArrow(scan, schema)


def with_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text), by the whole-token shortcut: pre-tokens
    proved to be one token are counted as they are met, the others merged. Null counts as an empty text; repeated rows
    are each answered; a text is counted whole. No row leaves its partition."""
    workers_find_us(docs.sparkSession)
    path = path or default_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, whole = vocabulary(path), whole_tokens(path)
        known: dict[str, int] = dict.fromkeys(v.special, 1)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part["text"].to_pylist()]
                totals, rests = [], []
                for t in texts:
                    tokens = v.pre_tokens(t)
                    rest = [w for w in tokens if w not in whole]
                    totals.append(len(tokens) - len(rest))
                    rests.append(rest)
                new = sorted({w for r in rests for w in r}.difference(known))
                known.update(zip(new, v.merged(w.encode() for w in new)[1].tolist()))
                n = [a + sum(map(known.__getitem__, r)) for a, r in zip(totals, rests)]
                if len(known) > MEMORY:
                    known = dict.fromkeys(v.special, 1)
                size = pa.compute.fill_null(pa.compute.binary_length(part["text"]), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op9(spark, sf_dir: str) -> DataFrame:
    return with_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10(spark, sf_dir: str) -> DataFrame:
    return with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
