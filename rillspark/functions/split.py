"""Text to chunks: by separators, and recursively by ever finer ones with the cheapest joining of small pieces."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rillspark.functions import languages

CHUNK = "array<struct<location:struct<start:bigint,end:bigint>,text:string,start:struct<offset:bigint,line:bigint,column:bigint>,end:struct<offset:bigint,line:bigint,column:bigint>>>"
#: White space by Unicode's property, which Python's own \s exceeds.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_WHITE = " \t\n\x0c\r"
# Separators of plain text, coarse to fine, and the costs of ways to join pieces.
PLAIN = (r"\n\n+", r"\n", r"[\.\?!]\s+|。|？|！", r"[;:\-—]\s+|；|：|—+", r",\s+|，", r"\s+")
LEVEL_COST = 512
OVERLAP_COST = 512
LINE_BREAK_COST = 64
SMALL_COST = 1048576
#: Above all depths, and above all costs of chunks.
NONE, NEVER = 1 << 30, 1 << 60
#: Ends whose chunks' own costs are in memory together, and characters of texts that are cut together and of those whose rows
#: are handed on together, unless one text has more.
BLOCK, TOGETHER, SLICE = 16384, 4 << 20, 1 << 19


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\s", f"[{WHITE}]"))


def rows(text: str, spans: Sequence[tuple[int, int]]) -> list[dict]:
    """Chunk rows of (start, end) spans in characters. Lines and columns count from 1; a later span of the same place
    takes the place of an earlier one, as places are keys."""
    breaks = [i for i, c in enumerate(text) if c == "\n"]

    def position(at: int) -> dict:
        line = bisect_right(breaks, at - 1)
        return {"offset": at, "line": line + 1, "column": at - (breaks[line - 1] + 1 if line else 0) + 1}

    return [{"location": {"start": a, "end": b}, "text": text[a:b], "start": position(a), "end": position(b)} for a, b in dict.fromkeys(spans)]


def in_slices(texts: Sequence[str | None], most: int) -> Iterator[slice]:
    """Slices of texts in order, none with more than `most` characters unless it has one text."""
    at = held = 0
    for i, t in enumerate(texts):
        size = 0 if t is None else len(t)
        if i > at and held + size > most:
            yield slice(at, i)
            at, held = i, 0
        held += size
    yield slice(at, len(texts))


def separator_spans(text: str, separators: Sequence[str], keep: str | None = None, include_empty: bool = False, trim: bool = True) -> list[tuple[int, int]]:
    marks = [m.span() for m in re.finditer("|".join(f"(?:{s})" for s in separators), text, re.MULTILINE)] if separators else []
    starts = [0, *(a if keep == "RIGHT" else b for a, b in marks)]
    ends = [*(b if keep == "LEFT" else a for a, b in marks), len(text)]
    out = []
    for a, b in zip(starts, ends):
        if trim:
            piece = text[a:b]
            a += len(piece) - len(piece.lstrip(ASCII_WHITE))
            b = max(a, b - (len(piece) - len(piece.rstrip(ASCII_WHITE))))
        if include_empty or b > a:
            out.append((a, b))
    return out


def separated(batches: Iterator[pd.Series], *how) -> Iterator[pd.Series]:
    """Chunk rows of all texts, those of some at a time, as they take many times what the texts do."""
    for texts in batches:
        for some in in_slices(texts, SLICE):
            yield texts[some].map(lambda t: rows(t, separator_spans(t, *how)), na_action="ignore")


def split_by_separators(text: Column, separators: Sequence[str], keep: str | None = None, include_empty: bool = False, trim: bool = True) -> Column:
    """Chunk rows; null for null. keep: None, LEFT or RIGHT of the separator."""
    separators = list(separators)

    @F.pandas_udf(CHUNK)
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return separated(batches, separators, keep, include_empty, trim)

    return split.asNondeterministic()(text)  # else a filter on the exploded array evaluates it again


def split_texts(text: Column, separators: Sequence[str], trim: bool = True) -> Column:
    """The texts alone of split_by_separators without empty ones, as an expression inside code generation."""
    parts = F.split(text, "(?m)" + "|".join(f"(?:{s})" for s in separators))
    parts = F.transform(parts, lambda x: F.trim(x, F.lit(ASCII_WHITE))) if trim else parts
    return F.filter(parts, lambda x: x != "")


@dataclass(frozen=True)
class CustomLanguage:
    language_name: str
    separators_regex: tuple[str, ...]
    aliases: tuple[str, ...] = ()


def break_level(gap: str) -> int:
    """0 without a line break, 1 with single ones, 2 with two of a kind in a row; CR LF is one."""
    if "\n" not in gap and "\r" not in gap:
        return 0
    runs = re.findall(r"[\r\n]+", gap)
    return 2 if any(r[0] in r[1:] for r in runs) else int(bool(runs))


class RecursiveSplitter:
    """Chunks of least cost.

    Text is cut into pieces by one pass for each separator, coarse to fine: a pass divides the pieces that are still larger
    than a chunk's overlap (or its least size, without one). What separates two pieces has the depth of its pass. Pieces
    without text go, the rest are known by arrays: bytes where they begin and end, the least depth before each, the line
    breaks before and within each.

    A chunk is a range of pieces. Its own cost depends on nothing else and is worked out for all ends at once, one length
    of ranges after the other: too small; ends at finer separators than one inside; ends at lesser line breaks than some
    inside. What remains, the cost of what goes before a chunk, is a relaxation over ends from left to right."""

    def __init__(self, custom: Sequence[CustomLanguage] = ()):
        self.custom: dict[str, tuple[re.Pattern, ...]] = {}
        self.plain = tuple(map(compiled, PLAIN))
        for language in custom:
            patterns = tuple(re.compile(s) for s in language.separators_regex)
            for name in (language.language_name, *language.aliases):
                if name.lower() in self.custom:
                    raise ValueError(f"language {name!r} is given twice")
                self.custom[name.lower()] = patterns

    def ladder(self, language: str | None) -> tuple[re.Pattern, ...]:
        """Separators of a custom language, or of one known by name or suffix followed by the plain ones."""
        name = (language or "").lower()
        if name in self.custom:
            return self.custom[name]
        known = languages.LADDERS.get(languages.names().get(name, ""), ())
        return (*map(re.compile, known), *self.plain)

    def spans(self, text: str, chunk_size: int, min_chunk_size: int | None = None, chunk_overlap: int | None = None, language: str | None = None) -> list[tuple[int, int]]:
        """The spans, in characters, of the cheapest chunks; sizes are in UTF-8 bytes."""
        return self.spans_of([(text, chunk_size, min_chunk_size, chunk_overlap, language)])[0]

    def spans_of(self, asked: Sequence[tuple[str, int, int | None, int | None, str | None]]) -> list[list[tuple[int, int]]]:
        """What `spans` gives for each; texts of the same sizes are worked out together."""
        alike: dict[tuple[int, int, int], list[int]] = {}
        cut: list[Pieces] = []
        for at, (text, chunk_size, min_chunk_size, chunk_overlap, language) in enumerate(asked):
            least = chunk_size // 2 if min_chunk_size is None else min_chunk_size
            overlap = min(chunk_overlap or 0, least)
            offsets = byte_offsets(text)
            cut.append(Pieces(text, cut_by_levels(text, self.ladder(language), offsets, overlap or least), offsets))
            alike.setdefault((chunk_size, least, overlap), []).append(at)
        out: list[list[tuple[int, int]]] = [[] for _ in asked]
        for sizes, those in alike.items():
            for at, chunks in zip(those, cheapest_of([cut[at] for at in those], *sizes)):
                start, end = cut[at].start, cut[at].end
                out[at] = [(int(start[a]), int(end[b])) for a, b in chunks]
        return out


def byte_offsets(text: str) -> np.ndarray:
    """The byte at which each character begins, and the number of bytes."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))])


def cut_by_levels(text: str, separators: Sequence[re.Pattern], offsets: np.ndarray, enough: int) -> list[tuple[int, int, int]]:
    """(start, end, depth of the separator before) of pieces in order; the depth of the first is 0, that of the separators
    of the first pass 2."""
    pieces = [(0, len(text), 0)]
    for depth, pattern in enumerate(separators, 2):
        finer: list[tuple[int, int, int]] = []
        for start, end, before in pieces:
            if offsets[end] - offsets[start] <= enough:
                finer.append((start, end, before))
                continue
            marks = [(start + m.start(), start + m.end()) for m in pattern.finditer(text[start:end])]
            begins, ends = [start, *(b for _, b in marks)], [*(a for a, _ in marks), end]
            finer += zip(begins, ends, [before, *[depth] * len(marks)])
        if len(finer) == len(pieces) and all(offsets[b] - offsets[a] <= enough for a, b, _ in finer):
            return finer
        pieces = finer
    return pieces


class Pieces:
    """Pieces with text, without white space around them, by arrays; a last, empty one stands for the end of the text."""

    def __init__(self, text: str, cut: list[tuple[int, int, int]], offsets: np.ndarray):
        start, end, depth, outer, inner, least, after = [], [], [], [], [], 0, 0
        for a, b, before in cut:
            if before < least:
                least = before
            held = text[a:b].lstrip(WHITE)
            a, held = b - len(held), held.rstrip(WHITE)
            if held:
                gap = text[after:a]
                outer.append(break_level(gap))
                start.append(after + len(gap.rstrip(" \t")) if outer[-1] else a)  # what indents a line belongs to it
                after = a + len(held)
                end.append(after)
                depth.append(least)
                inner.append(break_level(held))
                least = NONE
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        self.depth, self.outer, self.inner = (np.array([*x, last], np.int64) for x, last in ((depth, 0), (outer, 2), (inner, 0)))
        self.total = int(offsets[-1])
        self.begins, self.ends = np.append(offsets[self.start], self.total), np.append(offsets[self.end], self.total)


class Joined:
    """Pieces of several texts one after the other, those of most pieces first: `base` says where each begins, and `own` the
    beginning of the text that a piece is of."""

    def __init__(self, several: Sequence[Pieces]):
        self.size = np.array([len(p.start) for p in several], np.int64)
        self.base = np.cumsum(self.size + 1) - self.size - 1
        self.own = np.repeat(self.base, self.size + 1)
        for name in ("depth", "outer", "inner", "begins", "ends"):
            setattr(self, name, np.concatenate([getattr(p, name) for p in several]))
        self.steps = np.concatenate([[0], np.cumsum(LEVEL_COST // np.arange(1, 2 + max(2, int(self.depth.max()))))])


def own_costs(p: Joined, i: np.ndarray, most: int, least: int) -> np.ndarray:
    """[n - 1, j]: the cost of a chunk of n pieces that ends with piece i[j], by itself; NEVER if it is too large, unless it is
    one piece."""
    level, breaks, own, at = np.full(len(i), NONE), np.zeros(len(i), np.int64), p.own[i], np.arange(len(i))
    after, outer, ends = p.depth[i + 1], p.outer[i + 1], p.ends[i]
    out = [np.where(ends - p.begins[i] < least, SMALL_COST, 0)]  # nothing is inside
    s = i
    while True:
        s = s - 1
        can = s >= own
        can &= ends - p.begins[s] <= most
        if not can.all():  # nor can longer ones
            s, level, breaks, own, at, after, outer, ends = (x[can] for x in (s, level, breaks, own, at, after, outer, ends))
        if not len(s):
            break
        level, breaks = np.minimum(level, p.depth[s + 1]), np.maximum(breaks, p.inner[s + 1])
        cost = p.steps[np.maximum(p.depth[s] - level, 0)] + p.steps[np.maximum(after - level, 0)]
        cost += LINE_BREAK_COST * (np.maximum(breaks - p.outer[s], 0) + np.maximum(breaks - outer, 0))
        cost[ends - p.begins[s] < least] += SMALL_COST
        out.append(np.full(len(i), NEVER))
        out[-1][at] = cost
    return np.array(out)


def cheapest(p: Pieces, most: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """The first and last piece of each chunk."""
    return cheapest_of([p], most, least, overlap)[0]


def cheapest_of(several: Sequence[Pieces], most: int, least: int, overlap: int) -> list[list[tuple[int, int]]]:
    """The first and last piece of each chunk, for each text; all texts are gone through in step, piece by piece, those of
    fewer pieces until they end. best[q]: the least cost of chunks that cover the first q pieces. A chunk that begins with
    piece s follows chunks that cover s or, within the overlap, more; `before[s]` is the cost of the best of those known so
    far and `covers[s]` how much they cover, chosen by `rank[s]`, their cost and what they lack of the text."""
    if not several:
        return []
    order = sorted(range(len(several)), key=lambda x: -len(several[x].start))
    p = Joined([several[x] for x in order])
    slots = len(p.own)
    lack, left, early = (np.zeros(slots, np.int64) for _ in range(3))
    if overlap:
        for base, n, x in zip(p.base, p.size, order):
            begins, ends, total = p.begins[base : base + n + 1], p.ends[base : base + n], several[x].total
            lack[base : base + n + 1] = (total - begins) * OVERLAP_COST // overlap
            left[base : base + n + 1] = (total - np.append(0, ends)) * OVERLAP_COST // overlap
            reach = np.searchsorted(p.ends[base : base + n + 1], begins + overlap, "right") - 1
            early[base : base + n + 1] = base + np.searchsorted(reach, np.arange(n + 1))  # the first piece whose reach covers q
    alone = p.ends - p.begins > most
    best, before, rank, covers, first, came = (np.zeros(slots, np.int64) for _ in range(6))
    active = np.searchsorted(-p.size, -np.arange(int(p.size.max())), "left")  # texts with more than i pieces
    costs, at, held = np.zeros((0, 0, 0)), 0, 0
    for i in range(len(active)):
        b = p.base[: active[i]] + i
        cost = best[b]
        before[b], rank[b], covers[b] = cost + (OVERLAP_COST if overlap else OVERLAP_COST // 2), cost + left[b], i
        if overlap:
            back = b - early[b]
            far = int(back.max())
            if far > 0:
                s = np.maximum(b - np.arange(1, far + 1)[:, None], 0)
                found, which = np.nonzero((np.arange(1, far + 1)[:, None] <= back) & (rank[b] <= rank[s]))
                s, new = s[found, which], b[which]
                rank[s], covers[s], before[s] = rank[new], i, best[new] + OVERLAP_COST - np.maximum(0, lack[s] - left[new])
        if i >= at + held:
            at, held = i, min(max(1, BLOCK // len(b)), len(active) - i)
            ends = p.base[: len(b)] + np.arange(i, i + held)[:, None]
            costs = own_costs(p, np.minimum(ends, p.base[: len(b)] + p.size[: len(b)] - 1).ravel(), most, least).reshape(-1, held, len(b))
        own = costs[:, i - at, : len(b)]
        whole = own + before[np.maximum(b - np.arange(len(own))[:, None], 0)]
        k = whole.argmin(0)
        one = alone[b]
        best[b + 1] = np.where(one, own[0] + cost, whole[k, np.arange(len(b))])
        first[b], came[b] = np.where(one, i, i - k), np.where(one, i, covers[np.where(one, b, b - k)])
    out: list[list[tuple[int, int]]] = [[] for _ in several]
    for base, n, x in zip(p.base.tolist(), p.size.tolist(), order):
        begun, q = first[base : base + n].tolist(), n
        came_of = came[base : base + n].tolist()
        while q:
            out[x].append((begun[q - 1], q - 1))
            q = came_of[q - 1]
        out[x].reverse()
    return out


def split_recursively(text: Column, chunk_size: Column | int, min_chunk_size: Column | int | None = None, chunk_overlap: Column | int | None = None, language: Column | str | None = None, custom_languages: Sequence[CustomLanguage] = ()) -> Column:
    """Chunk rows; null where text or chunk_size is."""
    custom = tuple(custom_languages)
    column = lambda x, kind: x if isinstance(x, Column) else F.lit(x).cast(kind)

    @F.pandas_udf(CHUNK)
    def split(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        splitter = RecursiveSplitter(custom)
        number = lambda x: None if pd.isna(x) else int(x)
        for texts, *rest in batches:
            for some in in_slices(texts, TOGETHER):
                asked = [(t, *(number(x) for x in sizes), None if pd.isna(name) else name) for t, *sizes, name in zip(*(c[some] for c in (texts, *rest)))]
                live = [a for a in asked if a[0] is not None and a[1] is not None]
                found = iter(map(rows, [a[0] for a in live], splitter.spans_of(live)))
                yield pd.Series([None if a[0] is None or a[1] is None else next(found) for a in asked], dtype=object)

    return split.asNondeterministic()(text, column(chunk_size, "bigint"), column(min_chunk_size, "bigint"), column(chunk_overlap, "bigint"), column(language, "string"))
