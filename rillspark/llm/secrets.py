"""Secret scans: known shapes by pattern, and random strings by token efficiency.

A language's own words take few tokens; random strings take many. A candidate run with a low number of characters per
token under a tiktoken vocabulary is a secret, unless its form is that of a digest or another public identifier. Words
glued to a key dilute a run's ratio, so that a run that passes is judged by its pieces and windows too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import slices, workers_find_us

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that may hold keys, and pieces of them between marks that may be keys: long enough.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PIECE = re.compile(r"[A-Za-z0-9]{16,}")
#: Digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512, in one case), UUIDs and integrity values with their prefix.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+)"
)
#: Words joined by marks, each of letters or of digits alone: names, paths and dates rather than keys.
NAMES = re.compile(r"[+/_=-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)(?:[+/_=-]++|$))++")
MAX_RATIO = 2.0
#: Pieces of letters alone: from LETTERS on, and of fewer characters per token, as long words of many languages take many.
LETTERS, LETTERS_SHARE = 20, 0.875
#: Public identifiers between marks or ends.
BOUNDED = re.compile(rf"(?<![A-Za-z0-9])(?:{KNOWN.pattern})(?![A-Za-z0-9])")
#: Characters of the piece that a window over marks needs.
CORE = re.compile(r"[A-Za-z0-9]{8,}")
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ratio(run: str, path: str | None = None) -> float:
    return len(run) / max(1, len(encoding(path).encode_ordinary(run)))


def is_random(run: str, max_ratio: float, path: str | None = None) -> bool:
    has = any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run)
    return has and not KNOWN.fullmatch(run) and not NAMES.fullmatch(run) and ratio(run, path) < max_ratio


def random_letters(piece: str, max_ratio: float, path: str | None = None) -> bool:
    return len(piece) >= LETTERS and piece.isalpha() and ratio(piece, path) < LETTERS_SHARE * max_ratio


def best_ranges(values: list[float]) -> list[tuple[int, int]]:
    """The range of the largest sum, and those of the largest sums left and right of it, and so on, as far as they are
    above zero, in one pass: each range waits on a stack, with the sums before and after it, and is joined to an earlier
    one if that begins at a lower sum and ends at a lower one."""
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the last one with a lower sum before
    total = 0.0
    for i, v in enumerate(values):
        low, total = total, total + v
        if v <= 0:
            continue
        start, end, high = i, i + 1, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b) for a, b, *_ in stack]


def windows(run: str, max_ratio: float, path: str | None = None) -> Iterator[tuple[int, int]]:
    """Windows of tokens with the most tokens over what `max_ratio` allows their characters, widened to whole pieces; left
    and right of each the rest is searched too. At least one piece in them must look like a part of a key."""
    e = encoding(path)
    ends = list(accumulate(map(len, e.decode_tokens_bytes(e.encode_ordinary(run))), initial=0))
    done = 0
    for i, j in best_ranges([max_ratio - (b - a) for a, b in zip(ends, ends[1:])]):
        a, b = ends[i], ends[j]
        if b > done and b - a >= 16 and is_random(run[a:b], max_ratio, path) and any(not NAMES.fullmatch(m[0]) and not KNOWN.fullmatch(m[0]) for m in CORE.finditer(run[a:b])):
            while a and run[a - 1].isalnum() and run[a].isalnum():
                a -= 1
            while b < len(run) and run[b].isalnum() and run[b - 1].isalnum():
                b += 1
            done = b
            yield a, b


def random_spans(run: str, max_ratio: float, path: str | None = None) -> list[tuple[int, int]]:
    """The whole run if it's random, else the random pieces and windows of it outside public identifiers, as a union."""
    if is_random(run, max_ratio, path):
        return [(0, len(run))]
    found, at = [], 0
    for start, end in [*(m.span() for m in BOUNDED.finditer(run)), (len(run), len(run))]:
        part = run[at:start]
        if len(part) >= 16:
            found += [(at + m.start(), at + m.end()) for m in PIECE.finditer(part) if is_random(m[0], max_ratio, path) or random_letters(m[0], max_ratio, path)]
            if any(c.isdigit() for c in part) and not NAMES.fullmatch(part):
                found += [(at + a, at + b) for a, b in windows(part, max_ratio, path)]
        at = end
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(text: str | None, max_ratio: float = MAX_RATIO, path: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed, in code points, the end exclusive. Null has none."""
    if not text:
        return []
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(m.start() + a, 3, m.start() + b) for m in CANDIDATE.finditer(text) for a, b in random_spans(m[0], max_ratio, path)]
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def redact(text: str | None, mark: str = "[SECRET]", max_ratio: float = MAX_RATIO, path: str | None = None) -> str | None:
    """text with the union of its spans replaced, each maximal run by one mark."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in sorted(find(text, max_ratio, path), key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mark] if start > at or not out else []
        at = max(at, end)
    return "".join([*out, text[at:]])


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def with_secrets(docs: DataFrame, max_ratio: float = MAX_RATIO, path: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): counts of each kind, the digest of the base spans, and all spans.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows are each answered. Long texts are
    searched whole, in batches bounded by bytes. No row leaves its partition."""
    workers_find_us(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    spans = find(text, max_ratio, path)
                    base = [s for s in spans if s[0] != "random"]
                    n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                    rows.append((doc_id, *n[:3], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), n[3]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def redacted(docs: DataFrame, text: str = "text", max_ratio: float = MAX_RATIO, path: str | None = None) -> DataFrame:
    """docs with every secret in `text` replaced by a mark; other columns and all rows stay. Null stays null."""
    workers_find_us(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(column):
        return column.map(lambda x: redact(x, max_ratio=max_ratio, path=path), na_action="ignore")

    return docs.withColumn(text, clean(F.col(f"`{text}`")))


def op2(spark, sf_dir: str) -> DataFrame:
    return with_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
