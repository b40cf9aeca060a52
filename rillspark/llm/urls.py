"""URL filters: rules kept as a sorted array of 64-bit xxhash keys that workers memory-map.

A rule is a host and a path prefix, written as one string (`example.com/en/`). A url is probed with every suffix of its
host joined to its path cut at every length that a rule's path has: all keys of a batch go through one vectorised binary
search, and a hit counts only if the stored full string equals the probed one, so that collisions cannot decide.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, SparkSession

from rillspark.llm.common import slices, workers_find_us

#: host and path, and the verdict.
RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def save(rules: Iterable[tuple[str, str]], path: str) -> None:
    """One file: counts; sorted keys; verdicts; ends of strings; the strings in key order; path lengths that occur."""
    rows = sorted((key(rule), rule, verdict) for rule, verdict in dict(rules).items())
    texts = [r.encode() for _, r, _ in rows]
    lengths = sorted({len(r) - r.index("/") for _, r, _ in rows})
    with open(path, "wb") as f:
        f.write(struct.pack("<qq", len(rows), len(lengths)))
        f.write(np.array([k for k, _, _ in rows], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes())
        f.write(np.array(lengths, "<i8").tobytes())
        f.write(bytes(v == "block" for _, _, v in rows))
        f.write(b"".join(texts))


class Digests:
    """A saved file, memory-mapped: pages of it are read as probes touch them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = struct.unpack_from("<qq", data)
        self.data, at = data, 16
        self.keys = np.frombuffer(data, "<u8", n, at)
        self.ends = np.frombuffer(data, "<i8", n + 1, at := at + 8 * n)
        self.lengths = np.frombuffer(data, "<i8", m, at := at + 8 * n + 8).tolist()
        self.block = np.frombuffer(data, np.uint8, n, at := at + 8 * m)
        self.text = at + n
        self.longest = int(np.diff(self.ends).max(initial=0))  # in bytes, so that no rule has more characters

    def stored(self, k: int) -> str:
        return self.data[self.text + int(self.ends[k]) : self.text + int(self.ends[k + 1])].decode()

    def probe(self, strings: list[str], keys: np.ndarray | None = None) -> list[int]:
        """The place of each string among the rules, or -1."""
        found = np.fromiter(map(key, strings), np.uint64, len(strings)) if keys is None else keys
        first, last = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        out = [-1] * len(strings)
        for i in np.flatnonzero(last > first):
            for k in range(first[i], last[i]):  # more than one only where stored keys collide
                if self.stored(k) == strings[i]:
                    out[i] = k
        return out


@lru_cache(maxsize=4)
def digests(path: str) -> Digests:
    return Digests(path)


def parts(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z) and path; both empty for null or without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    return rest[:end].translate(LOWER), tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]


def judge(urls: list[str | None], d: Digests, default: str = "allow") -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each url. The longest fitting rule wins; of two as long, the one with the longer
    host. Without a rule the verdict is `default`."""
    split = list(map(parts, urls))
    strings, owners = [], []
    for i, (host, path) in enumerate(split):
        at = 0 if len(host) <= d.longest else host.find(".", len(host) - d.longest - 1) + 1 or -1  # no rule fits a longer end
        while host and at >= 0:
            suffix = host[at:]
            for n in d.lengths:
                if n <= len(path):
                    strings.append(suffix + path[:n])
                    owners.append((i, len(suffix)))
            at = host.find(".", at) + 1 or -1
    best: dict[int, tuple[int, int, int]] = {}
    for (i, n), s, k in zip(owners, strings, d.probe(strings)):
        if k >= 0:
            best[i] = max(best.get(i, (-1, -1, -1)), (len(s), n, k))
    return [(h, p, d.stored(b[2]), "block" if d.block[b[2]] else "allow") if (b := best.get(i)) else (h, p, None, default) for i, (h, p) in enumerate(split)]


@lru_cache(maxsize=64)
def added(spark_id: str, rules: tuple[tuple[str, str], ...]) -> str:
    folder = tempfile.mkdtemp(prefix="url-digests-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"url-digests-{uuid.uuid4().hex}.bin")
    save(rules, path)
    SparkContext.getOrCreate().addFile(path)
    return os.path.basename(path)


def shipped(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """The name under which executors find the saved rules: Spark copies the driver's file to each of them."""
    return added(spark.sparkContext.applicationId, tuple(rules))


def with_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """One row per row of pages (page_id, url): host, path, rule, verdict.

    A null url, or one without `://`, has an empty host and path and no rule. Repeated rows are each answered; an empty
    table gives an empty table. No row leaves its partition; of the pages only these two columns are read."""
    spark = pages.sparkSession
    workers_find_us(spark)
    name = shipped(spark, rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = digests(SparkFiles.get(name))
        for batch in batches:
            for part in slices(batch, "url", 1 << 20):
                rows = judge(part["url"].to_pylist(), d, default)
                yield pa.RecordBatch.from_arrays([part["page_id"], *(pa.array(c, pa.string()) for c in zip(*rows))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url").mapInArrow(scan, SCHEMA)


def op8(spark, sf_dir: str) -> DataFrame:
    return with_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
