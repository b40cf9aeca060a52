"""File sources: local folders and object stores by one reader, chosen by the path's scheme."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.session import shared_dir, spread
from rillspark.sources.tables import Source

BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def glob_regex(glob: str) -> str:
    """A regular expression of a glob: `*` and `?` also match `/`, `**/` any folders or none, `[!a]` and `{a,b}` as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def matches(name: Column, included: list[str] | None, excluded: list[str] | None) -> Column:
    """Whether a relative path fits a pattern to include (all do without any) and none to exclude, nor lies in a folder
    that one excludes."""
    some = lambda globs, c: reduce(or_, [c.rlike(glob_regex(g)) for g in globs])
    ok = some(included, name) if included else F.lit(True)
    if excluded:
        ok = ok & ~some(excluded, name)
        ok = ok & ~reduce(or_, [name.rlike(glob_regex(g)[:-1] + "/") for g in excluded])
    return ok


def decode_text(data: bytes | None) -> str | None:
    """By the byte order mark if there is one, else UTF-8; what doesn't decode becomes U+FFFD."""
    if data is None:
        return None
    for mark, name in BOMS:
        if data.startswith(mark):
            return bytes(data[len(mark) :]).decode(name, "replace")
    return bytes(data).decode("utf-8", "replace")


def decoded(content: Column | str) -> Column:
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(decode_text)

    return decode(content)


#: Bytes of a file that are digested at once.
BLOCK = 1 << 20


def file_system(path: str) -> tuple[Any, str] | None:
    """What opens a path's files inside tasks, and the path as it takes it; None for a scheme that only Spark knows."""
    from pyarrow import fs

    scheme, _, rest = path.rpartition("://")
    if not scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + re.sub("^file:", "", rest).lstrip("/") if scheme or path.startswith(("/", "file:")) else os.path.abspath(path)
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(), rest
    if scheme in ("gs", "gcs"):
        return fs.GcsFileSystem(), rest
    if scheme in ("abfs", "abfss"):
        container, _, account = rest.partition("@")
        host, _, folder = account.partition("/")
        return fs.AzureFileSystem(host.split(".")[0]), f"{container}/{folder}".rstrip("/")
    return None


class Files(Source):
    """Files under a path (file, s3a, abfss, gs ...) by relative name, whatever its characters, and hidden ones as well; links
    are followed. The ordinal is the time of change in µs. Names that don't match, folders' own keys and files over
    `max_file_size` don't exist. Folders are walked level by level: each is listed by a task, and one that is excluded isn't
    opened. Contents are read by tasks that are given names, so that the files asked for are the only ones opened."""

    def __init__(self, path: str, binary: bool = False, included_patterns: list[str] | None = None, excluded_patterns: list[str] | None = None, max_file_size: int | None = None):
        self.path, self.binary, self.included, self.excluded, self.most = path.rstrip("/"), binary, included_patterns, excluded_patterns, max_file_size
        self.keys, self.fetched = ["filename"], True

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("filename", T.StringType()), T.StructField("content", T.BinaryType() if self.binary else T.StringType())])

    def exists(self) -> Callable[[str, bool, int], bool]:
        """Whether a name is one of the source's, as a folder or as a file of some size."""
        some = lambda globs: [re.compile(glob_regex(g)) for g in globs or []]
        included, excluded, all_, most = some(self.included), some(self.excluded), self.included is None or not self.included, self.most

        def ok(name: str, folder: bool, size: int) -> bool:
            parts = name.split("/")
            if any(x.search("/".join(parts[: i + 1])) for x in excluded for i in range(len(parts))):
                return False
            return folder or ((all_ or any(x.search(name) for x in included)) and (most is None or size <= most))

        return ok

    def walked(self, spark: SparkSession) -> DataFrame:
        """filename, modified (µs) and length of every file."""
        path, ok = self.path, self.exists()

        def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            opened, top = file_system(path)
            for b in batches:
                found = []
                for folder in b["filename"].to_pylist():
                    at = f"{top}/{folder}".rstrip("/")
                    for x in opened.get_file_info(fs.FileSelector(at or "/", allow_not_found=True)):
                        name, is_folder = f"{folder}/{x.base_name}".lstrip("/"), x.type == fs.FileType.Directory
                        if x.type == fs.FileType.NotFound or not ok(name, is_folder, x.size or 0) or (not is_folder and x.base_name == ""):
                            continue
                        if is_folder and isinstance(opened, fs.LocalFileSystem) and os.path.islink(x.path) and f"{os.path.realpath(at)}/".startswith(f"{os.path.realpath(x.path)}/"):
                            continue  # a link to a folder that it lies in
                        found.append((name, (x.mtime_ns or 0) // 1000, x.size or 0, is_folder))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["filename", "modified", "length", "folder"])

        shared_dir(spark)
        level, out = spark.createDataFrame([("",)], "filename string"), None
        while True:
            level = level.select("filename").mapInArrow(children, "filename string, modified bigint, length bigint, folder boolean").checkpoint()
            files = level.where("NOT folder").drop("folder")
            out = files if out is None else out.unionByName(files)
            folders = level.where("folder")
            n = folders.count()
            if not n:
                return out
            level = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))

    def contents(self, files: DataFrame) -> DataFrame:
        """The files of given names; those that have gone meanwhile, or aren't the source's, are left out."""
        path, binary, ok = self.path, self.binary, self.exists()

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            opened, top = file_system(path)
            for b in batches:
                for name in b["filename"].to_pylist():
                    if (info := opened.get_file_info(f"{top}/{name}")).type != fs.FileType.File or not ok(name, False, info.size or 0):
                        continue
                    try:
                        with opened.open_input_stream(info.path, compression=None) as f:
                            data = f.read_buffer()
                    except FileNotFoundError:
                        continue
                    content = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("=ii", 0, data.size)), data]) if binary else pa.array([decode_text(data.to_pybytes())], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([name]), content], names=["filename", "content"])

        return files.select("filename").mapInArrow(fetch, self.schema())

    def digests(self, spark: SparkSession) -> DataFrame:
        """filename, size and MD5 digest of all that is in each file, of which a task holds one block at a time, so that files
        may be larger than a value can be. Those of a scheme that only Spark knows are held whole."""
        if file_system(self.path) is None:
            return self.scanned(spark).select("filename", F.col("length").alias("size"), F.md5("content").alias("digest"))
        path = self.path

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened, top = file_system(path)
            for b in batches:
                for name in b["filename"].to_pylist():
                    found, size = hashlib.md5(), 0
                    try:
                        with opened.open_input_stream(f"{top}/{name}", compression=None) as f:
                            while block := f.read(BLOCK):
                                found.update(block)
                                size += len(block)
                    except FileNotFoundError:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([found.hexdigest()])], names=["filename", "size", "digest"])

        return spread(self.walked(spark)).select("filename").mapInArrow(digest, "filename string, size bigint, digest string")

    def read(self, spark: SparkSession) -> DataFrame:
        if file_system(self.path) is None:
            return self.scanned(spark).select("filename", (F.col("content") if self.binary else decoded("content")).alias("content"))
        return self.contents(spread(self.walked(spark)))

    def values(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        return super().values(spark, keys) if file_system(self.path) is None else self.contents(spread(keys))

    def listing(self, spark: SparkSession) -> DataFrame:
        """Reads no contents."""
        if file_system(self.path) is None:
            return self.scanned(spark).select("filename", F.unix_micros("modificationTime").alias("_ordinal"))
        return self.walked(spark).select("filename", F.col("modified").alias("_ordinal"))

    def scanned(self, spark: SparkSession) -> DataFrame:
        """Files of a scheme that only Spark knows, by its own scan, which doesn't see hidden names."""
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path)
        df = df if self.most is None else df.where(F.col("length") <= self.most)  # pushed to the listing
        root = re.sub(r"^[a-z0-9]+:/*", "", self.path).strip("/")
        name = F.regexp_replace("path", rf"^(?:[a-z0-9]+:)?/*{re.escape(root)}/", "")
        return df.withColumn("filename", F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).where(matches(F.col("filename"), self.included, self.excluded))


LocalFile = Files


def amazon_s3(bucket_name: str, prefix: str = "", **options) -> Files:
    return Files(f"s3a://{bucket_name}/{prefix}", **options)


def azure_blob(account_name: str, container_name: str, prefix: str = "", **options) -> Files:
    return Files(f"abfss://{container_name}@{account_name}.dfs.core.windows.net/{prefix}", **options)


#: Documents that have no bytes of their own are exported: to these types, by the type they have.
EXPORTS = {
    "application/vnd.google-apps.document": ("text/markdown", "application/pdf"),
    "application/vnd.google-apps.spreadsheet": ("text/csv", "application/pdf"),
    "application/vnd.google-apps.presentation": ("text/plain", "application/pdf"),
    "application/vnd.google-apps.drawing": ("image/svg+xml", "image/png"),
    "application/vnd.google-apps.script": ("application/vnd.google-apps.script+json",) * 2,
}


class DriveFolders(Source):
    """Folders of a drive service, walked breadth first by a client that is passed in (`children(folder)`, `content(id,
    export_type)`). Each folder's children are listed by one task; contents are fetched by the tasks that read them."""

    def __init__(self, client_factory, root_folder_ids: list[str], binary: bool = False):
        self.client_factory, self.roots, self.binary, self.keys, self.fetched = client_factory, list(root_folder_ids), binary, ["file_id"], True

    def walked(self, spark: SparkSession) -> DataFrame:
        make, schema = self.client_factory, "file_id string, filename string, mime_type string, modified bigint, folder boolean"

        def children(batches):
            client = make()
            for b in batches:
                found = [c for f in b["file_id"] for c in client.children(f)]
                yield pd.DataFrame(found, columns=["file_id", "filename", "mime_type", "modified", "folder"])

        shared_dir(spark)
        level, out = spark.createDataFrame([(f,) for f in self.roots], "file_id string"), None
        while True:
            level = level.select("file_id").mapInPandas(children, schema).checkpoint()
            out = level.where("NOT folder") if out is None else out.unionByName(level.where("NOT folder"))
            level = level.where("folder")
            if level.isEmpty():
                return out.dropDuplicates(["file_id"])

    def read(self, spark: SparkSession) -> DataFrame:
        return self.contents(self.walked(spark))

    def values(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        return self.contents(self.walked(spark).join(keys, "file_id", "left_semi"))

    def contents(self, files: DataFrame) -> DataFrame:
        make, binary = self.client_factory, self.binary

        def fetch(batches):
            client = make()
            for b in batches:
                contents = [client.content(i, EXPORTS.get(m, (None, None))[int(binary)]) for i, m in zip(b["file_id"], b["mime_type"])]
                yield b[["file_id", "filename", "mime_type"]].assign(content=contents if binary else [decode_text(c) for c in contents])

        return files.mapInPandas(fetch, f"file_id string, filename string, mime_type string, content {'binary' if binary else 'string'}")

    def listing(self, spark: SparkSession) -> DataFrame:
        return self.walked(spark).select("file_id", F.col("modified").alias("_ordinal"))
