"""A source tree as a DataFrame: a Python data source that lists once and reads in parallel.

Spark's own file sources hide names that begin with ``_`` or ``.``; here only directories
that begin with a dot, or whose name is to be ignored, are left out, as well as symbolic
links and files beyond the size limit.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.config import Config, defaults


def walk(root: str, ignore: tuple, suffixes: tuple, max_bytes: int):
    """(path relative to root, size, mtime_ns), sorted by directory and name."""
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in ignore)
        for name in sorted(names):
            full = os.path.join(folder, name)
            if os.path.splitext(name)[1].lower() not in suffixes or os.path.islink(full):
                continue
            try:
                st = os.stat(full)
            except OSError:
                continue
            if st.st_size <= max_bytes:
                yield os.path.relpath(full, root).replace(os.sep, "/"), st.st_size, st.st_mtime_ns


class _Part(InputPartition):
    def __init__(self, files):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.ignore = tuple(x for x in options.get("ignore", "").split(",") if x)
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)
        self.max_bytes = int(options.get("max_bytes", 5 << 20))
        self.content = options.get("content", "true") == "true"
        self.per_part = int(options.get("files_per_partition", 200))

    def partitions(self):
        files = list(walk(self.root, self.ignore, self.suffixes, self.max_bytes))
        return [_Part(files[i : i + self.per_part]) for i in range(0, len(files), self.per_part)] or [_Part([])]

    def read(self, partition):
        for path, size, mtime in partition.files:
            if not self.content:  # a freshness check reads no file
                yield path, size, mtime, None, None
                continue
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    data = f.read()
            except OSError:
                continue
            yield path, size, mtime, hashlib.sha256(data).hexdigest(), data


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, size long, mtime_ns long, sha256 string, content binary"

    def reader(self, schema):
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, config: Config | None = None, content: bool = True) -> DataFrame:
    c = config or defaults()
    spark.dataSource.register(SourceTree)
    return (
        spark.read.format("source_tree").option("ignore", ",".join(c["index.ignore"])).option("suffixes", ",".join(c["index.suffixes"]))
        .option("max_bytes", c["index.max_file_bytes"]).option("content", str(content).lower()).load(root)
    )


class PathOutsideRoot(ValueError):
    pass


def open_range(root: str, path: str, start: int | None = None, end: int | None = None, max_bytes: int = 5 << 20, max_chars: int = 100_000) -> dict:
    """Lines of one file under root, or {"error": code}."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([base, full]) != base:
        return {"error": "path_outside_root"}
    if not os.path.isfile(full):
        return {"error": "file_not_found"}
    if os.path.getsize(full) > max_bytes:
        return {"error": "file_too_large"}
    first = 1 if start is None else start
    last = first + 200 if end is None else end
    if first < 1 or last < first:
        return {"error": "invalid_line_range"}
    try:
        with open(full, encoding="utf-8", errors="replace") as f:
            lines = f.read().split("\n")
    except OSError:
        return {"error": "file_unreadable"}
    text = "\n".join(lines[first - 1 : last])
    return {"path": path, "start_line": first, "end_line": min(last, len(lines)), "source": text[:max_chars], "truncated": len(text) > max_chars}
