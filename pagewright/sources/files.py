"""A data source of decoded files: ``spark.read.format("pagewright_files")``, pages where a file can be read, else its error.

    spark.dataSource.register(DecodedFiles)
    spark.read.format("pagewright_files").option("decoder", "package.module:function").load("/books/*.txt")

A decoder takes a file's bytes and gives its pages' texts; it raises ``Locked`` for a file that is locked, and anything
else for one that it can't read. No decoder of a format is here. A partition is a group of files, so that no task gets
more than ``bytesPerPartition`` (64 MB) beyond its largest file; a file that fails is a row, not a failed task.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, book_id string, page_index int, native_text string, code string"


class Locked(Exception):
    """A file is locked."""


def plain_text(content: bytes) -> list[str]:
    """A decoder of UTF-8 text: pages end at form feeds."""
    return content.decode("utf-8").split("\f")


def book_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", os.path.basename(path))


def decoded(path: str, content: bytes, decoder: Callable[[bytes], list[str]]) -> Iterator[tuple]:
    """The rows of a file: its pages, or one with the code of what went wrong."""
    try:
        pages = list(decoder(content))
    except Locked:
        yield path, book_of(path), None, None, "password_protected"
    except Exception:
        yield path, book_of(path), None, None, "invalid_file"
    else:
        for i, text in enumerate(pages):
            yield path, book_of(path), i, text, None


def _load(name: str) -> Callable[[bytes], list[str]]:
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


class _Group(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = re.sub(r"^file:(//)?(?=/)", "", options["path"])
        self.decoder = options.get("decoder", "pagewright.sources.files:plain_text")
        self.most = int(options.get("bytesperpartition", 64 << 20))

    def partitions(self) -> list[_Group]:
        found = sorted(p for p in (glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path)) if os.path.isfile(p))
        if not found:
            return [_Group([self.path])]  # one row says that it isn't there
        groups, size = [[]], 0
        for p in found:
            if groups[-1] and size + os.path.getsize(p) > self.most:
                groups.append([])
                size = 0
            groups[-1].append(p)
            size += os.path.getsize(p)
        return [_Group(g) for g in groups]

    def read(self, partition: _Group) -> Iterator[tuple]:
        decoder = _load(self.decoder)
        for path in partition.value:
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except FileNotFoundError:
                yield path, book_of(path), None, None, "file_not_found"
            except OSError:
                yield path, book_of(path), None, None, "invalid_file"
            else:
                yield from decoded(path, content, decoder)


class DecodedFiles(DataSource):
    """Files of a folder that all executors mount, or of a pattern. For stores that only Spark reads, see ``decoded_pages``."""

    @classmethod
    def name(cls) -> str:
        return "pagewright_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def decoded_pages(spark: SparkSession, path: str, decoder: Callable[[bytes], list[str]] = plain_text) -> DataFrame:
    """The same rows by Spark's own file reader, so that any store will do. A missing path raises and an empty file has no row, as Spark reads."""
    return decoded_contents(spark.read.format("binaryFile").load(path).select("path", "content"), decoder)


def decoded_contents(files: DataFrame, decoder: Callable[[bytes], list[str]] = plain_text) -> DataFrame:
    """The same rows of ``files`` (path, content): bytes that are at hand. Null content is a file that isn't there."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = [(path, book_of(path), None, None, "file_not_found")] if not content.is_valid else list(decoded(path, content.as_py(), decoder))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)
