"""Data source ``lhe_header``: the part of each event text file before its first event.

``spark.read.format("lhe_header").load(folder)`` gives one row a file.  A file is
read in small blocks, gzip included, and the read ends at the first event, so
the bytes read do not depend on how many events follow.  Files are dealt to
partitions by count, since every file costs about the same.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 14
FIRST_EVENT = b"<event"
MARK = b"<LesHouchesEvents"
FILES = 64  # files of one partition, at least
PARTITIONS = 4096  # at most
SCHEMA = "path string, preamble string, bytes_read long, file_bytes long"


def open_file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, prefix that makes the path a URI again)."""
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"


def can_open(path: str | list[str]) -> bool:
    """Whether every path is on a file system that Python can open here."""
    try:
        for p in [path] if isinstance(path, str) else path:
            open_file_system(p)
    except Exception:  # an unknown scheme or a missing client library
        return False
    return True


def list_files(path: str) -> list[tuple[str, int]]:
    """Visible files below a folder (or the file itself) as (URI, size), sorted."""
    system, inner, prefix = open_file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    start = len(posixpath.dirname(inner) if info.type == fs.FileType.File else inner.rstrip("/")) + 1
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[start:].split("/"))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


def read_preamble(uri: str) -> tuple[str, int]:
    """Text before the first event, and the bytes that were read for it."""
    system, inner, _ = open_file_system(uri)
    zipped, text, used, undo = uri.endswith(".gz"), b"", 0, zlib.decompressobj(31)
    with system.open_input_file(inner) as file:
        while block := file.read(BLOCK):
            used += len(block)
            while block:
                if not zipped:
                    text, block = text + block, b""
                else:
                    if undo.eof:  # the next member of the archive
                        undo = zlib.decompressobj(31)
                    text, block = text + undo.decompress(block), undo.unused_data
            if (end := text.find(FIRST_EVENT)) >= 0:
                return text[:end].decode(), used
    return text.decode(), used


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(0)
        self.files = files


class LheHeaderReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        files = sorted({f for p in self.paths for f in list_files(p)})
        parts = max(1, min(PARTITIONS, -(-len(files) // FILES)))
        return [Files(files[k::parts]) for k in range(parts)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for uri, size in partition.files:
            text, used = read_preamble(uri)
            if MARK.decode() in text:
                yield uri, text, used, size


class LheHeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lhe_header"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LheHeaderReader:
        path = self.options.get("path")
        paths = path.split("\n") if path else []
        if not paths:
            raise ValueError("a path is needed")
        return LheHeaderReader(paths)
