"""Listing of large trees by the executors, level by level, without pruned folders."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.session import cut_lineage, share_package

ENTRY = "path string, folder boolean, size bigint"
#: Bytes of content that a task holds before it hands them on.
BATCH_BYTES = 16 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for a local or mounted path or a URI."""
    found = urlparse(path)
    if found.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(found.path) if found.scheme else path
    return pafs.FileSystem.from_uri(path)


def list_folder(path: str) -> list[tuple[str, bool, int]]:
    """(path, is a folder, size) of a folder's entries; an unreadable folder has none, and links to folders are not followed."""
    system, name = file_system(path)
    if isinstance(system, pafs.LocalFileSystem):
        try:
            with os.scandir(name) as entries:
                return [(e.path, e.is_dir(follow_symlinks=False), e.stat().st_size) for e in entries
                        if e.is_dir(follow_symlinks=False) or e.is_file()]
        except OSError:
            return []
    try:
        found = system.get_file_info(pafs.FileSelector(name, recursive=False))
    except OSError:
        return []
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    return [(head + i.path, i.type == pafs.FileType.Directory, max(0, i.size or 0)) for i in found if i.type in (pafs.FileType.Directory, pafs.FileType.File)]


def list_tree(spark: SparkSession, root: str, prune: Sequence[str] = (), glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """All files below ``root``: ``path, size``.  Folders whose name is in ``prune`` are never listed.

    ``glob`` is matched with the file's name, as Spark's own listing does it; files above ``max_bytes`` are left out.  Each round
    lists one level's folders, dealt over the executors, and is written; there are as many rounds as levels.
    """
    pruned, names = frozenset(prune), glob_names(glob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for path, is_folder, size in list_folder(folder):
                    name = path.rsplit("/", 1)[-1]
                    wanted = name not in pruned if is_folder else (
                        (names is None or any(fnmatch.fnmatchcase(name, n) for n in names)) and (max_bytes is None or size <= max_bytes))
                    if wanted:
                        rows.append((path, is_folder, size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)],
                                                     ["path", "folder", "size"])

    share_package(spark)
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    found = None
    while True:
        listed = cut_lineage(level.mapInArrow(run, ENTRY))
        files = listed.filter(~F.col("folder")).select("path", "size")
        found = files if found is None else found.unionByName(files)
        folders = listed.filter("folder").select("path")
        if folders.isEmpty():
            return found
        level = folders.repartition(tasks * 4)


def glob_names(glob: str | None) -> list[str] | None:
    """A glob with alternatives in braces as plain globs."""
    if glob is None:
        return None
    head, brace, rest = glob.partition("{")
    if not brace or "}" not in rest:
        return [glob]
    inside, _, tail = rest.partition("}")
    return [n for part in inside.split(",") for n in glob_names(head + part + tail)]


def read_contents(files: DataFrame, parts: int | None = None) -> DataFrame:
    """``path, size, content`` of listed files; those that can't be read any more are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def take() -> pa.RecordBatch:
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)],
                                             ["path", "size", "content"])
            rows, held = [], 0
            return out

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = file_system(path)
                try:
                    with system.open_input_stream(name, compression=None) as file:
                        data = file.read()
                except OSError:
                    continue
                rows.append((path, len(data), data))
                held += len(data)
                if held > BATCH_BYTES:
                    yield take()
        if rows:
            yield take()

    share_package(files.sparkSession)
    tasks = parts or files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("path").repartition(tasks).mapInArrow(run, "path string, size bigint, content binary")
