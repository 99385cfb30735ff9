"""Corpora as tables: files and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.functions.paths import PRUNED_VENDORED_DIRS, extension, language_for_path, relative_path
from grainsieve.functions.text import let
from grainsieve.sources.listing import list_tree, read_contents


def scan_files(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = None,
               prune: Sequence[str] = PRUNED_VENDORED_DIRS) -> DataFrame:
    """Read every file below ``root``; unreadable files are skipped.

    Folders named in ``prune`` are never listed (a scan that wants vendored files gives none), files that ``glob`` or the size
    limit leaves out are never opened.  Executors list the tree level by level; the driver sees no file names.
    """
    df = read_contents(list_tree(spark, root, prune, glob, max_bytes))
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//)?", "")
    return _as_files(df, path, F.make_valid_utf8(F.col("content").cast("string")), F.col("size"),
                     F.regexp_replace(F.lit(root), r"^[a-z0-9]+:(//)?", ""))


def files_from_table(df: DataFrame, path: Column | str, text: Column | str, root: str | None = None) -> DataFrame:
    """Use a table with a text column as a corpus; one row is one file."""
    path = F.col(path) if isinstance(path, str) else path
    text = F.col(text) if isinstance(text, str) else text
    return _as_files(df, path, text, F.octet_length(text).cast("long"), root)


def _as_files(df: DataFrame, path: Column, content: Column, size: Column, root) -> DataFrame:
    return df.select(
        path.alias("path"),
        relative_path(path, root).alias("rel_path"),
        extension(path).alias("ext"),
        language_for_path(path).alias("language"),
        content.alias("content"),
        size.alias("size"),
    )


def to_lines(files: DataFrame, *keep: str, neighbours: bool = True) -> DataFrame:
    """One row per line, split at LF only; empty lines are kept.

    The neighbour lines are zipped next to each line inside the row before the explode, so no
    window or shuffle is needed and a row never carries its whole file along.
    """
    lines = F.split("content", "\n", -1)
    if not neighbours:
        return files.select("path", *keep, F.posexplode(lines).alias("_pos", "line")).select(
            "path", *keep, (F.col("_pos") + 1).alias("line_no"), "line"
        )
    zipped = let(
        lines,
        lambda ls: F.transform(
            ls,
            lambda line, i: F.struct(
                (i + 1).alias("line_no"),
                line.alias("line"),
                F.get(ls, i - 1).alias("prev_line"),
                F.get(ls, i + 1).alias("next_line"),
            ),
        ),
    )
    return files.select("path", *keep, F.explode(zipped).alias("_l")).select(
        "path", *keep,
        F.col("_l.line_no").alias("line_no"),
        F.col("_l.line").alias("line"),
        F.col("_l.prev_line").alias("prev_line"),
        F.col("_l.next_line").alias("next_line"),
    )
