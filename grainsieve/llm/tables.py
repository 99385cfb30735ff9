"""Written intermediate tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.session import checkpoint_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A batch for a Python worker is held several times over, off the heap and in the worker, by every task at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of one join key that stay on the heap, where Spark can't spill them.
HELD_ROWS = "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold"
#: Texts of a written table take a quarter less than in Spark's default codec.
CODEC = "zstd"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str | int | None]) -> Iterator[None]:
    """Hold session settings to ``values`` for a while; None leaves a setting as it is."""
    values = {key: str(value) for key, value in values.items() if value is not None}
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Workspace:
    """A folder below the shared checkpoint folder for the tables of one operator call.

    A written table is computed once; a lost executor costs a re-read.  ``drop`` removes a table
    that no later table is read from.  With ``batch_bytes`` the batches for Python workers stay below that size.
    """

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int | None = None):
        self.spark, self.batch_bytes = spark, batch_bytes
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, held_rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back; its shuffle files go as soon as the table is there.

        With ``held_rows`` the rows of a join key beyond that number may be spilled.
        """
        path = f"{self.root}/{name}"
        with settings(self.spark, {CLEANUP: "true", BATCH_BYTES: self.batch_bytes, HELD_ROWS: held_rows}):
            df.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def field(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{column}`")


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package from where the driver has it.

    A cluster whose machines lack the folder gets the package by ``--py-files`` or an installation.
    """
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([top, *paths])


def smallest_hashes(texts: DataFrame, column: str, most: int) -> DataFrame | None:
    """The ``most`` distinct texts with the smallest hashes, or all if there are fewer; None if there are none.

    Only hashes are gathered to find the bound, so copies of a text count once and are drawn once.
    """
    hashed = F.xxhash64(field(column))
    bound = texts.select(hashed.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return None if bound is None else texts.where(hashed <= bound).select(field(column)).distinct()
