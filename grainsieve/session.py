"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Settings that matter for skewed corpora; all are Spark's own switches.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where the join output is grouped again afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("grainsieve")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` (or set on the context) is used as it is.  Only
    a local session without one gets a folder of its own; on a cluster an unset folder is an
    error, since a machine-local path would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="grainsieve-checkpoint-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package from where the driver has it.

    A cluster whose machines lack the folder gets the package by ``--py-files`` or an installation.
    """
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([top, *paths])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Unlike a checkpointed RDD the rows are computed once, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/grainsieve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, bytes_per_task: int = 8 << 20) -> DataFrame:
    """Give a small input enough tasks for CPU-bound text work.

    A file with a single row group is one task however many cores wait.  Inputs that already have
    a task's worth of bytes per core are left alone, so nothing large is ever shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_task else df


def local_table(spark: SparkSession, rows: list[dict], schema: StructType) -> DataFrame:
    """Driver-side rows as a local relation.

    Unlike rows that pass through an RDD, Spark knows the size of a local relation and so
    broadcasts it exactly while it is below the broadcast threshold.
    """
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=fields), schema)


def bounded_values(df: DataFrame, column: str, limit: int) -> list | None:
    """Distinct values of a column when there are at most ``limit``, else None (one short job)."""
    rows = df.select(column).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else [r[0] for r in rows]
