"""Inventory over a stream of texts (optional extension).

Matching is stateless; a text is scanned when it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainsieve.operators.inventory import inventory_detections
from grainsieve.sources.corpus import files_from_table


def read_text_table_stream(spark: SparkSession, path: str, schema: str, path_expr, text_col: str) -> DataFrame:
    """A folder of parquet files as a stream of corpus rows."""
    raw = spark.readStream.schema(schema).parquet(path)
    return files_from_table(raw, path_expr, text_col)


def detect_stream(files: DataFrame) -> DataFrame:
    """Detections of a streaming corpus."""
    return inventory_detections(files)


def write_detections_stream(files: DataFrame, out: str, checkpoint: str):
    """Append detections to a parquet folder, exactly once per arriving file."""
    return (
        detect_stream(files).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
