"""Latest value before a position, per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(events: DataFrame, keys: list[str], order: str, value: str, out: str,
                bucket_width: int = 4096) -> DataFrame:
    """Add ``out``: the last non-null ``value`` strictly before each row, per key.

    A plain window would put all rows of one key into one task.  Positions are cut into buckets
    instead: a window inside each bucket, one summary row per bucket, a window over the few
    summaries, and an equality join back.  A key with a third of all rows is spread over as many
    tasks as it has buckets.
    """
    bucketed = events.withColumn("_bucket", F.floor(F.col(order) / bucket_width))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = bucketed.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    summary = (
        bucketed.filter(F.col(value).isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(F.max_by(value, order).alias("_final"))
    )
    # a bucket needs the last summary of any earlier bucket, also of buckets without a value
    marks = near.select(*keys, "_bucket").distinct().join(summary, [*keys, "_bucket"], "left")
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_far", F.last("_final", ignorenulls=True).over(across)).drop("_final")
    carried = carried.filter(F.col("_far").isNotNull())
    return (
        near.join(carried, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_near", "_far"))
        .drop("_near", "_far", "_bucket")
    )
