"""Runtime filters and the stateful stream."""

import datetime
import itertools

from pyspark.sql import functions as F

from grainsieve.functions.bloom import LEAST_BITS, Bloom, build_bloom
from grainsieve.operators.baseline import split_by_baseline
from grainsieve.streaming.findings_stream import new_findings, write_new_findings

FINDING = "file string, fingerprint string, seen_at timestamp"


def test_bloom_lets_all_members_and_few_others_pass(spark):
    keys = spark.range(5000).select(F.concat(F.lit("fp"), "id").alias("k")).unionByName(spark.createDataFrame([(None,), ("fp7",)], "k string"))
    bloom = build_bloom(keys, "k")
    assert bloom.bits == 1 << 16 and len(bloom.data) == bloom.bits // 8
    test = spark.range(20_000).select(F.concat(F.lit("fp"), "id").alias("k"), "id").withColumn("m", bloom.might_contain(F.col("k")))
    assert test.filter("id < 5000 AND NOT m").count() == 0
    assert test.filter("id >= 5000 AND m").count() < 0.03 * 15_000
    assert spark.createDataFrame([(None,)], "k string").select(bloom.might_contain(F.col("k"))).first()[0] is None


def test_bloom_of_a_subquery_is_not_spelled_in_the_plan(spark):
    bloom = build_bloom(spark.range(5000).select(F.concat(F.lit("fp"), "id").alias("k")), "k")
    keys = spark.range(20_000).select(F.when(F.col("id") % 100 != 7, F.concat(F.lit("fp"), "id")).alias("k"), "id")
    test = keys.withColumn("m", bloom.might_contain(F.col("k"), spark))
    assert test.collect() == keys.withColumn("m", bloom.might_contain(F.col("k"))).collect()
    kept = keys.where(bloom.might_contain(F.col("k"), spark))
    assert kept.count() == test.filter("m").count()
    assert len(kept._jdf.queryExecution().toString()) < len(bloom.data)


def test_empty_bloom(spark):
    bloom = build_bloom(spark.createDataFrame([], "k string"), "k")
    assert bloom == Bloom(LEAST_BITS, bytes(LEAST_BITS // 8))
    assert spark.range(9).select(bloom.might_contain(F.col("id").cast("string")).alias("m")).filter("m").count() == 0


def test_baseline_join_shuffles_known_findings_only(spark):
    findings = spark.range(4000).select(F.lit("f").alias("file"), F.when(F.col("id") % 50 == 0, " ").otherwise(F.concat(F.lit(" fp"), "id", F.lit(" "))).alias("fingerprint"))
    baseline = spark.range(0, 4000, 40).select(F.concat(F.lit("fp"), "id").alias("fingerprint"))
    kept, matched = split_by_baseline(findings, baseline)
    assert matched.count() == 80 and kept.count() == 3920  # ids divisible by 40 but not by 50
    joined = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(hex(substring(" in joined.split("LeftAnti")[1]  # the filter stands below the join


def stream(spark, folder, batches):
    """One file for each batch, read one by one."""
    for name, rows in batches.items():
        path = f"{folder}/{name}"
        spark.createDataFrame(rows, FINDING).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(FINDING).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_each_new_fingerprint_once_over_batches_and_restarts(spark, tmp_path):
    at = lambda day: datetime.datetime(2025, 1, day)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    baseline = spark.createDataFrame([(" old ",), ("older",)], "fingerprint string")
    first = {"a": [("1", "x", at(1)), ("1", "x", at(1)), ("1", "old", at(1)), ("1", " ", at(1)), ("1", None, at(1))]}
    write_new_findings(stream(spark, folder, first), baseline, out, checkpoint).awaitTermination()
    told = lambda: sorted(((r.file, (r.fingerprint or "").strip()) for r in spark.read.schema(FINDING).parquet(out).collect()))
    assert told() == [("1", ""), ("1", ""), ("1", "x")]
    # a restart from the same checkpoint: what was told stays told, also where it is spelled with spaces
    more = {"b": [("2", " x ", at(2)), ("2", "y", at(2)), ("2", "older", at(2))], "c": [("3", "y", at(3)), ("3", "z", at(3)), ("3", "", at(3))]}
    write_new_findings(stream(spark, folder, more), baseline, out, checkpoint).awaitTermination()
    files = told()
    assert [f for f in files if f[1] in ("x",)] == [("1", "x")] and sorted(f[1] for f in files) == ["", "", "", "x", "y", "z"]


def test_watermark_forgets(spark, tmp_path):
    at = lambda day: datetime.datetime(2025, 1, day)
    folder, names = str(tmp_path / "in"), itertools.count()
    # the state goes in the batch after the one that moves the watermark past it
    for day, name in ((1, "same"), (5, "same"), (20, "other"), (21, "same")):
        frame = stream(spark, folder, {f"b{next(names)}": [(str(day), name, at(day))]})
        new_findings(frame, spark.createDataFrame([], "fingerprint string"), "seen_at", "7 days").writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.file for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "20", "21"]
