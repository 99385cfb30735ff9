"""Baselines: known fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.functions.bloom import build_bloom
from grainsieve.functions.text import is_blank, trim_space
from grainsieve.session import cut_lineage


def parse_baseline(docs: DataFrame, text: str = "value") -> DataFrame:
    """Distinct fingerprints of baseline documents.

    A document is an object with ``fingerprints`` or a bare array; an empty one holds nothing and
    any other text is an error.
    """
    src = F.col(text)
    as_object = F.from_json(src, "struct<fingerprints:array<string>>")
    as_array = F.from_json(src, "array<string>")
    is_array = F.startswith(trim_space(src), F.lit("["))
    is_object = F.startswith(trim_space(src), F.lit("{"))
    valid = is_blank(src) | ((is_array | is_object) & F.try_parse_json(src).isNotNull())
    values = F.when(is_array, as_array).when(is_object, as_object["fingerprints"])
    checked = F.when(valid, values).otherwise(
        F.raise_error(F.concat(F.lit("failed to parse baseline: "), F.substring(src, 1, 80))).cast("array<string>")
    )
    return (
        docs.select(F.explode(checked).alias("_f"))
        .select(trim_space(F.col("_f")).alias("fingerprint"))
        .filter(F.col("fingerprint") != "")
        .distinct()
    )


def read_baseline(spark: SparkSession, path: str | None) -> DataFrame:
    """Fingerprints of a baseline file or folder; a blank or missing path is an empty set."""
    if path and path.strip():
        name = spark._jvm.org.apache.hadoop.fs.Path(path.strip())
        if name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name):
            return parse_baseline(spark.read.text(path.strip(), wholetext=True))
    return spark.createDataFrame([], "fingerprint string")


def build_baseline(findings: DataFrame) -> DataFrame:
    """Distinct non-blank fingerprints, sorted."""
    return (
        findings.filter(~is_blank(F.col("fingerprint")))
        .select(trim_space(F.col("fingerprint")).alias("fingerprint"))
        .distinct()
        .orderBy("fingerprint")
    )


def split_by_baseline(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, matched): findings outside and inside the baseline.

    Findings without a fingerprint are always kept; they bypass the join, so blanks never gather
    in one task.  A bounded filter of the baseline's fingerprints comes before the join, so of the findings that
    are new only the few that it mistakes for known ones are shuffled.
    """
    blank = is_blank(F.col("fingerprint"))
    keys = cut_lineage(baseline.select(trim_space(F.col("fingerprint")).alias("_known")).distinct())
    named = findings.filter(~blank)
    own = trim_space(F.col("fingerprint"))
    known = F.coalesce(build_bloom(keys, "_known").might_contain(own), F.lit(False))
    maybe, on = named.filter(known), own == F.col("_known")
    kept = maybe.join(keys, on, "left_anti").unionByName(named.filter(~known)).unionByName(findings.filter(blank))
    return kept, maybe.join(keys, on, "left_semi")
