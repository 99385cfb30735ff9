"""Advisories and compromised-package lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.text import trim_space
from grainsieve.functions.versions import parse_constraint

RANGE_COLUMNS = (
    "advisory_id", "ecosystem", "package", "severity", "title", "description", "aliases", "cwe",
    "references", "source", "cvss", "range_no", "lo", "lo_inclusive", "hi", "hi_inclusive", "fixed_version",
)


def advisory_ranges(advisories: DataFrame) -> DataFrame:
    """Constraint-style advisories: one row per affected range."""
    return advisories.select(
        F.col("id").alias("advisory_id"), "ecosystem", "package", "severity", "title", "description",
        "aliases", "cwe", "references", "source",
        (F.col("cvss") if "cvss" in advisories.columns else F.lit("")).alias("cvss"),
        "fixed_version", F.posexplode("affected_versions").alias("range_no", "_c"),
    ).withColumn("_r", parse_constraint(F.col("_c"))).select("*", "_r.*").select(*RANGE_COLUMNS)


def advisory_ranges_intervals(advisories: DataFrame) -> DataFrame:
    """Interval-style advisories ([introduced, fixed) per package); they carry no ecosystem: npm."""
    bound = lambda c: F.when(trim_space(F.col(c)) != "", trim_space(F.col(c)))
    return (
        advisories.select("*", F.posexplode("affected_ranges").alias("range_no", "_r"))
        .select(
            F.col("id").alias("advisory_id"), F.lit("npm").alias("ecosystem"), F.col("_r.package").alias("package"),
            "severity", "title", "description", "aliases",
            F.array().cast("array<string>").alias("cwe"), "references", F.lit("").alias("source"), F.lit("").alias("cvss"),
            "range_no",
            bound("_r.introduced").alias("lo"), F.lit(True).alias("lo_inclusive"),
            bound("_r.fixed").alias("hi"), F.lit(False).alias("hi_inclusive"),
            F.coalesce(bound("_r.fixed"), F.lit("")).alias("fixed_version"),
        )
        .select(*RANGE_COLUMNS)
    )


def compromised_versions(rules: DataFrame) -> DataFrame:
    """One row per (rule, ecosystem, package, version)."""
    return rules.select(
        F.col("id").alias("rule_id"), "ecosystem", "package", F.explode("versions").alias("version"),
        "severity", "description", "source", "iocs",
    )


def normalize_feed(feed: DataFrame) -> DataFrame:
    """Landed feed rows: ecosystem names of public databases become ours (rust is cargo)."""
    eco = F.lower(trim_space(F.col("ecosystem")))
    return feed.withColumn("ecosystem", F.when(eco == "rust", F.lit("cargo")).otherwise(eco))


def merge_intel(seed: DataFrame, feed: DataFrame, key: str = "id") -> DataFrame:
    """Seed and feed by id; where both have one, the feed's row stays.

    Of several rows of one side the one that sorts first stays, column by column.  An aggregate, so copies of one id collapse before the shuffle.
    """
    both = seed.withColumn("_priority", F.lit(1)).unionByName(feed.withColumn("_priority", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_priority"]
    return both.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("_priority", *columns)).alias("_r")).select("_r.*")
