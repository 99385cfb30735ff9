"""Findings of a stream of texts: each fingerprint once, and none that a baseline holds (optional extension).

Matching is stateless; the fingerprints that were told already are state, kept in the state store until the watermark has
passed them.  The baseline is a static table; its join needs no state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.text import is_blank, trim_space
from grainsieve.operators.rule_scan import assemble_findings, capture_filters, locate, scan_rules, unsuppressed, with_rule
from grainsieve.sources.rules import Rule, builtin_rules, rules_table


def stream_findings(files: DataFrame, rules: Sequence[Rule] | None = None, root: str | None = None) -> DataFrame:
    """Findings of the rules on a streaming corpus, without taint, which would need whole files of other batches."""
    rules = list(builtin_rules() if rules is None else rules)
    matches = capture_filters(with_rule(scan_rules(files, rules), rules_table(files.sparkSession, rules)))
    return assemble_findings(locate(unsuppressed(matches)), root)


def new_findings(findings: DataFrame, baseline: DataFrame, time: str, within: str = "7 days") -> DataFrame:
    """Findings whose fingerprint is neither in ``baseline`` nor was told before, within ``within`` of their ``time`` column.

    A fingerprint that comes again after that time is told again.  Findings without a fingerprint always pass; those older
    than the watermark are late and dropped, as in any deduplication with a bound.
    """
    known = baseline.select(trim_space(F.col("fingerprint")).alias("_known")).distinct()
    named = findings.withWatermark(time, within).withColumn("_fingerprint", trim_space(F.coalesce("fingerprint", F.lit(""))))
    fresh = named.join(known, F.col("_fingerprint") == F.col("_known"), "left_anti")
    once = fresh.filter(~is_blank(F.col("_fingerprint"))).dropDuplicatesWithinWatermark(["_fingerprint"])
    return once.unionByName(fresh.filter(is_blank(F.col("_fingerprint")))).drop("_fingerprint")


def write_new_findings(findings: DataFrame, baseline: DataFrame, out: str, checkpoint: str, time: str = "seen_at", within: str = "7 days"):
    """Append new findings to a Parquet folder; the checkpoint holds the state, so a restart tells nothing twice."""
    return (
        new_findings(findings, baseline, time, within).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
