"""Pass/fail gates as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.functions.normalize import SEVERITY_RANK, severity_rank
from grainsieve.functions.text import trim_space


def parse_categories(raw: str) -> list[str]:
    """Comma list: trimmed, upper-cased, blanks dropped, distinct."""
    return sorted({e.strip().upper() for e in raw.split(",")} - {""})


def category_gate(findings: DataFrame, raw: str) -> DataFrame:
    """Fails when a finding has a listed category."""
    names = parse_categories(raw)
    hit = F.upper(trim_space(F.coalesce("category", F.lit("")))).isin(*names) if names else F.lit(False)
    return _gate(findings, "categories", 1, hit)


def advisory_severity_gate(matches: DataFrame, threshold: str) -> DataFrame:
    """Fails when a match reaches the threshold; an unknown threshold never fails.  Counted matches do as well."""
    rank = SEVERITY_RANK.get(threshold.strip().upper(), 0)
    return _gate(matches, "advisories", 2, severity_rank(F.col("severity")) >= rank if rank else F.lit(False))


def new_findings_gate(kept: DataFrame, enabled: bool = True) -> DataFrame:
    """Fails when anything is left after the baseline."""
    return _gate(kept, "new_findings", 3, F.lit(enabled))


def _gate(df: DataFrame, name: str, order: int, hit) -> DataFrame:
    n = F.coalesce(F.sum(F.when(hit, F.col("matches"))), F.lit(0)) if "matches" in df.columns else F.count_if(hit)
    return df.agg(n.alias("n")).select(
        F.lit(name).alias("gate"), (F.col("n") > 0).alias("failed"), "n", F.lit(order).alias("gate_order")
    )


def all_gates(*gates: DataFrame) -> DataFrame:
    """All gates with the one that decides: the failed gate of lowest order."""
    table = gates[0]
    for g in gates[1:]:
        table = table.unionByName(g)
    everything = Window.partitionBy(F.lit(0))  # one row for each gate; no gate is computed twice
    first = F.min(F.when(F.col("failed"), F.col("gate_order"))).over(everything)
    return table.withColumn("_first", first).select(
        "gate", "failed", "n", "gate_order", F.coalesce(F.col("gate_order") == F.col("_first"), F.lit(False)).alias("decides")
    )
