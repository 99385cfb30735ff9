"""Defaults, ranks and report scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainsieve.functions.text import is_blank, trim_space

# The orders of severity and confidence.
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CONFIDENCE_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(F.upper(value) == name, F.lit(rank)).otherwise(out)
    return out


def severity_rank(value: Column) -> Column:
    """1 to 4; 0 for anything unknown."""
    return _rank(value, SEVERITY_RANK)


def confidence_rank(value: Column) -> Column:
    return _rank(value, CONFIDENCE_RANK)


def default_kind(value: Column) -> Column:
    return F.when(is_blank(value), F.lit("code")).otherwise(F.lower(trim_space(value)))


def default_framework(value: Column) -> Column:
    return F.when(is_blank(value), F.lit("JavaScript")).otherwise(value)


def default_confidence(value: Column) -> Column:
    return F.when(is_blank(value), F.lit("MEDIUM")).otherwise(F.upper(trim_space(value)))


def detector_severity(value: Column) -> Column:
    clean = F.upper(trim_space(F.coalesce(value, F.lit(""))))
    return F.when(clean.isin(*SEVERITY_RANK), clean).otherwise(F.lit("MEDIUM"))


def clean_list(values: Column) -> Column:
    """Trim entries, drop blanks; an empty list becomes null."""
    kept = F.filter(F.transform(values, trim_space), lambda v: v != "")
    return F.when(F.size(kept) > 0, kept)


def join_list(values: Column) -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), ";")


def format_iocs(iocs: Column) -> Column:
    return F.array_join(F.transform(iocs, lambda i: F.concat_ws(":", i["type"], i["value"])), ";")


def format_identifiers(advisory_id: Column, aliases: Column) -> Column:
    return F.concat_ws(";", advisory_id, aliases)


def sarif_level(severity: Column) -> Column:
    s = F.upper(trim_space(severity))
    return (
        F.when(s.isin("CRITICAL", "HIGH"), "error").when(s == "MEDIUM", "warning").otherwise("note")
    )


def sarif_precision(confidence: Column) -> Column:
    c = default_confidence(confidence)
    return F.when(c == "HIGH", "high").when(c == "LOW", "low").otherwise("medium")


def sarif_security_severity(severity: Column) -> Column:
    s = F.upper(trim_space(severity))
    return (
        F.when(s == "CRITICAL", "9.0").when(s == "HIGH", "8.0").when(s == "MEDIUM", "5.0").otherwise("3.0")
    )
