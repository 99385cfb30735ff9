"""Corpus, dependency and threshold filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.normalize import CONFIDENCE_RANK, SEVERITY_RANK, confidence_rank, severity_rank
from grainsieve.functions.paths import (
    in_pruned_dir, is_inventory_path, is_test_path, is_vendored_path, language_for_path,
)
from grainsieve.functions.text import string_array, trim_space
from grainsieve.session import bounded_values

MAX_INVENTORY_BYTES = 5 * 1024 * 1024


def clean_path(path: Column) -> Column:
    """Lexically clean path: no repeated or trailing slash, no ``.`` or ``..`` segment."""
    absolute = F.startswith(path, F.lit("/"))
    segments = F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, F.lit(1), F.size(acc) - 1),
        ).when((s == "..") & absolute, acc).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def source_file_filter(path: Column, rel_path: Column, include_tests=False, include_vendored=False) -> Column:
    """Files of the rule scan: supported language, not test or vendored unless asked for."""
    return language_for_path(path).isNotNull() & _wanted(path, rel_path, include_tests, include_vendored)


def inventory_file_filter(path: Column, rel_path: Column, include_tests=False, include_vendored=False,
                          extra_extensions=()) -> Column:
    return is_inventory_path(path, extra_extensions) & _wanted(path, rel_path, include_tests, include_vendored)


def _wanted(path, rel_path, include_tests, include_vendored) -> Column:
    keep = ~in_pruned_dir(rel_path, include_tests, include_vendored)
    if not include_vendored:
        keep = keep & ~is_vendored_path(rel_path)
    if not include_tests:
        keep = keep & ~is_test_path(rel_path)
    return keep


def within_size(files: DataFrame, max_bytes: int = 0, size: str = "size") -> DataFrame:
    """Drop files over the limit; zero or less means the default limit."""
    return files.filter(F.col(size) <= (max_bytes if max_bytes > 0 else MAX_INVENTORY_BYTES))


def only_changed(files: DataFrame, changed: DataFrame, list_limit: int = 10_000) -> DataFrame:
    """Keep the changed files; an empty list restricts nothing.

    A list of up to ``list_limit`` paths becomes a set test inside the scan, so file contents are
    never shuffled for it; a longer one is a semi join.
    """
    keys = changed.select(clean_path(F.col("path")).alias("_changed"))
    values = bounded_values(keys, "_changed", list_limit)
    if values is None:
        return files.join(keys.distinct(), clean_path(F.col("path")) == F.col("_changed"), "left_semi")
    if not values:
        return files
    return files.filter(F.array_contains(string_array(values), clean_path(F.col("path"))) if len(values) < 20
                        else clean_path(F.col("path")).isin(values))


def without_excluded(files: DataFrame, excluded: DataFrame, path: str = "path", list_limit: int = 1_000) -> DataFrame:
    """Drop files equal to, or below, an excluded path.

    Each file has its own ancestor paths, so the prefix test is an equality test.  A list of up to
    ``list_limit`` paths is tested inside the row; a longer one is an equality anti join over
    exploded ancestors, spread over the cluster, never a nested loop.
    """
    clean = clean_path(F.col(path))
    roots = (
        excluded.select(trim_space(F.col("path")).alias("_p")).filter(F.col("_p") != "")
        .select(clean_path(F.col("_p")).alias("_root"))
    )
    segments = F.split(clean, "/", -1)
    ancestors = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda n: F.when(F.array_join(F.slice(segments, F.lit(1), n), "/") == "", F.lit("/"))
        .otherwise(F.array_join(F.slice(segments, F.lit(1), n), "/")),
    ))
    values = bounded_values(roots, "_root", list_limit)
    if values is not None:
        return files.filter(~F.arrays_overlap(ancestors, string_array(values))) if values else files
    hit = (
        files.select(F.col(path).alias("_file"), F.explode(ancestors).alias("_root"))
        .join(roots.distinct(), "_root", "left_semi").select("_file").distinct()
    )
    return files.join(hit, F.col(path) == F.col("_file"), "left_anti")


def rules_for_project(rules: DataFrame, dependencies: DataFrame | None, enabled: bool = True) -> DataFrame:
    """Drop rules whose required packages are all absent.

    ``dependencies`` has one column ``package``; without an inventory or with an empty one (a short job
    looks), or with the gate off, every rule stays.
    """
    if not enabled or dependencies is None or dependencies.isEmpty():
        return rules
    wanted = rules.select("rule_id", F.explode("requires_dependency").alias("package"))
    present = wanted.join(dependencies.select("package").distinct(), "package", "left_semi")
    free = rules.filter(F.coalesce(F.size("requires_dependency"), F.lit(0)) <= 0)
    gated = rules.filter(F.size("requires_dependency") > 0)
    return free.unionByName(gated.join(present.select("rule_id").distinct(), "rule_id", "left_semi").select(*rules.columns))


def threshold_filter(min_severity: str = "LOW", min_confidence: str = "LOW",
                     severity: Column | None = None, confidence: Column | None = None) -> Column:
    """Keep findings at or above both thresholds; an unknown threshold switches its gate off.

    A finding of unknown severity has rank 0 and is dropped by any known threshold.
    """
    severity = F.col("severity") if severity is None else severity
    confidence = F.col("confidence") if confidence is None else confidence
    keep = F.lit(True)
    min_sev = SEVERITY_RANK.get(min_severity.upper(), 0)
    min_conf = CONFIDENCE_RANK.get(min_confidence.upper(), 0)
    if min_sev:
        keep = keep & (severity_rank(severity) >= min_sev)
    if min_conf:
        keep = keep & (confidence_rank(confidence) >= min_conf)
    return keep
