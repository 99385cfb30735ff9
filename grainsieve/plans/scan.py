"""Whole scans: rule scan, dependencies, pages, inventory."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.operators.filters import (
    inventory_file_filter, only_changed, source_file_filter, threshold_filter, within_size, without_excluded,
)
from grainsieve.operators.inventory import inventory_detections
from grainsieve.operators.packages import apply_policy, dependency_findings, match_advisories
from grainsieve.operators.proto import EVENT_PATTERNS, PROTO_RULE, proto_matches
from grainsieve.operators.rule_scan import (
    assemble_findings, capture_filters, locate, scan_rules, unsuppressed, with_rule,
)
from grainsieve.operators.taint import extract_assignments, final_states, gate_sinks, propagate
from grainsieve.session import cut_lineage
from grainsieve.sources.corpus import files_from_table, to_lines
from grainsieve.sources.pages import extract_scripts, resolve_scripts
from grainsieve.sources.rules import Rule, builtin_rules, rules_table


@dataclass
class ScanOptions:
    include_tests: bool = False
    include_vendored: bool = False
    extra_extensions: Sequence[str] = field(default_factory=tuple)
    max_file_bytes: int = 0
    changed_files: DataFrame | None = None
    excluded_paths: DataFrame | None = None
    project_dependencies: Sequence[str] | None = None
    gate_by_dependency: bool = False
    min_severity: str = "LOW"
    min_confidence: str = "LOW"
    root: str | None = None


def select_sources(files: DataFrame, options: ScanOptions) -> DataFrame:
    """The files of a rule scan; path tests come before anything touches the content."""
    kept = files.filter(source_file_filter(F.col("path"), F.col("rel_path"), options.include_tests, options.include_vendored))
    if options.excluded_paths is not None:
        kept = without_excluded(kept, options.excluded_paths)
    if options.changed_files is not None:
        kept = only_changed(kept, options.changed_files)
    return kept


def applicable_rules(rules: Sequence[Rule], options: ScanOptions) -> list[Rule]:
    """Rules whose required packages are present (rules and package names are driver-side lists)."""
    deps = options.project_dependencies
    if not options.gate_by_dependency or not deps:
        return list(rules)
    present = set(deps)
    return [r for r in rules if not r.requires_dependency or present & set(r.requires_dependency)]


def taint_gated(joined: DataFrame, lines: DataFrame) -> DataFrame:
    """Drop matches whose sink is a constant or sanitized at the end of its file."""
    gated = F.col("taint.require_tainted") & (F.col("language") == "javascript")
    sinks = joined.filter(gated)
    if sinks.isEmpty():
        return joined
    # a narrow pass turns lines into light facts; only facts of files with a gated match go on
    wanted = sinks.select(F.col("path").alias("file")).distinct()
    assigns = extract_assignments(lines.filter(F.col("language") == "javascript")).join(wanted, "file", "left_semi")
    finals = final_states(propagate(assigns))
    capture = F.try_element_at(F.col("captured"), F.col("taint.sink_capture"))
    prepared = sinks.withColumns({
        "sink_id": F.concat_ws("|", "path", "rule_order", "line_no", "start", F.octet_length("match")),
        "file": F.col("path"),
        "expr": capture,
        "require_tainted": F.col("taint.require_tainted"),
        "require_proven_tainted": F.col("taint.require_proven_tainted"),
        "sink_arg_index": F.col("taint.sink_arg_index"),
        "is_args": F.col("taint.sink_capture") == "args",
    })
    kept = gate_sinks(prepared, finals).select(*joined.columns)
    return joined.filter(~F.coalesce(gated, F.lit(False))).unionByName(kept)


def rule_scan(files: DataFrame, rules: Sequence[Rule] | None = None, options: ScanOptions | None = None,
              taint: bool = True) -> DataFrame:
    """Findings of the rules and of the prototype-key check on a corpus.

    One pass over the texts yields the matches of all rules and events; they are few, and written
    to the shared folder once, so that the branches below do not scan the corpus again.  Taint
    adds a second pass for assignments, only when some match asks for it.
    """
    options = options or ScanOptions()
    rules = applicable_rules(builtin_rules() if rules is None else rules, options)
    spark = files.sparkSession
    sources = select_sources(files, options)
    matches = cut_lineage(scan_rules(sources, rules, EVENT_PATTERNS))
    joined = capture_filters(with_rule(matches, rules_table(spark, rules)))
    if taint:
        joined = taint_gated(joined, to_lines(sources, "language"))
    proto = with_rule(proto_matches(matches), rules_table(spark, [PROTO_RULE]))
    found = unsuppressed(joined.unionByName(proto))
    findings = assemble_findings(locate(found), options.root)
    return findings.filter(threshold_filter(options.min_severity, options.min_confidence))


def all_findings(code: DataFrame, dependency_matches: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Code findings and dependency findings under the same thresholds."""
    options = options or ScanOptions()
    deps = dependency_findings(dependency_matches, options.root)
    keep = threshold_filter(options.min_severity, options.min_confidence)
    return code.unionByName(deps.filter(keep), allowMissingColumns=True)


def inventory_scan(files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Detections on a corpus; excluded paths do not apply here."""
    options = options or ScanOptions()
    kept = within_size(files, options.max_file_bytes).filter(inventory_file_filter(
        F.col("path"), F.col("rel_path"), options.include_tests, options.include_vendored, options.extra_extensions
    ))
    if options.changed_files is not None:
        kept = only_changed(kept, options.changed_files)
    return inventory_detections(kept)


def dependency_scan(packages: DataFrame, ranges: DataFrame, policy: DataFrame | None = None, now=None):
    """(kept, dropped) advisory matches under the policy."""
    matches = match_advisories(packages, ranges)
    if policy is None:
        return matches, matches.limit(0)
    return apply_policy(matches, policy, now)


def page_sources(pages: DataFrame) -> DataFrame:
    """Inline scripts of pages as a corpus of JavaScript files."""
    scripts = resolve_scripts(extract_scripts(pages)).filter(F.col("kind") == "inline")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit("/inline_"), F.col("inline_no").cast("string"), F.lit(".js"))
    return files_from_table(scripts, path, "body")
