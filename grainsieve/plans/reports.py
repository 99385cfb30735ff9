"""Report tables and sinks.

Rows stay partitioned; only headers (a handful of counts) are single rows.  A document that the
file format wants in one piece is a table of ordered lines, written range-partitioned, so that its
part files concatenate to the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainsieve.functions.normalize import (
    clean_list, default_confidence, default_framework, default_kind, format_identifiers, format_iocs,
    join_list, sarif_level, sarif_precision, sarif_security_severity,
)
from grainsieve.functions.paths import relative_path
from grainsieve.functions.text import is_blank, trim_space
from grainsieve.operators.baseline import build_baseline
from grainsieve.operators.rule_scan import FINDING_COLUMNS
from grainsieve.session import cut_lineage
from grainsieve.plans.summaries import category_counts, framework_counts, inventory_by, inventory_totals, report_totals

# Report columns, SARIF version and schema.
FINDINGS_CSV = (
    "kind", "file", "line", "column", "end_line", "end_column", "rule_id", "severity", "framework",
    "snippet", "matched_code", "highlighted_snippet", "confidence", "tags", "description", "category",
    "taxonomy", "cwe", "owasp", "package_name", "declared_version", "resolved_version",
    "version_source", "fixed_versions", "references", "remediation", "confidence_rationale",
    "project_path", "fingerprint",
)
ADVISORY_CSV = (
    "ecosystem", "package", "version", "fixed_version", "relationship", "dependency_path",
    "project_path", "manifest_path", "scope", "advisory_id", "aliases", "severity", "title",
    "description", "source", "cvss", "references", "remediation", "reachability",
)
COMPROMISED_CSV = (
    "ecosystem", "package", "version", "project_path", "manifest_path", "scope", "rule_id", "severity",
    "description", "iocs", "source",
)
INVENTORY_CSV = (
    "detector_id", "category", "data_type", "severity", "match_kind", "file", "line", "column",
    "end_column", "match", "snippet",
)
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
FINGERPRINT_KEY = "grainsieve/v1"


def findings_csv(findings: DataFrame) -> DataFrame:
    lists = {"tags", "taxonomy", "cwe", "owasp", "fixed_versions", "references"}
    special = {
        "kind": default_kind(F.col("kind")),
        "framework": F.when(F.coalesce("framework", F.lit("")) == "", "JavaScript").otherwise(F.col("framework")),
        "confidence": F.when(F.coalesce("confidence", F.lit("")) == "", "MEDIUM").otherwise(F.col("confidence")),
    }
    return findings.select(*[
        (join_list(F.col(c)) if c in lists else special.get(c, F.col(c))).alias(c) for c in FINDINGS_CSV
    ])


def advisory_csv(matches: DataFrame) -> DataFrame:
    special = {
        "aliases": format_identifiers(F.col("advisory_id"), F.col("aliases")),
        "references": join_list(F.col("references")),
    }
    return matches.select(*[special.get(c, F.col(c)).alias(c) for c in ADVISORY_CSV])


def compromised_csv(matches: DataFrame) -> DataFrame:
    return matches.select(*[(format_iocs(F.col("iocs")) if c == "iocs" else F.col(c)).alias(c) for c in COMPROMISED_CSV])


def inventory_csv(detections: DataFrame) -> DataFrame:
    return detections.select(*INVENTORY_CSV)


def package_csv(packages: DataFrame) -> DataFrame:
    return packages.select("project_path", "scope", "package", "declared_version", "resolved_version", "version_source").orderBy(
        "project_path", "package"
    )


def package_table_lines(packages: DataFrame) -> DataFrame:
    """Rows of the markdown package table."""
    return packages.select(F.concat(
        F.lit("| "), F.concat_ws(" | ", "project_path", "scope", "package", "declared_version"), F.lit(" |")
    ).alias("line"))


def _as_map(counts: DataFrame, key: str) -> DataFrame:
    """A counts table as one map; its size is the number of labels, not of findings."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "count")))).alias("m"))


def findings_header(findings: DataFrame, target: str, timestamp: str) -> DataFrame:
    """The head of the findings report: totals and two count maps, as JSON."""
    totals = report_totals(findings)
    frameworks = _as_map(framework_counts(findings), "framework").withColumnRenamed("m", "framework_summary")
    categories = _as_map(category_counts(findings), "category").withColumnRenamed("m", "finding_category_summary")
    nonempty = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return totals.crossJoin(frameworks).crossJoin(categories).select(F.to_json(F.struct(
        F.lit(timestamp).alias("timestamp"), F.lit(target).alias("target_directory"),
        "total_findings", "code_findings", "dependency_findings",
        nonempty("framework_summary"), nonempty("finding_category_summary"),
    )).alias("header"))


def inventory_header(detections: DataFrame, target: str, timestamp: str) -> DataFrame:
    by_category = _as_map(inventory_by(detections, "category"), "category").withColumnRenamed("m", "category_summary")
    by_type = _as_map(inventory_by(detections, "data_type"), "data_type").withColumnRenamed("m", "data_type_summary")
    nonempty = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return inventory_totals(detections).crossJoin(by_category).crossJoin(by_type).select(F.to_json(F.struct(
        F.lit(timestamp).alias("timestamp"), F.lit(target).alias("target_directory"), "total_detections",
        nonempty("category_summary"), nonempty("data_type_summary"),
        F.when(F.col("files_with_data") > 0, F.col("files_with_data")).alias("files_with_data"),
    )).alias("header"))


def matches_header(matches: DataFrame, target: str, timestamp: str) -> DataFrame:
    return matches.agg(F.count("*").alias("total_findings")).select(F.to_json(F.struct(
        F.lit(timestamp).alias("timestamp"), F.lit(target).alias("target_directory"), "total_findings"
    )).alias("header"))


def _omit_empty(df: DataFrame, columns) -> Column:
    """JSON of a row without empty texts, empty lists and zero numbers."""
    fields = []
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        col = F.col(c)
        if kind == "string":
            col = F.when(col != "", col)
        elif kind == "array":
            col = F.when(F.size(col) > 0, col)
        elif kind in ("integer", "long"):
            col = F.when(col != 0, col)
        fields.append(col.alias(c))
    return F.to_json(F.struct(*fields))


def matches_json_rows(matches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Advisory or compromised matches as JSON, without empty fields."""
    return matches.select(_omit_empty(matches, columns).alias("row"))


def write_matches_report(matches: DataFrame, columns: Sequence[str], path: str, target: str, timestamp: str) -> None:
    """Header JSON and one JSON line for each advisory or compromised match, next to each other."""
    matches_header(matches, target, timestamp).withColumnRenamed("header", "value").write.mode("overwrite").text(path + "/header")
    matches_json_rows(matches, columns).withColumnRenamed("row", "value").write.mode("overwrite").text(path + "/findings")


def findings_json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(_omit_empty(findings, FINDING_COLUMNS).alias("row"))


def sarif_rules(rules: DataFrame) -> DataFrame:
    """SARIF rule rows by id; of duplicate ids the last counts."""
    last = (
        rules.filter(~is_blank(F.col("rule_id")))
        .groupBy("rule_id").agg(F.max_by(F.struct(*rules.columns), F.col("rule_order")).alias("r")).select("r.*")
    )
    text = F.col("effective_description")
    return last.select(
        F.col("rule_id").alias("id"), text.alias("name"),
        F.when(is_blank(F.col("remediation")), text)
        .otherwise(F.concat(text, F.lit("\n\nRemediation: "), trim_space(F.col("remediation")))).alias("help"),
        clean_list(F.col("tags")).alias("tags"),
        sarif_precision(F.col("confidence")).alias("precision"),
        sarif_security_severity(F.col("severity")).alias("security_severity"),
        default_framework(F.col("framework")).alias("framework"),
        default_confidence(F.col("confidence")).alias("confidence"),
        clean_list(F.col("cwe")).alias("cwe"), clean_list(F.col("owasp")).alias("owasp"),
        clean_list(F.col("references")).alias("references"),
    ).orderBy("id")


def sarif_results(findings: DataFrame, rules: DataFrame, root: str | None = None) -> DataFrame:
    """SARIF result rows: findings left-joined with their rules (a small dimension table)."""
    index = rules.filter(~is_blank(F.col("rule_id"))).groupBy("rule_id").agg(
        F.max_by(F.struct("effective_description", "tags", "cwe", "owasp"), F.col("rule_order")).alias("_r")
    )
    described = trim_space(F.coalesce("_r.effective_description", F.lit("")))
    message = F.when(described != "", F.col("_r.effective_description")).when(~is_blank(F.col("snippet")), F.col("snippet")).otherwise(F.col("rule_id"))
    return findings.join(index, "rule_id", "left").select(
        "rule_id", sarif_level(F.col("severity")).alias("level"), message.alias("message"),
        relative_path(F.col("file"), root).alias("uri"),
        F.col("line").alias("start_line"), F.col("column").alias("start_column"), "end_line", "end_column",
        F.when(~is_blank(F.col("snippet")), F.col("snippet")).alias("snippet"),
        default_framework(F.col("framework")).alias("framework"),
        F.upper(trim_space(F.col("severity"))).alias("severity"),
        default_confidence(F.col("confidence")).alias("confidence"),
        clean_list(F.col("_r.tags")).alias("tags"), clean_list(F.col("_r.cwe")).alias("cwe"), clean_list(F.col("_r.owasp")).alias("owasp"),
        F.when(~is_blank(F.col("fingerprint")), F.col("fingerprint")).alias("fingerprint"),
    )


def sarif_result_json(results: DataFrame) -> DataFrame:
    positive = lambda c: F.when(F.col(c) != 0, F.col(c))
    text = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text")))
    region = F.struct(
        positive("start_line").alias("startLine"), positive("start_column").alias("startColumn"),
        positive("end_line").alias("endLine"), positive("end_column").alias("endColumn"), text("snippet").alias("snippet"),
    )
    location = F.struct(F.struct(
        F.struct("uri").alias("artifactLocation"), region.alias("region")
    ).alias("physicalLocation"))
    return results.select(F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct("framework", "severity", "confidence", "tags", "cwe", "owasp").alias("properties"),
        F.when(F.col("fingerprint").isNotNull(), F.create_map(F.lit(FINGERPRINT_KEY), F.col("fingerprint"))).alias("partialFingerprints"),
    )).alias("row"))


def sarif_rule_json(rules: DataFrame) -> DataFrame:
    text = lambda c: F.struct(F.col(c).alias("text"))
    return rules.select("id", F.to_json(F.struct(
        "id", "name", text("name").alias("shortDescription"), text("name").alias("fullDescription"), text("help").alias("help"),
        F.struct("tags", "precision", F.col("security_severity").alias("security-severity"), "framework", "confidence",
                 "cwe", "owasp", "references").alias("properties"),
    )).alias("row"))


def document_lines(sections: list[tuple[str, DataFrame | None, str]]) -> DataFrame:
    """Ordered lines (part, key, line) of one document.

    Each section is (opening line, rows or None, key column); rows have the key column, whose values differ, and ``row``.
    All rows but the last of a section end with a comma.  Rows are computed and written once; the last key is a maximum
    over the written key column, so neither finding it nor sorting the lines computes a row again.
    """
    out: DataFrame | None = None
    spark = next(rows for _, rows, _ in sections if rows is not None).sparkSession
    part = 0
    for opening, rows, key in sections:
        head = spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(opening).alias("line"))
        out = head if out is None else out.unionByName(head)
        part += 1
        if rows is not None:
            written = cut_lineage(rows.select(F.col(key).cast("string").alias("key"), "row"))
            last = written.agg(F.max("key")).first()[0]
            out = out.unionByName(written.select(
                F.lit(part).alias("part"), "key",
                F.concat("row", F.when(F.col("key") == F.lit(last), F.lit("")).otherwise(F.lit(","))).alias("line"),
            ))
            part += 1
    return out


def baseline_document(findings: DataFrame, generated_at: str) -> DataFrame:
    """Lines of a baseline document: header, sorted distinct fingerprints, footer."""
    rows = build_baseline(findings).select("fingerprint", F.concat(F.lit('    "'), "fingerprint", F.lit('"')).alias("row"))
    return document_lines([
        ('{\n  "version": 1,\n  "generated_at": "' + generated_at + '",\n  "fingerprints": [', rows, "fingerprint"),
        ("  ]\n}", None, ""),
    ])


def write_document(lines: DataFrame, path: str) -> DataFrame:
    """Write ordered lines; the part files, in the order of the manifest, concatenate to the document.

    The manifest (``part, file, bytes, start``, the place in the whole document of each file's first byte) comes from the
    listing of what was committed, so a copy by ranges can put the files together without reading them twice.
    """
    lines.orderBy("part", "key").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    return document_manifest(lines.sparkSession, path)


def document_manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"))
    along = Window.orderBy("file")  # one row for each part file
    return files.select(
        F.row_number().over(along).alias("part"), "file", "bytes",
        F.coalesce(F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_findings_report(findings: DataFrame, path: str, target: str, timestamp: str) -> None:
    """Header JSON and one JSON line per finding, next to each other."""
    findings_header(findings, target, timestamp).withColumnRenamed("header", "value").write.mode("overwrite").text(path + "/header")
    findings_json_rows(findings).withColumnRenamed("row", "value").write.mode("overwrite").text(path + "/findings")


def write_sarif(findings: DataFrame, rules: DataFrame, path: str, root: str | None = None) -> DataFrame:
    """A SARIF document as ordered lines; returns its manifest."""
    results = sarif_results(findings, rules, root)
    # a row's key is its digest, so the order is the same however the rows are dealt, and a number that tells equal rows apart
    keyed = cut_lineage(sarif_result_json(results).withColumn("i", F.monotonically_increasing_id())).select(
        F.concat_ws("-", F.sha2("row", 256), F.lpad(F.col("i").cast("string"), 20, "0")).alias("k"), "row")
    head = (
        '{"version":"' + SARIF_VERSION + '","$schema":"' + SARIF_SCHEMA
        + '","runs":[{"tool":{"driver":{"name":"grainsieve","rules":['
    )
    lines = document_lines([
        (head, sarif_rule_json(sarif_rules(rules)), "id"),
        (']}},"results":[', keyed, "k"),
        ("]}]}", None, ""),
    ])
    return write_document(lines, path)


def write_intel(merged: DataFrame, path: str) -> None:
    """The merged advisory or compromised rules as JSON rows."""
    merged.write.mode("overwrite").json(path)
