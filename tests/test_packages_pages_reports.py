import glob
import json

import pytest
from pyspark.sql import functions as F

from grainsieve.operators.baseline import build_baseline, parse_baseline, split_by_baseline
from grainsieve.operators.packages import advisory_hits, apply_policy, dependency_findings, flag_ignored, match_advisories, match_compromised, packages_of_hits, resolve_packages
from grainsieve.operators.scripts import name_scripts, script_manifest
from grainsieve.plans.summaries import advisory_summary, package_summary
from grainsieve.plans.gates import advisory_severity_gate, all_gates, category_gate, new_findings_gate, parse_categories
from grainsieve.operators.filters import rules_for_project
from grainsieve.plans.reports import baseline_document, document_manifest, findings_csv, write_csv, write_document, write_findings_report, write_sarif
from grainsieve.plans.scan import inventory_scan, page_sources, rule_scan
from grainsieve.sources.corpus import files_from_table, scan_files
from grainsieve.sources.intel import advisory_ranges, compromised_versions, merge_intel
from grainsieve.sources.lists import normalize_policy
from grainsieve.sources.manifests import extract_locks, extract_packages
from grainsieve.sources.pages import extract_scripts, resolve_scripts
from grainsieve.sources.rules import builtin_rules, import_bundle_rules, rules_table
from grainsieve.streaming.inventory_stream import read_text_table_stream, write_detections_stream

PKG = "ecosystem string, project_path string, manifest_path string, scope string, package string, declared_version string, resolved_version string, version_source string, relationship string"


def packages(spark, *triples):
    return spark.createDataFrame([("npm", "p", "p/package.json", "dependencies", n, d, r, "", "direct") for n, d, r in triples], PKG)


def ranges(spark):
    rows = [("A1", "npm", "lodash", "HIGH", "t", "d", ["<4.17.20"], "4.17.20"), ("A2", "npm", "next", "LOW", "t", "d", [">=1.0.0-rc.1 <1.2.6", ">=2.0.0 <2.1.0"], "")]
    df = spark.createDataFrame(rows, "id string, ecosystem string, package string, severity string, title string, description string, affected_versions array<string>, fixed_version string")
    empty = F.array().cast("array<string>")
    return advisory_ranges(df.withColumns({"aliases": empty, "cwe": empty, "references": empty, "source": F.lit("s")}))


def test_range_join(spark):
    p = packages(spark, ("lodash", "4.17.19", ""), ("lodash", "4.17.20", ""), ("lodash", "^4.0.0", ""), ("lodash", "^4.0.0", "4.1.0"),
                 ("next", "v1.0.0-rc.1", ""), ("next", "1.0.0-beta", ""), ("next", "1.2.6", ""), ("next", "2.0.5", ""), ("other", "1.0.0", ""))
    got = sorted((r.advisory_id, r.version, r.remediation) for r in match_advisories(p, ranges(spark)).collect())
    up = "Upgrade lodash to 4.17.20 or later."
    assert got == [("A1", "4.1.0", up), ("A1", "4.17.19", up), ("A2", "1.0.0-rc.1", ""), ("A2", "2.0.5", "")]


def test_hot_package_keeps_every_row(spark):
    p = packages(spark, *[("lodash", "4.0.0", "")] * 500, *[(f"x{i}", "1.0.0", "") for i in range(100)])
    assert match_advisories(p, ranges(spark)).count() == 500
    f = dependency_findings(match_advisories(p, ranges(spark)), "p")
    assert f.select("fingerprint").distinct().count() == 1 and f.first().kind == "dependency"


def test_matches_are_dealt_by_their_number(spark):
    rows = [(f"A{i}", "npm", "lodash", "HIGH", "t", "d", ["<5.0.0"], "") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, ecosystem string, package string, severity string, title string, description string, affected_versions array<string>, fixed_version string")
    empty = F.array().cast("array<string>")
    held = advisory_ranges(df.withColumns({"aliases": empty, "cwe": empty, "references": empty, "source": F.lit("s")}))
    p = packages(spark, *[("lodash", f"4.0.{i // 40}", "") for i in range(80)], ("lodash", "9.0.0", ""), ("x", "1.0.0", ""), (None, "1.0.0", ""))
    p = p.withColumn("project_path", F.concat(F.lit("p"), F.monotonically_increasing_id().cast("string")))
    hits = advisory_hits(p, held)
    assert hits.count() == 60
    dealt = packages_of_hits(p, hits, task_matches=200)  # one version alone is 1,200 matches
    assert sorted(map(str, dealt.collect())) == sorted(map(str, match_advisories(p, held).collect()))
    made = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 2400 and len(made) > 4 and max(made) < 1200
    policy = normalize_policy(spark.createDataFrame([("A1", "", ""), ("A2", "lodash", "2030-01-01 00:00:00"), ("A3", "x", "")], "id string, package string, expiry string"))
    flagged = [packages_of_hits(p, flag_ignored(hits, policy, "2025-01-01 00:00:00")), flag_ignored(match_advisories(p, held), policy, "2025-01-01 00:00:00")]
    assert flagged[0].columns == flagged[1].columns and flagged[0].where("ignored").count() == 160
    assert sorted(map(str, flagged[0].collect())) == sorted(map(str, flagged[1].collect()))


def test_counted_matches_make_no_pairs(spark):
    texts = ["<2.0.0", ">=1.0.0 <3.0.0", ">1.5.0", "=1.2.0", "<=1.2.0"]
    rows = [(f"A{i % 7}", "npm", f"p{i % 3}", (None, "LOW", "HIGH")[i % 5 % 3], "t", "d", [texts[i % 5], texts[i * 2 % 5], "<0.5.0"][: 1 + i % 3], "") for i in range(40)]
    rows += [(None, "npm", "p0", "HIGH", "t", "d", ["<9.0.0"], ""), ("N", None, "p0", "HIGH", "t", "d", ["<9.0.0"], "")] + [("same", "npm", "p1", "HIGH", "t", "d", ["<2.0.0", ">1.0.0"], "")] * 3
    df = spark.createDataFrame(rows, "id string, ecosystem string, package string, severity string, title string, description string, affected_versions array<string>, fixed_version string")
    empty = F.array().cast("array<string>")
    held = advisory_ranges(df.withColumns({"aliases": empty, "cwe": empty, "references": empty, "source": F.lit("s")}))
    p = packages(spark, *[(f"p{i % 4}", f"{i % 4}.{i % 5}.0", "") for i in range(60)], (None, "1.0.0", ""), ("p1", None, None))
    full, by = match_advisories(p, held).cache(), match_advisories(p, held, ["package", "version", "severity", "relationship"]).cache()
    want = full.groupBy("package", "version", "severity", "relationship").count().collect()
    assert want and sorted(map(str, map(tuple, by.collect()))) == sorted(map(str, map(tuple, want)))
    for told in (lambda m: advisory_severity_gate(m, "high"), advisory_summary, lambda m: package_summary(p, m)):
        assert sorted(map(tuple, told(by).collect())) == sorted(map(tuple, told(full).collect()))
    assert dependency_findings(by).agg(F.sum("matches")).first()[0] == full.count()


def test_compromised_and_policy(spark):
    rules = spark.createDataFrame([("C", "npm", "@s/x", ["1.0.0", "1.0.1"], "CRITICAL", "d", "s", [("ip", "1.1.1.1")])],
                                  "id string, ecosystem string, package string, versions array<string>, severity string, description string, source string, iocs array<struct<type:string,value:string>>")
    p = packages(spark, ("@s/x", "1.0.1", ""), ("@s/x", "1.0.2", ""), ("@s/x", "~1.0.0", "v1.0.0"))
    assert sorted(r.version for r in match_compromised(p, compromised_versions(rules)).collect()) == ["1.0.0", "1.0.1"]
    m = match_advisories(packages(spark, ("lodash", "1.0.0", ""), ("next", "1.0.0", "")), ranges(spark))
    def kept(*entries):
        policy = normalize_policy(spark.createDataFrame(list(entries), "id string, package string, expiry string"))
        k, d = apply_policy(m, policy, "2025-01-01 00:00:00")
        assert k.count() + d.count() == m.count()
        return sorted(r.advisory_id for r in k.collect())
    assert kept(("A1", "", "")) == ["A2"]
    assert kept(("A1", "next", ""), ("A2", None, "2024-12-31 00:00:00")) == ["A1", "A2"]
    assert kept(("A2", "next", "2025-01-01 00:00:00")) == ["A1"]


def test_manifests_and_locks(spark):
    files = files_from_table(spark.createDataFrame([
        ("package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2.0.0"}}'),
        ("npm-shrinkwrap.json", '{"dependencies": {"a": {"version": "1.5.0"}}}'),
        ("x/broken/package.json", "not json"),
    ], "p string, t string"), "p", "t")
    rows = resolve_packages(extract_packages(files), extract_locks(files)).collect()
    assert sorted((r.project_path, r.package, r.scope, r.resolved_version, r.version_source) for r in rows) == [
        (".", "a", "dependencies", "1.5.0", "npm-shrinkwrap.json"), (".", "b", "devDependencies", "", "")]


def test_merge_prefers_feed(spark):
    a = spark.createDataFrame([("1", "s"), ("2", "s")], "id string, v string")
    b = spark.createDataFrame([("2", "f"), ("3", "f")], "id string, v string")
    assert sorted((r.id, r.v) for r in merge_intel(a, b).collect()) == [("1", "s"), ("2", "f"), ("3", "f")]


PAGE = (
    "<p><script>  </script><SCRIPT>one()</SCRIPT><!-- <script>hidden()</script> --><script type='application/json'>{}</script>"
    "<script src='/a.js'>ignored</script><script src=/b/a.js></script><script src='data:x'></script><script type=module>two()</script>"
    "<script src='https://other.org/c.js'></script><script src='/d%zz.js'></script>"
)


def test_scripts(spark):
    pages = spark.createDataFrame([(1, "https://ex.org/p/", PAGE)], "page_id long, url string, html string")
    same = name_scripts(resolve_scripts(extract_scripts(pages)))
    assert sorted((r.pos, r.local_file) for r in same.collect()) == [(1, "inline_1.js"), (2, "a.js"), (3, "a_2.js"), (5, "inline_2.js"), (7, "")]
    res = spark.createDataFrame([("https://ex.org/a.js", 404, "x"), ("https://ex.org/b/a.js", 200, "toolong")], "url string, status int, body string")
    out = {r.pos: (r.http_status, r.bytes, r.error) for r in script_manifest(same, res, max_bytes=5).collect()}
    assert out == {1: (None, 5, None), 2: (404, 0, "HTTP 404"), 3: (200, 0, "response exceeded max bytes (5)"), 5: (None, 5, None), 7: (None, 0, "invalid URL escape")}
    assert {r.content for r in page_sources(pages).collect()} == {"one()", "two()"}


def test_baseline_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("a", "x"), ("b", " y "), ("c", ""), ("d", "x"), ("e", "z")], "file string, fingerprint string")
    write_document(baseline_document(f, "T").filter("true"), str(tmp_path / "b"))
    text = "\n".join(open(p).read().rstrip("\n") for p in sorted(glob.glob(str(tmp_path / "b" / "part-*"))))
    doc = json.loads(text)
    assert doc == {"version": 1, "generated_at": "T", "fingerprints": ["x", "y", "z"]}
    base = parse_baseline(spark.createDataFrame([('{"fingerprints": ["x", " q "]}',), ('["y"]',), ("",)], "value string"))
    kept, matched = split_by_baseline(f, base)
    assert sorted(r.file for r in kept.collect()) == ["c", "e"] and sorted(r.file for r in matched.collect()) == ["a", "b", "d"]
    assert split_by_baseline(f, base.limit(0))[0].count() == 5
    assert [r.fingerprint for r in build_baseline(f).collect()] == ["x", "y", "z"]
    with pytest.raises(Exception, match="failed to parse baseline"):
        parse_baseline(spark.createDataFrame([("{oops",)], "value string")).collect()


def test_gates(spark):
    assert parse_categories("Secrets Exposure, Injection , ,privacy risk") == ["INJECTION", "PRIVACY RISK", "SECRETS EXPOSURE"]
    f = spark.createDataFrame([(" injection ", "HIGH"), ("", "LOW")], "category string, severity string")
    table = {r.gate: (r.failed, r.n, r.decides) for r in all_gates(category_gate(f, "other"), advisory_severity_gate(f, "high"), new_findings_gate(f)).collect()}
    assert table == {"categories": (False, 0, False), "advisories": (True, 1, True), "new_findings": (True, 2, False)}
    assert not advisory_severity_gate(f, "").first().failed and category_gate(f, "Injection").first().failed


def test_reports_on_disk(spark, tmp_path):
    src = "eval(x);\nconst k = '-----BEGIN PRIVATE KEY-----, \"q\"';\n"
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.js").write_text(src)
    (tmp_path / "src" / "node_modules" / "b.js").write_text(src)
    (tmp_path / "src" / "note.txt").write_text("mail me: a@b.org")
    files = scan_files(spark, str(tmp_path / "src"))
    found = rule_scan(files)
    assert sorted((r.rule_id, r.line) for r in found.collect()) == [("JS-EVAL-EXEC", 1), ("PRIVATE-KEY-MATERIAL-LITERAL", 2)]
    assert [r.match for r in inventory_scan(files).filter("match_kind = 'literal'").collect()] == ["a@b.org"]
    write_sarif(found, rules_table(spark, builtin_rules()), str(tmp_path / "sarif"), str(tmp_path / "src"))
    doc = json.loads("".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "sarif" / "part-*")))))
    manifest = document_manifest(spark, str(tmp_path / "sarif")).orderBy("part").collect()
    whole = "".join(open(tmp_path / "sarif" / r.file).read() for r in manifest)
    assert json.loads(whole) == doc and [r.start for r in manifest] == [sum(m.bytes for m in manifest[:k]) for k in range(len(manifest))]
    run = doc["runs"][0]
    assert len(run["tool"]["driver"]["rules"]) == 87 and len(run["results"]) == 2
    assert {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]} == {"a.js"}
    write_csv(findings_csv(found), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert len(back.columns) == 29 and back.count() == 2
    write_findings_report(found, str(tmp_path / "json"), "src", "T")
    head = json.loads(spark.read.text(str(tmp_path / "json/header")).first().value)
    assert head["total_findings"] == 2 and head["finding_category_summary"] == {"Secrets Exposure": 1}
    row = next(r for r in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "json/findings")).collect())) if r["rule_id"] == "JS-EVAL-EXEC")
    assert "category" not in row and row["line"] == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x a@b.org"), (2, "nothing")], "id long, text string").write.parquet(str(tmp_path / "in"))
    files = read_text_table_stream(spark, str(tmp_path / "in"), "id long, text string", F.concat(F.lit("t/"), F.col("id").cast("string")), "text")
    q = write_detections_stream(files, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.file for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["t/1"]


def test_empty_inventory_keeps_every_rule(spark):
    rules = spark.createDataFrame([("r1", ["a"]), ("r2", [])], "rule_id string, requires_dependency array<string>")
    none = spark.createDataFrame([], "package string")
    assert rules_for_project(rules, none).count() == 2
    assert [r.rule_id for r in rules_for_project(rules, none.union(spark.createDataFrame([("b",)], "package string"))).collect()] == ["r2"]


def test_unreadable_expiry_suppresses_nothing(spark):
    rows = [("a", None, ""), ("b", None, "not a date"), ("c", None, "2030-01-01T00:00:00Z")]
    out = normalize_policy(spark.createDataFrame(rows, "id string, package string, expiry string")).collect()
    assert [(r.id, r.expiry is None) for r in out] == [("a", True), ("c", False)]


def test_merge_of_repeated_ids_is_defined(spark):
    seed = spark.createDataFrame([("x", "seed")], "id string, title string")
    feed = spark.createDataFrame([("x", "second"), ("x", "first")], "id string, title string")
    assert [r.title for r in merge_intel(seed, feed).collect()] == ["first"]


def test_bundle_rules_that_share_an_id_keep_their_patterns(spark):
    schema = (
        "id string, severity string, message string, query string, metadata_query string, pattern_either array<string>, patterns array<string>, "
        "languages array<string>, metadata_framework string, metadata_description string"
    )
    rows = [("dup", "ERROR", "m", p, None, None, None, ["javascript"], None, None) for p in ("eval[(]", "exec[(]", "([")]
    assert sorted(r.pattern for r in import_bundle_rules(spark.createDataFrame(rows, schema)).collect()) == ["eval[(]", "exec[(]"]
