import re
from dataclasses import replace as dc_replace

import pytest
from pyspark.sql import functions as F

from grainsieve.operators.filters import only_changed, rules_for_project, without_excluded
from grainsieve.operators.rule_scan import capture_filters, scan_rules, with_rule
from grainsieve.operators.suppression import is_suppressed
from grainsieve.plans.derived import CODE_FILES
from grainsieve.plans.scan import ScanOptions, rule_scan
from grainsieve.sources.corpus import files_from_table
from grainsieve.sources.rules import Rule, builtin_rules, load_rules, rules_table


def corpus(spark, *files):
    return files_from_table(spark.createDataFrame(list(files), "p string, t string"), "p", "t")


def found(df):
    return sorted((r.rule_id, r.line, r.column) for r in df.collect())


def test_pack_shape():
    rules = builtin_rules()
    assert len(rules) == 87 and len({r.id for r in rules}) == 87
    for r in rules:
        assert re.compile(r.pattern).groups == len(r.capture_names)
        assert not re.fullmatch(r.pattern, "")
        assert r.requires_literal


def test_every_rule_hits_the_derived_corpus(spark):
    files = files_from_table(CODE_FILES.frame(spark, "/root/testdata/sf0.001"), "path", "text")
    hit = {r.rule_id for r in scan_rules(files, builtin_rules()).select("rule_id").distinct().collect()}
    assert {r.id for r in builtin_rules()} - hit == set()


def test_scan_with_taint_and_literals(spark):
    src = (
        "const a = req.query.x;\nlet b = 'lit';\neval(\"use strict\");\neval(a + b);\n"
        "el.innerHTML = a;\ndocument.write(b);\ndocument.write(a);\n"
        "const c = DOMPurify.sanitize(a).trim();\nel.innerHTML = c;\nfoo.query(a);\ndb.query(a);\n"
        "fs.readFile(b, a);\nfs.readFile(a, b);\n"
    )
    got = found(rule_scan(corpus(spark, ("src/x.js", src))))
    assert [g[:2] for g in got] == [
        ("DOM-XSS-DOCUMENT-WRITE", 7), ("DOM-XSS-INNERHTML-ASSIGN", 5), ("JS-EVAL-EXEC", 4), ("PATH-TRAVERSAL-FS-READ", 13), ("SQL-RAW-QUERY", 11),
    ]


def test_location_of_a_match_over_lines(spark):
    src = "x;\napp.use(session({ secret: 's',\n  cookie: { secure: false } }));\n"
    row = rule_scan(corpus(spark, ("a.js", src))).collect()
    assert [(r.rule_id, r.line, r.column, r.end_line, r.end_column) for r in row] == [("EXPRESS-SESSION-SECURE-FALSE", 2, 9, 3, 26)]
    assert row[0].highlighted_snippet.endswith("(lines 2-3)")


def test_proto_assignment_state(spark):
    src = "obj[key] = 1;\nconst key = k;\nobj[key] = 2;\nif (key === '__proto__') {}\nobj[key] = 3;\nlet key = z;\nobj[key] = 4;\n"
    got = found(rule_scan(corpus(spark, ("a.js", src))))
    assert got == [("proto-assignment", 3, 1), ("proto-assignment", 7, 1)]


def test_thresholds_and_dependency_gate(spark):
    files = corpus(spark, ("a.js", "Object.assign(a, b);\njwt.decode(t);\nx.bypassSecurityTrustHtml(h);"))
    assert [g[0] for g in found(rule_scan(files, options=ScanOptions(min_severity="HIGH")))] == ["ANGULAR-BYPASS-SECURITY-TRUST-HTML", "JWT-DECODE-ONLY"]
    gated = ScanOptions(min_severity="HIGH", gate_by_dependency=True, project_dependencies=["react"])
    assert [g[0] for g in found(rule_scan(files, options=gated))] == ["JWT-DECODE-ONLY"]
    open_gate = ScanOptions(min_severity="HIGH", gate_by_dependency=True, project_dependencies=None)
    assert len(found(rule_scan(files, options=open_gate))) == 2


def test_rule_table_gate(spark):
    rules = rules_table(spark, [Rule("A", "LOW", requires_dependency=["x"]), Rule("B", "LOW"), Rule("C", "LOW", requires_dependency=["y", "z"])])
    deps = spark.createDataFrame([("z",), ("z",)], "package string")
    ids = lambda df: sorted(r.rule_id for r in df.collect())
    assert ids(rules_for_project(rules, deps)) == ["B", "C"]
    assert ids(rules_for_project(rules, None)) == ids(rules_for_project(rules, deps, enabled=False)) == ["A", "B", "C"]


@pytest.mark.parametrize("line, prev, rule, want", [
    ("eval(x) // scanner-disable-line", "", "R", True),
    ("eval(x) // scanner-disable-line R, S", "", "R", True),
    ("eval(x) // scanner-disable-line S", "", "R", False),
    ("eval(x) // scanner-disable-line legacy code", "", "R", False),
    ("eval(x)", "# SCANNER-DISABLE-NEXT-LINE", "R", True),
    ("eval(x)", "// scanner-disable-line", "R", False),
    ("eval(x) /* scanner-expected R */", "", "R", True),
    ("eval(x)", "  * scanner-expected-next-line r", "R", False),
    ("eval('scanner-disable-line')", "", "R", False),
    ("fetch('http://a', 'scanner-disable-line')", "", "R", False),
    ("// scanner-disable-line S scanner-disable-line", "", "R", False),
    ("// scanner-disable-line S * scanner-disable-line", "", "R", True),
])
def test_suppression(spark, line, prev, rule, want):
    df = spark.createDataFrame([(line, prev, rule)], "l string, p string, r string")
    assert df.select(is_suppressed(F.col("l"), F.col("p"), F.col("r")).alias("s")).first().s is want


def test_capture_filters(spark):
    rules = [
        Rule("IGN", "LOW", pattern=r"ign\((\w+)\)", capture_names=["a"], ignore_if_matches={"a": "^ok"}),
        Rule("REQ", "LOW", pattern=r"req\((\w*)\)", capture_names=["a"], require_if_matches={"a": "(?i)^bad"}),
        Rule("LIT", "LOW", pattern=r"lit\(([^)]*)\)", capture_names=["a"], ignore_if_literal=["a"]),
        Rule("ARG", "LOW", pattern=r"arg\((.*)\)$", capture_names=["args"], min_arg_count=2, max_arg_count=3),
    ]
    src = "ign(ok1)\nign(no)\nreq(BADx)\nreq(good)\nreq()\nlit('a' + 1)\nlit(v)\nlit(`t`)\nlit(`t${v}`)\narg(a)\narg(a, f(b, c))\narg('x,y', [1, 2], {k: 3}, 4)\narg()"
    kept = capture_filters(with_rule(scan_rules(corpus(spark, ("a.js", src)), rules), rules_table(spark, rules)))
    assert sorted((r.rule_id, r.line_no) for r in kept.collect()) == [("ARG", 11), ("ARG", 13), ("IGN", 2), ("LIT", 7), ("LIT", 9), ("REQ", 3)]


def test_path_joins(spark):
    files = spark.createDataFrame([("/r/a.js",), ("/r/ab/c.js",), ("/r/a.jsx",), ("/x/y",)], "path string")
    left = without_excluded(files, spark.createDataFrame([("/r/a.js",), (" /r/ab/ ",), ("",)], "path string"))
    assert sorted(r.path for r in left.collect()) == ["/r/a.jsx", "/x/y"]
    assert only_changed(files, files.limit(0)).count() == 4
    assert only_changed(files, spark.createDataFrame([("/r/./a.js",)], "path string")).count() == 1


def test_load_rules(tmp_path):
    (tmp_path / "a.yaml").write_text("id: N1\nseverity: HIGH\npattern: 'x[(]'\ntags: one\ncwe: [' CWE-1 ', '']\nmessage: said\n")
    (tmp_path / "b.yml").write_text(
        "rules:\n - {id: B1, severity: ERROR, languages: [cobol, ts], patterns: [{pattern: '(('}, {pattern: 'ok'}], metadata: {framework: React, tags: t}}\n"
        " - {id: '', query: x}\n - {id: B2, pattern: only}\n"
    )
    (tmp_path / "c.txt").write_text("nothing")
    n, b = load_rules(str(tmp_path))
    assert (n.id, n.tags, n.cwe, n.effective_confidence, n.language_key, n.effective_description) == ("N1", ["one"], ["CWE-1"], "MEDIUM", "javascript", "said")
    assert (b.id, b.severity, b.framework, b.language, b.pattern, b.description) == ("B1", "HIGH", "React", "JavaScript", "ok", "Imported from bundle rule B1")


def test_rules_of_one_id_keep_their_own_matches(spark):
    one = next(r for r in builtin_rules() if r.id == "JS-EVAL-EXEC")
    rules = [dc_replace(one, severity="LOW"), dc_replace(one, pattern=r"exec_this\(", severity="HIGH", capture_names=[], requires_literal=[])]
    files = corpus(spark, ("a.js", "eval(code);\nexec_this(x);\n"))
    found = with_rule(scan_rules(files, rules), rules_table(spark, rules)).select("line_no", "severity").collect()
    assert sorted(tuple(r) for r in found) == [(1, "LOW"), (2, "HIGH")]
