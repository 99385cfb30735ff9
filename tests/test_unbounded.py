"""Results don't depend on how long a match, a number or a page script is."""

from pyspark.sql import functions as F

from grainsieve.functions.versions import version_key
from grainsieve.operators.baseline import read_baseline
from grainsieve.operators.rule_scan import scan_rules
from grainsieve.operators.taint import argument_count, classify_expression, is_literal
from grainsieve.sources.pages import extract_scripts
from grainsieve.sources.rules import builtin_rules


def test_long_stretch_between_call_and_option(spark):
    gap = "a" * 2000
    text = f"session({{ secret: '{gap}', resave: true }})\n"
    other = f"import subprocess\nsubprocess.run('{gap}', shell=True)\n"
    files = spark.createDataFrame([("a.js", "javascript", text), ("b.py", "python", other)], "path string, language string, content string")
    found = {r["rule_id"] for r in scan_rules(files, builtin_rules()).select("rule_id").collect()}
    assert {"EXPRESS-SESSION-RESAVE-TRUE", "PYTHON-SUBPROCESS-SHELL-TRUE"} <= found


def test_version_numbers_of_any_length(spark):
    rows = [("9" * 19, "9" * 18), ("1." + "0" * 30 + "2", "1.1"), ("1.0.0-" + "9" * 25, "1.0.0-" + "9" * 24), ("1.0.0", "1.0.0-5")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(version_key(F.col("a")) > version_key(F.col("b"))).collect()] == [True] * 4


def test_comments_and_scripts_in_document_order(spark):
    html = "<!-- <script>no</script> --><script><!-- code //--></script><script>x='<!--'</script><script src='/a.js'></script>-->"
    pages = spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")
    rows = extract_scripts(pages).orderBy("pos").collect()
    assert [(r["kind"], r["src"], r["body"]) for r in rows] == [
        ("inline", "", "<!-- code //-->"), ("inline", "", "x='<!--'"), ("external", "/a.js", "")]


def test_baseline_reader(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"fingerprints":\n [" x ", "y"]}')
    assert {r[0] for r in read_baseline(spark, str(tmp_path / "b.json")).collect()} == {"x", "y"}
    for path in (None, " ", str(tmp_path / "none.json")):
        assert read_baseline(spark, path).collect() == []


def test_nesting_of_any_depth(spark):
    deep = "f(" * 40 + "a" + ")" * 40
    cases = [
        ("(" * 12 + '"a"' + ")" * 12, 0, [], True), (f"encodeURIComponent({deep})", 2, [], False), ("( ( a ) )", None, ["a"], False),
        ("(a) + (b)", 1, [], False), ("((a) + b)", 1, ["b"], False), ("encodeURI(x) + foo(a", 2, [], False), ("()", None, [], False),
    ]
    rows = spark.createDataFrame([(c[0],) for c in cases], "e string")
    got = rows.select(classify_expression(F.col("e")).alias("f"), is_literal(F.col("e")).alias("lit")).collect()
    assert [(r.f.base, r.f.ids, r.lit) for r in got] == [c[1:] for c in cases]
    args = [(f"a, {deep}", 2), ("a, f(f(f(f(1,2))))", 2), ("'(', g[{k: [1, 2]}], `,`", 3), ("x(a, b", 1), ("a), b", 2), ("", 0), (",".join(["q"] * 1500), 1500)]
    rows = spark.createDataFrame([(a,) for a, _ in args], "e string")
    assert [r.n for r in rows.select(argument_count(F.col("e")).alias("n")).collect()] == [n for _, n in args]
