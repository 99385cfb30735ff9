import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainsieve.functions.fingerprint import fingerprint
from grainsieve.functions.text import (
    cut_bytes, highlight, java_pattern, prefix_scan, squeeze_space, trim_space,
)
from grainsieve.functions.urls import numbered_name, resolve_url, same_origin, script_name
from grainsieve.functions.versions import is_exact, parse_constraint, version_key
from grainsieve.operators.filters import clean_path
from grainsieve.sources.corpus import files_from_table, to_lines

quick = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_ascii_boundary_and_space():
    assert re.search(java_pattern(r"\bmail\b"), "émail")
    assert not re.search(java_pattern(r"\bmail\b"), "xmail")
    assert java_pattern(r"[^\s,]") == r"[^\t\n\f\r ,]"
    assert java_pattern(r"\\b") == r"\\b"


def test_cut_inside_character(spark):
    text = "a" + "é" * 80
    got = one(spark, text, cut_bytes(F.col("v"), 120))
    assert got == "a" + "é" * 59 + "�..."
    three = "€" * 50
    assert one(spark, three, cut_bytes(F.col("v"), 121)) == "€" * 40 + "�..."
    assert one(spark, three, cut_bytes(F.col("v"), 122)) == "€" * 40 + "��..."


@quick
@given(st.text(alphabet=" \t\n  　abé", max_size=30))
def test_trim_and_squeeze(spark, text):
    row = spark.createDataFrame([(text,)], "v string").select(trim_space(F.col("v")).alias("t"), squeeze_space(F.col("v")).alias("s")).first()
    assert row.t == text.strip()
    assert row.s == " ".join(text.split())


@quick
@given(st.lists(st.integers(0, 50), max_size=400))
def test_prefix_sums(spark, values):
    got = spark.createDataFrame([(values,)], "v array<int>").select(F.expr(prefix_scan("v", "q")).alias("r")).first().r
    want, total = [], 0
    for v in values:
        want.append(total)
        total += v
    assert got == want


@quick
@given(st.text(alphabet="ab \t", max_size=12))
def test_fingerprint_ignores_spacing(spark, code):
    df = spark.createDataFrame([(code, "  " + code.replace(" ", " \t "))], "a string, b string")
    fp = lambda c: fingerprint(F.lit("R"), F.lit("/root/x.js"), F.col(c), (F.lit(None).cast("string"), F.lit(" n ")), "/root")
    row = df.select(fp("a").alias("a"), fp("b").alias("b")).first()
    assert row.a == row.b
    body = b"R\0x.js\0" + " ".join(code.split()).encode() + b"\0n\0"
    assert row.a == hashlib.sha256(body).hexdigest()[:16]


def test_highlight(spark):
    line = F.lit("  call(x);")
    got = spark.range(1).select(
        highlight(line, F.lit(2), F.lit(9), F.lit(0), F.lit(4), F.lit("call(x)")).alias("one"),
        highlight(line, F.lit(2), F.lit(3), F.lit(2), F.lit(4), F.lit("call(x)")).alias("many"),
        highlight(line, F.lit(2), F.lit(2), F.lit(0), F.lit(4), F.lit(" ")).alias("none"),
    ).first()
    assert got.one == "[[DANGEROUS]]call(x)[[/DANGEROUS]];"
    assert got.many == "[[DANGEROUS]]call(x);[[/DANGEROUS]] (lines 4-6)"
    assert got.none == "call(x);"


def test_lines_keep_empty_and_neighbours(spark):
    df = spark.createDataFrame([("a", "x\n\ny\n"), ("b", "")], "p string, t string")
    rows = to_lines(files_from_table(df, "p", "t")).orderBy("path", "line_no").collect()
    assert [(r.path, r.line_no, r.line, r.prev_line, r.next_line) for r in rows] == [
        ("a", 1, "x", None, ""), ("a", 2, "", "x", "y"), ("a", 3, "y", "", ""), ("a", 4, "", "y", None), ("b", 1, "", None, None),
    ]


def test_versions(spark):
    order = ["1.0.0-2", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-rc.9", "1.0.0-rc.10", "1.0", "v1.0.1", "1.2", "1.10.0", "2.0.0-alpha", "2.0.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string")
    got = [r.i for r in df.select("i", version_key(F.col("v")).alias("k")).orderBy("k").collect()]
    assert got == list(range(len(order)))
    r = one(spark, ">=1.0.0 <1.2.6", parse_constraint(F.col("v")))
    assert (r.lo, r.lo_inclusive, r.hi, r.hi_inclusive) == ("1.0.0", True, "1.2.6", False)
    r = one(spark, "<4.17.20", parse_constraint(F.col("v")))
    assert (r.lo, r.hi) == (None, "4.17.20")
    assert [one(spark, v, is_exact(F.col("v"))) for v in ("1.2.3", "^1.2", "v1.0.0-rc.1", "*", "")] == [True, False, True, False, False]


def test_urls(spark):
    page = F.lit("HTTPS://Ex.org:8443/a/b/c.html?q=1#f")
    def res(ref):
        return one(spark, ref, resolve_url(page, F.col("v")))
    assert res("x.js") == "https://Ex.org:8443/a/b/x.js"
    assert res("../../../x.js") == "https://Ex.org:8443/x.js"
    assert res("/y/./z/..") == "https://Ex.org:8443/y/"
    assert res("//cdn.org/l.js") == "https://cdn.org/l.js"
    assert res("?p=2") == "https://Ex.org:8443/a/b/c.html?p=2"
    assert res("data:text/x,1").startswith("data:")
    same = lambda a, b: spark.range(1).select(same_origin(F.lit(a), F.lit(b)).alias("r")).first().r
    assert same("http://A.org/x", "HTTP://a.org/y") and not same("http://a.org", "http://a.org:80/") and not same("http://a.org", "https://a.org")
    name = lambda u: one(spark, u, script_name(F.col("v")))
    assert name("http://a.org/js/app.js?v=1") == "app.js"
    assert name("http://a.org/") == "_.js"
    assert name("http://a.org") == hashlib.sha256(b"http://a.org").hexdigest()[:16] + ".js"
    assert name("http://a.org/x%20y+z") == "x_y_z.js"
    assert name("http://a.org/m.MJS") == "m.MJS"
    assert one(spark, "a.min.js", numbered_name(F.col("v"), F.lit(3))) == "a.min_3.js"


def test_clean_path(spark):
    for raw, want in (("/a//b/./c/..", "/a/b"), ("../x/../y", "../y"), ("/../a", "/a"), ("", "."), ("a/", "a")):
        assert one(spark, raw, clean_path(F.col("v"))) == want
