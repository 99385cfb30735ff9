"""The index of guard literals finds what a test of each literal finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from grainsieve.operators import lexical
from grainsieve.operators.lexical import Pattern, find_matches, literal_index
from grainsieve.operators.proto import EVENT_PATTERNS
from grainsieve.operators.rule_scan import scan_rules
from grainsieve.sources.rules import builtin_rules


def test_literals_at_every_place(spark):
    rng = random.Random(2)
    alphabet = "ab(.=$_é\\]^-"
    literals = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(literal_index(literals)), F.lit(1)).alias("found"))
    for row in frame.collect():
        want = [max((w for w in literals if row.t.startswith(w, i)), key=len, default=None) for i in range(len(row.t))]
        assert row.found == [w for w in want if w]


def rows(frame):
    return sorted(map(repr, frame.collect()))


def test_same_matches_with_and_without_the_index(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"{rng.choice(['get', 'set', 'run', 'x'])}{rng.choice(['', 'All', '_one', 'Y'])}{i}" for i in range(40)]
    patterns = [Pattern(f"p{i}", rf"\b{re.escape(w)}(\w*)", 1, any_of=(w, words[i - 1]) if i % 3 else (w,), guard=r"\d\d" if i % 4 == 0 else "",
                        gate=[None, "even", "odd"][i % 3]) for i, w in enumerate(words)]
    patterns += [Pattern(f"c{i}", rf"(?i){w}", any_of=(w.lower(),), ignore_case_guard=True) for i, w in enumerate(words[:9])]
    patterns += [Pattern("free", r"z+"), Pattern("guarded", r"q\d", guard="q")]
    lines = [(k, " ".join(rng.choice([str.upper, str, str])(rng.choice([*words, "zz", "q7", "-", "("])) for _ in range(rng.randrange(6)))) for k in range(400)]
    units = spark.createDataFrame(lines, "k long, line string")
    gates = {"even": F.col("k") % 2 == 0, "odd": F.col("k") % 2 == 1}
    monkeypatch.setattr(lexical, "INDEX_LITERALS", 10**9)
    want = rows(find_matches(units, patterns, gates=gates))
    monkeypatch.setattr(lexical, "INDEX_LITERALS", 1)
    assert rows(find_matches(units, patterns, gates=gates)) == want and len(want) > 300


@pytest.mark.parametrize("limit", [1])
def test_rule_pack_by_the_index(spark, monkeypatch, limit):
    text = "\n".join(["eval(a);", "child_process.exec(cmd, done);", "document.write(x)", "app.use(csurf({ ignoreMethods: ['GET', 'POST'] }));", "var key = names[1];", "obj[key] = v;"])
    files = spark.createDataFrame([("a.js", "javascript", text), ("b.py", "python", "import subprocess\nsubprocess.run(c, shell=True)\n")], "path string, language string, content string")
    want = rows(scan_rules(files, builtin_rules(), EVENT_PATTERNS))
    monkeypatch.setattr(lexical, "INDEX_LITERALS", limit)
    assert rows(scan_rules(files, builtin_rules(), EVENT_PATTERNS)) == want and len(want) >= 6


def test_marked_texts_give_the_matches_of_a_pass_for_each(spark):
    """One pass of a pattern yields matches, gaps and captures; texts that hold the mark, several matches and line breaks too."""
    import re

    from grainsieve.operators.lexical import MARK

    patterns = [Pattern("none", r"[0-9]+"), Pattern("two", r"([a-z]+)=([a-z]*)", 2), Pattern("cash", r"\$\{x\}|é(q)?", 1)]
    texts = ["", "abc", "12", f"a=b{MARK}7{MARK}", "é1\né22 x=y\n\nk= 3", "${x}éq9${x}", f"{MARK}${{x}}", "\n5", "7\n\n", None]
    units = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, line string")
    found = find_matches(units, patterns, multiline=True)
    want = []
    for n, t in enumerate(texts):
        for p in patterns:
            for m in re.finditer(p.pattern, t or ""):
                before = t[:m.start()]
                line_start = len(before[:before.rfind("\n") + 1].encode())
                want.append((n, p.key, m[0], len(before.encode()), [g or "" for g in m.groups()], before.count("\n"), line_start))
    got = [(r.n, r.pattern_key, r["match"], r.start, list(r.captures), r.line_offset, r.line_start) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(want) == 17
    # a pattern from a column is compiled anew for every text
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString().upper()


def test_lists_of_candidates_and_marks_are_made_in_short_steps(spark):
    patterns = [Pattern(f"p{i}", rf"w{i}(x?)\b", 1, any_of=(f"w{i}",)) for i in range(40)]
    cases = re.findall(r"CASE _pid (.*?) END", lexical._marked("`line`", patterns))
    assert sum(c.count("WHEN") for c in cases) == 40 and max(c.count("WHEN") for c in cases) <= 4
    units = spark.createDataFrame([(i, f"w{i} w{i}x w7") for i in range(40)] + [(99, None), (98, "none")], "k int, line string")
    found = find_matches(units, patterns)
    want = [(i, f"p{j}", t) for i in range(40) for j in range(40) for t in re.findall(rf"w{j}x?\b", f"w{i} w{i}x w7")]
    assert sorted((r.k, r.pattern_key, r["match"]) for r in found.collect()) == sorted(want)
    # an explode that makes the lists itself evaluates all guards of a text term by term
    assert not re.search(r"Generate explode\(concat", found._jdf.queryExecution().optimizedPlan().toString())


def test_an_extension_is_cut_out_once(spark):
    from pyspark.sql import functions as F

    from grainsieve.functions.paths import language_for_path

    df = spark.createDataFrame([("a/b.PY",), ("x.tsx",), ("no",), (None,), ("a.js/x",)], "path string").select(language_for_path(F.col("path")).alias("l"))
    assert [r.l for r in df.collect()] == ["python", "javascript", None, None, None]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract") == 1
