import re

from grainsieve.operators.inventory import identifier_dictionary, inventory_detections
from grainsieve.sources.corpus import files_from_table
from grainsieve.sources.detectors import Detector, builtin_detectors, expand_words

SAMPLE = (
    "const user_email = 'a.b@example.org'; // EMAIL email e_mail\n"
    "éemail mail; 123456789 123-45-6789 4111111111111111\n"
    "address_line-2 address_line addressLine3 xaddress_line\n"
    "toKen api_Key paſſword\n"
    "aa:bb:cc:dd:ee:ff 10.0.0.255 10.0.0.256 DE89370400440532013000 eyJhb.eyJz.c2ln\n"
    "\n"
)


def run(spark, text, detectors=None):
    files = files_from_table(spark.createDataFrame([("f.js", text)], "p string, t string"), "p", "t")
    return inventory_detections(files, detectors).collect()


def brute(text, detectors):
    """All patterns on all lines with the standard library (folding letters spelled out)."""
    out = set()
    for no, line in enumerate(text.split("\n"), 1):
        for d in detectors:
            pats = [("identifier", "(?i)(?<![A-Za-z0-9_])(?:" + p.replace("k", "[kK]").replace("s", "[sſ]") + ")(?![A-Za-z0-9_])") for p in d.identifier_patterns]
            pats += [("literal", p.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")) for p in d.literal_patterns]
            for kind, p in pats:
                for m in re.finditer(p, line, re.A):
                    start = len(line[: m.start()].encode()) + 1
                    out.add((d.id, kind, no, start, start + len(m.group().encode()), m.group()))
    return out


def test_against_brute_force(spark):
    got = {(r.detector_id, r.match_kind, r.line, r.column, r.end_column, r.match) for r in run(spark, SAMPLE)}
    assert got == brute(SAMPLE, builtin_detectors())
    assert {r[0] for r in got} >= {"DATA-EMAIL", "DATA-SSN", "DATA-POSTAL-ADDRESS", "DATA-JWT", "DATA-PASSWORD", "DATA-API-TOKEN"}


def test_match_slices_back(spark):
    lines = SAMPLE.split("\n")
    for r in run(spark, SAMPLE):
        assert lines[r.line - 1].encode()[r.column - 1 : r.end_column - 1].decode() == r.match


def test_word_expansion_agrees_with_the_patterns():
    words, rest = identifier_dictionary(builtin_detectors())
    assert [p for _, p in rest] == [r"address_?line[_-]?\d?"]
    for d in builtin_detectors():
        for p in d.identifier_patterns:
            for w in expand_words(p) or ():
                assert re.fullmatch(p, w) and d.id in words[w]


def test_custom_detectors_report_a_match_once(spark):
    twice = [Detector("X", "C", "T", "odd", ("na?me", "name"), ("n.me", "name"))]
    rows = run(spark, "name name", twice)
    assert sorted((r.match_kind, r.column) for r in rows) == [("identifier", 1), ("identifier", 6), ("literal", 1), ("literal", 6)]
    assert {r.severity for r in rows} == {"MEDIUM"}


def test_one_line_with_very_many_matches(spark):
    text = " ".join(f"u{i}@ex.org" for i in range(3000))
    rows = run(spark, text)
    assert len(rows) == 3000
    assert all(text[r.column - 1 : r.end_column - 1] == r.match for r in rows)


def test_plan_is_narrow(spark):
    files = files_from_table(spark.createDataFrame([("f", "x")], "p string, t string"), "p", "t")
    plan = inventory_detections(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
