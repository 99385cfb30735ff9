"""The sweep of versions over ranges against every version against every range."""

import functools
import random

import pytest

from grainsieve.operators.packages import versions_in_ranges

RANGES = "ecosystem string, package string, advisory_id string, range_no int, lo string, lo_inclusive boolean, hi string, hi_inclusive boolean"
TRIPLES = "ecosystem string, package string, version string"


def key(version):
    core, _, pre = version.partition("-")
    nums = [int(n or 0) for n in core.split(".")]
    return ([*nums, *[0] * (4 - len(nums))], pre == "", [(not p.isdigit(), int(p) if p.isdigit() else 0, "" if p.isdigit() else p) for p in pre.split(".")] if pre else [])


def inside(version, lo, lo_in, hi, hi_in):
    k = key(version)
    above = lo is None or k > key(lo) or ((True if lo_in is None else lo_in) and k == key(lo))
    below = hi is None or k < key(hi) or (bool(hi_in) and k == key(hi))
    return above and below


def random_version(rng):
    v = ".".join(str(rng.randrange(4)) for _ in range(rng.randrange(1, 5)))
    return v + rng.choice(["", "", "", "-rc.1", "-rc.2", "-beta", "-1", "-beta.11"])


@pytest.mark.parametrize("block", [2, 4096])
def test_random_ranges(spark, block):
    rng = random.Random(11)
    triples = sorted({("npm", f"p{rng.randrange(4)}", random_version(rng)) for _ in range(160)} | {("pip", "p0", "1.0"), ("npm", "p0", "1.0"), ("npm", "p0", "1.0.0")})
    some = functools.partial(rng.choice, [True, False, None])
    bound = lambda: rng.choice([None, random_version(rng), random_version(rng)])
    ranges = [("npm", f"p{rng.randrange(5)}", f"A{i}", i % 3, bound(), some(), bound(), some()) for i in range(60)]
    got = versions_in_ranges(spark.createDataFrame(triples, TRIPLES), spark.createDataFrame(ranges, RANGES), block).collect()
    want = sorted((e, p, v, a, n) for e, p, v in triples for f, q, a, n, *r in ranges if (e, p) == (f, q) and inside(v, *r))
    assert sorted((r.ecosystem, r.package, r.version, r.advisory_id, r.range_no) for r in got) == want


def test_hot_package_gives_hits_only(spark):
    versions = spark.range(30_000).selectExpr("'npm' AS ecosystem", "'hot' AS package", "concat_ws('.', id div 1000, id div 10 % 100, id % 10) AS version")
    ranges = spark.range(3_000).selectExpr(
        "'npm' AS ecosystem", "'hot' AS package", "concat('A', id) AS advisory_id", "0 AS range_no", "concat_ws('.', id div 100, id % 100, 3) AS lo", "true AS lo_inclusive",
        "concat_ws('.', id div 100, id % 100, 5) AS hi", "id % 2 = 0 AS hi_inclusive")
    found = versions_in_ranges(versions, ranges)
    assert found.count() == 3_000 * 2 + 1_500 and found.select("version", "advisory_id").distinct().count() == 7_500


@pytest.mark.parametrize("empty", ["triples", "ranges"])
def test_nothing_to_match(spark, empty):
    triples = spark.createDataFrame([("npm", "a", "1.0")] if empty == "ranges" else [], TRIPLES)
    ranges = spark.createDataFrame([("npm", "a", "A", 0, None, None, None, None)] if empty == "triples" else [], RANGES)
    assert versions_in_ranges(triples, ranges).count() == 0
