import random

import pytest
from pyspark.sql import functions as F

from grainsieve.operators.asof import last_before
from grainsieve.operators import taint
from grainsieve.operators.taint import (
    argument_count, bound_names, classify_expression, final_states, gate_sinks, propagate, referenced_names,
)

T, S, U, C = 3, 2, 1, 0


@pytest.mark.parametrize("expr, base, ids", [
    ("req.body", T, []), ("req", None, ["req"]), ("req['x']", U, []), ("req['x'].y", T, []), ("req.q.id()", T, []),
    ("'a' + \"b\"", C, []), ("`x`", C, []), ("`x${v}`", C, ["v"]), ("-1", C, []), ("/a+/g", C, []), ("null", C, []),
    ("encodeURI(req.x)", S, []), ("DOMPurify.sanitize(x).trim()", S, []), ("foo(x)", U, []), ("a + req.b", T, ["a"]),
    ("localStorage.getItem('k')", T, []), ("a ? b : c", U, []), ("x => y", U, []), ("(a)", None, ["a"]), ("a === b", None, ["a", "b"]),
])
def test_classes(spark, expr, base, ids):
    f = spark.createDataFrame([(expr,)], "e string").select(classify_expression(F.col("e")).alias("f")).first().f
    assert (f.base, f.ids) == (base, ids)


def test_names(spark):
    df = spark.createDataFrame([("{ a, b: c }", "f(x.y, { k: z, ...w }, 'q', `t${u}`)"), ("o[k]", "new N(1)"), ("a.href", "a")], "t string, e string")
    rows = df.select(F.array_sort(bound_names(F.col("t"))).alias("b"), F.array_sort(referenced_names(F.col("e"))).alias("r")).collect()
    assert [(r.b, r.r) for r in rows] == [(["a", "c"], ["f", "u", "w", "x", "z"]), (["k", "o"], ["N"]), (["a"], ["a"])]


def test_argument_count(spark):
    df = spark.createDataFrame([("",), ("a",), ("a, f(b, c)",), ("'x,y', [1, 2], {k: 3}",)], "e string")
    assert [r.n for r in df.select(argument_count(F.col("e")).alias("n")).collect()] == [0, 1, 2, 3]


def statements(n, files, seed=1):
    """Assignments over few names, with their ranks by a plain loop."""
    rng = random.Random(seed)
    rows, want = [], {}
    for i in range(files):
        state = {}
        for pos in range(n):
            t, a, b = (rng.choice("abcd") for _ in range(3))
            kind = rng.randrange(6)
            get = lambda v: state.get(v, U)  # noqa: B023, E731
            expr, rank = [
                (a, get(a)), (f"{a} + {b}", max(get(a), get(b))), ("'x'", C), ("req.q", T), (f"encodeURI({a})", S),
                (f"{a}.trim()", S if get(a) == S else (get(a) if get(a) != U else U)),
            ][kind]
            rows.append((f"f{i}", pos, [t], expr))
            state[t] = rank
            want[(f"f{i}", pos)] = rank
    return rows, want


@pytest.mark.parametrize("limit", [1000, 0])
def test_propagation_by_fold_and_by_rounds(spark, limit):
    rows, want = statements(25, 3)
    df = spark.createDataFrame(rows, "file string, pos long, targets array<string>, expr string")
    got = {(r.file, r.pos): r["rank"] for r in propagate(df, fold_limit=limit, bucket_width=4).collect()}
    assert got == want


def test_one_large_file_among_small_ones(spark):
    rows, want = statements(12, 2, seed=5)
    big, big_want = statements(40, 1, seed=6)
    rows += [("hot", p, t, e) for _, p, t, e in big]
    want |= {("hot", p): r for (_, p), r in big_want.items()}
    df = spark.createDataFrame(rows, "file string, pos long, targets array<string>, expr string")
    out = propagate(df, fold_limit=20)
    assert {(r.file, r.pos): r["rank"] for r in out.collect()} == want
    last = {(r.file, r.name): r["rank"] for r in final_states(out).collect()}
    for (f, p), t in {(r[0], r[1]): r[2][0] for r in rows}.items():
        if not any(r[0] == f and r[1] > p and r[2] == [t] for r in rows):
            assert last[(f, t)] == want[(f, p)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    steps = 20_000
    forms = ["v{0}", "v{0}.trim()", "v{0} + 'x'", "(v{0})", "v{0} + k", "k.trim() + v{0}", "f(v{0})"]
    rows = [("f", 0, ["k"], "'fixed'"), ("f", 1, ["v1"], "req.body.x")]
    rows += [("f", i, [f"v{i}"], forms[i % 4 if i % 500 else 4 + i // 500 % 3].format(i - 1)) for i in range(2, steps)]
    # a name that is written again and again, and one whose two parts come from the same place
    rows += [("f", steps + i, ["s"], "s + v7") for i in range(1, 3000)] + [("f", 30_000 + i, ["t"], "t || t.trim()") for i in range(3000)]
    state = {}
    frame = spark.createDataFrame(rows, "file string, pos long, targets array<string>, expr string")
    written = []
    real = taint.cut_lineage
    monkeypatch.setattr(taint, "cut_lineage", lambda df: written.append(1) or real(df))
    got = {r.pos: r["rank"] for r in propagate(frame, fold_limit=100).collect()}
    assert len(written) <= 20
    facts = {r.pos: r.f for r in frame.select("pos", classify_expression(F.col("expr")).alias("f")).collect()}
    for _, pos, (name,), _ in sorted(rows, key=lambda r: r[1]):
        f = facts[pos]
        ranks = lambda names: [state.get(n, U) for n in names]  # noqa: B023, E731
        direct = max([*([] if f.base is None else [f.base]), *ranks(f.ids), *[S if r == S else U for r in ranks(f.pass_ids)]], default=U)
        state[name] = direct if direct != U else max(ranks(f.all_ids), default=U)
        assert got[pos] == state[name], (pos, rows[pos])


def test_last_before_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 9}", i, i if rng.random() < 0.1 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {(r.k, r.pos): r.prev for r in last_before(df, ["k"], "pos", "v", "prev", bucket_width=16).collect()}
    want, last = {}, {}
    for k, p, v in rows:
        want[(k, p)] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want


def test_sink_gate(spark):
    finals = spark.createDataFrame([("f", "t", T), ("f", "c", C), ("f", "s", S)], "file string, name string, rank int")
    cases = [
        ("any", "t", True, False, None, False, True), ("const", "c", True, False, None, False, False), ("san", "s", True, False, None, False, False),
        ("unknown", "zz", True, False, None, False, True), ("proven-unknown", "zz", True, True, None, False, False), ("proven", "t", True, True, None, False, True),
        ("missing", "", True, False, None, False, True), ("missing-proven", "", True, True, None, False, False),
        ("index0", "c, t", True, False, 0, True, False), ("index1", "c, t", True, False, 1, True, True), ("index9", "c, t", True, False, 9, True, True),
        ("all", "c, t", True, False, None, True, True), ("off", "c", False, False, None, False, True),
    ]
    rows = [(n, "f", "javascript", e, rt, rp, i, a) for n, e, rt, rp, i, a, _ in cases] + [("py", "f", "python", "c", True, False, None, False)]
    df = spark.createDataFrame(rows, "sink_id string, file string, language string, expr string, require_tainted boolean, require_proven_tainted boolean, sink_arg_index int, is_args boolean")
    assert {r.sink_id for r in gate_sinks(df, finals).collect()} == {c[0] for c in cases if c[-1]} | {"py"}
