"""Vector codes against brute force."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest

from grainsieve.llm import vector_codes
from grainsieve.llm.tables import share_package


@pytest.fixture(scope="module")
def session(spark):
    share_package(spark)
    return spark


def nearest(book, part):
    return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(part, book[e], strict=True)), e))


def brute_force(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) from rows of (vec_id, vector, label), in plain Python."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    size = -(-width // parts)
    cut = [[(v + [0] * (size * parts - len(v)))[k * size : (k + 1) * size] for k in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][k] for i in order] for k in range(parts)]
    for _ in range(rounds):
        for k in range(parts):
            held = collections.defaultdict(list)
            for own in cut:
                held[nearest(books[k], own[k])].append(own[k])
            books[k] = [[sum(x) // len(held[e]) for x in zip(*held[e], strict=True)] if held[e] else entry for e, entry in enumerate(books[k])]
    codes = [[nearest(books[k], own[k]) for k in range(parts)] for own in cut]
    errors = [sum((a - b) ** 2 for k in range(parts) for a, b in zip(own[k], books[k][code[k]], strict=True)) for own, code in zip(cut, codes, strict=True)]
    by_label = collections.Counter()
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{c:02x}" for c in code), error, by_label[label], digest)
                               for (i, _, label), code, error in zip(kept, codes, errors, strict=True))


def as_bag(frame):
    assert frame.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return collections.Counter(map(tuple, frame.collect()))


def test_given_table(session):
    table = session.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(300)
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    frame = session.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert as_bag(vector_codes.vector_codes(frame, entries=20)) == brute_force(rows, entries=20)


def test_odd_vectors(session):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 8) / 1024], int(i) % 3) for i in range(70)]  # many ties
    rows += [(5, rows[9][1], None), (5, rows[9][1], None), (None, rows[3][1], 1), (100, None, 1), (101, [1.0, None] + [0.0] * 6, 2),
             (102, [float("nan")] * 8, 2), (103, [float("inf")] * 8, None), (-4, [0.5, -0.25, 1e-9], None), (104, [], 9), (105, [-1e-9] * 7, 9)]
    wide = [(*r, "x", 1.0, 4) for r in rows]
    frame = session.createDataFrame(wide, "vec_id long, embedding array<double>, label int, code string, error double, `a.b` int")
    assert as_bag(vector_codes.vector_codes(frame, entries=16)) == brute_force(rows, entries=16)
    # codebooks beyond one mask word, and more entries than vectors
    assert as_bag(vector_codes.vector_codes(frame, entries=70)) == brute_force(rows, entries=70)
    assert as_bag(vector_codes.vector_codes(frame)) == brute_force(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [float("nan")], 1)]])
def test_nothing_usable(session, rows):
    frame = session.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(frame).collect() == []


@pytest.mark.parametrize(("count", "width", "spread"), [(1, 3, 10), (64, 16, 300), (65, 1, 4), (256, 16, 40), (300, 0, 5)])
def test_search_is_exact_and_looks_at_candidates_only(count, width, spread):
    rng = np.random.default_rng(count)
    book, rows = rng.integers(-spread, spread + 1, (count, width)), rng.integers(-3 * spread, 3 * spread + 1, (500, width))
    best, squares, computed = vector_codes.Slices(book).nearest(rows)
    apart = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (squares == apart.min(axis=1)).all() and computed <= apart.size


def test_codes_name_their_entries(session):
    frame = session.createDataFrame([(i, [i / 8, -i / 4, 0.5, i * i / 64]) for i in range(6)], "vec_id long, embedding array<double>")
    books = vector_codes.train(frame, parts=2)
    out = vector_codes.decode(vector_codes.encode(frame, books), books).collect()
    want = {i: [math.floor(1024 * x) / 1024 for x in (i / 8, -i / 4, 0.5, i * i / 64)] for i in range(6)}
    assert {r.vec_id: r.approximation for r in out} == want and all(r.error == 0 for r in out)
