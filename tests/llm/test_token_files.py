"""Token files: codes against plain arrays, and whole files against the tokenizers library."""

from __future__ import annotations

import collections
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainsieve.llm import token_files
from grainsieve.llm.tables import share_package


@pytest.fixture(scope="module")
def session(spark):
    share_package(spark)
    return spark


def shard_of(ids, starts=None):
    ids = np.array(ids, dtype=np.uint32)
    starts = [0, len(ids)] if starts is None else starts
    return token_files.Shard(token_files.shard_bytes(ids, np.array(starts), pa.array(range(len(starts) - 1), pa.int64())))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=1300), st.data())
def test_codes_give_back_any_id(ids, data):
    shard = shard_of(ids)
    assert shard.range(0, len(ids)).tolist() == ids
    if ids:
        places = data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=50))
        assert shard.take(np.array(places, dtype=np.int64)).tolist() == [ids[p] for p in places]
        a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
        assert shard.range(a, b).tolist() == ids[a:b]


def test_long_runs(monkeypatch):
    monkeypatch.setattr(token_files, "RUN_IDS", 64)
    ids = np.random.default_rng(0).geometric(0.001, 20_000) % 50_000
    starts = np.unique(np.concatenate([[0, 20_000], np.random.default_rng(1).integers(0, 20_000, 300)]))
    shard = shard_of(ids, starts)
    assert [own.tolist() for _, own in shard.texts()] == [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert shard.take(np.arange(20_000)[::-7]).tolist() == ids[::-7].tolist()
    with pytest.raises(IndexError):
        shard.take(np.array([20_000]))


def test_widths_are_the_cheapest():
    counts = np.zeros(33, dtype=np.int64)
    counts[[2, 9, 16]] = [900, 500, 30]

    def size(widths):
        total, below = 0, 0
        for k, width in enumerate(widths):
            ids = sum(counts) if k == 0 else sum(counts[below + 1 :])
            below += width
            total += ids * (width + (k + 1 < len(widths)))
        return total

    def splits(n):
        yield [n]
        for first in range(1, n):
            for rest in splits(n - first):
                yield [first, *rest]

    assert size(token_files.chunk_widths(counts)) == min(map(size, splits(16)))


def expected(session, rows):
    """What the library gives, in order; rows of one id by the hash of their text."""
    texts = session.createDataFrame([(t or "",) for _, t in rows], "t string")
    hashes = dict(map(tuple, texts.select("t", F.xxhash64("t")).collect()))
    tokenizer = Tokenizer.from_file(token_files.TOKENIZER)
    own = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    own = [(i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids, hashes[t or ""]) for (i, ids), (_, t) in zip(own, rows, strict=True)]
    out, before = [], 0
    for i, n, crc, ids, _ in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[4])):
        out.append((i, before, n, crc, tuple(ids)))
        before += n
    return out


def rows_of(files, with_ids=True):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in files.documents(with_ids).orderBy("start").collect()]


ODD = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (3, "other"), (None, "one two"), (None, None), (-7, "Ärger 日本 <|endoftext|> x"),
       (8, " ".join(f"word{i % 977}" for i in range(30_000))), (9, "\n\t \r"), (10, "a " * 300)]


@pytest.mark.parametrize("shard_ids", [5, 100, 1 << 20])
def test_files_of_odd_rows(session, tmp_path, shard_ids):
    frame = session.createDataFrame([(*r, "x", 5, 1) for r in ODD], "doc_id long, text string, raw string, n long, `a.b` int")
    files = token_files.write_token_files(frame, str(tmp_path / "out"), shard_ids=shard_ids)
    want = expected(session, ODD)
    assert rows_of(files) == want
    named = {os.path.basename(r.file) for r in files.manifest.collect()}
    assert named == set(os.listdir(tmp_path / "out"))
    # any position, in any order, and such as lie outside
    ids = [x for row in want for x in row[4]]
    asked = [0, len(ids) - 1, 17, 17, 4000, -1, len(ids), None, *range(0, len(ids), 997)]
    got = files.tokens_at(session.createDataFrame([(p,) for p in asked], "position long"), bucket_ids=1000)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((p, ids[p]) for p in asked if p is not None and 0 <= p < len(ids))


def test_given_table_and_manifest_on_disk(session, tmp_path):
    docs = session.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = token_files.write_token_files(docs, shard_ids=20_000)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(files) == expected(session, rows)
    files.manifest.write.parquet(str(tmp_path / "manifest"))
    again = token_files.open_token_files(session, str(tmp_path / "manifest"))
    assert again.documents().count() == len(rows)


def test_other_ids_and_empty_table(session):
    frame = session.createDataFrame([("b", "x y"), ("a", None), (None, "z")], "doc_id string, text string")
    assert [r[0] for r in rows_of(token_files.write_token_files(frame))] == [None, "a", "b"]
    files = token_files.write_token_files(frame.limit(0))
    assert files.documents().collect() == [] and files.manifest.count() == 0
