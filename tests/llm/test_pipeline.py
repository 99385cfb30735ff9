"""The pipeline's stages on a small table with planted cases, and the registered SQL."""

from __future__ import annotations

import corpus_pipeline
import pytest
from oracle import compare, connect

from grainsieve.llm import queries
from grainsieve.llm.tables import share_package

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    share_package(spark)
    long = "Der Hund und die Katze sitzen heute wieder im Garten und warten auf das Essen , das es bald gibt ".split()
    text = " ".join(long * 3)
    rows = [(1, None, "de", "s", 0), (2, "123 !", "de", "s", 5), (3, text, "de", "s", 1), (4, text, "de", "s", 1), (5, text + " ja", "de", "s", 1),
            (6, "mail a.b@c.de now", "en", "s", 1), (7, "etwas ganz anderes steht hier", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        found[name] = docs.collect()
    ids = lambda name: sorted(r.doc_id for r in found[name])
    assert ids("language ID") == [3, 4, 5, 6, 7]
    assert ids("exact dedup") == [4, 5, 6, 7]
    assert ids("near copies") == [4, 6, 7]
    assert {r.doc_id: r.text for r in found["personal data"]}[6] == "mail <email> now"
    assert all(set(found[n][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for n in list(found)[:-1])
    assert ids("packing") == [4, 6, 7] and sum(r.length for r in found["packing"]) <= 1024


def test_language_stage_fills_labels_and_needs_none(spark):
    share_package(spark)
    german, english = "der hund und die katze sitzen im garten", "the dog and the cat are sitting in the garden"
    rows = [(i, (german if i % 2 else english) + f" {i}", "de" if i % 2 else "en") for i in range(40)]
    rows += [(100, "die katze und der hund im garten", None), (101, "the cat and the dog in the garden", None), (102, german, "xx"), (103, "12 !", None), (104, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, SMALL).where("doc_id >= 100").collect()}
    assert got == {100: "de", 101: "en", 102: "xx"}
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    out = corpus_pipeline.identify_language(spark, bare, SMALL).collect()
    assert sorted(r.doc_id for r in out) == [*range(40), 100, 101, 102] and all(r.lang is None for r in out)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) is None
