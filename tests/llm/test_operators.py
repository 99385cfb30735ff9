"""Operators for training text against brute force, on a small table and on edge cases."""

from __future__ import annotations

import collections
import hashlib
import json
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainsieve.llm import (
    exact_dedup,
    html_extract,
    jaccard_join,
    language_id,
    license_scan,
    merge_replay,
    packing,
    pii,
    pretokens,
    substring_dedup,
    tables,
    topk_search,
)
from grainsieve.llm.tables import share_package, smallest_hashes

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, n long, row string, `a.b` int"


@pytest.fixture(scope="module")
def session(spark):
    share_package(spark)
    return spark


@pytest.fixture(scope="module")
def documents(session):
    return session.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(session):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (3, "other words"), (None, "one two three"), (None, None),
        (7, long), (8, long), (9, long + " end"), (10, "a " * 200), (11, "Ärger ß 日本 a@b.cd 1.2.3.4 +1 (017) 555-7713"), (12, "\n\t \r"), (13, "12345 !!"),
    ]
    return session.createDataFrame([(i, t, "x", 5, "r", 1) for i, t in rows], SCHEMA).cache()


def texts_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def as_bag(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_exact_dedup(name, request):
    frame = request.getfixturevalue(name)
    out = exact_dedup.exact_dedup(frame, first_bytes=4, growth=3).collect()
    rows = texts_of(frame)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = as_bag((i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert as_bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = collections.Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    whole = exact_dedup.exact_dedup(frame, carry=True).where("kept").select("row.*")
    assert whole.columns == frame.columns and whole.count() == len(groups)
    # rounds of few bytes, so carried texts are read from ever later places
    carried = exact_dedup.exact_dedup(frame, carry=True, first_bytes=4, growth=3).collect()
    assert as_bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in carried) == want
    assert as_bag(map(repr, (r.row for r in carried))) == as_bag(map(repr, frame.collect()))
    assert len({r.text_sha256 for r in carried if r.kept}) == sum(r.kept for r in carried) == len(groups)


def components_of(rows, words, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i), doc)) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize(("name", "words", "percent"), [("documents", 5, 80), ("odd", 4, 85)])
def test_jaccard_join(name, words, percent, request):
    frame = request.getfixturevalue(name)
    out = jaccard_join.jaccard_join(frame, words=words, percent=percent, sketch_bits=10).collect()
    assert as_bag((r.doc_id, r.n_shingles, r.component_id) for r in out) == as_bag(components_of(texts_of(frame), words, percent))


@pytest.mark.parametrize(("name", "words", "percent"), [("documents", 4, 85), ("odd", 4, 85), ("near", 2, 60), ("near", 2, 80)])
@pytest.mark.parametrize("block", [9, 512])
def test_jaccard_links(name, words, percent, block, request, session, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "SMALL_COMPONENT", 2 if block == 9 else 8)
    random = np.random.default_rng(7)
    near = [(i, " ".join(f"w{j}" if random.random() > 0.06 else f"x{random.integers(99)}" for j in range(30))) for i in range(60)]
    frame = session.createDataFrame([*near, *near[:5]], "doc_id long, text string") if name == "near" else request.getfixturevalue(name)
    rows = texts_of(frame)
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    reach = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
    counts = [sum(reach(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    out = jaccard_join.jaccard_join(frame, words=words, percent=percent, sketch_bits=10).collect()
    assert as_bag((r.doc_id, r.n_shingles, r.n_links) for r in out) == as_bag((d, len(s), c) for (d, _), s, c in zip(rows, sets, counts, strict=True))
    classes = list(set(sets))
    links = jaccard_join.jaccard_links(frame, words=words, percent=percent, sketch_bits=10).collect()
    assert len(links) == sum(reach(a, b) for i, a in enumerate(classes) for b in classes[:i])
    assert 2 * sum(r.copies_a * r.copies_b for r in links) == sum(counts) - sum(sets.count(s) - 1 for s in sets if s)


def test_workspace_settings_hold_while_it_writes(session):
    key = tables.BATCH_BYTES
    before = session.conf.get(key)

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    # rows large enough that the default would put all of them into one batch
    rows = session.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("text")).mapInArrow(largest, "size long")
    small = tables.Workspace(session, "test", 1 << 20).write(rows, "small").agg(F.max("size")).first()[0]
    assert small <= 3 << 20 and session.conf.get(key) == before
    assert jaccard_join.JaccardJoin(session.range(1).selectExpr("id doc_id", "'a b' text"), "doc_id", "text", 4, 85, 10).space.batch_bytes == jaccard_join.BATCH_BYTES


def test_components_meet_by_the_blocks_of_the_lighter(session):
    join = jaccard_join.JaccardJoin(session.range(1).selectExpr("id doc_id", "'a b' text"), "doc_id", "text", 4, 85, 10)
    rooted = session.createDataFrame([(1, 1, 50), (2, 1, 60), (3, 3, 7), (4, 4, 900), (5, 5, 7)], "cid long, root long, n long")
    met = session.createDataFrame([(1, 3), (1, 4), (3, 4), (3, 5)], "root_a long, root_b long")
    assert as_bag(map(tuple, join.lighter_first(met, rooted).collect())) == as_bag([(3, 1), (1, 4), (3, 4), (3, 5)])
    # one component that all others meet is dealt to several tasks
    hot = session.range(1, 1001).selectExpr("id root_a", "5000 root_b").union(session.createDataFrame([(1, 2)], "a long, b long"))
    blocks = session.range(1, 1001).selectExpr("id root", "1 blocks").union(session.createDataFrame([(5000, 3)], "a long, b long"))
    dealt, parts = join.parts_across(hot, blocks)
    assert as_bag(map(tuple, parts.collect())) == as_bag([(5000, -(-3000 // jaccard_join.PART_BLOCKS)), (2, 1)])
    assert dealt.count() == 1001 and dealt.join(parts, "root_b").where("part < 0 OR part >= parts").count() == 0
    assert dealt.where("root_b = 5000").groupBy("part").count().where("count > 200").count() == 0


def test_batches_of_the_near_copies_are_small():
    assert jaccard_join.BATCH_BYTES <= 1 << 20 and corpus_pipeline.BATCH_BYTES <= 1 << 20


def removed_of(rows, window):
    words = [WORD.findall(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for (doc, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        yield doc, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


@pytest.mark.parametrize(("name", "bucket"), [("documents", 20_000), ("documents", 20), ("odd", 20_000)])
def test_substring_dedup(name, bucket, request):
    frame = request.getfixturevalue(name)
    out = substring_dedup.substring_dedup(frame, bucket_contexts=bucket).collect()
    assert as_bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == as_bag(removed_of(texts_of(frame), 35))


@pytest.mark.parametrize("bucket", [20_000, 2])
def test_substring_dedup_of_long_windows(session, bucket):
    random = np.random.default_rng(11)
    shared = [f"w{i}" for i in random.integers(0, 1000, 400)]
    rows = [(i, " ".join([*map(str, random.integers(0, 10**6, 30 + i)), *shared[a:b], f"end{i}"])) for i, (a, b) in enumerate([(0, 400), (0, 150), (100, 330), (50, 140), (200, 289)])]
    out = substring_dedup.substring_dedup(session.createDataFrame(rows, "doc_id long, text string"), window=90, bucket_contexts=bucket).collect()
    assert as_bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == as_bag(removed_of(rows, 90))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_merge_replay(name, request):
    import tiktoken

    frame = request.getfixturevalue(name)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.read_ranks(merge_replay.RANKS), special_tokens={})
    want = as_bag((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in texts_of(frame))
    assert as_bag((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in merge_replay.bpe_encode(frame).collect()) == want


def test_part_table_keeps_all_parts_of_a_block(monkeypatch):
    monkeypatch.setattr(pretokens, "MOST_PARTS", 50)
    table = pretokens.PartTable(lambda parts: [np.frombuffer(p, dtype=np.uint8).astype(np.int32) for p in parts])
    for text in ["a b c", " ".join(f"x{i}" for i in range(200)) + " a b c", "a b c d", " ".join(f"y{i}" for i in range(48))]:
        (ids,) = table.column(pa.array([text]))
        assert bytes(ids.astype(np.uint8)) == text.encode()


def test_merge_replay_words():
    merges = merge_replay.merges_of(merge_replay.RANKS)
    words = [b"a" * 300, b"abababab", " thndhain".encode(), "éèééé".encode(), b"x"]
    assert [x.tolist() for x in merges.replay(words)] == [merges.encode_one(w) for w in words]


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_packing(name, request):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(name)
    out = packing.best_fit_pack(frame).toPandas()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = []
    for doc, text in texts_of(frame):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((-1 if doc is None else doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = out.fillna({"doc_id": -1})
    assert as_bag(got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False)) == as_bag(want)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 1024


def test_ids_with_added_tokens(tmp_path):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", "plain text here", f"{end}{end}", f"x{end}", f"{end} \n y", f"<|endof{end}text|>", "", None, "<|endoftext|", f"  {end}  z it's"]
    with open(packing.TOKENIZER, encoding="utf-8") as file:
        whole = json.load(file)
    token = whole["added_tokens"][0]
    files = {"plain": [token], "strip": [token | {"lstrip": True}], "two": [token, token | {"id": token["id"] + 1, "content": "it's", "special": False, "normalized": True}]}
    for name, added in files.items():
        path = str(tmp_path / f"{name}.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(whole | {"added_tokens": added}, file)
        tokenizer = Tokenizer.from_file(path)
        got = [ids.tolist() for ids in packing.token_table(path).column(pa.array(texts))]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts], name
    assert [ids.tolist() for ids in packing.part_table(packing.TOKENIZER).column(pa.array(texts[:1]))] == [[64, 220, 50256, 275]]


def test_pack_sizes_chooses_the_smallest_sum_of_squares():
    sizes = np.random.default_rng(1).integers(1, 17, 200)
    got, _ = packing.pack_sizes(sizes, 16)
    fill: list[int] = []
    squares = lambda f: sum(v * v for g, v in collections.Counter(16 - x for x in f).items() if g)
    for size, chosen in zip(sizes.tolist(), got.tolist(), strict=True):
        options = [squares([*fill[:i], fill[i] + size, *fill[i + 1 :]]) for i in range(len(fill)) if fill[i] + size <= 16] + [squares([*fill, size])]
        if chosen == len(fill):
            fill.append(0)
        fill[chosen] += size
        assert squares(fill) == min(options)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_of(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_pii(name, request):
    frame = request.getfixturevalue(name)
    out = pii.detect(frame, pii.train(frame)).collect()
    want = as_bag((i, hashlib.sha256(pii.listed(base_of(t)).encode()).hexdigest()) for i, t in texts_of(frame))
    assert as_bag((r.doc_id, r.base_sha256) for r in out) == want
    redacted = pii.redact(frame, None)
    assert redacted.columns == frame.columns and redacted.count() == frame.count()


def test_pii_random_texts():
    random = np.random.default_rng(5)
    parts = ["a", "@", "b.c", ".", "1", "12", "300", "+1", " ", "-", "(", "4111111111111111", "é", "\n", "00"]
    for _ in range(3000):
        text = "".join(random.choice(parts, random.integers(1, 30)))
        assert pii.base_spans(text) == base_of(text)


def test_skip_chain_adds_repetitions(documents):
    text = "call +1 (017) 555-7713 now. Later (017) 555-7713 again, in 2024 there were 17."
    base, all_ = pii.find(text, pii.train(documents))
    assert set(base) < set(all_)
    assert pii.redact_text(text, all_) == "call <phone> now. Later <phone> again, in 2024 there were 17."


def test_a_sure_label_reaches_all_repeats():
    node = np.full((41, 5), -30.0)
    node[0, 4] = 0.0
    node[1:] = np.log([0.5, 1e-9, 1e-9, 1e-9, 0.5])
    edges = np.array([(i, i + 1) for i in range(40) for _ in range(2)])
    p = pii.marginals(node, edges, np.full(len(edges), 2.0))
    assert (p[:, 4] >= pii.THRESHOLD).all()
    assert np.allclose(p.sum(axis=1), 1) and pii.marginals(node[:0], edges[:0], np.empty(0)).shape == (0, 5)


def test_samples_take_copies_once(session):
    texts = session.createDataFrame([("copy 1",)] * 500 + [(f"text {i}",) for i in range(100)], "text string")
    assert smallest_hashes(texts, "text", 1000).count() == 101
    drawn = [r.text for r in smallest_hashes(texts, "text", 30).collect()]
    assert len(drawn) == len(set(drawn)) == 30
    assert smallest_hashes(texts.where("false"), "text", 5) is None


def test_language_id(documents, odd):
    model = language_id.train(documents)
    out = language_id.predict(documents.withColumn("h", language_id.held_out("doc_id")), model).where("h and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    clash = language_id.predict(odd.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")), model)
    assert [(r["doc_id"], r["lang_pred_"]) for r in clash.where("doc_id in (1, 2, 12, 13)").collect()] == [(1, "und"), (2, "und"), (12, "und"), (13, "und")]


def test_language_id_learns_every_label(session):
    random = np.random.default_rng(3)
    words = {f"l{k:02d}": ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(80)}
    rows = [(100 * k + i, " ".join(random.choice(own, 10)), lang) for k, (lang, own) in enumerate(words.items()) for i in range(24 if k < 64 else 12)]
    docs = session.createDataFrame(rows, "doc_id long, text string, lang string")
    for dense in (64, 100):
        language_id.DENSE_LANGUAGES, before = dense, language_id.DENSE_LANGUAGES
        try:
            model = language_id.train(docs)
        finally:
            language_id.DENSE_LANGUAGES = before
        assert model.languages == sorted(words) and (model.weights is None) == (dense == 64)
        out = language_id.predict(docs.where(language_id.held_out("doc_id")), model).collect()
        rare = [r.lang == r.lang_pred for r in out if r.lang >= "l64"]
        assert len(rare) > 20 and np.mean(rare) > 0.95 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_html_extract(session):
    pages = session.read.parquet(f"{SMALL}/pages.parquet")
    model = html_extract.train(pages)
    page = (
        '<body><div class="sidebar"><ul><li><a href=1>One</a></ul></div><div class="post-content"><h1>A title</h1><p>First &amp; long paragraph of the '
        "article.<p>Second  paragraph, <b>bold, and it\nends here.</div><div class=comments><p>I liked it very much, thank you.</p></div><script>x</script>")
    rows = [(1, "u", None, 3), (2, "u", "", 3), (3, None, page, 3), (3, None, page, 3), (4, "u", "<p", 3), (5, "u", "<" * 2000, 3), (6, "u", "<div>" * 3000 + "x", 3)]
    out = html_extract.extract(session.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == 7 and got[1] == got[2] == ""
    assert got[3] == "A title\nFirst & long paragraph of the article.\nSecond paragraph, bold, and it ends here."
    for r in html_extract.extract(pages, model).join(pages, "page_id").collect():
        article = re.sub("<br>", " ", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        lines = [re.sub(r"\s+", " ", html_extract.html_module.unescape(re.sub(r"<[^>]*(>|$)", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in lines if x)


OPEN_ELEMENTS = [
    "<datalist><option value=a><option value=b></datalist>", "<datalist><option value=a>", "<select><option>One<option>Two</select>", "<select><option>One",
    "<label>", "<label for=x>Name", "<button type=button>", "<svg width=1 height=1><path d='M0 0'>", "<svg/>", "<script src=x/></script>", "<script src=x/>",
    "<script>var a = 1;</script>", "<script src=x/>var a = 1;</script>", "<style>", "<canvas>", "<audio controls>", "<video src=v>", "<object data=o>", "<template>",
    "<noscript>", "<iframe src=i>", "<title>", "<textarea>", "<math>", "<legend>", "<button>Press</button>", "<label>Tick</label>",
]


@pytest.mark.parametrize("element", OPEN_ELEMENTS)
def test_html_keeps_what_follows_an_open_element(element):
    model = html_extract.Boosted()
    model.start = 1.0  # every node stays
    page = f"<html><body><article><h1>Head</h1><p>Before it.</p>{element}<p>After it.</p><div><p>And at the end.</p></div></article></body></html>"
    lines = html_extract.extract_page(page, model).split("\n")
    for line in ("Head", "Before it.", "After it.", "And at the end."):
        assert sum(line in x for x in lines) == 1
    assert "var a" not in " ".join(lines) and "M0" not in " ".join(lines) and "Press" not in " ".join(lines)


def test_html_formula_and_hostile_pages():
    model = html_extract.Boosted()
    model.start = 1.0
    assert html_extract.extract_page("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p></article>", model) == "Let x=1 hold."
    many = "<article>" + "<label>a" * 20_000 + "<p>After.</p></label></article>"
    assert html_extract.extract_page(many, model).endswith("After.")


def test_html_without_content_elements(session):
    """Pages whose article elements are plain divs: nearly all of the article is found, and little else."""
    pages = session.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.train(pages)
    found = wanted = extra = 0
    for r in pages.collect():
        plain = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", r.html)
        want = collections.Counter(html_extract.extract_page(r.html, model).split())
        got = collections.Counter(html_extract.extract_page(plain, model).split())
        found, wanted, extra = found + sum((want & got).values()), wanted + sum(want.values()), extra + sum((got - want).values())
    assert found >= 0.97 * wanted and extra <= 0.03 * wanted


def test_license_scan(session):
    template = license_scan.TEMPLATES["bsd-redistribution"]
    rows = [(1, "x " * 100 + template.upper() + " y" * 50), (2, template.replace("binary", "object")), (3, "Released under the MIT\nLicense."), (3, "Released under the MIT\nLicense."),
            (4, None), (5, ""), (6, "the software license"), (7, "a license " * 5000), (None, "Licensed under CC BY-NC 4.0."), (8, template[:60])]
    out = {(r.doc_id, r.license): (r.containment, r.first_word) for r in license_scan.license_scan(session.createDataFrame(rows, "doc_id long, text string")).collect()}

    def shingles(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for doc, text in rows:
        own = shingles(text or "")
        for name, t in license_scan.TEMPLATES.items():
            share = len(set(own) & set(shingles(t))) / len(set(shingles(t)))
            if share >= 0.8:
                want[doc, name] = (share, min(own.index(s) for s in set(own) & set(shingles(t))))
    assert out == want and (1, "bsd-redistribution") in out


def test_license_scan_short_templates_and_families(session):
    gpl = "you can redistribute it under the terms of the GNU General Public License as published"
    rows = [(1, "x " * 300 + "All  Rights\nReserved." + " y" * 9), (2, "all rights reserved"), (3, "all rights are reserved"), (4, "reserved all rights"),
            (5, gpl.replace("General", "Affero General")), (6, gpl), (7, "a " + license_scan.TEMPLATES["mit-text"].lower()), (8, "Licensed under the BSD 3-Clause License"),
            (9, "This work is licensed under the GNU Lesser General Public License, version 3"), (None, "All rights reserved"), (10, "the end")]
    docs = session.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.license): (r.containment, r.first_word) for r in license_scan.license_scan(docs).collect()}
    assert {k: v for k, v in out.items() if k[1] == "all-rights-reserved"} == {(1, "all-rights-reserved"): (1.0, 300), (2, "all-rights-reserved"): (1.0, 0), (None, "all-rights-reserved"): (1.0, 0)}
    assert {k for k in out if k[1] != "all-rights-reserved"} == {(5, "agpl-header"), (7, "mit-text"), (7, "mit-permission"), (8, "bsd-3-clause-notice"), (9, "lgpl-notice")}
    own = {(r.doc_id, r.license) for r in license_scan.license_scan(docs, templates={"end": "the end", "one": "Reserved"}).collect()}
    assert own == {(10, "end"), (1, "one"), (2, "one"), (3, "one"), (4, "one"), (None, "one")}
    with pytest.raises(ValueError):
        license_scan.license_scan(docs, templates={"none": "..."})


def test_top_k(session):
    vectors = [r.asDict() for r in session.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    rows = [(r["vec_id"], r["embedding"], 1) for r in vectors] + [(1000, None, 1), (1001, [None], 1), (1002, [float("nan")], 1), (1100, [float("inf")], 1), (1200, [], 1), (None, [1.0], 1)]
    frame = session.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = topk_search.top_k(frame, candidate_block=97, query_block=2, seeds=40).collect()
    good = [(i, np.floor(np.array(v, dtype=np.float32).astype(np.float64) * 1024).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 100 == 0:
            scores = sorted((-int(a[: len(b)] @ b[: len(a)]), i) for i, b in good if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert as_bag((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == as_bag(want)


def test_empty_tables(session):
    docs = session.createDataFrame([], "doc_id long, text string, lang string")
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert jaccard_join.jaccard_join(docs).count() == 0
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert merge_replay.bpe_encode(docs).count() == 0
    assert packing.best_fit_pack(docs).count() == 0
    assert pii.detect(docs, pii.train(docs)).count() == 0
    assert language_id.predict(docs, language_id.train(docs)).count() == 0
    assert license_scan.license_scan(docs).count() == 0
    pages = session.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages, html_extract.train(pages)).count() == 0
    assert topk_search.top_k(session.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
