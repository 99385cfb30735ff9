"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.llm import (
    conversation_trie,
    exact_dedup,
    html_extract,
    jaccard_join,
    language_id,
    license_scan,
    merge_replay,
    packing,
    pii,
    substring_dedup,
    token_files,
    topk_search,
    vector_codes,
)
from grainsieve.llm.tables import share_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.predict(docs.select("doc_id", "text", language_id.held_out("doc_id").alias("held_out")), model).drop("text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.bpe_encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_token_files(_table(spark, sf_dir, "documents")).documents()


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_topk_search, op2_pii, op3_html_extract, op4_language_id, op5_jaccard_join, op6_license_scan,
              op7_byte_bpe, op8_exact_dedup, op9_packing, op10_substring_dedup, op11_token_files, op12_conversation_trie, op13_vector_codes)
}

#: A round of fitting in SQL: the best entry of each part (its distance and number in one), and the next codebook.
_ASSIGN = """a{k} AS (
  SELECT rn, part, min(CAST(list_sum(list_transform(list_zip(x.p, b.c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) * 256 + b.entry) AS best
  FROM x JOIN b{k} b USING (part) GROUP BY rn, part
)"""
_REPLACE = """b{n} AS (
  SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY i) AS c FROM (
      SELECT part, entry, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v
      FROM (SELECT part, best % 256 AS entry, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM a{k} JOIN x USING (rn, part))
      GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry)
)"""
_ROUNDS = ",\n".join(step for k in range(4) for step in (_ASSIGN.format(k=k), _REPLACE.format(k=k, n=k + 1)))

ORACLES = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM g
), p AS (
  SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS k FROM c WHERE n > 1) GROUP BY doc_id
), e AS (
  SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN p USING (doc_id)
), f AS (
  SELECT doc_id, list(x ORDER BY k) AS kept FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM e)
    ANTI JOIN (SELECT doc_id, unnest(gone) AS k FROM p) USING (doc_id, k) GROUP BY doc_id
)
SELECT e.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM e LEFT JOIN f USING (doc_id)""",
    "op12_conversation_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_transform(string_split_regex(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT)),
      lambda s, d: list_reduce([xor(s, d), 0, 1, 2, 3, 4, 5, 6, 7], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END),
      4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), parts AS (
  SELECT c.conv_id, 0 AS own, place, r, x FROM c JOIN t ON t.conv_id = c.base WHERE place <= h
  UNION ALL
  SELECT c.conv_id, 1, place, r, x FROM c JOIN t ON t.conv_id = c.conv_id WHERE place > h
), s AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY own, place) AS turns FROM parts GROUP BY conv_id
), m AS (
  SELECT conv_id, turns[1:d] AS seq, d AS depth, d = len(turns) AS ends
  FROM (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN s USING (conv_id)), unnest(generate_series(0, len(turns))) AS g(d)
), n AS (
  SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY seq, depth
), k AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(length(seq[depth].x), 0) AS chars
  FROM n LEFT JOIN (SELECT seq AS above, conv_id FROM n) p ON n.depth > 0 AND p.above = n.seq[1:n.depth - 1]
), w AS (
  SELECT k.*, (SELECT count(*) FROM n ch WHERE ch.depth = k.depth + 1 AND ch.seq[1:k.depth] = k.seq) AS n_children FROM k
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, w.parent_conv_id, w.n_convs, w.n_children,
  CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves,
  CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN w b ON b.depth >= w.depth AND b.seq[1:w.depth] = w.seq
GROUP BY w.seq, w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, w.ends_sha256""",
    "op13_vector_codes": f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rn,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), x AS (
  SELECT rn, part, e[len(e) // 4 * part + 1 : len(e) // 4 * (part + 1)] AS p FROM v, unnest([0, 1, 2, 3]) AS g(part)
), b0 AS (
  SELECT part, rn - 1 AS entry, p AS c FROM x WHERE rn <= 256
),
{_ROUNDS},
{_ASSIGN.format(k=4)}, d AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM b4
), f AS (
  SELECT rn, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY rn
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM v JOIN f USING (rn), d""",
}
