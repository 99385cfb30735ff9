"""Exact top-k inner-product search with a pivot table.

Distances of every vector to some pivots are computed once.  By the triangle inequality the largest
difference of two vectors' distances to a pivot is a lower bound of their distance, and with the norms
an upper bound of their inner product.  A block of candidates is evaluated in the order of these bounds
until the next bound falls below the k-th score found, so no candidate that could enter is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.llm.tables import Workspace, field

K = 10
PIVOTS = 32
#: Vectors of a candidate block and of a query block, and vectors from which the first k-th score is taken.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 128
SEED_VECTORS = 512
SCALE = 1024


def quantized(vector: Column) -> Column:
    """floor(1024 x) of every component, as integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(rows: list[bytes]) -> np.ndarray:
    """Integer vectors as rows; shorter ones are padded by zeros, which changes no inner product."""
    found = [np.frombuffer(r, dtype=np.int64) for r in rows]
    out = np.zeros((len(found), max(map(len, found), default=0)), dtype=np.int64)
    for row, values in zip(out, found, strict=True):
        row[: len(values)] = values
    return out


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows, in floating point where that is exact."""
    a, b = _common(a, b)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, pivots = (x.astype(np.float64) for x in _common(a, pivots))
    squares = (a**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * a @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def search_block(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray,
                 pivots: np.ndarray, floors: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[int, int, int]]:
    """(query row, candidate row, score) of each query's best in the block, at most k and no worse than its floor.

    Candidates are in ascending id order; ties go to the smaller id.
    """
    query_table, table = distances(queries, pivots), distances(candidates, pivots)
    squares, query_squares = ((x.astype(np.float64) ** 2).sum(1) for x in (candidates, queries))
    slack = 1e-6 * (squares.max(initial=0) + query_squares.max(initial=0)) + 1
    for q in range(len(queries)):
        nearest = np.abs(table - query_table[q]).max(axis=1)
        bounds = (squares + query_squares[q] - nearest**2) / 2 + slack
        order = np.argsort(-bounds, kind="stable")
        order = order[ids[order] != query_ids[q]]
        rows, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        least = float(floors[q])
        for at in range(0, len(order), step):
            part = order[at : at + step]
            part = part[bounds[part] >= least]
            if not len(part):
                break
            rows = np.concatenate([rows, part])
            scores = np.concatenate([scores, inner_products(queries[q : q + 1], candidates[part])[0]])
            best = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) == k:
                least = max(least, float(scores[-1]))
        for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
            if score >= floors[q]:
                yield q, row, score


def _blocks(vectors: DataFrame, size: int, count: int, name: str) -> DataFrame:
    """Vectors packed into rows: ``name, ids, vectors``, dealt by a hash into blocks of about ``size``."""
    number = max(1, -(-count // size))

    def pack(part: pa.Table) -> pa.Table:
        order = np.argsort(part["vec_id"].to_numpy(), kind="stable")
        ids = part["vec_id"].to_numpy()[order].astype(np.int64)
        matrix = _matrix([part["vector"][int(i)].as_py() for i in order])
        return pa.table({name: pa.array([part["block"][0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()),
                         "width": pa.array([matrix.shape[1]], pa.int32()), "vectors": pa.array([matrix.tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(number)).alias("block")
    return vectors.select("vec_id", "vector", block).groupBy("block").applyInArrow(pack, f"{name} bigint, ids binary, width int, vectors binary")


def top_k(vectors: DataFrame, queries: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          pivots: int = PIVOTS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK, seeds: int = SEED_VECTORS) -> DataFrame:
    """The k best-scoring other vectors of each query: ``query_id, rank, vec_id, score``.

    ``queries`` is a condition on the id column (default: divisible by 100).  Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without an id.  An id stands for one
    query and one set of candidates: rows that repeat an id are no candidates of their own id, rows that
    repeat an id and a vector count once, and a query id with several vectors is asked with each of
    them.  Fewer than k others give all of them.  Vectors of different lengths meet in their common
    part; an empty vector scores 0.  Sums beyond 64 bits are not supported.

    Candidates lie in blocks, queries in smaller ones; each query block is sent to each candidate block
    by an equality join on the block's number, and a task holds one pair of blocks at a time.
    """
    space = Workspace(vectors.sparkSession, "top-k")
    vector = field(vector_col)
    asked = field(id_col) % 100 == 0 if queries is None else queries
    kept = vectors.where(usable(vector) & field(id_col).isNotNull()).select(
        field(id_col).cast("long").alias("vec_id"), quantized(vector).alias("values"), asked.alias("asked")).distinct()

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.int64).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), batch.column(2)], ["vec_id", "vector", "asked"])

    table = space.write(kept.mapInArrow(to_bytes, "vec_id bigint, vector binary, asked boolean"), "vectors")
    count, query_count = table.count(), table.where("asked").count()
    drawn = table.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(seeds).collect()  # a bounded sample
    seed_ids, seed_matrix = np.array([r["vec_id"] for r in drawn], dtype=np.int64), _matrix([bytes(r["vector"]) for r in drawn])
    blocks = max(1, -(-count // candidate_block))
    candidates = space.write(_blocks(table, candidate_block, count, "block"), "candidates")
    asked_blocks = space.write(_blocks(table.where("asked"), query_block, query_count, "query_block"), "queries")
    sent = asked_blocks.select("query_block", F.col("ids").alias("query_ids"), F.col("width").alias("query_width"), F.col("vectors").alias("query_vectors"),
                               F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, width, raw, query_ids, query_width, query_raw = (batch.column(i)[row].as_py() for i in range(6))
                ids, query_ids = np.frombuffer(ids, dtype=np.int64), np.frombuffer(query_ids, dtype=np.int64)
                own, asking = np.frombuffer(raw, dtype=np.int64).reshape(len(ids), width), np.frombuffer(query_raw, dtype=np.int64).reshape(len(query_ids), query_width)
                own, asking = _common(own, asking)
                first = inner_products(asking, seed_matrix)
                # the k-th score among distinct other ids is a floor of the true one
                floors = np.full(len(asking), -np.inf)
                one_each = np.unique(seed_ids, return_index=True)[1]
                for q in range(len(asking)):
                    others = first[q, one_each[seed_ids[one_each] != query_ids[q]]]
                    if len(others) >= k:
                        floors[q] = np.partition(others, -k)[-k]
                found = list(search_block(asking, query_ids, own, ids, seed_matrix[:pivots], floors, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(query_ids[q]) for q, _, _ in found], pa.int64()), pa.array([query_raw[8 * query_width * q : 8 * query_width * (q + 1)] for q, _, _ in found], pa.binary()),
                     pa.array([int(ids[c]) for _, c, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())],
                    ["query_id", "query_vector", "vec_id", "score"])

    found = sent.join(candidates, "block").select("ids", "width", "vectors", "query_ids", "query_width", "query_vectors").mapInArrow(
        run, "query_id bigint, query_vector binary, vec_id bigint, score bigint")
    place = Window.partitionBy("query_id", "query_vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
