"""Product codes of vectors, assigned by slicing sorted coordinates and intersecting bit masks.

Vectors are cut into equal parts, and each part position has a codebook.  For every dimension of a codebook the
entries are sorted by their coordinate, and mask j holds the first j of them as bits.  The entries whose coordinate
lies in a range are the difference of two such masks, so those in a box around a vector are the AND of one
difference for each dimension.  A box of the best distance found so far holds every entry that is as near or nearer,
so only its entries need exact distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from grainsieve.llm.tables import Workspace, field
from grainsieve.llm.topk_search import SCALE, usable

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors searched at a time, and how many pairs of a vector and an entry get their distances at a time.
SEARCH_ROWS = 4096
SEARCH_PAIRS = 1 << 18


def roots(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


class Slices:
    """One codebook: sorted coordinates and prefix masks of each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        bits = np.zeros((width, count + 1, -(-max(count, 1) // 64) * 64), dtype=bool)
        for d in range(width):
            for j, entry in enumerate(order[:, d].tolist()):
                bits[d, j + 1] = bits[d, j]
                bits[d, j + 1, entry] = True
        self.masks = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.all = np.packbits(np.arange(bits.shape[2]) < count, bitorder="little").view(np.uint64)
        self.radius = self._first_radius()

    def _first_radius(self) -> int:
        """Half the median distance of an entry to the nearest other one."""
        some = self.entries[:: -(-len(self.entries) // 64) or 1]
        if len(self.entries) < 2:
            return 1
        squares = ((some[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2)
        return max(1, int(roots(np.sort(squares, axis=1)[:, 1:2]).mean()) // 2)

    def box(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ by no more than ``radius`` in any dimension."""
        found = np.tile(self.all, (len(rows), 1))
        for d, held in enumerate(self.sorted):
            first = np.searchsorted(held, rows[:, d] - radius, side="left")
            end = np.searchsorted(held, rows[:, d] + radius, side="right")
            found &= self.masks[d, end] ^ self.masks[d, first]
        return found

    def _settle(self, rows: np.ndarray, masks: np.ndarray, best: np.ndarray, squares: np.ndarray) -> int:
        """Take the masks' entries into account, by exact distances; returns how many there were."""
        at, entry = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little"))
        for a in range(0, len(at), SEARCH_PAIRS):
            r, e = at[a : a + SEARCH_PAIRS], entry[a : a + SEARCH_PAIRS]
            apart = rows[r] - self.entries[e]
            own = np.einsum("ij,ij->i", apart, apart)
            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            least = np.minimum.reduceat(own, starts)
            tied = np.where(own == np.repeat(least, np.diff(np.append(starts, len(r)))), e, len(self.entries))
            which, where = np.minimum.reduceat(tied, starts), r[starts]
            better = (least < squares[where]) | ((least == squares[where]) & (which < best[where]))
            best[where[better]], squares[where[better]] = which[better], least[better]
        return len(at)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row, the first of equal ones, its squared distance, and the distances computed in all."""
        best = np.full(len(rows), len(self.entries), dtype=np.int64)
        squares = np.full(len(rows), np.iinfo(np.int64).max)
        radius = np.full(len(rows), self.radius, dtype=np.int64)
        seen = np.zeros((len(rows), self.masks.shape[2]), dtype=np.uint64)
        open_, computed = np.arange(len(rows)), 0
        while len(open_):
            found = self.box(rows[open_], radius[open_])
            new = found & ~seen[open_]
            seen[open_] = found
            own_best, own_squares = best[open_], squares[open_]
            computed += self._settle(rows[open_], new, own_best, own_squares)
            best[open_], squares[open_] = own_best, own_squares
            hit = own_best < len(self.entries)
            # a box with the best distance as its radius misses no entry that is as near; an empty one grows
            needed = np.where(hit, roots(np.where(hit, own_squares, 0)), 2 * radius[open_])
            more = needed > radius[open_]
            open_ = open_[more]
            radius[open_] = needed[more]
        return best, squares, computed


@dataclass
class Codebooks:
    """For each part position the entries, as integer vectors."""

    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return sum(book.shape[1] for book in self.books)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def integer_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, and floor(1024 x) of their components, padded by zeros."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    good = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row_of[~np.isfinite(flat)]] = False
    out = np.zeros((len(lengths), width), dtype=np.int64)
    held = good[row_of]
    out[row_of[held], (np.arange(len(flat)) - starts[row_of])[held]] = np.floor(flat[held] * SCALE).astype(np.int64)
    rows = np.flatnonzero(good)
    return rows, out[rows]


def _slices(books: list[np.ndarray]) -> list[Slices]:
    return [Slices(book) for book in books]


def assign(rows: np.ndarray, slices: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers (rows x parts) and squared distances summed over the parts."""
    codes, error = np.zeros((len(rows), len(slices)), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for first in range(0, len(rows), SEARCH_ROWS):
        some, column = rows[first : first + SEARCH_ROWS], 0
        for k, own in enumerate(slices):
            size = own.entries.shape[1]
            best, squares, _ = own.nearest(np.ascontiguousarray(some[:, column : column + size]))
            codes[first : first + len(some), k] = best
            error[first : first + len(some)] += squares
            column += size
    return codes, error


def _partial_sums(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """One row for each task: counts and component sums of all entries, as bytes."""
    width = sum(book.shape[1] for book in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _slices(books)
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros_like(b) for b in books]
        for batch in batches:
            _, rows = integer_rows(batch.column(0), width)
            codes, column = assign(rows, slices)[0], 0
            for k, book in enumerate(books):
                counts[k] += np.bincount(codes[:, k], minlength=len(book))
                np.add.at(sums[k], codes[:, k], rows[:, column : column + book.shape[1]])
                column += book.shape[1]
        flat = np.concatenate([x.ravel() for pair in zip(counts, sums, strict=True) for x in pair])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["task", "sums"])

    return vectors.mapInArrow(run, "task bigint, sums binary")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, task = None, 0
    for batch in batches:
        for row in range(batch.num_rows):
            own = np.frombuffer(batch.column(1)[row].as_py(), dtype=np.int64)
            total = own.copy() if total is None else total + own
            task = batch.column(0)[row].as_py()
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"])


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> Codebooks:
    """Fit the codebooks on all usable vectors.

    Each starts as the parts of the vectors with the smallest ids, ascending, those without an id last; rows that
    repeat an id stand by their vectors.  A round assigns every part to its nearest entry, the first of equal ones, and
    replaces each entry by the floor of its parts' mean; an entry without parts stays.  Vectors that are null or hold a
    null or non-finite component take no part; shorter ones are padded by zeros to the longest, whose length is rounded
    up to a multiple of ``parts``.  Without usable vectors the codebooks are empty.  Sums beyond 64 bits are not supported.

    A round is one pass over the vectors.  Each task sends one row, its sums by entry, and these are added up in two
    steps, so what meets in one place is bounded by the codebooks' size and the root of the number of tasks.
    """
    vector = field(vector_col)
    kept = vectors.where(usable(vector))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = kept.select(field(id_col).alias("id"), vector.alias("v")).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()  # bounded
    start = integer_rows(pa.array([r["v"] for r in first], pa.list_(pa.float64())), width)[1]
    size = width // parts
    books = [np.ascontiguousarray(start[:, k * size : (k + 1) * size]) for k in range(parts)]
    only = vectors.select(vector.alias("v"))
    steps = isqrt(max(1, only.rdd.getNumPartitions()))
    for _ in range(rounds if len(start) else 0):
        some = _partial_sums(only, books).repartition(steps, "task").mapInArrow(_added, "task bigint, sums binary")
        total = np.frombuffer(some.coalesce(1).mapInArrow(_added, "task bigint, sums binary").first()["sums"], dtype=np.int64)
        for k, book in enumerate(books):
            counts, total = total[: len(book)], total[len(book) :]
            sums, total = total[: book.size].reshape(book.shape), total[book.size :]
            books[k] = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book)
    return Codebooks(books)


def encode(vectors: DataFrame, codebooks: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """Add ``code`` (entry numbers in hexadecimal, in the order of the parts) and ``error`` (squared distances summed).

    All columns but the vector stay.  Vectors that are null or hold a null or non-finite component give no row; those
    longer than the codebooks are an error.
    """
    books, width = codebooks.books, codebooks.width
    columns = [c for c in vectors.columns if c != vector_col]
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _slices(books)
        for batch in batches:
            rows, values = integer_rows(batch.column(0), width)
            codes, error = assign(values, slices)
            text = ["".join(f"{x:0{digits}x}" for x in own) for own in codes.tolist()]
            kept = [batch.column(i + 1).take(pa.array(rows)) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array(error, pa.int64())], names)

    # columns go by position, so that their names may be any
    taken = vectors.select(field(vector_col), *[field(c) for c in columns])
    names = [f"c{i}" for i in range(len(columns) + 2)]
    plain = StructType([StructField(n, f.dataType) for n, f in zip(names, taken.schema.fields[1:], strict=False)])
    plain = plain.add(names[-2], StringType()).add(names[-1], LongType())
    return taken.toDF("v", *names[:-2]).mapInArrow(run, plain).toDF(*columns, "code", "error")


def decode(codes: DataFrame, codebooks: Codebooks, code_col: str = "code") -> DataFrame:
    """Add ``approximation``, the entries that a code names, as components of the original scale; a null code gives null."""
    books = codebooks.books
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    @F.arrow_udf("array<double>")
    def entries(text: pa.Array) -> pa.Array:
        out = []
        for code in text.to_pylist():
            places = None if code is None else [int(code[i : i + digits], 16) for i in range(0, digits * len(books), digits)]
            out.append(None if places is None else np.concatenate([b[p] for b, p in zip(books, places, strict=True)]) / SCALE)
        return pa.array(out, pa.list_(pa.float64()))

    return codes.withColumn("approximation", entries(field(code_col)))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all usable vectors by codebooks fitted on them: ``vec_id, code, error, label_error, codebooks_sha256``.

    ``label_error`` is the error summed over the rows of equal label, nulls together.  See ``train`` for unusable,
    repeated and uneven vectors; an empty table gives no rows, and other columns play no part.
    """
    space = Workspace(vectors.sparkSession, "vector-codes")
    codebooks = train(vectors, id_col, vector_col, parts, entries, rounds)
    rows = vectors.select(field(id_col).alias("vec_id"), field(label_col).alias("label"), field(vector_col).alias("vector"))
    coded = space.write(encode(rows, codebooks, "vector"), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256"))
