"""Files of token ids in directly addressable codes.

Ids are split into chunks, lowest bits first.  The first level holds the lowest chunk of every id, the next level the
next chunk of the ids that have one, and so on; each level but the last has a bitmap that says which ids go on, and a
directory of its ranks.  The rank of a set bit is the id's place in the next level, so any id is read by one chunk and one
bit of each level that it reaches, and no block is decoded.

A file (a shard) holds, in little-endian order: the magic bytes; eight unsigned 64-bit numbers (ids, documents,
levels, length of the document ids' stream, and four zeros); for each level four of them (bits of a chunk, chunks, place
of the chunks, place of the bitmap and directory behind them); where each document starts, from 0, and the end; the
document ids as an Arrow stream; then the levels.  Chunks are packed bit by bit from the lowest bit on.
"""

from __future__ import annotations

import io
import mmap
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainsieve.llm.packing import TOKENIZER, part_table
from grainsieve.llm.pretokens import release_memory
from grainsieve.llm.tables import Workspace, field, text_or_empty
from grainsieve.session import checkpoint_dir

MAGIC = b"CHUNKED1"
END_ID = 0
#: Ids after which a shard is closed (a document is never cut), and bits of a bitmap for each entry of its directory.
SHARD_IDS = 8 << 20
RANK_BITS = 512
#: Ids that are packed or unpacked at a time; a multiple of 8, so that packed runs end at a byte.
RUN_IDS = 1 << 18
#: Bytes of text that are taken for an id when the number of ranges is chosen; a range may hold more than a shard.
BYTES_PER_ID = 2
WORD = 32


def chunk_widths(ids_by_bits: np.ndarray) -> list[int]:
    """The chunk widths with the smallest total size, given how many ids need each number of bits (1 to 32).

    A level costs its width and one bit of the bitmap for every id that reaches it; the last has no bitmap.
    """
    longest = max(1, int(np.flatnonzero(ids_by_bits).max(initial=1)))
    reach = [int(ids_by_bits[bits + 1 :].sum()) for bits in range(longest)]  # ids longer than so many bits
    best: list[tuple[int, list[int]]] = [(0, [])] * (longest + 1)
    for start in range(longest - 1, -1, -1):
        ids = reach[start] if start else int(ids_by_bits.sum())
        best[start] = min((ids * (width + (start + width < longest)) + best[start + width][0], [width, *best[start + width][1]])
                          for width in range(1, longest - start + 1))
    return best[0][1]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits one behind the other, lowest bit first."""
    out = []
    shifts = np.arange(width, dtype=np.uint32)
    for a in range(0, len(values), RUN_IDS):
        bits = (values[a : a + RUN_IDS, None] >> shifts).astype(np.uint8) & 1
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many ids need each number of bits; 0 needs one."""
    out = np.zeros(WORD + 1, dtype=np.int64)
    for a in range(0, len(ids), RUN_IDS):
        out += np.bincount(np.frexp(ids[a : a + RUN_IDS].astype(np.float64))[1].clip(1), minlength=WORD + 1)
    return out


def _level(ids: np.ndarray, width: int, last: bool) -> tuple[bytes, bytes, np.ndarray]:
    """One level's chunks, its bitmap with the directory of ranks behind it, and what is left of the ids that go on."""
    chunks, flags, left = [], [], []
    for a in range(0, len(ids), RUN_IDS):
        part = ids[a : a + RUN_IDS]
        chunks.append(pack_bits(part & np.uint32((1 << width) - 1), width))
        if not last:
            part = part >> np.uint32(width)
            flags.append(part > 0)
            left.append(part[flags[-1]])
    if last or not flags:
        return b"".join(chunks), b"" if last else np.zeros(1, dtype="<u8").tobytes(), ids[:0]
    on = np.concatenate(flags)
    sums = np.concatenate([[0], np.cumsum(np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.int64))])
    # the bitmap fills whole directory entries, so that counting within one never leaves it
    bitmap = np.packbits(on, bitorder="little").tobytes().ljust((len(sums) - 1) * (RANK_BITS // 8), b"\0")
    return b"".join(chunks), bitmap + sums.astype("<u8").tobytes(), np.concatenate(left)


def shard_bytes(ids: np.ndarray, starts: np.ndarray, doc_ids: pa.Array) -> bytes:
    """One shard's file: ids as unsigned 32-bit numbers, where each document starts (and the end), and the documents' ids."""
    stream = io.BytesIO()
    names = pa.table({"doc_id": doc_ids})
    with pa.ipc.new_stream(stream, names.schema) as sink:
        sink.write_table(names)
    widths = chunk_widths(bit_lengths(ids))
    levels, rest = [], ids
    for k, width in enumerate(widths):
        count = len(rest)
        chunks, behind, rest = _level(rest, width, k + 1 == len(widths))
        levels.append((width, count, chunks, behind))
    place = len(MAGIC) + 8 * 8 + 32 * len(levels) + 8 * len(starts) + stream.tell()
    head = [len(ids), len(starts) - 1, len(levels), stream.tell(), 0, 0, 0, 0]
    for width, count, chunks, behind in levels:
        head += [width, count, place, place + len(chunks)]
        place += len(chunks) + len(behind)
    parts = [MAGIC, np.array(head, dtype="<u8").tobytes(), np.asarray(starts, dtype="<u8").tobytes(), stream.getvalue()]
    return b"".join(parts + [x for level in levels for x in level[2:]])


class Shard:
    """A shard's file, read where it is addressed; ``data`` is a memory map or any buffer."""

    def __init__(self, data):
        self.data = np.frombuffer(data, dtype=np.uint8)
        if self.data[: len(MAGIC)].tobytes() != MAGIC:
            raise ValueError("not a file of token ids")
        numbers = lambda place, n: self.data[place : place + 8 * n].view("<u8").astype(np.int64)
        at = len(MAGIC)
        self.ids, self.documents, levels, names, *_ = numbers(at, 8).tolist()
        self.levels = numbers(at + 64, 4 * levels).reshape(levels, 4).tolist()
        at += 64 + 32 * levels
        self.starts = numbers(at, self.documents + 1)
        at += 8 * (self.documents + 1)
        with pa.ipc.open_stream(self.data[at : at + names].tobytes()) as source:
            self.doc_ids = source.read_all()["doc_id"].combine_chunks()
        self.directories = [numbers(behind + -(-count // RANK_BITS) * (RANK_BITS // 8), -(-count // RANK_BITS) + 1) if k + 1 < levels else None
                            for k, (_, count, _, behind) in enumerate(self.levels)]

    def _chunks(self, level: int, at: np.ndarray) -> np.ndarray:
        """The chunks at some places of a level: up to five bytes each."""
        width, _, place, _ = self.levels[level]
        first = at * width
        out, base, shift = np.zeros(len(at), dtype=np.uint64), place + (first >> 3), (first & 7).astype(np.uint64)
        for byte in range((width + 14) // 8):
            out |= self.data[np.minimum(base + byte, len(self.data) - 1)].astype(np.uint64) << np.uint64(8 * byte)
        return (out >> shift) & np.uint64((1 << width) - 1)

    def _on(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.data[self.levels[level][3] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: one entry of the directory and the words of its block before the place."""
        behind, block = self.levels[level][3], at // RANK_BITS
        out = self.directories[level][block].copy()
        inside = at % RANK_BITS
        for word in range(RANK_BITS // 64):
            held = np.clip(inside - 64 * word, 0, 64)
            some = np.flatnonzero(held)
            if not len(some):
                break
            place = behind + block[some] * (RANK_BITS // 8) + 8 * word
            value = np.zeros(len(some), dtype=np.uint64)
            for byte in range(8):
                value |= self.data[place + byte].astype(np.uint64) << np.uint64(8 * byte)
            mask = np.where(held[some] == 64, np.uint64(2**64 - 1), (np.uint64(1) << (held[some] % 64).astype(np.uint64)) - np.uint64(1))
            out[some] += np.bitwise_count(value & mask).astype(np.int64)
        return out

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        at, who = np.asarray(places, dtype=np.int64), np.arange(len(places))
        if len(at) and (at.min() < 0 or at.max() >= self.ids):
            raise IndexError("no id at this place")
        out, shift = np.zeros(len(at), dtype=np.uint64), 0
        for level, (width, _, _, _) in enumerate(self.levels):
            out[who] |= self._chunks(level, at) << np.uint64(shift)
            shift += width
            if level + 1 < len(self.levels):
                on = self._on(level, at)
                at, who = self._rank(level, at[on]), who[on]
        return out.astype(np.uint32)

    def _run(self, level: int, start: int, end: int) -> np.ndarray:
        width, _, place, _ = self.levels[level]
        first = start * width
        raw = self.data[place + first // 8 : place + -(-end * width // 8)]
        bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + (end - start) * width].reshape(end - start, width)
        out = np.zeros(end - start, dtype=np.uint32)
        for k in range(width):
            out |= bits[:, k].astype(np.uint32) << np.uint32(k)
        return out

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``: a run of every level, whose first place is a rank."""
        out, who, shift = np.zeros(end - start, dtype=np.uint32), np.arange(end - start), 0
        for level, (width, _, _, behind) in enumerate(self.levels):
            if start == end:
                break
            out[who] |= self._run(level, start, end) << np.uint32(shift)
            shift += width
            if level + 1 < len(self.levels):
                raw = self.data[behind + start // 8 : behind + -(-end // 8)]
                on = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
                start = int(self._rank(level, np.array([start]))[0])
                who = who[on]
                end = start + len(who)
        return out

    def texts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document, its ids) of all documents, some at a time."""
        row = 0
        while row < self.documents:
            stop = max(row + 1, int(np.searchsorted(self.starts, self.starts[row] + RUN_IDS, side="right")) - 1)
            ids = self.range(int(self.starts[row]), int(self.starts[stop]))
            for doc in range(row, stop):
                yield doc, ids[self.starts[doc] - self.starts[row] : self.starts[doc + 1] - self.starts[row]]
            row = stop


def _place(path: str) -> tuple[pyarrow.fs.FileSystem | None, str]:
    """A file system and a path for a task; None for a shared folder that is mounted."""
    found = urlparse(path)
    if found.scheme in ("", "file"):
        return None, unquote(found.path) if found.scheme else path
    return pyarrow.fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    system, name = _place(path)
    if system is None:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "wb") as file:
            file.write(data)
    else:
        with system.open_output_stream(name) as file:
            file.write(data)


def open_shard(path: str) -> Shard:
    system, name = _place(path)
    if system is None:
        with open(name, "rb") as file:
            return Shard(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    with system.open_input_file(name) as file:
        return Shard(file.read())


@dataclass
class TokenFiles:
    """A folder of shards: ``manifest`` has a row for each (file, first id before it, its ids and documents)."""

    manifest: DataFrame
    id_type: str

    def documents(self, with_ids: bool = False) -> DataFrame:
        """Every document as its shard holds it: ``doc_id, start, n_tokens, ids_crc32``, and on demand ``ids``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    shard = open_shard(path)
                    rows: list[tuple] = []
                    held = 0
                    for doc, ids in shard.texts():
                        rows.append((doc, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")), ids.astype(np.int64) if with_ids else None))
                        held += len(ids) if with_ids else 16
                        if held > 4 * RUN_IDS:
                            yield batch_of(shard, before, rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(shard, before, rows)

        def batch_of(shard: Shard, before: int, rows: list[tuple]) -> pa.RecordBatch:
            docs = np.array([r[0] for r in rows])
            columns = [shard.doc_ids.take(pa.array(docs)), pa.array(before + shard.starts[docs]), pa.array([r[1] for r in rows], pa.int64()),
                       pa.array([r[2] for r in rows], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([r[3] for r in rows], pa.list_(pa.int64()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        schema = f"doc_id {self.id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
        files = self.manifest.select("file", "before")
        return files.repartition(max(1, self.manifest.count()), "file").mapInArrow(run, schema)

    def tokens_at(self, positions: DataFrame, position_col: str = "position", bucket_ids: int = SHARD_IDS) -> DataFrame:
        """The id at each position of the whole corpus: ``position, token``; positions outside it and nulls give no row.

        Positions meet shards by an equality join on their bucket of ``bucket_ids`` positions; each file is opened once for
        at most ``bucket_ids`` positions of a group, and only the bytes of the asked ids are read from it.
        """
        span = F.sequence(F.floor(F.col("before") / bucket_ids), F.floor((F.col("before") + F.col("n_ids") - 1) / bucket_ids))
        shards = self.manifest.where("n_ids > 0").select("file", "before", "n_ids", F.explode(span).alias("bucket"))
        asked = positions.select(field(position_col).cast("long").alias("position")).where("position IS NOT NULL")
        met = asked.withColumn("bucket", F.floor(F.col("position") / bucket_ids)).join(shards, "bucket").where(
            (F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("n_ids")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, shard = None, None
            for batch in batches:
                files, places = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
                inside = places - batch.column(2).to_numpy()
                token = np.zeros(len(places), dtype=np.int64)
                for path in dict.fromkeys(files.tolist()):
                    if path != name:
                        name, shard = path, open_shard(path)
                    own = np.flatnonzero(files == path)
                    token[own] = shard.take(inside[own])
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(token)], ["position", "token"])

        return met.select("file", "position", "before").sortWithinPartitions("file").mapInArrow(run, "position bigint, token bigint")


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer_path: str = TOKENIZER, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> TokenFiles:
    """Encode every document and write its ids, closed by ``end_id``, in ascending order of ``id_col``.

    A null text is empty, so its ids are ``end_id`` alone.  Null document ids come first; rows that repeat an id are
    documents of their own, in the order of their texts' 64-bit hashes.  An empty table gives no file.  Other columns play
    no part.  ``folder`` is a new folder that driver and executors share, by default one below ``spark.checkpoint.dir``.

    Texts are sorted into ranges of about ``shard_ids`` ids, and encoded where they arrive.  A task closes a shard at that
    many ids, so neither a large range nor a hot id is ever held whole.  Files have names of their own for every attempt
    of a task; the manifest names those of the attempts that succeeded.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "token-files")
    kind = docs.schema[id_col].dataType.simpleString()
    root = (folder or f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}").rstrip("/")
    text = text_or_empty(text_col)
    texts = docs.select(field(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("uid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = part_table(tokenizer_path)
        ids: list[np.ndarray] = []
        rows: list[pa.RecordBatch] = []  # the ids of the documents in ``ids``
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal held
            starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            docs_ = pa.Table.from_batches(rows).combine_chunks()
            path = f"{root}/{uuid.uuid4().hex}.ids"
            whole = np.concatenate(ids, dtype=np.uint32, casting="same_kind")
            ids.clear(), rows.clear()
            held = 0
            write_file(path, shard_bytes(whole, starts, docs_["doc_id"].combine_chunks()))
            sizes = [pa.array([path]), pa.array([len(whole)], pa.int64()), pa.array([docs_.num_rows], pa.int64())]
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in docs_.slice(0, 1).columns] + sizes, ["doc_id", "hash", "uid", "file", "n_ids", "n_docs"])

        for batch in batches:
            keys, first = batch.select(["doc_id", "hash", "uid"]), 0
            for row, own in enumerate(table.column(batch.column("text"))):
                own = np.append(own, end_id)
                ids.append(own.astype(np.uint16 if own.max() < 1 << 16 else np.uint32))
                held += len(own)
                if held >= shard_ids:
                    rows.append(keys.slice(first, row + 1 - first))
                    first = row + 1
                    yield close()
            if first < batch.num_rows:
                # a copy: a slice would keep the texts of its batch
                rows.append(pa.RecordBatch.from_pylist(keys.slice(first).to_pylist(), schema=keys.schema))
        if ids:
            yield close()
        release_memory()

    order = [F.asc_nulls_first("doc_id"), "hash", "uid"]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(1, -(-size // (BYTES_PER_ID * shard_ids)))
    shards = texts.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(
        run, f"doc_id {kind}, hash bigint, uid bigint, file string, n_ids bigint, n_docs bigint")
    written = space.write(shards, "shards")
    # one row for each shard
    along = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.select("file", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(along), F.lit(0)).alias("before"))
    return TokenFiles(space.write(manifest, "manifest"), kind)


def open_token_files(spark: SparkSession, manifest_path: str, id_type: str = "bigint") -> TokenFiles:
    """Files written before, by their manifest saved as Parquet."""
    return TokenFiles(spark.read.parquet(manifest_path), id_type)
