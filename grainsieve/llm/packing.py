"""Best-fit packing by sums of squares.

Each piece goes where the sum over all residual gaps of the squared number of open sequences with
that gap becomes smallest.  Only the counts by gap decide, so a placement is one vector operation
over at most ``max_tokens`` numbers.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.pretokens import PartTable
from grainsieve.llm.tables import Workspace, field, text_or_empty

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
MAX_TOKENS = 1024
#: Pieces that one task packs together.
GROUP_PIECES = 60_000
_TABLES: dict[str, AddedTokens | WholeTexts] = {}


class WholeTexts:
    """Token ids of whole texts by tokenizers itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids, dtype=np.int32)


class AddedTokens:
    """A table of parts behind a file's added tokens: texts are cut at those before parts are.

    ``passes`` hold the tokens' ids by content; as in tokenizers, the first token from the left wins,
    of several at one place the longest, and a later pass looks at what earlier ones left.
    """

    ROWS = 256

    def __init__(self, table: PartTable, passes: list[dict[str, int]]):
        self.table = table
        self.ids = {content: i for own in passes for content, i in own.items()}
        self.patterns = [re.compile(f"({'|'.join(map(re.escape, sorted(own, key=len, reverse=True)))})") for own in passes if own]

    def cut(self, text: str) -> list[str | int]:
        """Stretches of text and ids of added tokens in order; none for an empty text."""
        out: list[str | int] = [text]
        for pattern in self.patterns:
            left, out = out, []
            for piece in left:
                if isinstance(piece, int):
                    out.append(piece)
                else:
                    out += [self.ids[p] if k % 2 else p for k, p in enumerate(pattern.split(piece)) if p]
        return [p for p in out if p != ""]

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not any(self._holds(texts, content) for content in self.ids):
            yield from self.table.column(texts)
            return
        for row in range(0, len(texts), self.ROWS):
            rows = [self.cut(text or "") for text in texts.slice(row, self.ROWS).to_pylist()]
            encoded = self.table.column(pa.array([p for own in rows for p in own if isinstance(p, str)], pa.large_string()))
            for own in rows:
                parts = [next(encoded) if isinstance(p, str) else np.array([p], dtype=np.int32) for p in own]
                yield np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)

    @staticmethod
    def _holds(texts: pa.Array, content: str) -> bool:
        return bool(pc.any(pc.match_substring(texts, content)).as_py())


def token_table(path: str) -> AddedTokens | WholeTexts:
    """What gives the ids of a column of texts by a byte-level tokenizers file.

    Where the file's merges stand in the order of the ids that they make, merging by id gives what
    merging by the list gives, and the faster library reads the file's own vocabulary; texts are cut at
    the file's added tokens first.  Any other file, and one whose added tokens take in white space or
    look at the letters around them, is left to tokenizers.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, added = whole["model"], whole.get("added_tokens") or []
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    plain = not whole.get("normalizer") and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
    if plain and made == sorted(made) and len(set(made)) == len(made) and not model.get("ignore_merges"):
        import tiktoken

        byte_of = {c: bytes([b]) for b, c in byte_characters().items()}
        singles = [t for t in vocabulary if len(t) == 1 and t in byte_of]
        mergeable = {byte_of[t]: vocabulary[t] for t in singles}
        mergeable |= {b"".join(byte_of[c] for c in a + b): i for (a, b), i in zip(merges, made, strict=True)}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mergeable, special_tokens={})
        passes = [{t["content"]: vocabulary.get(t["content"], t["id"]) for t in added if t["content"] and bool(t.get("normalized")) == later}
                  for later in (False, True)]
        return AddedTokens(PartTable(lambda parts: [np.array(fast.encode_ordinary(p.decode()), dtype=np.int32) for p in parts]), passes)
    return WholeTexts(path)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def part_table(path: str) -> AddedTokens | WholeTexts:
    """The Python worker's table for a file."""
    if path not in _TABLES:
        _TABLES[path] = token_table(path)
    return _TABLES[path]


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens; only the first may be shorter."""
    first = n % most or most
    return [(0, min(first, n))] + [(s, most) for s in range(first, n, most)]


def pack_sizes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the given order.

    Ties go to the smallest gap that holds the piece, and to the sequence opened or changed last.
    """
    counts = np.zeros(most + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    bins, offsets, opened = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        change = 2 * (counts[: most + 1 - size] - counts[size:]) + 2
        change[0] = -2 * counts[size] + 1  # the piece fills the gap
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        new = 2 * counts[most - size] + 1 if size < most else 0
        best = int(change.argmin())
        if change[best] < new:
            gap = best + size
            which = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, which, opened = most, opened, opened + 1
        bins[i], offsets[i] = which, most - gap
        if gap > size:
            counts[gap - size] += 1
            stacks[gap - size].append(which)
    return bins, offsets


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = TOKENIZER,
           end_id: int = END_ID, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Cut every text's tokens, closed by ``end_id``, into pieces of at most ``max_tokens``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = part_table(tokenizer_path)
        for batch in batches:
            rows, piece, start, length, crc, out = [], [], [], [], [], []
            for row, ids in enumerate(table.column(batch.column(1))):
                ids = np.append(ids, end_id).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), max_tokens)):
                    own = ids[s : s + n]
                    rows.append(row), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        out.append(own.astype(np.int64))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(field(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = TOKENIZER,
                  end_id: int = END_ID, max_tokens: int = MAX_TOKENS, with_ids: bool = False,
                  group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document into sequences of at most ``max_tokens`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and
    with ``with_ids`` the ids.  A null or empty text is one piece that holds ``end_id`` alone; rows
    that repeat a document are packed each; a null id stays null.  An empty table gives no rows.

    Tokens are counted where the text is read; only numbers are shuffled.  Pieces are dealt by a
    hash into groups of about ``group_pieces``, whose number grows with the input, and each group is
    packed by itself, longest first, so a group leaves a few half-open sequences at most.
    """
    space = Workspace(docs.sparkSession, "packing")
    found = pieces(docs, id_col, text_col, tokenizer_path, end_id, max_tokens, with_ids)
    cut_ = space.write(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut_.count() // group_pieces))
    bits = 40

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((part["uid"].to_numpy(), -part["length"].to_numpy()))
        bins, offsets = pack_sizes(part["length"].to_numpy()[order], max_tokens)
        part = part.drop(columns=["salt", "uid"]).iloc[order]
        return part.assign(sequence_id=bins + (int(key[0]) << bits), offset=offsets)

    schema = cut_.drop("uid").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    salted = cut_.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return salted.groupBy("salt").applyInPandas(run, schema)
