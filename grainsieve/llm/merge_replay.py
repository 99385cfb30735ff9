"""Byte-level BPE by corpus-level merge replay.

The new parts of a block of texts are one corpus.  An inverted index leads from the rank of a token
pair to the positions where the pair stands; merges are applied in rank order, each to all of its
positions at once, and only the neighbours of merged positions enter the index again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from grainsieve.llm.pretokens import HashTable, PartTable
from grainsieve.llm.tables import field, text_or_empty
from grainsieve.llm.words import mix

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
NO_RANK = np.int64(2**62)

#: White space, letters and numbers as the library that reads the pattern sees them (fixed values).
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


def pattern_for_regex(pattern: str) -> str:
    """The same pattern for the ``regex`` module, whose ``\\s`` also holds four control characters."""
    out, inside = [], False
    for token in regex.findall(r"\\.|.", pattern, flags=regex.DOTALL):
        if token == r"\s":
            token = WHITE_SPACE if inside else f"[{WHITE_SPACE}]"
        elif token == r"\S" and not inside:
            token = f"[^{WHITE_SPACE}]"
        elif token in "[]":
            inside = token == "["
        out.append(token)
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merges:
    """A rank file as arrays: ids of single bytes, and a table from id pairs to merged ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.table = HashTable(20)
        keys = np.array(sorted(pairs), dtype=np.uint64)
        self.table.insert(mix(keys), np.array([pairs[int(k)] for k in keys], dtype=np.int64))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.table.find(mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)))
        return np.where(found < 0, NO_RANK, found)

    def encode_one(self, word: bytes) -> list[int]:
        """The lowest-ranked, leftmost merge again and again, on one word."""
        ids = [self.ranks[bytes([b])] for b in word]
        while len(ids) > 1:
            found = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
            at = int(found.argmin())
            if found[at] == NO_RANK:
                break
            ids[at : at + 2] = [int(found[at])]
        return ids

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every word; words are not empty."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        last = np.cumsum(lengths) - 1
        ids = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(ids)
        after = np.arange(1, n + 1)
        after[last] = -1
        before = np.arange(-1, n - 1)
        before[last - lengths + 1] = -1
        alive = np.ones(n, dtype=bool)
        pair = np.full(n, NO_RANK)
        has = np.flatnonzero(after >= 0)
        pair[has] = self.rank(ids[has], ids[has + 1])
        has = has[pair[has] != NO_RANK]
        order = has[np.argsort(pair[has], kind="stable")]
        ranks, first = np.unique(pair[order], return_index=True)
        index = {r: [p] for r, p in zip(ranks.tolist(), np.split(order, first[1:]), strict=True)}
        heap = ranks.tolist()
        irregular: list[np.ndarray] = []
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at] & (pair[at] == rank)]
            if len(at) > 1:  # of overlapping pairs every second one stays, from the left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():
                    run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at] = rank
            alive[gone] = False
            pair[gone] = NO_RANK
            after[at] = after[gone]
            follows = at[after[at] >= 0]
            before[after[follows]] = follows
            leads = before[at]
            touched = np.concatenate([leads[leads >= 0], at])
            pair[at] = NO_RANK
            touched = touched[after[touched] >= 0]
            fresh = self.rank(ids[touched], ids[after[touched]])
            pair[touched] = fresh
            known = fresh != NO_RANK
            touched, fresh = touched[known], fresh[known]
            if not len(fresh):
                continue
            lower = fresh < rank
            if lower.any():
                irregular.append(touched[lower])
            if len(fresh) > 1:
                order = np.argsort(fresh, kind="stable")
                touched, fresh = touched[order], fresh[order]
            borders = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
            for value, where in zip(fresh[np.concatenate([[0], borders])].tolist(), np.split(touched, borders), strict=True):
                if value in index:
                    index[value].append(where)
                else:
                    index[value] = [where]
                    heapq.heappush(heap, value)
        left = np.flatnonzero(alive)
        out = np.split(ids[left].astype(np.int32), np.searchsorted(left, last[:-1], side="right"))
        if irregular:  # there, a merge made a pair of a lower rank: the order within the word decides
            for w in np.unique(np.searchsorted(last, np.concatenate(irregular))).tolist():
                out[w] = np.array(self.encode_one(words[w]), dtype=np.int32)
        return out


@cache
def merges_of(path: str) -> Merges:
    return Merges(read_ranks(path))


def part_encoder(path: str, pattern: str):
    """Encode lists of parts: pre-tokens by the pattern, the distinct ones replayed as one corpus."""
    merges, find = merges_of(path), regex.compile(pattern_for_regex(pattern)).findall

    def encode(parts: list[bytes]) -> list[np.ndarray]:
        tokens = [[t.encode() for t in find(p.decode())] for p in parts]
        distinct = {t: merges.ranks.get(t) for own in tokens for t in own}
        known = {t: np.array([r], dtype=np.int32) for t, r in distinct.items() if r is not None}
        unknown = [t for t, r in distinct.items() if r is None]
        if unknown:
            known |= zip(unknown, merges.replay(unknown), strict=True)
        return [known[own[0]] if len(own) == 1 else np.concatenate([known[t] for t in own]) for own in tokens]

    return encode


_TABLES: dict[tuple[str, str], PartTable] = {}


def part_table(path: str, pattern: str) -> PartTable:
    if (path, pattern) not in _TABLES:
        _TABLES[path, pattern] = PartTable(part_encoder(path, pattern))
    return _TABLES[path, pattern]


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS,
               pattern: str = PATTERN, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and with ``with_ids`` also ``ids`` and
    ``decoded`` (binary).  A null text is empty and has no ids; null and repeated ids are passed
    through; other columns are not read.  An empty table gives no rows.

    Rows stay where they are read: no shuffle, and memory bounded by a block of text and by the
    number of parts that a worker remembers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = part_table(ranks_path, pattern)
        token = merges_of(ranks_path).token
        most = max(token) + 1
        decimals = np.array([b"%d " % i for i in range(most)])
        token_bytes = [token.get(i, b"") for i in range(most)]
        for batch in batches:
            counts, id_digests, text_digests, all_ids, all_bytes = [], [], [], [], []
            for ids in table.column(batch.column(1)):
                raw = b"".join([token_bytes[i] for i in ids.tolist()])
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(decimals[ids].tobytes().replace(b"\0", b"")[:-1]).hexdigest())
                text_digests.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_bytes.append(raw)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                       pa.array(text_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(field(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
