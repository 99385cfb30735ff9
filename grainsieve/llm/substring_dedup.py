"""Substring dedup by anchored groups of suffixes, named by doubling at the one depth of a window.

A window is a run of consecutive words of one document.  Its anchor is a k-gram with the smallest hash
in it, so equal windows have equal anchors.  The suffixes that start the windows of an anchor form one
group; an anchor that occurs once holds no repeated window and is dropped before any text moves.  Groups
are packed into buckets that fit in memory, and a group that does not fit is split by the whole window
as its prefix.  In a bucket suffixes get the names of the nodes that a suffix tree would have at depth
1, 2, 4, ... words, and a node at the depth of a window with two leaves is a repeat.  No tree is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.tables import Workspace, field, text_or_empty
from grainsieve.llm.words import Words, split, text_chunks

WINDOW = 35
ANCHOR = 8
#: Suffix groups are dealt into buckets of about so many contexts; a group with more is split further.
BUCKET_CONTEXTS = 20_000
#: Windows that a context holds at most: bits of a mask.
MASK_BITS = 63


def window_anchors(words: Words, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of each one's anchor, the hash of the k-gram at each word, and
    which windows kept the position of the window before although a later one is as small.

    Where several k-grams of a window share the smallest hash, consecutive windows keep one position as
    long as they hold it, so a run of one word has an anchor for many windows.
    """
    n = len(words.hash)
    if n < window:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    grams = words.all_grams(k)
    places, span = window - k + 1, 1
    best = np.arange(len(grams))
    while 2 * span <= places:  # the last position of the smallest hash among 2 * span positions
        left, right = best[:-span], best[span:]
        best = np.where(grams[left] < grams[right], left, right)
        span *= 2
    left, right = best[: n - window + 1], best[places - span : places - span + n - window + 1]
    last = np.where(grams[left] < grams[right], left, right)
    end = np.repeat(words.first[1:], np.diff(words.first))[: n - window + 1]
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= end)
    anchors, kept = last[starts], np.zeros(len(starts), dtype=bool)
    moved = np.flatnonzero((np.diff(anchors) == 1) & (grams[anchors[1:]] == grams[anchors[:-1]])) + 1
    held = -1
    for i in moved.tolist():  # ties: keep the position of the window before while it lies in this window
        if starts[i] == starts[i - 1] + 1:
            held = anchors[i - 1]
            if held >= starts[i] and grams[held] == grams[anchors[i]]:
                anchors[i], kept[i] = held, True
    return starts, anchors, grams, kept


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)


def repeated_windows(contexts: list[bytes], weights: np.ndarray, windows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bit masks of the repeated windows of each context (bit i: the window that starts at its word i).

    The nodes of the suffix tree over all contexts are named at doubling depths; the leaves below a node
    at the depth of a window are counted with the weights of their contexts.
    """
    data = np.frombuffer(b"\n".join(contexts), dtype=np.uint8)
    ends = np.cumsum([len(c) + 1 for c in contexts])
    words = split(data, np.concatenate([[0], np.minimum(ends, len(data))]))
    names = np.unique(words.hash, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while 2 * depth <= window:
        names = _named(names[:-depth], names[depth:])
        depth *= 2
    if depth < window:
        names = _named(names[: len(names) - (window - depth)], names[window - depth :])
    owner = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    node = names[words.first[owner] + offset]
    leaves = np.bincount(node, weights=weights[owner])
    masks = np.zeros(len(contexts), dtype=np.int64)
    hit = leaves[node] >= 2
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << offset[hit])
    return masks


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of the nodes reached by a node and the node that follows it."""
    pairs = left * (int(max(right.max(initial=0), 0)) + 1) + right
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


class SubstringDedup:
    """One run over a table of texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, window: int, k: int, bucket: int):
        self.space = Workspace(docs.sparkSession, "substring-dedup")
        self.window, self.k, self.bucket = window, k, bucket
        text = text_or_empty(text_col)
        self.docs = docs.select(field(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit("second")).alias("t2"))
        self.kind = docs.schema[id_col].dataType.simpleString()

    def scan(self) -> DataFrame:
        """Every document's number of words, the digest of all its words, and the hashes of its anchors."""
        window, k = self.window, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, digests, keys = [], [], []
                for _, data, offsets in text_chunks(batch.column(1)):
                    words = split(data, offsets)
                    _, anchors, grams, kept = window_anchors(words, window, k)
                    at = anchors[_runs(anchors)]
                    # windows that keep a position may equal each other with one anchor: it counts twice
                    at = np.sort(np.concatenate([at, np.unique(anchors[kept])]))
                    counts += np.diff(words.first).tolist()
                    keys += np.split(grams[at].view(np.int64), np.searchsorted(at, words.first[1:-1]))
                    raw = data.tobytes()
                    digests += [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "t1", "t2", "n_words", "all_sha256", "keys"])

        return self.docs.mapInArrow(run, f"doc_id {self.kind}, t1 bigint, t2 bigint, n_words bigint, all_sha256 string, keys array<bigint>")

    def contexts(self, wanted: DataFrame) -> DataFrame:
        """For each wanted anchor of each wanted text, the words of its windows, joined by one space."""
        window, k = self.window, self.k
        texts = self.docs.join(wanted.withColumnRenamed("doc_id", "rep_id").hint("merge"), ["t1", "t2"])
        texts = texts.where(F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("text", "t1", "t2", "copies", "keys")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys, lows, counts, contexts = [], [], [], [], []
                wanted_keys = batch.column(4)
                for first, data, offsets in text_chunks(batch.column(0)):
                    words = split(data, offsets)
                    starts, anchors, grams, _ = window_anchors(words, window, k)
                    at = _runs(anchors)
                    low, n = starts[at], np.diff(np.append(at, len(anchors)))
                    text_of = np.searchsorted(words.first, low, side="right") - 1
                    key = grams[anchors[at]].view(np.int64)
                    raw = data.tobytes()
                    borders = np.searchsorted(text_of, np.arange(len(offsets)))
                    for t in range(len(offsets) - 1):
                        a, b = int(borders[t]), int(borders[t + 1])
                        own = np.asarray(wanted_keys[first + t].values.to_numpy())
                        for i in (a + np.flatnonzero(np.isin(key[a:b], own))).tolist():
                            x, m = int(low[i]), int(n[i])
                            rows.append(first + t), keys.append(int(key[i])), lows.append(x - int(words.first[t])), counts.append(m)
                            contexts.append(b" ".join(raw[words.start[x] : words.end[x + m + window - 2]].split()))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(keys, pa.int64()), pa.array(lows, pa.int64()), pa.array(counts, pa.int32()), pa.array(contexts, pa.binary())],
                    ["t1", "t2", "copies", "key", "low", "windows", "context"])

        return texts.mapInArrow(run, "t1 bigint, t2 bigint, copies bigint, key bigint, low bigint, windows int, context binary")

    def masks(self, distinct: DataFrame) -> DataFrame:
        """``c1, c2, mask`` of the contexts that hold a repeated window."""
        window, bucket = self.window, self.bucket
        large = self.space.write(distinct.groupBy("key").count().where(F.col("count") > bucket).select("key"), "large")
        buckets = max(1, -(-distinct.count() // bucket))

        def tree(part: pd.DataFrame) -> pd.DataFrame:
            found = repeated_windows(part["context"].tolist(), part["weight"].to_numpy(), part["windows"].to_numpy(), window)
            return pd.DataFrame({"c1": part["c1"], "c2": part["c2"], "mask": found})[found != 0]

        small = distinct.join(large, "key", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        out = small.select("bucket", "context", "weight", "windows", "c1", "c2").groupBy("bucket").applyInPandas(tree, "c1 bigint, c2 bigint, mask bigint")
        if large.isEmpty():
            return out

        def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, bits, texts = [], [], []
                for row, (context, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    parts = context.split(b" ")
                    for i in range(n):
                        rows.append(row), bits.append(1 << i), texts.append(b" ".join(parts[i : i + window]))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in (2, 3, 4)], pa.array(bits, pa.int64()), pa.array(texts, pa.binary())], ["weight", "c1", "c2", "bit", "words"])

        split_ = distinct.join(large, "key").select("context", "windows", "weight", "c1", "c2").mapInArrow(windows_of, "weight bigint, c1 bigint, c2 bigint, bit bigint, words binary")
        split_ = self.space.write(split_.select("weight", "c1", "c2", "bit", F.xxhash64("words").alias("w1"), F.xxhash64("words", F.lit("second")).alias("w2")), "large-windows")
        nodes = self.space.write(split_.groupBy("w1", "w2").agg(F.sum("weight").alias("leaves")).where("leaves > 1").select("w1", "w2"), "large-nodes")
        return out.union(split_.join(nodes, ["w1", "w2"]).groupBy("c1", "c2").agg(F.bit_or("bit").alias("mask")))

    def removed(self, covered: DataFrame) -> DataFrame:
        """``t1, t2, n_removed, kept_sha256`` of the texts with covered words."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, digests = [], []
                for text, lows, masks in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                    words = text.encode().split()
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for low, mask in zip(lows.as_py(), masks.as_py(), strict=True):
                        starts = low + np.flatnonzero((mask >> np.arange(MASK_BITS)) & 1)
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + window, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    counts.append(int(gone.sum()))
                    digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["t1", "t2", "n_removed", "kept_sha256"])

        texts = self.docs.join(covered.withColumnRenamed("doc_id", "rep_id").hint("merge"), ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("rep_id")))
        return texts.select("text", "t1", "t2", "lows", "masks").mapInArrow(run, "t1 bigint, t2 bigint, n_removed bigint, kept_sha256 string")

    def run(self) -> DataFrame:
        space = self.space
        docs = space.write(self.scan(), "docs")
        texts = space.write(docs.where(F.size("keys") > 0).groupBy("t1", "t2", "keys").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")), "texts")
        anchors = texts.select("t1", "t2", "doc_id", "copies", F.explode("keys").alias("key"))
        shared = space.write(anchors.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key"), "shared")
        wanted = anchors.join(shared, "key").groupBy("t1", "t2", "doc_id", "copies").agg(F.collect_set("key").alias("keys"))
        wanted = space.write(wanted, "wanted")
        found = space.write(
            self.contexts(wanted).withColumns({"c1": F.xxhash64("context"), "c2": F.xxhash64("context", F.lit("second"))}), "contexts")
        distinct = space.write(found.groupBy("key", "context", "windows", "c1", "c2").agg(F.sum("copies").alias("weight")), "distinct")
        masks = space.write(self.masks(distinct), "masks")
        marks = found.where("copies = 1").select("t1", "t2", "low", "c1", "c2").join(masks, ["c1", "c2"])
        covered = space.write(
            marks.groupBy("t1", "t2").agg(F.collect_list(F.struct("low", "mask")).alias("marks"))
            .select("t1", "t2", F.col("marks.low").alias("lows"), F.col("marks.mask").alias("masks"))
            .join(texts.select("t1", "t2", "doc_id"), ["t1", "t2"]), "covered")
        changed = space.write(self.removed(covered), "removed")
        whole = space.write(texts.where("copies > 1").select("t1", "t2", F.lit(True).alias("whole")), "whole")
        out = docs.drop("keys").join(changed, ["t1", "t2"], "left").join(whole, ["t1", "t2"], "left")
        gone = F.coalesce("whole", F.lit(False))
        return out.select(
            "doc_id", "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR, bucket_contexts: int = BUCKET_CONTEXTS) -> DataFrame:
    """Remove every word that lies in a window whose word sequence also starts anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Returns ``doc_id, n_words, n_removed, kept_sha256`` for
    every row.  A null text has no words; texts shorter than a window keep all of theirs; rows that
    repeat a text count as occurrences of each other, whatever their ids; a null id stays null; an empty
    table gives no rows.  Texts are told apart by two 64-bit hashes, so are the words of windows.

    The result does not depend on ``anchor``; it is raised where more than ``MASK_BITS`` windows could
    share one.
    """
    return SubstringDedup(docs, id_col, text_col, window, max(anchor, window - MASK_BITS + 1), bucket_contexts).run()
