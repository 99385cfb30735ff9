"""N-gram Jaccard join by grouped prefixes.

Documents with one shingle set are one class.  A class's shingles are ordered by how common they are
(a fixed-size count sketch over all documents) and by their hash; two sets that reach the threshold
share a shingle among their first ones, their prefix.  Classes with identical prefixes and sizes are one
group, and all that a prefix can tell is told once for a group: groups meet in the buckets of their
shingles, where shingles with the same groups make one bucket, group pairs are filtered by sizes, by the place
of the shared shingle and by both prefixes, and only the members of the remaining ones are verified by their whole sets.

Components need no pair within a component that is already joined.  So each bucket first offers its
members to one leader; then only groups of different components are paired.  Every pair that shares a
prefix shingle is verified or lies in one component, so no link between components is lost.

Links lie within components.  There all pairs of classes are verified, block against block: blocks are bounded, a
set moves once for each block that its own meets, and a task counts the links of two blocks by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.bloom import build_bloom
from grainsieve.llm import tables
from grainsieve.llm.components import components
from grainsieve.llm.tables import Workspace, field, settings, text_or_empty
from grainsieve.llm.words import mix, split, text_chunks

WORDS = 5
PERCENT = 80
#: log2 of the number of counters of the sketch, and members of a group that are paired as one.
SKETCH_BITS = 20
GROUP_MEMBERS = 256
#: Classes up to which a component meets others pair by pair.
SMALL_COMPONENT = 8
#: Shingles and sets of a block of a component, and shingles that a matrix product takes at a time.
BLOCK_SHINGLES = 1 << 16
BLOCK_SETS = 512
PRODUCT_SHINGLES = 4096
#: Pairs of blocks that a part of a component's pairs with others has, about.
PART_BLOCKS = 256
#: Bytes of a batch of texts or sets for a Python worker, and blocks of one component that a join holds before it may spill.
BATCH_BYTES = 1 << 20
HELD_BLOCKS = 32
_BLOCK = 1 << 12


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; a shorter text is one shingle, an empty one none."""
    for _, data, offsets in text_chunks(texts):
        found = split(data, offsets, lower=True)
        hashes, first = found.grams(words)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            own = hashes[a:b] if b > a else found.whole(i) if found.first[i + 1] > found.first[i] else hashes[:0]
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def prefix_size(n: int, percent: int) -> int:
    """Shingles among which sets of ``n`` must meet any set that they reach ``percent`` with."""
    return n - (n * percent + 99) // 100 + 1


def sketch(texts: DataFrame, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many shingle occurrences over all texts fall on each of 2^bits counters."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for own in shingle_sets(batch.column(0), words):
                counts[(own >> np.uint64(64 - bits)).astype(np.int64)] += 1  # collisions within one text count once
        blocks = counts.reshape(-1, min(_BLOCK, size))
        rows = [i for i in range(len(blocks)) if blocks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([blocks[i].tobytes() for i in rows], pa.binary())], ["block", "counts"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, dtype=np.int64) for c in part["counts"]], axis=0)
        return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    rows = texts.mapInArrow(count, "block int, counts binary").withColumn("salt", F.spark_partition_id() % 16)
    rows = rows.groupBy("block", "salt").applyInPandas(add, "block int, counts binary")
    rows = rows.groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros(size, dtype=np.int64)
    for row in rows.toLocalIterator():
        out[row["block"] * min(_BLOCK, size) : (row["block"] + 1) * min(_BLOCK, size)] = np.frombuffer(row["counts"], dtype=np.int64)
    return out


def most_shared(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, levels: np.ndarray, bits: int) -> int:
    """An upper bound of what two sets share, from their prefixes.

    Up to the place in the common order where the shorter-reaching prefix ends, both sets are known.
    """
    key = lambda x: levels[(x >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
    (last_a, last_b) = (int(key(a[-1:])[0]), int(a[-1])), (int(key(b[-1:])[0]), int(b[-1]))
    if last_a <= last_b:
        k = key(b)
        b_known = int(np.count_nonzero((k < last_a[0]) | ((k == last_a[0]) & (b <= a[-1]))))
        a_known = len(a)
    else:
        k = key(a)
        a_known = int(np.count_nonzero((k < last_b[0]) | ((k == last_b[0]) & (a <= b[-1]))))
        b_known = len(b)
    shared = len(np.intersect1d(a[:a_known], b[:b_known], assume_unique=True))
    return shared + min(size_a - a_known, size_b - b_known)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (a, b)]
    flat = [np.concatenate(side) if side else np.empty(0, dtype=np.uint64) for side in (a, b)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)))
    at = []
    for row, values in zip(rows, flat, strict=True):
        place = np.searchsorted(common, values)
        held = np.flatnonzero(place < len(common))
        held = held[common[place[held]] == values[held]]
        order = held[np.argsort(place[held], kind="stable")]
        at.append((row[order], place[order]))
    for first in range(0, len(common), PRODUCT_SHINGLES):
        sides = []
        for (row, place), count in zip(at, (len(a), len(b)), strict=True):
            x, y = np.searchsorted(place, [first, first + PRODUCT_SHINGLES])
            dense = np.zeros((count, min(PRODUCT_SHINGLES, len(common) - first)), dtype=np.float32)
            dense[row[x:y], place[x:y] - first] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T  # exact: at most PRODUCT_SHINGLES ones
    return out.astype(np.int64)


def _reach(size: Column, place: Column, other: Column, other_place: Column, percent: int) -> Column:
    """Whether two sets can reach the threshold if their first common shingle stands at these places.

    They share no more than what is left of either from there on; the sizes' own bound is part of it.
    """
    most = F.least(size - place, other - other_place)
    return most * 100 >= (size + other - most) * percent


class JaccardJoin:
    """One run of the join over a table of texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bits: int):
        self.spark = docs.sparkSession
        self.space = Workspace(self.spark, "jaccard-join", BATCH_BYTES)
        self.words, self.percent, self.bits = words, percent, bits
        text = text_or_empty(text_col)
        self.texts = docs.select(field(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
        with settings(self.spark, {tables.BATCH_BYTES: BATCH_BYTES}):
            counts = sketch(self.texts.select("text"), words, bits)
        self.levels = np.frexp(counts.astype(np.float64))[1].astype(np.uint8)  # 1 + log2, rounded down; 0 for none

    def sets(self) -> DataFrame:
        """``doc_id, text_hash, n`` of every document, two halves of its set's digest and its ordered prefix."""
        words, percent, bits = self.words, self.percent, self.bits
        shared = self.texts.sparkSession.sparkContext.broadcast(self.levels)  # 2^bits bytes
        kind = self.texts.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = shared.value
            for batch in batches:
                sizes, one, two, prefixes = [], [], [], []
                for own in shingle_sets(batch.column(1), words):
                    sizes.append(len(own))
                    one.append(int(mix(own, 1).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(own, 2).sum(dtype=np.uint64).view(np.int64)))
                    common = levels[(own >> np.uint64(64 - bits)).astype(np.int64)]
                    order = np.argsort(common, kind="stable")[: prefix_size(len(own), percent) if len(own) else 0]
                    prefixes.append(own[order].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n", "d1", "d2", "prefix"])

        return self.texts.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>")

    def allowed(self, pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """The pairs of groups (a, b) whose prefixes allow the threshold."""
        percent, bits = self.percent, self.bits
        shared = self.texts.sparkSession.sparkContext.broadcast(self.levels)
        side = lambda x: groups.select(F.col("gid").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"prefix_{x}"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = shared.value
            for batch in batches:
                keep = []
                columns = [batch.column(i) for i in range(2, 6)]
                prefixes = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in columns[2:]]
                for i, (n, m) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
                    (va, oa), (vb, ob) = prefixes
                    most = most_shared(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], n, m, levels, bits)
                    keep.append(100 * most >= percent * (n + m - most))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "prefix_a", "prefix_b")
        return joined.mapInArrow(run, "a bigint, b bigint")

    def linked(self, pairs: DataFrame, classes: DataFrame, name: str, more: DataFrame | None = None) -> DataFrame:
        """The pairs whose whole sets reach the threshold; texts are read again for their members, and for classes in ``more``."""
        words, percent = self.words, self.percent
        ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid")))
        ids = (ids if more is None else ids.union(more.select("cid"))).distinct()
        wanted = self.space.write(
            classes.join(ids, "cid", "left_semi").select("cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")), f"{name}-wanted")
        # a bounded filter of the wanted hashes keeps nearly all other texts out of the shuffle
        likely = self.texts.where(build_bloom(wanted, "rep_hash").might_contain(F.col("text_hash"), self.spark))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [s.tobytes() for s in shingle_sets(batch.column(1), words)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

        same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
        texts = likely.join(wanted.hint("merge"), same).select("cid", "text")
        sets = self.space.write(texts.mapInArrow(run, "cid bigint, shingles binary").dropDuplicates(["cid"]), f"{name}-sets")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                    shared = np.sort(np.concatenate([x, y]), kind="stable")
                    both = int(np.count_nonzero(shared[1:] == shared[:-1]))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"set_{x}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
        return self.space.write(joined.mapInArrow(verify, "a bigint, b bigint"), f"{name}-links")

    def prepare(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Documents, classes with their group, groups, and the buckets in which groups meet.

        A group's id is a hash of its size and prefix; groups that shared one would be paired as one, and their members be
        verified as any others.  Shingles whose groups are the same ones make one bucket, named by 128 bits; in it a group
        stands at the first of its places, so no bound gets tighter by that.
        """
        space = self.space
        docs = space.write(self.sets(), "docs")
        own = docs.where("n > 0").withColumn("gid", F.xxhash64("n", "prefix"))
        classes = space.write(
            own.groupBy("n", "d1", "d2", "gid")
            .agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"))
            .withColumn("cid", F.monotonically_increasing_id()), "classes")
        sizes = classes.groupBy("gid").agg(F.min("cid").alias("head"), F.count("*").alias("members"), F.sum("copies").alias("copies"))
        groups = space.write(own.select("gid", "n", "prefix").distinct().join(sizes, "gid"), "groups")
        places = groups.select("gid", "n", "copies", F.posexplode("prefix").alias("place", "shingle"))
        mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("gid")))
        shared = places.groupBy("shingle").agg(F.count("*").alias("size"), F.struct(mark(1), mark(2)).alias("token")).where("size > 1")
        buckets = places.join(shared, "shingle").groupBy("token", "gid").agg(
            F.min("place").alias("place"), F.max("size").alias("size"), F.max("n").alias("n"), F.max("copies").alias("copies"))
        return docs, classes, groups, space.write(buckets, "buckets")

    def expanded(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs of classes (a, b) of pairs of groups; a group may be paired with itself."""
        own = classes.select(F.col("gid").alias("a"), F.col("cid").alias("x"))
        other = classes.select(F.col("gid").alias("b"), F.col("cid").alias("y"))
        both = pairs.join(own, "a").join(other, "b").where("x != y")
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def blocks(self, members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The sets of components in bounded blocks: ``root, block (band, part), sets``; ``members`` has ``cid, root, n, copies``."""
        band = F.floor(F.log("n") / float(np.log(100 / self.percent)))
        spread = members.withColumn("band", band)
        weight = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("long")
        parts = spread.groupBy("root", "band").agg(weight.alias("parts"))
        placed = spread.join(parts, ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).join(sets, "cid")
        return self.space.write(placed.groupBy("root", F.struct("band", "part").alias("block")).agg(
            F.collect_list(F.struct("cid", "copies", "shingles")).alias("sets")), name)  # bounded by BLOCK_SHINGLES and BLOCK_SETS

    def compared(self, met: DataFrame, count: bool) -> DataFrame:
        """The links between the sets of two blocks, ``same, sets_a, sets_b``: ``a, b``, or with ``count`` the rows linked to a class, ``cid, others``."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    same, *sides = (batch.column(i)[row] for i in range(3))
                    cids, copies, found = zip(*[(
                        np.array([m["cid"].as_py() for m in side], dtype=np.int64), np.array([m["copies"].as_py() for m in side], dtype=np.int64),
                        [np.frombuffer(m["shingles"].as_buffer(), dtype=np.uint64) for m in side]) for side in sides], strict=True)
                    both = shared_counts(*found)
                    sizes = [np.array([len(x) for x in side]) for side in found]
                    near = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None] - both)
                    if same.as_py():
                        near = np.triu(near, 1)
                    if count:
                        others = [near @ copies[1], copies[0] @ near]
                        ids, sums = np.concatenate(cids), np.concatenate(others)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[sums > 0]), pa.array(sums[sums > 0])], ["cid", "others"])
                    else:
                        x, y = np.nonzero(near)
                        ends = cids[0][x], cids[1][y]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], ["a", "b"])

        found = met.select("same", "sets_a", "sets_b").mapInArrow(run, "cid bigint, others bigint" if count else "a bigint, b bigint")
        return found.groupBy("cid").agg(F.sum("others").alias("others")) if count else found

    def component_links(self, members: DataFrame, sets: DataFrame, count: bool) -> DataFrame:
        """All links within components: ``a, b``, or with ``count`` the rows of other classes linked to a class, ``cid, others``.

        ``members`` has ``cid, root, n, copies`` of classes in components of two or more, ``sets`` their shingles.
        """
        blocks = self.blocks(members, sets, "blocks")
        sides = [blocks.select("root", F.col("block").alias(f"block_{x}"), F.col("sets").alias(f"sets_{x}")) for x in "ab"]
        # sets that reach the threshold differ by one band at most
        met = sides[0].join(sides[1], "root").where((F.col("block_a") <= F.col("block_b")) & (F.col("block_b.band") - F.col("block_a.band") <= 1))
        return self.space.write(self.compared(met.withColumn("same", F.col("block_a") == F.col("block_b")), count), "links-within", HELD_BLOCKS)

    def lighter_first(self, met_roots: DataFrame, rooted: DataFrame) -> DataFrame:
        """The pairs of components with the one of fewer shingles as ``root_a``: its blocks move once for each pair."""
        sizes = rooted.groupBy("root").agg(F.sum("n").alias("shingles"))
        side = lambda x: sizes.select(F.col("root").alias(f"root_{x}"), F.struct("shingles", "root").alias(x))
        both = met_roots.join(side("a"), "root_a").join(side("b"), "root_b")
        return both.select(F.least("a", "b")["root"].alias("root_a"), F.greatest("a", "b")["root"].alias("root_b"))

    def links_across(self, met_roots: DataFrame, rooted: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between components (root_a, root_b) of which some groups met, block against block."""
        ids = met_roots.select(F.col("root_a").alias("root")).union(met_roots.select("root_b")).distinct()
        met_roots = self.lighter_first(met_roots, rooted.join(ids, "root", "left_semi"))
        blocks = self.blocks(rooted.join(ids, "root").select("cid", "root", "n", "copies"), sets, "blocks-across")
        met_roots, parts = self.parts_across(met_roots, blocks.groupBy("root").agg(F.count("*").alias("blocks")))
        sides = [blocks.select(F.col("root").alias(f"root_{x}"), F.col("block").alias(f"block_{x}"), F.col("sets").alias(f"sets_{x}")) for x in "ab"]
        dealt = sides[1].join(parts, "root_b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = met_roots.join(sides[0], "root_a").join(dealt, ["root_b", "part"]).where(F.abs(F.col("block_b.band") - F.col("block_a.band")) <= 1)
        return self.space.write(self.compared(met.withColumn("same", F.lit(False)), False), "links-across", HELD_BLOCKS)

    def parts_across(self, met_roots: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs of components with a ``part`` of those that ``root_b`` meets, and ``root_b, parts``.

        A component that many others meet is one key; its pairs are dealt to parts of about ``PART_BLOCKS`` pairs of blocks,
        and its blocks go to each of them.  ``blocks`` has the number of blocks of each ``root``.
        """
        side = lambda x: blocks.select(F.col("root").alias(f"root_{x}"), F.col("blocks").alias(f"blocks_{x}"))
        work = met_roots.join(side("a"), "root_a").groupBy("root_b").agg(F.count("*").alias("met"), F.sum("blocks_a").alias("blocks_a"))
        parts = self.space.write(work.join(side("b"), "root_b").select(
            "root_b", F.least("met", F.ceil(F.col("blocks_a") * F.col("blocks_b") / PART_BLOCKS)).cast("int").alias("parts")), "parts-across")
        part = F.pmod(F.xxhash64("root_a"), F.col("parts")).cast("int")
        return met_roots.join(parts, "root_b").select("root_a", "root_b", part.alias("part")), parts

    def classes_with_roots(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents, classes with the component of each, and the sets of the classes that any link was found for."""
        space, percent = self.space, self.percent
        docs, classes, groups, buckets = self.prepare()
        # the groups of a bucket that are close in size meet a leader: the one with the fewest rare shingles, so most like the others
        band = F.floor(F.log("n") / float(np.log(100 / percent))).alias("band")
        leaders = (
            buckets.groupBy("token", band).agg(F.min(F.struct("place", -F.col("copies"), "gid", "n")).alias("top"))
            .select("token", "band", F.col("top.gid").alias("leader"), F.col("top.n").alias("leader_n"), F.col("top.place").alias("leader_place")))
        buckets = buckets.withColumn("band", band)
        star = buckets.join(leaders, ["token", "band"]).where((F.col("gid") != F.col("leader")) & _reach(F.col("n"), F.col("place"), F.col("leader_n"), F.col("leader_place"), percent))
        star = self.allowed(star.select(F.col("leader").alias("a"), F.col("gid").alias("b")).distinct(), groups)
        # the first class of a leader meets all classes of another group, and that of any group the group's others
        heads = groups.select(F.col("gid").alias("a"), F.col("head").alias("x"))
        own = classes.select(F.col("gid").alias("b"), F.col("cid").alias("y"))
        within = heads.join(groups.where("members > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b")), "a").join(own, "b").select("x", "y")
        across = star.join(heads, "a").join(own, "b").select("x", "y")
        star = space.write(across.unionByName(within).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "star")
        first = self.linked(star, classes, "star")
        roots = components(space, first, "first").select(F.col("id").alias("cid"), "root")
        # groups of one bucket, component, size and place; only those of different components are paired
        rooted = classes.join(roots, "cid", "left").select("cid", "gid", "n", "copies", F.coalesce("root", "cid").alias("root"))
        rooted = space.write(rooted.join(rooted.groupBy("root").agg((F.count("*") > SMALL_COMPONENT).alias("large")), "root"), "rooted")
        labelled = space.write(buckets.join(rooted.select("gid", "root", "large").distinct(), "gid"), "labelled")
        space.drop("buckets")
        mixed = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
        part = F.when(F.col("large"), 0).otherwise(F.pmod(F.xxhash64("gid"), F.ceil(F.col("size") / GROUP_MEMBERS).cast("long")))
        packs = space.write(labelled.join(mixed, "token").groupBy("token", "root", "large", "n", "place", part.alias("part")).agg(
            F.collect_list(F.when(~F.col("large"), F.col("gid"))).alias("members")), "packs")  # the members of a small component at most
        space.drop("labelled")
        left, right = (packs.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "large", "n", "place", "members")]) for x in "ab")
        paired = left.join(right, "token").where((F.col("root_a") < F.col("root_b")) & _reach(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"), percent))
        # small components meet by their groups, pair by pair; where one is large, all of both, block by block
        met_roots = space.write(paired.where("large_a OR large_b").select("root_a", "root_b").distinct(), "met-roots")
        pairs = paired.where("NOT large_a AND NOT large_b").select(F.explode("members_a").alias("x"), "members_b").select("x", F.explode("members_b").alias("y"))
        pairs = self.allowed(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), groups)
        apart = [rooted.select(F.col("cid").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
        wanted = self.expanded(pairs, classes).join(apart[0], "a").join(apart[1], "b").where("root_a != root_b").select("a", "b").join(star, ["a", "b"], "left_anti")
        wanted = space.write(wanted, "pairs")
        space.drop("packs")
        ids = met_roots.select(F.col("root_a").alias("root")).union(met_roots.select("root_b")).distinct()
        second = self.linked(wanted, classes, "pairs", rooted.join(ids, "root", "left_semi"))
        sets = [self.spark.read.parquet(f"{space.root}/{x}-sets") for x in ("star", "pairs")]
        across = self.links_across(met_roots, rooted, sets[1])
        roots = components(space, first.union(second).union(across), "all").select(F.col("id").alias("cid"), "root")
        whole = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        return docs, space.write(whole, "rooted-classes"), sets[0].unionByName(sets[1]).dropDuplicates(["cid"])

    def linked_members(self, whole: DataFrame) -> DataFrame:
        """The classes in components of two or more."""
        many = whole.groupBy("root").agg(F.count("*").alias("classes")).where("classes > 1").select("root")
        return self.space.write(whole.join(many, "root").select("cid", "root", "n", "copies"), "linked-members")

    def run(self, links: bool = True) -> DataFrame:
        docs, whole, sets = self.classes_with_roots()
        least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
        member = whole.join(least, "root").select("cid", "n", "d1", "d2", "root", "component_id", "copies")
        if links:
            around = self.component_links(self.linked_members(whole), sets, count=True)
            member = member.join(around, "cid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
        shown = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
        member = self.space.write(member.drop("cid", "copies", "others"), "members")
        return docs.join(member, ["n", "d1", "d2"], "left").select(
            "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", *shown)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps its smallest id; all columns stay.

    Texts without words are in no component and stay.  Of rows of a component that share the smallest
    id the one with the smallest text hash stays.
    """
    found = jaccard_join(docs, id_col, text_col, links=False, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("first")
    kept = found.where("root is not null").groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    kept = kept.union(found.where("root is null").select("doc_id", "text_hash")).distinct()
    kept = Workspace(docs.sparkSession, "one-of-each").write(kept, "kept")
    on = field(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_hash"))
    return docs.join(kept.hint("merge"), on, "left_semi")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, links: bool = True) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are lower-cased in A-Z; a set holds the distinct shingles of ``words`` words, or the whole
    sequence of a shorter text.  Returns one row per row: ``doc_id, n_shingles, component_id`` (the
    smallest id of its component), ``text_hash``, which tells rows of one id apart, ``root``, which
    tells components apart where ids are null (itself null for a text without words), and with ``links``
    ``n_links``, the number of other rows that reach the threshold with it.

    A null or empty text has no shingles and no links.  A null id never becomes a component's id unless
    all ids of the component are null; rows that repeat an id or a text are members of one class.  An
    empty table gives no rows.  Sets are told apart by 128-bit digests, shingles by 64-bit hashes.
    """
    return JaccardJoin(docs, id_col, text_col, words, percent, sketch_bits).run(links)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  percent: int = PERCENT, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Every link between different shingle sets, once, by the sets' representatives.

    Returns ``doc_id_a, text_hash_a, copies_a`` and the same for b; ``copies`` documents have the set.
    The representative has the smallest id, a null one first.  Documents of one set are links of each
    other that are not listed.  Nulls, empty texts and repeated rows are taken as by ``jaccard_join``.
    """
    join = JaccardJoin(docs, id_col, text_col, words, percent, sketch_bits)
    _, whole, sets = join.classes_with_roots()
    links = join.component_links(join.linked_members(whole), sets, count=False)
    side = lambda x: whole.select(F.col("cid").alias(x), F.col("rep.doc_id").alias(f"doc_id_{x}"), F.col("rep.text_hash").alias(f"text_hash_{x}"), F.col("copies").alias(f"copies_{x}"))
    return links.join(side("a"), "a").join(side("b"), "b").drop("a", "b")
