"""Prefix trie of conversations by composable fingerprints.

The fingerprint of a sequence of turns is an element of a monoid, (length, sum of v_i * B^i in four
prime fields), so the fingerprint of a sequence of two parts comes from those of the parts.  A rebuilt
conversation is a head of its base conversation and a suffix of its own turns; the fingerprints of all of
its prefixes are combined from the prefix sums of both, and no rebuilt text ever exists.

Equality rests on stored turns, not on fingerprints: each prefix holds the class of its last turn and the
fingerprint of the prefix before.  Classes are compared by their stored texts, and a group of prefixes by the
references of its members, so that equal groups are equal sequences by induction over the depth.  Where a
comparison fails, all fingerprints are drawn anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.llm.tables import Workspace, field, text_or_empty

#: The field of a fingerprint's lane, and how many lanes there are.
PRIME = (1 << 31) - 1
LANES = 4
#: Turns of a base conversation's head at most, and how many conversations share a base.
HEADS = 6
BASE = 100
#: Turns of one conversation that one key of a join or a window may hold.
SLICE = 1 << 16
#: Turns of one range of the sorted table.
RANGE_TURNS = 500_000
ATTEMPTS = 5


def bases(attempt: int) -> list[int]:
    """The base of each lane; another set for each attempt."""
    return [int(b) for b in np.random.default_rng(7 + attempt).integers(1 << 20, PRIME - 1, LANES)]


def times(a: Column, b: Column | int) -> Column:
    return a * b % PRIME


def powers(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at in the field, for any non-negative exponents, 16 bits of them at a time."""
    out, rest, step = np.ones(len(at), dtype=np.uint64), at.astype(np.uint64), base
    while rest.any():
        most = min(int(rest.max()), (1 << 16) - 1)
        table = np.ones(most + 1, dtype=np.uint64)
        filled = 1
        while filled <= most:  # each round doubles the filled part
            more = min(filled, most + 1 - filled)
            table[filled : filled + more] = table[:more] * np.uint64(pow(step, filled, PRIME)) % PRIME
            filled += more
        out = out * table[(rest & np.uint64(0xFFFF)).astype(np.int64)] % PRIME
        rest >>= np.uint64(16)
        step = pow(step, 1 << 16, PRIME)
    return out


def combine(left: tuple[int, list[int]], right: tuple[int, list[int]], lane_bases: list[int]) -> tuple[int, list[int]]:
    """The fingerprint of a sequence from those of its two parts."""
    (m, a), (n, b) = left, right
    return m + n, [(x + pow(base, m, PRIME) * y) % PRIME for x, y, base in zip(a, b, lane_bases, strict=True)]


def lanes_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy().astype(np.uint64) for n in names])


def positions(turns: DataFrame, space: Workspace, lane_bases: list[int], ranges: int) -> DataFrame:
    """Each turn's place in its conversation (from 1) and the fingerprints of the turns before it and up to it.

    The table is sorted into ranges that may cut a conversation; a task makes the running products of its range
    in a stream, and products of the few conversations that cross a border are composed from the ranges' own.
    """
    values, sums, before = ([f"{x}{k}" for k in range(LANES)] for x in "vsp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, last, length, carry = None, None, 0, np.zeros(LANES, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = conv[0] if first is None else first
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(conv))))
            goes_on = conv[0] == last
            place = np.arange(len(conv)) - starts[run_of] + 1 + np.where((run_of == 0) & goes_on, length, 0)
            arrays = []
            for k, value in enumerate(lanes_of(batch, values)):
                term = value * powers(lane_bases[k], place) % PRIME
                total = np.cumsum(term)
                own = total - (total - term)[starts][run_of]
                if goes_on:
                    own[run_of == 0] += carry[k]
                own %= PRIME
                arrays += [own.astype(np.int64), ((own + np.uint64(PRIME) - term) % PRIME).astype(np.int64)]
                carry[k] = own[-1]
            last, length = conv[-1], int(place[-1])
            columns = [*[batch.column(n) for n in ("conv_id", "a", "b", "chars")], pa.array(place, pa.int64()),
                       *map(pa.array, arrays), pa.array(np.full(len(conv), part)), pa.array(conv == first)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "a", "b", "chars", "place", *[n for pair in zip(sums, before, strict=True) for n in pair], "part", "leads"])

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "start", "a", "b", "uid"]
    schema = "conv_id bigint, a bigint, b bigint, chars bigint, place bigint, "
    schema += "".join(f"s{k} bigint, p{k} bigint, " for k in range(LANES)) + "part bigint, leads boolean"
    local = space.write(turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                        .select("conv_id", "a", "b", "chars", *values).mapInArrow(run, schema), "local")
    # of each range, the products of the conversations that may go on in the next one: its first and its last
    totals = local.groupBy("part", "conv_id").agg(F.max_by(F.struct("place", *sums), "place").alias("t"), F.max("leads").alias("leads"))
    ends = local.groupBy("part").agg(F.max("conv_id").alias("conv_id"))
    edges = totals.join(ends.withColumn("ends", F.lit(True)), ["part", "conv_id"], "left").where(F.col("leads") | F.col("ends")).select("conv_id", "part", "t.*")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rows, so_far = [], (0, [0] * LANES)
        for row in part.sort_values("part").itertuples():
            rows.append((row.conv_id, row.part, so_far[0], *so_far[1]))
            so_far = combine(so_far, (row.place, [getattr(row, n) for n in sums]), lane_bases)
        return pd.DataFrame(rows, columns=["conv_id", "part", "m", *[f"c{k}" for k in range(LANES)]])

    # at most two rows of each range, one group for each conversation that starts or ends one
    carried = edges.groupBy("conv_id").applyInPandas(fold, "conv_id bigint, part bigint, m bigint, " + ", ".join(f"c{k} bigint" for k in range(LANES)))
    carried = space.write(carried.where("m > 0"), "carried")

    @F.arrow_udf("array<bigint>")
    def shifts(m: pa.Array) -> pa.Array:
        own = m.to_numpy()
        flat = np.stack([powers(b, own) for b in lane_bases], axis=1).astype(np.int64).ravel()
        return pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * LANES, pa.array(flat))

    carried = carried.withColumn("shift", shifts("m"))
    joined = local.join(carried, ["part", "conv_id"], "left")
    moved = {"place": F.col("place") + F.coalesce("m", F.lit(0))}
    for k in range(LANES):
        for n in (f"s{k}", f"p{k}"):
            moved[n] = F.when(F.col("m").isNull(), F.col(n)).otherwise((F.col(f"c{k}") + times(F.col(n), F.col("shift")[k])) % PRIME)
    return joined.select("conv_id", "a", "b", "chars", *[c.alias(n) for n, c in moved.items()])


def packed(lanes: list[Column]) -> tuple[Column, Column]:
    """Four lanes in two numbers."""
    return tuple(lanes[2 * i] * (PRIME + 1) + lanes[2 * i + 1] for i in range(2))


def rebuilt_prefixes(placed: DataFrame, space: Workspace, lane_bases: list[int]) -> DataFrame:
    """One row for each prefix of each rebuilt conversation, the empty one among them.

    ``conv_id, depth``, the prefix's fingerprint ``f0, f1``, that of the prefix before ``g0, g1``, the last turn's
    class ``a, b`` and length, and whether the conversation ends there.
    """
    sums = [f"s{k}" for k in range(LANES)]
    head = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % BASE
    # what a conversation gives to its rebuilt form: its number of turns and the fingerprint of those it drops
    own = placed.groupBy("conv_id").agg(
        F.max("place").alias("n"), F.max(F.when(F.col("place") == head, F.struct(*sums))).alias("dropped"))
    # what a base gives: at most HEADS - 1 turns
    stored = F.struct("place", *sums, *[f"p{k}" for k in range(LANES)], "a", "b", "chars")
    heads = placed.where((F.col("conv_id") % BASE == 0) & (F.col("place") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(stored)).alias("turns"))
    convs = own.withColumn("h", head).withColumn("base", base).join(heads, "base", "left").select(
        "conv_id", "n", "h", "dropped", F.slice(F.coalesce("turns", F.array()), F.lit(1), F.col("h").cast("int")).alias("turns"))
    convs = space.write(convs.withColumn("k", F.size("turns").cast("long")), "conversations")
    tops = [F.coalesce(F.get("turns", F.size("turns") - 1)[s], F.lit(0).cast("long")) for s in sums]
    ends = convs.select(
        "conv_id", "n", "h", "k", *[t.alias(f"t{i}") for i, t in enumerate(tops)],
        *[F.coalesce(F.col("dropped")[s], F.lit(0)).alias(f"d{i}") for i, s in enumerate(sums)],
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SLICE))).alias("slice")).where("n > h")
    joined = placed.withColumn("slice", F.floor(F.col("place") / SLICE)).join(ends, ["conv_id", "slice"]).where(F.col("place") > F.col("h"))

    def after_head(name: str) -> list[Column]:
        # B^(k - h) moves the own turns from behind h turns to behind the k that the base has; k <= h < HEADS
        out = []
        for i, b in enumerate(lane_bases):
            back = F.array(*[F.lit(pow(pow(b, -1, PRIME), d, PRIME)).cast("long") for d in range(HEADS)])
            rest = (F.col(f"{name}{i}") - F.col(f"d{i}") + PRIME) % PRIME
            out.append((F.col(f"t{i}") + times(rest, back[(F.col("h") - F.col("k")).cast("int")])) % PRIME)
        return out

    names = ["f0", "f1", "g0", "g1"]
    suffixes = joined.select("conv_id", (F.col("k") + F.col("place") - F.col("h")).alias("depth"),
                             *[c.alias(n) for n, c in zip(names, [*packed(after_head("s")), *packed(after_head("p"))], strict=True)],
                             "a", "b", "chars", (F.col("place") == F.col("n")).alias("ends"))
    one = convs.select("conv_id", "n", "h", "k", F.explode("turns").alias("t"))
    lanes = [packed([F.col(f"t.{x}{k}") for k in range(LANES)]) for x in "sp"]
    shared = one.select("conv_id", F.col("t.place").alias("depth"), *[c.alias(n) for n, c in zip(names, [*lanes[0], *lanes[1]], strict=True)],
                        "t.a", "t.b", "t.chars", ((F.col("t.place") == F.col("k")) & (F.col("n") <= F.col("h"))).alias("ends"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), *[zero.alias(n) for n in [*names, "a", "b", "chars"]],
                         ((F.col("k") == 0) & (F.col("n") <= F.col("h"))).alias("ends"))
    return space.write(suffixes.unionByName(shared).unionByName(roots), "prefixes")


def end_digests(prefixes: DataFrame, tasks: int) -> DataFrame:
    """SHA-256 of the ids that end at each node, in a stream over sorted rows; no list of ids is ever held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def close(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])],
                                              ["depth", "f0", "f1", "ends_sha256"])

        for batch in batches:
            done = []
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.empty(0, dtype=np.int64)
            ids = batch.column(3).to_pylist()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                key = tuple(keys[s].tolist())
                text = ",".join(map(str, ids[s:e]))
                if key == now:
                    state.update(f",{text}".encode())
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.encode())
            yield close(done)
        if now is not None:
            yield close([(*now, state.hexdigest())])

    key = ["depth", "f0", "f1"]
    rows = prefixes.where("ends").select(*key, "conv_id").repartition(tasks, *key).sortWithinPartitions(*key, "conv_id")
    return rows.mapInArrow(run, "depth bigint, f0 bigint, f1 bigint, ends_sha256 string")


def hashed_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, attempt: int) -> DataFrame:
    """Turns as numbers: a class of two hashes, a value below the prime for each lane, a length, and what orders ties."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    hash_of = lambda k: F.xxhash64(F.lit(k + 100 * attempt), role, text)
    return conversations.where(field(id_col).isNotNull()).select(
        field(id_col).cast("long").alias("conv_id"), field(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, 32).alias("start"),
        hash_of(0).alias("a"), hash_of(1).alias("b"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("uid"),
        *[(F.pmod(hash_of(2 + k), F.lit(PRIME - 1)) + 1).alias(f"v{k}") for k in range(LANES)])


def same_texts(conversations: DataFrame, role_col: str, text_col: str, attempt: int) -> bool:
    """Whether all stored turns of a class are equal, role by role and text by text."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    stored = conversations.select(F.xxhash64(F.lit(100 * attempt), role, text).alias("a"), F.xxhash64(F.lit(100 * attempt + 1), role, text).alias("b"),
                                  F.struct(role.alias("role"), text.alias("text")).alias("turn"))
    return stored.groupBy("a", "b").agg((F.min("turn") != F.max("turn")).alias("differ")).where("differ").isEmpty()


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", range_turns: int = RANGE_TURNS, first_attempt: int = 0) -> DataFrame:
    """The trie of all rebuilt conversations, one row for each node.

    A conversation is rebuilt from the first h turns of its base (its id less its last two digits) and its own turns
    after its first h, h being crc32 of its id modulo 6.  Returns ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by number, nulls first; equal numbers by role, then by the first 32 characters of the text, then
    by a hash of it.  Repeated rows are turns of their own.  A null role or text is empty; rows without an id take no
    part; a base without rows gives no turns.  An empty table gives no rows, not even a root.  Other columns play no part.

    Texts are hashed where they are read and compared once; everything later is numbers.  A long conversation is cut
    into ranges or slices wherever its turns meet; counts of hot nodes merge before the shuffle.  Sums over subtrees need no
    walk: each node hands its weight to its smallest member, and a node sums what its members carry.
    """
    spark = conversations.sparkSession
    space = Workspace(spark, "conversation-trie")
    rows = conversations.where(field(id_col).isNotNull()).count()
    ranges = max(1, -(-rows // range_turns), min(spark.sparkContext.defaultParallelism, -(-rows // 10_000)))
    key = ["depth", "f0", "f1"]
    for attempt in range(first_attempt, first_attempt + ATTEMPTS):
        if not same_texts(conversations, role_col, text_col, attempt):
            continue
        lane_bases = bases(attempt)
        turns = hashed_turns(conversations, id_col, turn_col, role_col, text_col, attempt)
        part = Workspace(spark, f"conversation-trie-{attempt}")
        prefixes = rebuilt_prefixes(positions(turns, part, lane_bases, ranges), part, lane_bases)
        before, last = F.struct("g0", "g1"), F.struct("a", "b")
        nodes = space.write(prefixes.groupBy(*key).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("g0").alias("g0"), F.max("g1").alias("g1"),
            F.max("chars").alias("chars"), ((F.min(before) != F.max(before)) | (F.min(last) != F.max(last))).alias("differ")), f"nodes{attempt}")
        if nodes.where("differ").isEmpty():
            break
    else:
        raise RuntimeError("no set of fingerprints told all prefixes apart")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g0").alias("f0"), F.col("g1").alias("f1")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = space.write(counted.withColumn("weight", F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).cast("long"))
                          .withColumn("slice", F.floor(F.col("depth") / SLICE)).drop("differ", "chars"), "counted")
    # weights below a node on the path of its smallest member: within a slice, and those of later slices
    by_slice = counted.groupBy("conv_id", "slice").agg(F.sum("weight").alias("w"), F.max("depth").alias("deepest"),
                                                       F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min("depth").alias("highest"))
    along = Window.partitionBy("conv_id").orderBy(F.desc("slice"))
    paths = space.write(by_slice.select("conv_id", "slice", "deepest", "highest", "leaf", "w", (F.sum("w").over(along) - F.col("w")).alias("later")), "paths")
    down = Window.partitionBy("conv_id", "slice").orderBy(F.desc("depth"))
    own = counted.join(paths.select("conv_id", "slice", "later"), ["conv_id", "slice"]).select(
        *key, "conv_id", "n_convs", "n_children", "g0", "g1", (F.sum("weight").over(down) + F.col("later")).alias("own"))

    # what a member brings to every node above those that it stands for
    brought = paths.groupBy("conv_id").agg(F.sum("w").alias("w"), F.max("leaf").alias("leaf"), F.max("deepest").alias("deepest"), F.min("highest").alias("highest"))
    spread = brought.where("w > 0 OR leaf > 0").select(
        "conv_id", "w", "leaf", "highest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("deepest") / SLICE))).alias("slice"))
    members = prefixes.select(*key, "conv_id", F.floor(F.col("depth") / SLICE).alias("slice")).join(spread, ["conv_id", "slice"])
    above = members.groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < F.col("highest"), F.col("w")).otherwise(0)).alias("more"))

    # below the first node that a conversation stands for, the node before is its own
    first = brought.select(F.col("conv_id").alias("of"), F.col("highest").alias("top"))
    tops = counted.join(first, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("top"))).where("depth > 0").select(
        F.col("conv_id").alias("of"), "depth", F.col("g0").alias("h0"), F.col("g1").alias("h1"))
    parents = counted.where("n_children > 0").select(F.col("conv_id").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("f0").alias("h0"), F.col("f1").alias("h1"))
    branch = tops.join(parents, ["depth", "h0", "h1"]).select(F.col("of").alias("conv_id"), "depth", "parent")

    digests = end_digests(prefixes, ranges)
    found = own.join(above, key, "left").join(digests, key, "left").join(branch, ["conv_id", "depth"], "left")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"), (F.col("own") + F.coalesce("more", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
