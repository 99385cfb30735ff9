"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their length and first bytes, then by ever longer runs of the following
bytes, until a group has one member or its texts have ended.  Members of a group agree in every
byte read so far, so texts that end together are equal; no digest decides anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grainsieve.llm.tables import Workspace, field, text_or_empty

#: Bytes of the first digit, and how many times longer each further digit is.
FIRST_BYTES = 64
GROWTH = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
                first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """Mark one document of each set of equal texts as kept: the one with the largest id.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every row, and with ``carry``
    also ``row``, a struct of all input columns.  A null text is empty (in ``row`` it stays null); a
    null id is smaller than any other; of rows that repeat an id and a text exactly one is kept.  An
    empty table gives an empty result, and columns of any name may be present.

    Every round is an aggregation, which merges a hot group before its shuffle, and a join with its
    written result, whose hot keys adaptive execution splits.  Only groups of two or more go on, with
    the bytes that are not read yet, so the rounds are few: digits grow by ``growth``.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    # a carried text moves once: as the body that is read, with the other columns beside it
    once = carry and docs.schema[text_col].dataType == StringType()
    beside = [field(c) for c in docs.columns if not (once and c == text_col)]
    row = F.struct(*beside) if carry and beside else F.lit(None).cast("string")
    body = field(text_col) if once else text_or_empty(text_col).cast("binary")
    unread = F.coalesce(F.col("body").cast("binary"), F.lit(bytearray()))
    rows = docs.select(
        field(id_col).alias("doc_id"), row.alias("row"), body.alias("body"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"),
    ).withColumns({"size": F.octet_length(unread).cast("long"), "head": F.substring(unread, 1, first_bytes)})
    groups = space.write(rows.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    joined = rows.join(groups.hint("merge"), ["size", "head"], "left")
    open_ = F.col("n").isNotNull()
    state = space.write(joined.select(
        "doc_id", "row", "text_sha256", F.col("size").alias("group"), open_.alias("open"),
        F.monotonically_increasing_id().alias("uid"), (F.col("body") if once else F.when(open_, unread)).alias("body"),
        F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
    ), "round0")
    results = ["doc_id", "row", "keep_id", "group_size", "kept", "text_sha256", *(["body"] if once else [])]
    done = [state.where(~F.col("open")).select(*results)]
    # the first digit repeats the head, so the bytes of a round always start where the last one ended
    read, width, turn = 0, first_bytes * growth, 1
    while not state.where("open").isEmpty():
        part = state.where("open").withColumn("digit", F.substring(unread, read + 1, width))
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "uid")).alias("best")
        groups = space.write(
            part.groupBy("group", "digit").agg(F.count("*").alias("n"), best).where("n > 1")
            .select("group", "digit", "n", F.col("best.doc_id").alias("best_id"), F.col("best.uid").alias("best_uid")),
            f"groups{turn}",
        )
        same = F.col("n").isNotNull()
        open_ = same & (F.octet_length(unread) > read + width)
        rest = F.col("body") if once else F.when(open_, F.substring(unread, F.lit(width + 1), F.octet_length(unread)))
        state = space.write(part.join(groups.hint("merge"), ["group", "digit"], "left").select(
            "doc_id", "row", "text_sha256", F.coalesce("best_uid", "uid").alias("group"), open_.alias("open"), "uid", rest.alias("body"),
            F.when(same, F.col("best_id")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (~same | (F.col("uid") == F.col("best_uid"))).alias("kept"),
        ), f"round{turn}")
        done.append(state.where(~F.col("open")).select(*results))
        read, width, turn = read + width if once else 0, width * growth, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    if once:
        whole = [F.col("body").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
        out = out.withColumn("row", F.struct(*whole)).drop("body")
    return out if carry else out.drop("row")
