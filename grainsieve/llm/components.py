"""Connected components of a table of links by contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.tables import Workspace


def components(space: Workspace, links: DataFrame, name: str = "components") -> DataFrame:
    """``id, root`` for every end of ``links`` (columns ``a, b``); the root is the smallest id of its component.

    Each round hooks every node to its smallest neighbour and contracts the links by it, so the number
    of links falls by a factor and a chain needs a logarithmic number of rounds.
    """
    links = space.write(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links0")
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = None
    turn = 0
    while not links.isEmpty():
        hooks = space.write(both(links).groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("to")), f"{name}-hooks{turn}")
        jump = hooks.select(F.col("id").alias("to"), F.col("to").alias("further"))
        hooks = space.write(hooks.join(jump, "to").select("id", F.col("further").alias("to")), f"{name}-jumps{turn}")
        if roots is None:
            roots = hooks.select("id", F.col("to").alias("root"))
        else:
            moved = hooks.select(F.col("id").alias("root"), "to")
            roots = space.write(roots.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")), f"{name}-roots{turn}")
        left = hooks.select(F.col("id").alias("a"), F.col("to").alias("p"))
        right = hooks.select(F.col("id").alias("b"), F.col("to").alias("q"))
        links = space.write(
            links.join(left, "a").join(right, "b").where("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(),
            f"{name}-links{turn + 1}")
        turn += 1
    if roots is None:
        roots = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots
