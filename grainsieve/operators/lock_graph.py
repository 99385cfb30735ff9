"""Dependency graphs of lock files: nearest-ancestor resolution, shortest paths, packages at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.text import let
from grainsieve.session import cut_lineage
from grainsieve.sources.locks import MODULES, is_importer, lock_entries, package_of
from grainsieve.sources.manifests import file_name, project_of

SEPARATOR = ">"
DEV_KINDS = ("devDependencies",)


def lookup_places(node: Column, package: Column) -> Column:
    """Where a package required by ``node`` may be installed, nearest first.

    Every folder on the way up is asked but ``node_modules`` folders themselves, which are never their own parents.
    """
    def places(parts: Column) -> Column:
        up = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.slice(parts, F.lit(1), n))
        up = F.filter(up, lambda p: (F.size(p) == 0) | (F.get(p, F.size(p) - 1) != "node_modules"))
        return F.transform(up, lambda p: F.concat(
            F.array_join(p, "/"), F.when(F.size(p) == 0, "").otherwise("/"), F.lit(MODULES), package))

    return let(F.filter(F.split(node, "/", -1), lambda p: p != ""), places)


def lock_edges(entries: DataFrame) -> DataFrame:
    """Every requirement of every entry with the node that satisfies it: one join on candidate places, no walk.

    ``lock_path, source, package, kind, wanted, target, version``; target and version are null where nothing is
    installed.  A link leads to the workspace that it names, whose version may be null.
    """
    key = ["lock_path", "source", "package", "kind", "wanted"]
    wanted = entries.select("lock_path", F.col("node").alias("source"), F.explode("wants").alias("w")).select("lock_path", "source", "w.*")
    asked = wanted.select(*key, F.posexplode_outer(lookup_places(F.col("source"), F.col("package"))).alias("up", "place"))
    installed = entries.select("lock_path", F.col("node").alias("place"), F.coalesce("link_to", "node").alias("target"), "version", F.lit(True).alias("held"))
    # one row for a requirement, which repeated ones share; a place that holds nothing is not counted, nor any place for a null wish
    held = F.when(F.col("held") & F.col("wanted").isNotNull(), F.col("up"))
    found = asked.join(installed, ["lock_path", "place"], "left").groupBy(*key).agg(
        F.min_by(F.struct("target", "version"), held).alias("n")).select(*key, "n.target", "n.version")
    versions = entries.filter(is_importer(F.col("node"))).select("lock_path", F.col("node").alias("target"), F.col("version").alias("own_version"))
    return found.join(versions, ["lock_path", "target"], "left").select(
        "lock_path", "source", "package", "kind", "wanted", "target", F.coalesce("version", "own_version").alias("version"))


def dependency_paths(edges: DataFrame) -> DataFrame:
    """The shortest way from every importer to every node that it reaches.

    ``lock_path, importer, target, package, version, kind, wanted, depth, names``: of equally short ways the one whose names
    sort first, of several requirements on its last step the one whose kind and wish sort first.  ``kind`` is that of
    the way's first step.  A frontier moves one step a round over the edges, so the rounds are as many as the longest
    shortest way; a cycle ends where it meets a node that was reached before.
    """
    steps = edges.filter(F.col("target").isNotNull())
    best = ["lock_path", "importer", "target"]
    rest = ["names", "kind", "wanted", "package", "version"]

    def settled(ways: DataFrame) -> DataFrame:
        return ways.groupBy(*best).agg(F.min(F.struct(*rest)).alias("w")).select(*best, "w.*")

    first = steps.filter(is_importer(F.col("source")) & (F.col("source") != F.col("target"))).select(
        "lock_path", F.col("source").alias("importer"), "target", F.array("package").alias("names"), "kind", "wanted", "package", "version")
    frontier = cut_lineage(settled(first).withColumn("depth", F.lit(1)))
    found, depth = [], 1
    while not frontier.isEmpty():
        found.append(frontier)
        seen = reduce(DataFrame.unionByName, [f.select(*best) for f in found])
        # what a workspace asks for in development concerns itself alone
        further = steps.filter(~(is_importer(F.col("source")) & F.col("kind").isin(*DEV_KINDS)))
        onward = further.select("lock_path", F.col("source").alias("at"), F.col("target").alias("to"), "package", "version", "wanted")
        here = frontier.select("lock_path", "importer", F.col("target").alias("at"), "names", "kind")
        ways = here.join(onward, ["lock_path", "at"]).filter(F.col("to") != F.col("importer")).select(
            "lock_path", "importer", F.col("to").alias("target"), F.concat("names", F.array("package")).alias("names"), "kind", "wanted", "package", "version")
        depth += 1
        frontier = cut_lineage(settled(ways).join(seen, best, "left_anti").withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, found, frontier)


def lock_packages(files: DataFrame) -> DataFrame:
    """Every package that a project reaches through its lock file, as package rows with ``dependency_path``.

    The project is the importer's folder; a package that it requires itself is direct, any other transitive.
    """
    edges = cut_lineage(lock_edges(cut_lineage(lock_entries(files))))
    paths = dependency_paths(edges)
    base = project_of(F.col("lock_path"))
    project = F.when(F.col("importer") == "", base).when(base == ".", F.col("importer")).otherwise(F.concat(base, F.lit("/"), "importer"))
    return paths.select(
        F.lit("npm").alias("ecosystem"), project.alias("project_path"), F.col("lock_path").alias("manifest_path"), F.col("kind").alias("scope"),
        "package", F.col("wanted").alias("declared_version"), F.coalesce("version", F.lit("")).alias("resolved_version"),
        file_name(F.col("lock_path")).alias("version_source"), F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("relationship"),
        F.array_join("names", SEPARATOR).alias("dependency_path"),
    )


def with_transitive(resolved: DataFrame, locked: DataFrame) -> DataFrame:
    """Declared packages and the transitive ones of lock files, all with ``dependency_path``.

    A declared npm package takes the version that its own project's lock file gives it: the nearest copy, in a workspace
    its own one.  Where a project has several lock files, the file name that sorts first decides.
    """
    own = locked.filter(F.col("relationship") == "direct").groupBy("project_path", "package").agg(
        F.min(F.struct("version_source", "resolved_version")).alias("_l"))
    npm = resolved.filter(F.col("ecosystem") == "npm").join(own, ["project_path", "package"], "left").select(
        *[F.coalesce(f"_l.{c}", F.col(c)).alias(c) if c in ("resolved_version", "version_source") else F.col(c) for c in resolved.columns])
    declared = npm.unionByName(resolved.filter(F.col("ecosystem") != "npm")).withColumn("dependency_path", F.col("package"))
    return declared.unionByName(locked.filter(F.col("relationship") == "transitive"))
