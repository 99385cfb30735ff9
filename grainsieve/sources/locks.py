"""npm lock files as graphs: installed packages (nodes) and what each of them requires.

A node is known by its install path in the lock file: ``""`` is the project itself, ``packages/app`` a workspace,
``node_modules/a/node_modules/b`` a copy of ``b`` that only ``a`` and what lies below it see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.session import cut_lineage
from grainsieve.sources.manifests import NPM_SCOPES, file_name, npm_packages, project_of

NPM_LOCKS = ("package-lock.json", "npm-shrinkwrap.json")
MODULES = "node_modules/"
_ENTRY = "struct<name:string,version:string,link:boolean,resolved:string,dev:boolean,optional:boolean," + ",".join(
    f"{s}:map<string,string>" for s in NPM_SCOPES) + ">"
#: A nested entry of the older format: children stay text, and are read in the next round.
_NESTED = "version string, dev boolean, optional boolean, requires map<string,string>, dependencies map<string,string>"
ENTRY_COLUMNS = ("lock_path", "node", "name", "version", "link_to", "dev", "optional", "wants")


def is_importer(node: Column) -> Column:
    """The project itself or a workspace: nothing that was installed."""
    return ~F.rlike(node, F.lit(r"(^|/)node_modules(/|$)"))


def package_of(node: Column) -> Column:
    """The name that an install path gives to its package; a scope belongs to it."""
    return F.substring_index(node, MODULES, -1)


def _wants(maps: list[tuple[str, Column]]) -> Column:
    """Requirements of several kinds as an array of (kind, package, wanted)."""
    none = F.array().cast("array<struct<key:string,value:string>>")

    def of(kind: str, entries: Column) -> Column:
        # a function per kind: a second lambda argument would be the element's index
        return F.transform(F.coalesce(F.map_entries(entries), none), lambda e: F.struct(
            F.lit(kind).alias("kind"), e["key"].alias("package"), e["value"].alias("wanted")))

    return F.concat(*[of(kind, entries) for kind, entries in maps])


def _flat_entries(locks: DataFrame) -> DataFrame:
    parsed = locks.select("lock_path", F.explode(F.from_json("content", f"packages map<string,{_ENTRY}>")["packages"]).alias("node", "e"))
    return parsed.select(
        "lock_path", "node", "e.name", "e.version", F.when(F.col("e.link"), F.col("e.resolved")).alias("link_to"),
        F.coalesce("e.dev", F.lit(False)).alias("dev"), F.coalesce("e.optional", F.lit(False)).alias("optional"),
        _wants([(s, F.col(f"e.{s}")) for s in NPM_SCOPES]).alias("wants"),
    )


def _nested_entries(locks: DataFrame, files: DataFrame) -> DataFrame:
    """The older format: entries hold entries.  One round for each level, each over that level's rows only."""
    top = locks.withColumn("_j", F.from_json("content", "packages map<string,string>, dependencies map<string,string>"))
    old = top.filter(F.col("_j.packages").isNull() & F.col("_j.dependencies").isNotNull())
    level = old.select("lock_path", F.lit("").alias("parent"), F.explode("_j.dependencies").alias("name", "entry"))
    found = []
    while True:
        rows = cut_lineage(level.select(
            "lock_path", F.concat("parent", F.when(F.col("parent") == "", "").otherwise("/"), F.lit(MODULES), "name").alias("node"),
            F.from_json("entry", _NESTED).alias("e")))
        if rows.isEmpty():
            break
        found.append(rows)
        level = rows.select("lock_path", F.col("node").alias("parent"), F.explode("e.dependencies").alias("name", "entry"))
    no_name = F.lit(None).cast("string")
    # such a lock file does not say what the project itself requires: its manifest does
    asked = npm_packages(files).groupBy("project_path").agg(F.collect_list(
        F.struct(F.col("scope").alias("kind"), "package", F.col("declared_version").alias("wanted"))).alias("_w"))
    none = F.array().cast("array<struct<kind:string,package:string,wanted:string>>")
    roots = old.select("lock_path", project_of(F.col("lock_path")).alias("project_path")).join(asked, "project_path", "left")
    out = roots.select("lock_path", F.lit("").alias("node"), no_name.alias("name"), no_name.alias("version"), no_name.alias("link_to"),
                       F.lit(False).alias("dev"), F.lit(False).alias("optional"), F.coalesce("_w", none).alias("wants"))
    for rows in found:
        out = out.unionByName(rows.select(
            "lock_path", "node", no_name.alias("name"), "e.version", no_name.alias("link_to"), F.coalesce("e.dev", F.lit(False)).alias("dev"),
            F.coalesce("e.optional", F.lit(False)).alias("optional"), _wants([("dependencies", F.col("e.requires"))]).alias("wants")))
    return out


def lock_entries(files: DataFrame) -> DataFrame:
    """One row for each entry of each npm lock file: ``ENTRY_COLUMNS``; ``wants`` holds (kind, package, wanted).

    Files that are no JSON objects give no rows.  A null version is an entry without one (a workspace).
    """
    locks = files.filter(file_name(F.col("rel_path")).isin(*NPM_LOCKS)).select(F.col("rel_path").alias("lock_path"), "content")
    return _flat_entries(locks).unionByName(_nested_entries(locks, files))
