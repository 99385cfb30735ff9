"""Lock files as graphs: resolution, paths and packages against hand-made and brute-force results."""

import json
import random

from pyspark.sql import functions as F

from grainsieve.operators.lock_graph import dependency_paths, lock_edges, lock_packages, lookup_places, with_transitive
from grainsieve.operators.packages import match_advisories, resolve_packages
from grainsieve.session import cut_lineage
from grainsieve.sources.corpus import files_from_table
from grainsieve.sources.intel import advisory_ranges
from grainsieve.sources.locks import lock_entries
from grainsieve.sources.manifests import extract_locks, extract_packages


def files(spark, contents):
    rows = [(path, text if isinstance(text, str) else json.dumps(text)) for path, text in contents.items()]
    return files_from_table(spark.createDataFrame(rows, "p string, t string"), "p", "t")


def places(node, package):
    """Where the module loader looks, by walking up folder by folder."""
    out, parts = [], [p for p in node.split("/") if p]
    while True:
        if not parts or parts[-1] != "node_modules":
            out.append("/".join([*parts, "node_modules", package]))
        if not parts:
            return out
        parts.pop()


def shortest(packages):
    """{(importer, node): names} by breadth-first search, names in order."""
    def wants(node, first):
        kinds = ["dependencies", "peerDependencies", "optionalDependencies"] + (["devDependencies"] if first else [])
        for package in sorted({p for k in kinds for p in packages[node].get(k, {})}):
            for place in places(node, package):
                if place in packages:
                    entry = packages[place]
                    yield package, entry["resolved"] if entry.get("link") else place
                    break

    out = {}
    for importer in [n for n in packages if "node_modules" not in n.split("/")]:
        found, frontier = {importer: ()}, {importer: ()}
        while frontier:
            ways = {}
            for node, names in frontier.items():
                for package, target in wants(node, node == importer):
                    if target not in found:
                        ways[target] = min(ways.get(target, (*names, package)), (*names, package))
            found |= ways
            frontier = ways
        out |= {(importer, node): names for node, names in found.items() if node != importer}
    return out


def random_lock(rng):
    names = ["a", "b", "@s/c", "d", "e"]
    nodes = ["", "packages/w"]
    for _ in range(14):
        parent = rng.choice(nodes)
        place = f"{parent}/node_modules/{rng.choice(names)}".lstrip("/")
        if place not in nodes:
            nodes.append(place)
    packages = {}
    for node in nodes:
        entry = {} if "node_modules" not in node else {"version": f"{rng.randrange(9)}.0.0"}
        for kind in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            if kind != "devDependencies" or "node_modules" not in node:
                chosen = rng.sample(names, rng.randrange(0, 3))
                if chosen:
                    entry[kind] = {c: f"^{rng.randrange(9)}" for c in chosen}
        packages[node] = entry
    packages["node_modules/w"] = {"link": True, "resolved": "packages/w"}
    packages[""].setdefault("dependencies", {})["w"] = "*"
    return packages


def test_paths_of_random_locks(spark):
    rng = random.Random(5)
    locks = {f"p{i}/package-lock.json": {"lockfileVersion": 3, "packages": random_lock(rng)} for i in range(12)}
    rows = dependency_paths(lock_edges(lock_entries(files(spark, locks)))).collect()
    got = {(r.lock_path, r.importer, r.target): tuple(r.names) for r in rows}
    want = {(path, importer, node): names for path, lock in locks.items() for (importer, node), names in shortest(lock["packages"]).items()}
    assert got == want and len(rows) == len(got) and all(r.depth == len(r.names) for r in rows)


def test_lookup_places(spark):
    cases = ["", "node_modules/a", "node_modules/@s/u/node_modules/b", "packages/app", "packages/lib/node_modules/q"]
    frame = spark.createDataFrame([(c,) for c in cases], "node string").select("node", lookup_places(F.col("node"), F.lit("x")).alias("places"))
    assert {r.node: r.places for r in frame.collect()} == {c: places(c, "x") for c in cases}


def test_two_versions_cycle_and_older_format(spark):
    new = {"packages": {
        "": {"dependencies": {"express": "^4", "qs": "6.5.2"}}, "node_modules/qs": {"version": "6.5.2"},
        "node_modules/express": {"version": "4.0.0", "dependencies": {"qs": "6.5.1", "loop": "1"}},
        "node_modules/express/node_modules/qs": {"version": "6.5.1"}, "node_modules/loop": {"version": "1.0.0", "dependencies": {"express": "*", "gone": "1"}}}}
    old = {"dependencies": {
        "express": {"version": "4.0.0", "requires": {"qs": "6.5.1"}, "dependencies": {"qs": {"version": "6.5.1"}}}, "qs": {"version": "6.5.2"}}, "requires": True}
    corpus = files(spark, {"n/package-lock.json": new, "o/package-lock.json": old, "o/package.json": {"dependencies": {"express": "^4", "qs": "6.5.2"}},
                           "broken/package-lock.json": "{", "empty/package-lock.json": {}, "list/package-lock.json": "[1]"})
    rows = {(r.project_path, r.package, r.resolved_version, r.relationship, r.dependency_path) for r in lock_packages(corpus).collect()}
    both = {(p, "express", "4.0.0", "direct", "express") for p in "no"} | {(p, "qs", "6.5.2", "direct", "qs") for p in "no"} | {
        (p, "qs", "6.5.1", "transitive", "express>qs") for p in "no"}
    assert rows == both | {("n", "loop", "1.0.0", "transitive", "express>loop")}


def test_advisories_reach_transitive_packages(spark):
    lock = {"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1.0.0", "dependencies": {"lodash": "^4"}},
                         "node_modules/lodash": {"version": "4.17.11"}, "packages/w": {"dependencies": {"lodash": "^3"}},
                         "packages/w/node_modules/lodash": {"version": "3.0.0"}}}
    corpus = files(spark, {"package-lock.json": lock, "package.json": {"dependencies": {"a": "1"}}, "packages/w/package.json": {"dependencies": {"lodash": "^3"}}})
    packages = with_transitive(resolve_packages(extract_packages(corpus), extract_locks(corpus)), lock_packages(corpus))
    advisory = spark.createDataFrame([("A1", "npm", "lodash", "HIGH", "t", "d", ["<4.17.20"], "4.17.20")],
                                     "id string, ecosystem string, package string, severity string, title string, description string, affected_versions array<string>, fixed_version string")
    empty = F.array().cast("array<string>")
    found = match_advisories(packages, advisory_ranges(advisory.withColumns({"aliases": empty, "cwe": empty, "references": empty, "source": F.lit("s")})))
    got = {(r.project_path, r.version, r.relationship, r.reachability, r.dependency_path) for r in found.collect()}
    assert got == {(".", "4.17.11", "transitive", "indirect", "a>lodash"), ("packages/w", "3.0.0", "direct", "direct", "lodash")}


def test_a_requirement_meets_its_places_once(spark):
    lock = {"lockfileVersion": 3, "packages": {
        "": {"dependencies": {"a": "1", "gone": "1", "null": None}}, "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "2"}},
        "node_modules/a/node_modules/b": {"version": "2.0.0"}, "node_modules/b": {"version": "1.0.0"}, "node_modules/null": {"version": "1.0.0"}}}
    one = files(spark, {"x/package-lock.json": lock})
    edges = lock_edges(lock_entries(one.unionByName(one)))  # a file that is there twice gives its requirements once
    assert sorted((r.source, r.package, r.target, r.version) for r in edges.collect()) == [
        ("", "a", "node_modules/a", "1.0.0"), ("", "gone", None, None), ("", "null", None, None),
        ("node_modules/a", "b", "node_modules/a/node_modules/b", "2.0.0")]
    # requirements meet places and workspaces' versions, and are not joined with their own result
    plan = lock_edges(cut_lineage(lock_entries(one)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
