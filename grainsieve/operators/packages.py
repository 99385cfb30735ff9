"""Package joins: lock resolution, frameworks, advisories, compromised versions, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.functions.fingerprint import dependency_fingerprint
from grainsieve.functions.versions import clean_version, first_number, is_exact, version_key
from grainsieve.operators.rule_scan import FINDING_COLUMNS
from grainsieve.session import cut_lineage

#: Places of versions that one row of a range may name.
RANK_BLOCK = 4096
#: Matches that one task makes, as long as there are no more tasks than these.
TASK_MATCHES = 1 << 18
MOST_TASKS = 2048

# Package -> framework label.
FRAMEWORK_PACKAGES = {
    "next": "Next.js", "nuxt": "Nuxt", "react": "React", "react-dom": "React", "vue": "Vue",
    "pinia": "Vue", "@angular/core": "Angular", "express": "Express",
}


def resolve_packages(declared: DataFrame, locks: DataFrame) -> DataFrame:
    """Declared npm packages with the locked version where one exists."""
    locked = locks.groupBy("project_path", "package").agg(
        F.min_by(F.struct("locked_version", "version_source"), F.col("version_source")).alias("_l")
    )
    npm = declared.filter(F.col("ecosystem") == "npm").join(locked, ["project_path", "package"], "left").select(
        *declared.columns, F.coalesce("_l.locked_version", F.lit("")).alias("resolved_version"),
        F.coalesce("_l.version_source", F.lit("")).alias("version_source"),
    )
    other = declared.filter(F.col("ecosystem") != "npm").withColumns({"resolved_version": F.lit(""), "version_source": F.lit("")})
    return npm.unionByName(other)


def with_match_version(packages: DataFrame) -> DataFrame:
    """Add ``version``: the resolved one, else an exact declared one, else null."""
    resolved = F.coalesce("resolved_version", F.lit(""))
    return packages.withColumn(
        "version",
        F.when(resolved != "", clean_version(resolved)).when(is_exact(F.col("declared_version")), clean_version(F.col("declared_version"))),
    )


def detect_frameworks(packages: DataFrame) -> DataFrame:
    """(framework, slug, package_count): package rows per framework label."""
    table = F.create_map(*[F.lit(x) for kv in FRAMEWORK_PACKAGES.items() for x in kv])
    return (
        packages.select(F.try_element_at(table, F.col("package")).alias("framework"))
        .filter(F.col("framework").isNotNull())
        .groupBy("framework").agg(F.count("*").alias("package_count"))
        .withColumn("slug", F.regexp_replace(F.lower("framework"), "[^a-z0-9]", ""))
    )


def version_runs(triples: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The place of every version in its package's order, and every range as a run of places, by a sweep.

    ``triples`` has distinct (ecosystem, package, version).  Versions and the ranges' two bounds are events of one ordered
    window, whose running count says how many versions lie before a bound; a range is then a run of the versions'
    places (``first`` to ``last``).  The windows are split by the versions' first number, so a package with many
    versions spreads over several.
    """
    key = ["ecosystem", "package"]
    one = ranges.select(*key, "advisory_id", "range_no", "lo", "lo_inclusive", "hi", "hi_inclusive")
    # a bound shared by many ranges is one event; bounds of packages that nobody has drop out by the join below
    bound = lambda at, after: one.filter(F.col(at).isNotNull()).select(*key, F.col(at).alias("text"), after.cast("int").alias("turn"))
    after_lo, after_hi = ~F.coalesce("lo_inclusive", F.lit(True)), F.coalesce("hi_inclusive", F.lit(False))
    bounds = bound("lo", after_lo).unionByName(bound("hi", after_hi)).distinct().select(*key, "text", (F.col("turn") * 2).alias("turn"))
    # at one place in the order: bounds that stand before equal versions, the versions, bounds behind them
    events = triples.select(*key, F.col("version").alias("text"), F.lit(1).alias("turn")).unionByName(bounds)
    keyed = cut_lineage(events.withColumn("sort", version_key(F.col("text"))).withColumn("part", first_number(F.col("sort"))))
    here = Window.partitionBy(*key, "part").orderBy("sort", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    versions = F.count_if(F.col("turn") == 1)
    totals = keyed.groupBy(*key, "part").agg(versions.alias("n"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counted = keyed.select(*key, "part", "text", "turn", versions.over(here).alias("own")).join(before, [*key, "part"])
    places = cut_lineage(counted.select(*key, "text", "turn", (F.col("own") + F.col("before")).alias("place")))

    at = lambda x: places.filter(F.col("turn") != 1).select(
        *key, F.col("text").alias(x), (F.col("turn") / 2).cast("int").alias(f"{x}_after"), F.col("place").alias(f"{x}_place"))
    count = totals.groupBy(*key).agg(F.sum("n").alias("n")).filter("n > 0")
    runs = one.join(count, key).withColumns({"lo_after": after_lo.cast("int"), "hi_after": after_hi.cast("int")})
    runs = runs.join(at("lo"), [*key, "lo", "lo_after"], "left").join(at("hi"), [*key, "hi", "hi_after"], "left").select(
        *key, "advisory_id", "range_no", (F.coalesce("lo_place", F.lit(0)) + 1).alias("first"), F.coalesce("hi_place", "n").alias("last")).filter("first <= last")
    return places.filter(F.col("turn") == 1).select(*key, F.col("text").alias("version"), "place"), runs


def _places(runs: DataFrame, block: int, tasks: int | None = None) -> DataFrame:
    """One row for each place of a run, ``first`` to ``last``; a long run is cut into blocks of places, dealt to ``tasks``."""
    number = F.lit(block)
    blocks = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / number), F.floor(F.col("last") / number))))
    blocks = blocks if tasks is None else blocks.repartition(tasks)
    place = F.explode(F.sequence(F.greatest("first", F.col("block") * number), F.least("last", (F.col("block") + 1) * number - 1)))
    return blocks.select(*[c for c in runs.columns if c not in ("first", "last")], place.alias("place"))


def _tasks(rows: int, task_rows: int = TASK_MATCHES, most: int = MOST_TASKS) -> tuple[int, int]:
    """Tasks for a step that makes ``rows`` rows of whatever few it reads, and the rows that each makes."""
    size = max(task_rows, -(-rows // most))
    return max(1, -(-rows // size)), size


def versions_in_ranges(triples: DataFrame, ranges: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """Every (version, range) of one package where the version lies in the range; only hits are ever produced."""
    versions_at, runs = version_runs(triples, ranges)
    runs = cut_lineage(runs)
    tasks, _ = _tasks(runs.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0)
    return versions_at.join(_places(runs, block, tasks), ["ecosystem", "package", "place"]).drop("place")


def advisories_at_versions(triples: DataFrame, ranges: DataFrame, severities: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """How many advisories of each severity hold a version: ``ecosystem, package, version, severity, advisories``.

    ``severities`` has the severity of each (ecosystem, package, advisory_id, range_no).  An advisory counts once for a
    version, by its first range that holds it.  Its runs of places are cut to what no run before them covers; the ends of
    all these pieces are summed by place, so no pair of a version and an advisory is made.  Only an advisory whose ranges
    differ in severity (an id that is used twice) meets its versions one by one.
    """
    key = ["ecosystem", "package"]
    versions_at, runs = version_runs(triples, ranges)
    which = [*key, "advisory_id"]
    rated = cut_lineage(runs.join(severities, [*which, "range_no"]).select(*which, "range_no", "severity", "first", "last").distinct())
    own = Window.partitionBy(*which)
    blank = F.coalesce(F.max(F.col("severity").isNull()).over(own) != F.min(F.col("severity").isNull()).over(own), F.lit(False))
    differs = blank | F.coalesce(F.min("severity").over(own) != F.max("severity").over(own), F.lit(False))
    rated = rated.withColumn("differs", differs)
    before = F.max("last").over(own.orderBy("first", "last", "range_no").rowsBetween(Window.unboundedPreceding, -1))
    pieces = rated.filter(~F.col("differs")).withColumn("first", F.greatest("first", before + 1)).filter("first <= last")
    singly = _places(rated.filter("differs"), block).groupBy(*which, "place").agg(F.min(F.struct("range_no", "severity"))["severity"].alias("severity"))
    ends = pieces.select(*key, "severity", F.explode(F.array(
        F.struct(F.col("first").alias("place"), F.lit(1).alias("change")), F.struct((F.col("last") + 1).alias("place"), F.lit(-1).alias("change")))).alias("_e"))
    changes = ends.select(*key, "severity", "_e.*").unionByName(singly.select(*key, "severity", "place", F.lit(1).alias("change"))).unionByName(
        singly.select(*key, "severity", (F.col("place") + 1).alias("place"), F.lit(-1).alias("change")))
    changes = changes.groupBy(*key, "severity", "place").agg(F.sum("change").alias("change"))
    # at most as many rows for a severity as the package has versions
    along = Window.partitionBy(*key, "severity").orderBy("place")
    steps = changes.select(*key, "severity", F.sum("change").over(along).alias("advisories"), F.col("place").alias("first"),
                           (F.lead("place").over(along) - 1).alias("last")).filter("advisories > 0")
    return versions_at.join(_places(steps, block), [*key, "place"]).drop("place")


def match_advisories(packages: DataFrame, ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Packages whose version lies in an advisory's range: the 19 report columns plus ``cwe``.

    The range test runs on distinct (ecosystem, package, version) triples: a package that fills a
    third of the inventory collapses map-side to its few versions before anything is shuffled.
    Of several ranges of one advisory that hold a version the first one counts.  The matching triples are then
    joined back by equality, in tasks that are cut by the matches they make.

    There are as many matches as pairs of a package and an advisory.  With ``by``, some of the packages' columns and
    ``severity``, equal matches are one row with their number, ``matches``, and are counted without being made.
    """
    versioned = with_match_version(packages).filter(F.col("version").isNotNull())
    ranges = cut_lineage(ranges)
    key = ["ecosystem", "package", "version", "advisory_id"]
    which = ["ecosystem", "package", "advisory_id", "range_no"]
    told = _told(ranges)
    if by is not None:
        columns = [c for c in by if c != "severity"]
        alike = cut_lineage(versioned.groupBy(*dict.fromkeys([*key[:3], *columns])).agg(F.count("*").alias("_n")))
        held = advisories_at_versions(alike.select(*key[:3]).distinct(), ranges, told.select(*which, F.col("_a.severity").alias("severity")))
        return alike.join(held, key[:3]).groupBy(*by).agg(F.sum(F.col("_n") * F.col("advisories")).alias("matches"))
    return packages_of_hits(packages, _hits(versioned.select(*key[:3]).distinct(), ranges, told))


def advisory_hits(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The advisories that hold each distinct (ecosystem, package, version) of the packages.

    ``ecosystem, package, version, advisory_id`` and the report columns that follow from them.  What depends on these alone, a
    policy's flag say, is told here: a hit stands for as many matches as its version has package rows (``packages_of_hits``).
    """
    ranges = cut_lineage(ranges)
    versioned = with_match_version(packages).filter(F.col("version").isNotNull())
    return _hits(versioned.select("ecosystem", "package", "version").distinct(), ranges, _told(ranges))


def _told(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("ecosystem", "package", "advisory_id", "range_no").agg(F.min(F.struct(
        "fixed_version", "aliases", "severity", "title", "description", "source", "cvss", "references", "cwe")).alias("_a"))


def _hits(triples: DataFrame, ranges: DataFrame, told: DataFrame) -> DataFrame:
    key = ["ecosystem", "package", "version", "advisory_id"]
    first = versions_in_ranges(triples, ranges).groupBy(*key).agg(F.min("range_no").alias("range_no"))
    fixed = F.coalesce("_a.fixed_version", F.lit(""))
    return first.join(told, ["ecosystem", "package", "advisory_id", "range_no"]).select(
        *key, fixed.alias("fixed_version"), *[f"_a.{c}" for c in ("aliases", "severity", "title", "description", "source", "cvss", "references", "cwe")],
        F.when(fixed != "", F.concat(F.lit("Upgrade "), F.col("package"), F.lit(" to "), fixed, F.lit(" or later.")))
        .otherwise(F.lit("")).alias("remediation"))


def packages_of_hits(packages: DataFrame, hits: DataFrame, task_matches: int = TASK_MATCHES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """Every package row with every hit of its version: the 19 report columns, ``cwe`` and what else the hits have.

    Few rows meet few hits and make many matches, so tasks are cut by the matches that they make, which are counted first, and
    not by the bytes that they read.  The package rows of a version with many matches are dealt to several parts, and its
    hits go to each of them.
    """
    key = ["ecosystem", "package", "version"]
    hits = cut_lineage(hits)
    path = F.col("dependency_path") if "dependency_path" in packages.columns else F.lit("")
    rows = with_match_version(packages).filter(F.col("version").isNotNull()).select(
        *key, "relationship", path.alias("dependency_path"), "project_path", "manifest_path", "scope",
        F.when(F.col("relationship") == "transitive", F.lit("indirect")).otherwise(F.lit("direct")).alias("reachability"))
    counts = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("_rows")).join(hits.groupBy(*key).agg(F.count("*").alias("_hits")), key))
    total = counts.agg(F.sum(F.col("_rows") * F.col("_hits"))).first()[0] or 0
    tasks, size = _tasks(total, task_matches, most_tasks)
    counts = counts.select(*key, F.least("_rows", F.ceil(F.col("_rows") * F.col("_hits") / size)).cast("int").alias("_parts"))
    # a number of partitions that is named here is not lowered for their few bytes
    dealt = lambda df: df.repartition(tasks, *key, "_part")
    left = dealt(rows.join(counts, key).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).drop("_parts"))
    right = dealt(hits.join(counts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
    columns = ["ecosystem", "package", "version", "fixed_version", "relationship", "dependency_path", "project_path", "manifest_path", "scope",
               "advisory_id", "aliases", "severity", "title", "description", "source", "cvss", "references", "remediation", "reachability", "cwe"]
    return left.join(right, [*key, "_part"]).select(*columns, *[c for c in hits.columns if c not in columns])


def match_compromised(packages: DataFrame, compromised: DataFrame) -> DataFrame:
    """Packages at exactly a compromised version."""
    versioned = with_match_version(packages).filter(F.col("version").isNotNull())
    bad = compromised.withColumn("version", clean_version(F.col("version")))
    present = versioned.select("ecosystem", "package", "version").distinct()
    hits = bad.join(present, ["ecosystem", "package", "version"], "left_semi")
    return versioned.join(hits, ["ecosystem", "package", "version"]).select(
        "ecosystem", "package", "version", "project_path", "manifest_path", "scope", "rule_id", "severity",
        "description", "iocs", "source",
    )


def flag_ignored(matches: DataFrame, policy: DataFrame, now) -> DataFrame:
    """Add ``ignored``: an active policy entry covers the match (active up to its expiry).

    Entries with and without a package become two equality joins, so there is no nested loop.
    """
    active = policy.filter(F.col("expiry").isNull() | (F.col("expiry") >= F.lit(now).cast("timestamp")))
    by_id = active.filter(F.col("package").isNull()).select(
        F.col("id").alias("advisory_id"), F.lit(True).alias("_by_id")).distinct()
    by_package = active.filter(F.col("package").isNotNull()).select(
        F.col("id").alias("advisory_id"), "package", F.lit(True).alias("_by_package")).distinct()
    flagged = matches.join(by_id, "advisory_id", "left").join(by_package, ["advisory_id", "package"], "left")
    return flagged.select(
        *matches.columns, (F.col("_by_id").isNotNull() | F.col("_by_package").isNotNull()).alias("ignored")
    )


def apply_policy(matches: DataFrame, policy: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) advisory matches."""
    flagged = flag_ignored(matches, policy, now)
    return flagged.filter(~F.col("ignored")).drop("ignored"), flagged.filter("ignored").drop("ignored")


def dependency_findings(matches: DataFrame, root: str | None = None) -> DataFrame:
    """Advisory matches as findings of kind ``dependency``.

    Of matches that are counted by some columns (``match_advisories``), the findings' columns that follow from those are
    left, and ``matches``.
    """
    if "matches" in matches.columns:
        known = {"framework": "ecosystem", "package_name": "package", "declared_version": "version", "severity": "severity", "project_path": "project_path"}
        told = [F.col(c).alias(name) for name, c in known.items() if c in matches.columns]
        return matches.select(F.lit("dependency").alias("kind"), F.lit("HIGH").alias("confidence"), *told, "matches")
    values = {
        "kind": F.lit("dependency"),
        "file": F.col("manifest_path"),
        "rule_id": F.col("advisory_id"),
        "severity": F.col("severity"),
        "framework": F.col("ecosystem"),
        "confidence": F.lit("HIGH"),
        "description": F.col("description"),
        "cwe": F.col("cwe"),
        "references": F.col("references"),
        "remediation": F.col("remediation"),
        "package_name": F.col("package"),
        "declared_version": F.col("version"),
        "fixed_versions": F.filter(F.array("fixed_version"), lambda v: v != ""),
        "project_path": F.col("project_path"),
        "fingerprint": dependency_fingerprint(F.col("advisory_id"), F.col("manifest_path"), F.col("package"), F.col("version"), root),
    }
    empty_list = F.array().cast("array<string>")
    numbers = {c: F.lit(0) for c in ("line", "column", "end_line", "end_column")}
    lists = {c: empty_list for c in ("tags", "taxonomy", "owasp")}
    return matches.select(*[
        values.get(c, numbers.get(c, lists.get(c, F.lit("")))).alias(c) for c in FINDING_COLUMNS
    ])
