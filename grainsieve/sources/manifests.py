"""Packages declared in manifests, versions fixed in lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NPM_SCOPES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
LOCK_FILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml")
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([=<>!~]=?=?)?\s*([^\s;#,]*)"
GO_REQUIRE = r"^\s*(?:require\s+)?([A-Za-z0-9._~-]+\.[A-Za-z0-9._~/-]+)\s+(v[0-9][^\s]*)"
CARGO_LINE = r"""^\s*([A-Za-z0-9_-]+)\s*=\s*(?:"([^"]*)"|\{[^}]*\bversion\s*=\s*"([^"]*)")"""
#: A section of dependencies, of one target or of all, and the crate whose own table it is.
CARGO_SECTION = r"""^(?:target\.(?:'[^']*'|"[^"]*"|[A-Za-z0-9_-]+)\.)?(dependencies|dev-dependencies|build-dependencies)(?:\."?([A-Za-z0-9_-]+)"?)?$"""
CARGO_VERSION = r"""(?m)^\s*version\s*=\s*["']([^"']*)["']"""
CARGO_RENAME = r"""\bpackage\s*=\s*["']([^"']*)["']"""
GO_REPLACE = r"^\s*(?:replace\s+)?([^\s()]+)(?:\s+(v[^\s]+))?\s+=>\s+([^\s]+)(?:\s+(v[^\s]+))?"
PNPM_ENTRY = r"(?m)^ {6}'?([^':\s]+)'?:[ ]*\n\s+specifier:[^\n]*\n\s+version:\s*'?([^\s'(]+)"
COLUMNS = ("ecosystem", "project_path", "manifest_path", "scope", "package", "declared_version", "relationship")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def project_of(path: Column) -> Column:
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(folder == "", F.lit(".")).otherwise(folder)


def _rows(df: DataFrame, ecosystem: str, scope, package, version, relationship=None) -> DataFrame:
    return df.select(
        F.lit(ecosystem).alias("ecosystem"), project_of(F.col("rel_path")).alias("project_path"),
        F.col("rel_path").alias("manifest_path"), scope.alias("scope"), package.alias("package"),
        version.alias("declared_version"), (relationship if relationship is not None else F.lit("direct")).alias("relationship"),
    )


def npm_packages(files: DataFrame) -> DataFrame:
    own = files.filter(file_name(F.col("rel_path")) == "package.json")
    schema = ", ".join(f"{s} map<string,string>" for s in NPM_SCOPES)
    parsed = own.select("rel_path", F.from_json("content", schema).alias("_j"))
    none = F.array().cast("array<struct<key:string,value:string>>")

    def scoped(scope: str) -> Column:
        # a function per scope: a second lambda argument would be the element's index
        return F.transform(
            F.coalesce(F.map_entries(F.col("_j")[scope]), none),
            lambda e: F.struct(F.lit(scope).alias("scope"), e["key"].alias("package"), e["value"].alias("version")),
        )

    entries = F.concat(*[scoped(s) for s in NPM_SCOPES])
    rows = parsed.select("rel_path", F.explode(entries).alias("_e"))
    return _rows(rows, "npm", F.col("_e.scope"), F.col("_e.package"), F.col("_e.version"))


def pip_packages(files: DataFrame) -> DataFrame:
    own = files.filter(F.rlike(file_name(F.col("rel_path")), F.lit(r"^requirements[^/]*\.txt$")))
    rows = own.select("rel_path", F.explode(F.split("content", "\n", -1)).alias("_l"))
    rows = rows.filter(F.rlike(F.col("_l"), F.lit(REQUIREMENT)))
    op, version = F.regexp_extract("_l", REQUIREMENT, 2), F.regexp_extract("_l", REQUIREMENT, 3)
    declared = F.when(op.isin("==", "==="), version).otherwise(F.concat(op, version))
    return _rows(rows, "pip", F.lit("pip:dependencies"), F.regexp_extract("_l", REQUIREMENT, 1), declared)


def go_packages(files: DataFrame) -> DataFrame:
    """Required modules; one that is replaced stands as its replacement, a local folder as the module without a version."""
    own = files.filter(file_name(F.col("rel_path")) == "go.mod").withColumn("_lines", F.split("content", "\n", -1))
    swapped = F.transform(
        F.filter("_lines", lambda x: F.rlike(x, F.lit(GO_REPLACE))),
        lambda x: F.struct(*[F.regexp_extract(x, GO_REPLACE, k).alias(n) for k, n in enumerate(("old", "at", "new", "version"), 1)]))
    # a column of its own first: beside a generator the fields of a struct would lose their names
    rows = own.withColumn("_swapped", swapped).select("rel_path", "_swapped", F.explode("_lines").alias("_l"))
    rows = rows.filter(F.rlike(F.col("_l"), F.lit(GO_REQUIRE)) & ~F.contains("_l", F.lit("=>")))
    indirect = F.when(F.rlike(F.col("_l"), F.lit(r"//\s*indirect")), F.lit("transitive")).otherwise(F.lit("direct"))
    rows = rows.select("rel_path", "_swapped", indirect.alias("_rel"), F.regexp_extract("_l", GO_REQUIRE, 1).alias("_module"), F.regexp_extract("_l", GO_REQUIRE, 2).alias("_version"))
    fits = F.filter("_swapped", lambda r: (r["old"] == F.col("_module")) & ((r["at"] == "") | (r["at"] == F.col("_version"))))
    # a replacement of this very version goes before one of all versions
    chosen = F.array_max(F.transform(fits, lambda r: F.struct((r["at"] != "").alias("named"), r["new"].alias("new"), r["version"].alias("version"))))
    rows = rows.withColumn("_r", chosen)
    local = F.rlike(F.col("_r.new"), F.lit(r"^[./]"))
    module = F.when(F.col("_r").isNull() | local, F.col("_module")).otherwise(F.col("_r.new"))
    version = F.when(F.col("_r").isNull(), F.col("_version")).when(local, "").otherwise(F.col("_r.version"))
    return _rows(rows, "go", F.lit("go:dependencies"), module, version, F.col("_rel"))


def cargo_packages(files: DataFrame) -> DataFrame:
    """Crates of dependency sections, of all targets or one, in lines or in tables of their own; a renamed crate by its real name."""
    own = files.filter(file_name(F.col("rel_path")) == "Cargo.toml")
    sections = own.select("rel_path", F.explode(F.split(F.concat(F.lit("\n"), "content"), r"\n\s*\[", -1)).alias("_s"))
    sections = sections.select("rel_path", F.trim(F.substring_index("_s", "]", 1)).alias("_name"), "_s")
    deps = sections.filter(F.rlike(F.col("_name"), F.lit(CARGO_SECTION))).select(
        "rel_path", "_s", F.concat(F.lit("cargo:"), F.regexp_extract("_name", CARGO_SECTION, 1)).alias("_scope"), F.regexp_extract("_name", CARGO_SECTION, 2).alias("_table"))

    def real(name, text):
        return F.when(F.rlike(text, F.lit(CARGO_RENAME)), F.regexp_extract(text, CARGO_RENAME, 1)).otherwise(name)

    rows = deps.filter(F.col("_table") == "").select("rel_path", "_scope", F.explode(F.split("_s", "\n", -1)).alias("_l")).filter(
        F.rlike(F.col("_l"), F.lit(CARGO_LINE))
    )
    version = F.concat(F.regexp_extract("_l", CARGO_LINE, 2), F.regexp_extract("_l", CARGO_LINE, 3))
    lines = _rows(rows, "cargo", F.col("_scope"), real(F.regexp_extract("_l", CARGO_LINE, 1), F.col("_l")), version)
    tables = deps.filter(F.col("_table") != "")
    return lines.unionByName(_rows(tables, "cargo", F.col("_scope"), real(F.col("_table"), F.col("_s")), F.regexp_extract("_s", CARGO_VERSION, 1)))


def extract_packages(files: DataFrame) -> DataFrame:
    """Declared packages of every manifest; the file name selects the format."""
    return npm_packages(files).unionByName(pip_packages(files)).unionByName(go_packages(files)).unionByName(cargo_packages(files))


def extract_locks(files: DataFrame) -> DataFrame:
    """Locked npm versions: (project_path, package, locked_version, version_source)."""
    own = files.filter(file_name(F.col("rel_path")).isin("package-lock.json", "npm-shrinkwrap.json"))
    entry = "map<string,struct<version:string>>"
    parsed = own.select("rel_path", F.from_json("content", f"packages {entry}, dependencies {entry}").alias("_j"))
    none = F.array().cast("array<struct<key:string,value:struct<version:string>>>")
    top = F.transform(
        F.filter(F.coalesce(F.map_entries("_j.packages"), none), lambda e: F.rlike(e["key"], F.lit("^node_modules/(?!.*/node_modules/)"))),
        lambda e: F.struct(F.replace(e["key"], F.lit("node_modules/"), F.lit("")).alias("package"), e["value"]["version"].alias("version")),
    )
    flat = F.transform(
        F.coalesce(F.map_entries("_j.dependencies"), none),
        lambda e: F.struct(e["key"].alias("package"), e["value"]["version"].alias("version")),
    )
    npm = parsed.select("rel_path", F.explode(F.when(F.size(top) > 0, top).otherwise(flat)).alias("_e")).select("rel_path", "_e.*")
    pnpm_files = files.filter(file_name(F.col("rel_path")) == "pnpm-lock.yaml")
    regex = F.lit(PNPM_ENTRY)
    pnpm = (
        pnpm_files.select(
            "rel_path",
            F.regexp_extract_all("content", regex, F.lit(1)).alias("package"),
            F.regexp_extract_all("content", regex, F.lit(2)).alias("version"),
        )
        .select("rel_path", F.explode(F.arrays_zip("package", "version")).alias("_e"))
        .select("rel_path", "_e.*")
    )
    return npm.unionByName(pnpm).select(
        project_of(F.col("rel_path")).alias("project_path"), "package",
        F.col("version").alias("locked_version"), file_name(F.col("rel_path")).alias("version_source"),
    )
