"""Path predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainsieve.functions.text import string_map, trim_space

# Language of a file extension, language aliases, display names, path segments,
# inventory extensions.
LANGUAGE_EXTENSIONS = {
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"),
    "python": (".py",),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "php": (".php",),
    "ruby": (".rb",),
    "csharp": (".cs",),
    "bash": (".sh", ".bash", ".zsh"),
    "yaml": (".yaml", ".yml"),
}
LANGUAGE_ALIASES = {
    "javascript": ("", "javascript", "js", "typescript", "ts", "jsx", "tsx", "mjs", "cjs"),
    "python": ("python", "py"),
    "go": ("go", "golang"),
    "rust": ("rust", "rs"),
    "java": ("java",),
    "php": ("php",),
    "ruby": ("ruby", "rb"),
    "csharp": ("c#", "csharp", "cs", "c-sharp"),
    "bash": ("bash", "shell", "sh", "zsh"),
    "yaml": ("yaml", "yml"),
}
LANGUAGE_DISPLAY = {
    "javascript": "JavaScript",
    "python": "Python",
    "go": "Go",
    "rust": "Rust",
    "java": "Java",
    "php": "PHP",
    "ruby": "Ruby",
    "csharp": "C#",
    "bash": "Bash",
    "yaml": "YAML",
}
TEST_SEGMENTS = ("__tests__", "__mocks__", "cypress", "e2e", "playwright")
VENDORED_SEGMENTS = ("node_modules", "dist", "build", "out", "coverage", ".next", "vendor")
PRUNED_VENDORED_DIRS = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", "vendor")
INVENTORY_EXTENSIONS = (
    ".json", ".yaml", ".yml", ".env", ".ini", ".toml", ".xml", ".html", ".md", ".txt", ".csv", ".sql",
)


def _regex_any(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty when the last segment has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_for_path(path: Column) -> Column:
    """Language key of a path, null when it is not a supported source file."""
    # looked up once: in a chain of conditions each would cut the extension out anew
    return F.try_element_at(string_map((e, key) for key, exts in LANGUAGE_EXTENSIONS.items() for e in exts), extension(path))


def source_glob() -> str:
    """File name glob of all source extensions, any case: other files are not even opened."""
    def any_case(ext: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext[1:])

    return "*.{" + ",".join(any_case(e) for exts in LANGUAGE_EXTENSIONS.values() for e in exts) + "}"


def language_alias(name: Column) -> Column:
    """Language key of a free-form language name; unknown names pass through lower-cased."""
    clean = F.lower(trim_space(F.coalesce(name, F.lit(""))))
    out = clean
    for key, aliases in LANGUAGE_ALIASES.items():
        out = F.when(clean.isin(*aliases), F.lit(key)).otherwise(out)
    return out


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"\.(test|spec)\.[^/]*$") | low.rlike(f"(^|/)({_regex_any(TEST_SEGMENTS)})/")


def is_vendored_path(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(\.min\.[mc]?js|\.d\.ts)$") | low.rlike(f"(^|/)({_regex_any(VENDORED_SEGMENTS)})/")


def in_pruned_dir(rel_path: Column, include_tests: bool = False, include_vendored: bool = False) -> Column:
    """A directory on the way to the file has a pruned name (exact case)."""
    names: tuple[str, ...] = ()
    if not include_vendored:
        names += PRUNED_VENDORED_DIRS
    if not include_tests:
        names += TEST_SEGMENTS
    if not names:
        return F.lit(False)
    return rel_path.rlike(f"(^|/)({_regex_any(names)})/")


def normalize_extensions(extra) -> tuple[str, ...]:
    """Extensions given by a caller: trimmed, lower-cased, with their dot, blanks dropped."""
    out = []
    for e in extra or ():
        e = e.strip().lower()
        if e:
            out.append(e if e.startswith(".") else "." + e)
    return tuple(out)


def is_inventory_path(path: Column, extra_extensions=()) -> Column:
    known = INVENTORY_EXTENSIONS + normalize_extensions(extra_extensions)
    return language_for_path(path).isNotNull() | extension(path).isin(*known)


def relative_path(path: Column, root: str | Column | None) -> Column:
    """Path below ``root``; unchanged when it lies elsewhere or no root is given."""
    if root is None:
        return path
    root = F.lit(root) if isinstance(root, str) else root
    base = F.regexp_replace(trim_space(root), "/+$", "")
    clean = trim_space(path)
    return (
        F.when((base != "") & F.startswith(clean, F.concat(base, F.lit("/"))),
               F.substring(clean, F.length(base) + 2, F.length(clean)))
        .when((base != "") & (clean == base), F.lit("."))
        .otherwise(clean)
    )
