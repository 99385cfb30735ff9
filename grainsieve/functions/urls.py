"""URL resolution, origins and script file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainsieve.functions.text import let, trim_space

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*):([0-9]*)$", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1)


def same_origin(a: Column, b: Column) -> Column:
    """Scheme and host without case, the written port as text (default ports are not folded)."""
    return (scheme(a) == scheme(b)) & (F.lower(host(a)) == F.lower(host(b))) & (port(a) == port(b))


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``; the result starts with one slash."""
    def body(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(segments, -1)
        text = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(""))
        return F.regexp_replace(text, "^//", "/")

    return let(F.split(path, "/", -1), body)


def resolve_url(page: Column, ref: Column) -> Column:
    """Resolve a reference against the page URL."""
    def body(r: Column) -> Column:
        tail = F.regexp_extract(r, r"^[^?#]*([?#].*)?$", 1)
        ref_path = F.regexp_extract(r, r"^([^?#]*)", 1)
        base_path = url_path(page)
        base_query = F.regexp_extract(page, r"^[^?#]*(\?[^#]*)?", 1)
        base = F.concat(scheme(page), F.lit("://"), authority(page))
        folder = F.regexp_replace(base_path, r"[^/]*$", "")
        own_scheme = F.rlike(r, F.lit(_SCHEME))
        with_host = F.when(own_scheme, r).otherwise(F.concat(scheme(page), F.lit(":"), r))
        absolute = let(with_host, lambda u: F.when(
            F.rlike(u, F.lit(_AUTHORITY)),
            F.concat(
                scheme(u), F.lit("://"), authority(u),
                F.when(url_path(u) == "", F.lit("")).otherwise(remove_dot_segments(url_path(u))),
                F.regexp_extract(u, r"^[^?#]*([?#].*)?$", 1),
            ),
        ).otherwise(u))
        empty_path = F.when(base_path == "", F.lit("")).otherwise(remove_dot_segments(base_path))
        return (
            F.when(own_scheme | F.startswith(r, F.lit("//")), absolute)
            .when(ref_path == "", F.concat(base, empty_path, F.when(F.startswith(tail, F.lit("?")), tail).otherwise(F.concat(base_query, tail))))
            .when(F.startswith(r, F.lit("/")), F.concat(base, remove_dot_segments(ref_path), tail))
            .otherwise(F.concat(base, remove_dot_segments(F.concat(folder, ref_path)), tail))
        )

    return let(trim_space(ref), body)


def bad_escape(url: Column) -> Column:
    """A percent sign in the path that starts no escape."""
    return F.rlike(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit(r"%(?![0-9A-Fa-f]{2})"))


def script_name(url: Column) -> Column:
    """Safe file name of an external script."""
    def body(path: Column) -> Column:
        stripped = F.regexp_replace(path, "/+$", "")
        base = F.when(path == "", F.lit(".")).when(stripped == "", F.lit("/")).otherwise(
            F.substring_index(stripped, "/", -1)
        )
        base = F.replace(F.replace(F.replace(trim_space(base), F.lit(".."), F.lit("_")), F.lit("/"), F.lit("_")), F.lit("\\"), F.lit("_"))
        base = F.when(base.isin("", "."), F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit(".js"))).otherwise(base)
        return let(base, lambda b: F.regexp_replace(
            F.when(F.rlike(F.lower(b), F.lit(r"\.[mc]?js$")), b).otherwise(F.concat(b, F.lit(".js"))),
            "[^A-Za-z0-9._-]", "_",
        ))

    return let(F.coalesce(F.try_url_decode(F.replace(url_path(url), F.lit("+"), F.lit("%2B"))), url_path(url)), body)


def numbered_name(name: Column, n: Column) -> Column:
    """``stem_n.ext`` from the second use of a name on."""
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(n == 1, name).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))
