"""Script extraction from HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.text import let, prefix_scan, trim_space
from grainsieve.functions.urls import bad_escape, resolve_url, same_origin, scheme

# Script types that hold JavaScript.
SCRIPT_TYPES = (
    "", "module", "text/javascript", "application/javascript", "application/ecmascript", "text/ecmascript",
)
_ATTRS = r"""([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)"""
#: Elements whose content is text: a script that is spelled there is none.
TEXT_ELEMENTS = ("textarea", "title", "style", "xmp", "iframe", "noembed", "noframes")
_TEXTS = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in TEXT_ELEMENTS)
#: Comments, text elements and scripts in document order: none is looked for inside another; what is not closed goes on to the end.
SCRIPT = rf"(?is)<!--.*?(?:-->|\z)|{_TEXTS}|<script\b{_ATTRS}>(.*?)(?:</script\s*>|\z)"
ONE_SCRIPT = rf"(?is)^<script\b{_ATTRS}>(.*?)(?:</script\s*>)?\z"
# Named character references that attribute values use; those by number need no table.
ENTITIES = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&", "nbsp": "\u00a0"}
REFERENCE = rf"&(?:#[0-9]{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|{'|'.join(ENTITIES)});"


def decode_references(value: Column) -> Column:
    """Named and numeric character references as characters, each once: what a reference makes is no part of another."""
    def character(ref: Column) -> Column:
        name = F.substring(ref, F.lit(2), F.length(ref) - 2)
        digits = F.regexp_replace(name, "^#[xX]?", "")
        code = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        # a number that is no character stands for the replacement character
        spelled = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD).cast("long")), 8, "0")), "UTF-32")
        named = F.lit(None).cast("string")
        for k, v in ENTITIES.items():
            named = F.when(name == k, F.lit(v)).otherwise(named)
        return F.when(F.startswith(name, F.lit("#")), spelled).otherwise(named)

    def joined(refs: Column) -> Column:
        pieces = F.split(value, REFERENCE, -1)
        return F.array_join(F.concat(F.transform(refs, lambda r, i: F.concat(F.get(pieces, i), character(r))), F.array(F.get(pieces, F.size(pieces) - 1))), "")

    return F.when(F.contains(value, F.lit("&")), let(F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0)), joined)).otherwise(value)


def attribute_pattern(name: str) -> str:
    return rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attribute(attrs: Column, name: str) -> Column:
    """Trimmed attribute value with its character references decoded; empty when absent."""
    value = F.concat(*[F.regexp_extract(attrs, attribute_pattern(name), k) for k in (1, 2, 3)])
    return trim_space(let(value, decode_references))


def extract_scripts(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per JavaScript ``<script>``: (key, url, pos, kind, src, body, inline_no).

    All work happens inside the page's row; a script with a source ignores its body, empty inline
    scripts are dropped.  ``inline_no`` counts the kept inline scripts of the page.
    """
    def scripts(doc: Column) -> Column:
        # one walk over the page; the parts of a script come from its own text
        found = F.filter(F.regexp_extract_all(doc, F.lit(SCRIPT), F.lit(0)), lambda m: F.lower(F.substring(m, 1, 7)) == "<script")
        parts = F.transform(found, lambda m: F.struct(F.regexp_extract(m, ONE_SCRIPT, 1).alias("attrs"), F.regexp_extract(m, ONE_SCRIPT, 2).alias("body")))
        raw = F.transform(parts, lambda s: F.struct(
            F.lower(attribute(s["attrs"], "type")).alias("type"), attribute(s["attrs"], "src").alias("src"), trim_space(s["body"]).alias("body")))
        return F.filter(raw, lambda s: s["type"].isin(*SCRIPT_TYPES) & ((s["src"] != "") | (s["body"] != "")))

    inline_before = prefix_scan("transform(_kept, s -> IF(s.src = '', 1, 0))", "n")
    rows = F.expr(
        "transform(_kept, (s, i) -> named_struct('pos', i + 1, 'kind', IF(s.src = '', 'inline', 'external'), 'src', s.src, "
        "'body', IF(s.src = '', s.body, ''), 'inline_no', IF(s.src = '', _before[i] + 1, NULL)))"
    )
    has_script = F.contains(F.lower(html), F.lit("<script"))
    return (
        pages.filter(has_script & scheme(F.col(url)).isin("http", "https"))
        .select(F.col(key), F.col(url), let(F.col(html), scripts).alias("_kept"))
        .select("*", F.expr(inline_before).alias("_before"))
        .select(key, url, F.explode(rows).alias("_s"))
        .select(key, url, "_s.*")
    )


def resolve_scripts(scripts: DataFrame, url: str = "url", same_origin_only: bool = True) -> DataFrame:
    """Add ``source_url`` and ``url_error``; drop references that are not http(s) or foreign."""
    external = F.col("kind") == "external"
    target = resolve_url(F.col(url), F.col("src"))
    out = scripts.withColumn("url_error", F.when(external & bad_escape(F.col("src")), F.lit("invalid URL escape")))
    out = out.withColumn("source_url", F.when(external & F.col("url_error").isNull(), target).when(external, F.col("src")))
    wanted = scheme(F.col("source_url")).isin("http", "https")
    if same_origin_only:
        wanted = wanted & same_origin(F.col(url), F.col("source_url"))
    return out.filter(~external | F.col("url_error").isNotNull() | wanted)
