"""Text expressions: Unicode trimming, byte-exact cuts, regex dialect, prefix sums."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space when text is trimmed or squeezed.
SPACE_CLASS = (
    r"\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# An ASCII word boundary spelled with look-around, since Java's \b follows Unicode letters.
_ASCII_BOUNDARY = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


def java_pattern(pattern: str) -> str:
    """Spell a linear-time-dialect pattern for Spark: ASCII ``\\b``, and ``\\s`` without VT."""
    out: list[str] = []
    in_class = False
    for token in re.findall(r"\\.|.", pattern, flags=re.S):
        if token == r"\b" and not in_class:
            token = _ASCII_BOUNDARY
        elif token == r"\s":
            token = r"\t\n\f\r " if in_class else r"[\t\n\f\r ]"
        elif token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        out.append(token)
    return "".join(out)


_SEPARATOR = chr(31)


def string_array(values) -> Column:
    """A constant array of texts, folded at planning time (one call instead of one per text)."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_SEPARATOR.join(values)), _SEPARATOR, -1)


def string_map(pairs) -> Column:
    """A constant map of texts."""
    pairs = dict(pairs)
    return F.map_from_arrays(string_array(pairs.keys()), string_array(pairs.values()))


def sql_quote(value: str) -> str:
    """A text literal for expression strings."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Spark inlines a projected column into the lambdas that use it and would then evaluate it per
    element; a one-element ``transform`` binds it as a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# Every character of the class, for trimming without a regex.
_SPACES = "".join(map(chr, [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
# UTF-8 beginnings of the characters of the class beyond Latin-1.
_WIDE_SPACE_BYTES = (b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def trim_space(c: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(c, F.lit(_SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_space(c) == "")


def squeeze_space(c: Column) -> Column:
    """Trim, and turn every run of white space into one space.

    A class within Latin-1 is one table lookup per character; the full class is only used on
    texts that hold a byte sequence it could need.
    """
    raw = c.cast("binary")
    wide = F.lit(False)
    for prefix in _WIDE_SPACE_BYTES:
        wide = wide | F.contains(raw, F.lit(prefix))
    narrow = F.regexp_replace(c, r"[\x09-\x0d\x20\x85\xa0]+", " ")
    return trim_space(F.when(wide, F.regexp_replace(c, f"[{SPACE_CLASS}]+", " ")).otherwise(narrow))


def byte_prefix(c: Column, n: int) -> Column:
    """The first ``n`` bytes of a text; bytes of a character cut in two each become U+FFFD."""
    raw = c.cast("binary")

    def is_tail(k: int) -> Column:
        h = F.hex(F.substring(raw, k, 1))
        return (h >= "80") & (h < "C0")

    # number of bytes of the cut character that lie before the cut
    partial = (
        F.when(~is_tail(n + 1), F.lit(0))
        .when(~is_tail(n), F.lit(1))
        .when(~is_tail(n - 1), F.lit(2))
        .otherwise(F.lit(3))
    )
    return let(
        partial,
        lambda p: F.concat(
            F.substring(raw, F.lit(1), F.lit(n) - p).cast("string"),
            F.repeat(F.lit("�"), p),
        ),
    )


def cut_bytes(c: Column, n: int) -> Column:
    """Trim; cut to ``n`` bytes plus ``...`` when longer."""
    return let(
        trim_space(c),
        lambda t: F.when(F.octet_length(t) > n, F.concat(byte_prefix(t, n), F.lit("..."))).otherwise(t),
    )


def finding_snippet(line: Column) -> Column:
    return cut_bytes(line, 120)


def inventory_snippet(line: Column) -> Column:
    return cut_bytes(line, 200)


def byte_slice(c: Column, start: Column, length: Column) -> Column:
    """Bytes ``[start, start+length)`` (0-based) of a text, as text."""
    return F.substring(c.cast("binary"), start + 1, length).cast("string")


def highlight(line: Column, start: Column, end: Column, n_lines: Column, first_line_no: Column, matched: Column) -> Column:
    """Mark the match on its line; a match over several lines marks the whole first line.

    ``start``/``end`` are 0-based byte offsets on ``line``; ``n_lines`` is the number of line
    breaks inside the match.
    """
    size = F.octet_length(line)
    marked = F.concat(
        byte_slice(line, F.lit(0), start),
        F.lit("[[DANGEROUS]]"),
        byte_slice(line, start, end - start),
        F.lit("[[/DANGEROUS]]"),
        byte_slice(line, end, size - end),
    )
    first = F.when(is_blank(line), matched).otherwise(line)
    spread = F.concat(
        F.lit("[[DANGEROUS]]"),
        cut_bytes(first, 120),
        F.lit("[[/DANGEROUS]] (lines "),
        first_line_no.cast("string"),
        F.lit("-"),
        (first_line_no + n_lines).cast("string"),
        F.lit(")"),
    )
    return (
        F.when(is_blank(matched), finding_snippet(line))
        .when(n_lines > 0, spread)
        .otherwise(cut_bytes(marked, 120))
    )


_BLOCK = 128


def sql_let(value: str, name: str, body: str) -> str:
    """``let`` for expression strings."""
    return f"transform(array({value}), {name} -> {body})[0]"


def prefix_scan(values: str, name: str, op: str = "sum") -> str:
    """Exclusive running sum or maximum of an int array, in the row, as an expression string.

    Elements are folded inside blocks and the block totals are folded once more, so the work is
    near-linear even for a text with very many matches.  ``name`` keeps the variables of nested
    uses apart.
    """
    zero, step = ("0", "{a} + {b}") if op == "sum" else ("-1", "greatest({a}, {b})")
    v, t, h = f"{name}_v", f"{name}_t", f"{name}_h"

    def fold(part: str) -> str:
        return f"aggregate({part}, {zero}, ({name}_a, {name}_b) -> {step.format(a=name + '_a', b=name + '_b')})"

    block = f"CAST({name}_i div {_BLOCK} AS INT)"
    totals = (
        f"transform(sequence(0, CAST(greatest(size({v}) - 1, 0) div {_BLOCK} AS INT)), "
        f"{name}_k -> {fold(f'slice({v}, {name}_k * {_BLOCK} + 1, {_BLOCK})')})"
    )
    heads = f"transform({t}, ({name}_x, {name}_k) -> {fold(f'slice({t}, 1, {name}_k)')})"
    inside = fold(f"slice({v}, {block} * {_BLOCK} + 1, {name}_i % {_BLOCK})")
    body = f"transform({v}, ({name}_x, {name}_i) -> {step.format(a=f'{h}[{block}]', b=inside)})"
    return sql_let(f"CAST({values} AS ARRAY<INT>)", v, sql_let(totals, t, sql_let(heads, h, body)))
