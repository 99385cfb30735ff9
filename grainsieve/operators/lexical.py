"""Find every match of a set of patterns in a table of texts, with byte positions.

One plan serves all pattern sets (code rules, literal detectors, identifier detectors):

1. per text, one walk over an index of all guard literals (a trie, spelled as a regex) finds those that
   occur, and with them the short list of patterns that can match at all; the time of a walk depends on the text,
   not on the number of patterns.  A few patterns, and guards that are no literals, are tested one by one;
2. the list is exploded, so only (text, candidate pattern) pairs meet a regular expression - the
   full product of texts and patterns never exists;
3. one pass of the pattern marks the matches, the gaps between them and the captures in the text; start bytes are running
   sums over matches and gaps, inside the row.

Everything is narrow: no shuffle, no join, no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.text import java_pattern, prefix_scan, sql_let, sql_quote, string_array


@dataclass(frozen=True)
class Pattern:
    """One pattern in the linear-time dialect (no look-around, never matches the empty text).

    ``any_of``: the text must contain one of these substrings; ``guard``: it must match this
    cheap regex.  Without either the pattern is tried on every text.  ``gate`` names a condition shared by many patterns (such as a language) that is tested once per text.
    """

    key: str
    pattern: str
    captures: int = 0
    any_of: tuple[str, ...] = ()
    guard: str = ""
    ignore_case_guard: bool = False
    gate: str | None = None


#: Guard literals from which one walk over an index is cheaper than a test of each.
INDEX_LITERALS = 150
#: Stands before and behind a match and between its captures in a marked text.
MARK = chr(31)
#: Patterns whose numbers are compared one after the other.
CASE_BRANCHES = 4
#: Branches that a node of the index tries one after the other; more are split by their first characters.
INDEX_BRANCHES = 6


def literal_index(literals: Sequence[str]) -> str:
    """A regex whose group 1 is the longest of the literals that starts at a place; it consumes nothing.

    Literals share their beginnings, so a place is left after a character or two; a literal that others begin with is told
    from the one that was found.
    """
    tree: dict = {}
    for literal in literals:
        node = tree
        for c in literal:
            node = node.setdefault(c, {})
        node[""] = {}
    plain = lambda c: c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}"

    def spell(node: dict) -> str:
        chars = sorted(c for c in node if c)
        if not chars:
            return ""
        body = branch(node, chars)
        if "" in node:
            return f"(?:{body})?+"
        return body if len(chars) == 1 else f"(?:{body})"

    def branch(node: dict, chars: list[str]) -> str:
        if len(chars) <= INDEX_BRANCHES:
            return "|".join(plain(c) + spell(node[c]) for c in chars)
        half = len(chars) // 2
        return "|".join(f"(?=[{''.join(map(plain, part))}])(?:{branch(node, part)})" for part in (chars[:half], chars[half:]))

    return f"(?=({spell(tree)}))"


def _indexed(src: Column, owners: dict[str, list[int]]) -> tuple[Column, Column]:
    """Whether any literal occurs in a text, and the numbers of the patterns whose literals do."""
    found = {w: sorted({i for other, own in owners.items() if w.startswith(other) for i in own}) for w in owners}
    words = sorted(owners)
    index = literal_index(words)
    of = lambda w: F.split(F.element_at(
        string_array(",".join(map(str, found[x])) for x in words), F.array_position(string_array(words), w).cast("int")), ",", -1)
    seen = F.array_distinct(F.regexp_extract_all(src, F.lit(index), F.lit(1)))
    return F.rlike(src, F.lit(index)), F.array_distinct(F.flatten(F.transform(seen, of))).cast("array<int>")


def _guard(text: str, p: Pattern) -> str:
    """The guard as an expression string: a pack of rules then costs one parse, not many calls."""
    parts = []
    if p.any_of:
        subject = f"lower({text})" if p.ignore_case_guard else text
        parts.append(" OR ".join(f"contains({subject}, {sql_quote(w)})" for w in p.any_of))
    if p.guard:
        parts.append(f"rlike({text}, {sql_quote(java_pattern(p.guard))})")
    return " AND ".join(f"({x})" for x in parts) or "true"


def find_matches(
    units: DataFrame,
    patterns: Sequence[Pattern],
    text: str = "line",
    gates: Mapping[str, Column] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """All non-overlapping matches of all patterns.

    Adds ``pattern_key``, ``match``, ``start`` (0-based byte offset in the text), ``captures``
    (array, '' for a capture that took no part) and, with ``multiline``, ``line_offset`` (line
    breaks before the match), ``line_start`` (byte offset of the line the match starts on).
    ``gates`` maps gate names to conditions on the text's row.
    """
    patterns = list(patterns)
    src = F.col(text)
    patterns_left = set(range(len(patterns)))
    no_ids = F.array().cast("array<int>")
    possible, lists = F.lit(False), []

    def gated(gate: str | None, ids: Column) -> Column:
        return ids if gate is None else F.when(gates[gate], ids).otherwise(no_ids)

    # literal guards by one walk; "" and characters that a regex may not see alone are tested one by one
    for folded in (False, True):
        own = [i for i, p in enumerate(patterns) if p.any_of and p.ignore_case_guard == folded and all(p.any_of)]
        owners: dict[str, list[int]] = {}
        for i in own:
            for w in patterns[i].any_of:
                owners.setdefault(w, []).append(i)
        if len(owners) < INDEX_LITERALS:
            continue
        some, ids = _indexed(F.lower(src) if folded else src, owners)
        gates_of = sorted({patterns[i].gate or "" for i in own})
        if "" not in gates_of:
            some = reduce(or_, (gates[g] for g in gates_of)) & some
        possible = possible | some
        for gate in gates_of:
            # a constant array, read by number: a set of this gate's patterns would be built anew for each text
            mine = string_array("1" if (p.gate or "") == gate else "0" for p in patterns)
            lists.append(gated(gate or None, ids if len(gates_of) == 1 else F.filter(ids, lambda i: F.element_at(mine, i + 1) == "1")))  # noqa: B023
        guards = {i: java_pattern(patterns[i].guard) for i in own if patterns[i].guard}
        if guards:
            lists[-len(gates_of):] = [F.filter(x, lambda i: ~i.isin(*guards) | reduce(or_, (
                (i == k) & F.rlike(src, F.lit(g)) for k, g in guards.items()))) for x in lists[-len(gates_of):]]  # noqa: B023
        patterns_left -= set(own)
    by_gate: dict[str | None, list[tuple[int, str]]] = {}
    for i in sorted(patterns_left):
        by_gate.setdefault(patterns[i].gate, []).append((i, _guard(f"`{text}`", patterns[i])))
    # drop the texts no pattern can match in generated code, before any array is built
    for gate, guarded in by_gate.items():
        some = F.expr(" OR ".join(f"({g})" for _, g in guarded))
        ids = F.expr("array_remove(array(" + ", ".join(f"CASE WHEN {g} THEN {i} ELSE -1 END" for i, g in guarded) + "), -1)")
        possible = possible | (some if gate is None else gates[gate] & some)
        lists.append(gated(gate, ids))
    # many guards make one method too long for the JVM to compile; code that holds a lambda is cut into short ones.  Lists that
    # stand in their own step are evaluated by such code, those inside an explode term by term
    apart = F.exists(F.array(src), lambda t: F.lit(True))
    candidates = units.filter(possible & apart).withColumn("_pids", F.when(apart, F.concat(*lists)))
    candidates = candidates.withColumn("_pid", F.explode_outer("_pids")).filter(F.col("_pid").isNotNull())

    at = F.col("_pid") + 1
    regex = F.element_at(string_array(java_pattern(p.pattern) for p in patterns), at)
    n_caps = F.element_at(string_array(str(p.captures) for p in patterns).cast("array<int>"), at)
    key = F.element_at(string_array(p.key for p in patterns), at)

    matched = candidates.select(*units.columns, regex.alias("_re"), n_caps.alias("_n"), key.alias("pattern_key"), "_pid")
    rows = F.explode(F.expr(_match_rows(f"`{text}`", patterns, multiline))).alias("_row")
    extra = ["match", "start", "captures"] + (["line_offset", "line_start"] if multiline else [])
    return matched.select(*units.columns, "pattern_key", rows).select(
        *units.columns, "pattern_key", *[f"_row.{c}" for c in extra]
    )


def _marked(text: str, patterns: Sequence[Pattern]) -> str:
    """The text with ``MARK`` before and behind every match, and behind it the captures, each with a ``MARK`` behind it.

    Patterns are literals here, so each is compiled once for a task and not once for a text; halves of the patterns are told
    apart first, so a text is not compared with the number of each.
    """
    def branch(i: int, p: Pattern) -> str:
        marks = "".join(f"{MARK}${k}" for k in range(p.captures + 1)) + MARK
        regex, rep = (sql_quote(x).replace("$", "\\u0024") for x in (java_pattern(p.pattern), marks))
        return f"WHEN {i} THEN regexp_replace({text}, {regex}, {rep})"

    def choose(first: int, last: int) -> str:
        if last - first <= CASE_BRANCHES:
            return "CASE _pid " + " ".join(branch(i, patterns[i]) for i in range(first, last)) + " END"
        half = (first + last) // 2
        return f"IF(_pid < {half}, {choose(first, half)}, {choose(half, last)})"

    return choose(0, len(patterns)) if patterns else "CAST(NULL AS STRING)"


def _match_rows(text: str, patterns: Sequence[Pattern], multiline: bool) -> str:
    """Array of match structs of one (text, pattern) pair, as an expression string; null when nothing matches.

    ``q`` binds the marked text's pieces: gap, match, captures, gap and so on, ``_n + 2`` pieces for a match.  A single
    match needs no sums.  Else ``p`` binds the matches ``m``, the gaps ``g`` around them (one more than matches) and the
    captures; the start of match i is the size of all gaps up to i and all matches before it.  A text that holds the
    mark itself has its matches, gaps and captures from a pass for each.
    """
    max_caps = max((p.captures for p in patterns), default=0)

    def parts(matches: str, gaps: str, capture) -> str:
        fields = [f"'m', {matches}", f"'g', {gaps}"] + [f"'c{k}', IF(_n >= {k}, {capture(k)}, NULL)" for k in range(1, max_caps + 1)]
        return "named_struct(" + ", ".join(fields) + ")"

    def every(k: int) -> str:
        return f"filter(q, (q_x, q_j) -> q_j % (_n + 2) = {k})"

    plain = parts(f"regexp_extract_all({text}, _re, 0)", f"split({text}, _re, -1)", lambda k: f"regexp_extract_all({text}, _re, {k})")
    pieces = f"IF(q IS NULL, {plain}, {parts(every(1), every(0), lambda k: every(k + 1))})"
    captures = (
        "slice(array(" + ", ".join(f"p.c{k}[i]" for k in range(1, max_caps + 1)) + "), 1, _n)" if max_caps
        else "CAST(array() AS ARRAY<STRING>)"
    )
    start = "s[i] + octet_length(p.g[i])"
    sizes = "transform(p.m, (m, i) -> octet_length(p.g[i]) + octet_length(m))"
    row = f"'match', m, 'start', {start}, 'captures', {captures}"
    single = "'match', q[1], 'start', octet_length(q[0]), 'captures', slice(q, 3, _n)"

    def breaks(t: str) -> str:
        return f"(octet_length({t}) - octet_length(replace({t}, '\\n', '')))"

    def tail(t: str) -> str:
        return f"octet_length(substring_index({t}, '\\n', -1))"

    def rows(several: str) -> str:
        body = sql_let(pieces, "p", sql_let(prefix_scan(sizes, "z"), "s", several))
        cases = f"CASE WHEN {text} IS NULL OR size(q) = 1 THEN NULL WHEN size(q) = _n + 3 THEN array(named_struct({single})) ELSE {body} END"
        return sql_let(f"IF(contains({text}, '{MARK}'), NULL, split({_marked(text, patterns)}, '{MARK}', -1))", "q", cases)

    if not multiline:
        return rows(f"transform(p.m, (m, i) -> named_struct({row}))")

    # byte just after the last line break inside a gap, or inside a gap and its match; else -1
    in_gap = f"IF({breaks('p.g[i]')} > 0, {start} - {tail('p.g[i]')}, -1)"
    in_piece = f"IF({breaks('m')} > 0, {start} + octet_length(m) - {tail('m')}, {in_gap})"
    all_breaks = prefix_scan(f"transform(p.m, (m, i) -> {breaks('p.g[i]')} + {breaks('m')})", "y")
    last_break = prefix_scan(f"transform(p.m, (m, i) -> {in_piece})", "w", "max")
    flat = f"transform(p.m, (m, i) -> named_struct({row}, 'line_offset', 0, 'line_start', 0))"
    row += f", 'line_offset', b[i] + {breaks('p.g[i]')}, 'line_start', greatest(l[i], {in_gap}, 0)"
    single += f", 'line_offset', {breaks('q[0]')}, 'line_start', IF({breaks('q[0]')} > 0, octet_length(q[0]) - {tail('q[0]')}, 0)"
    body = f"transform(p.m, (m, i) -> named_struct({row}))"
    spread_out = sql_let(all_breaks, "b", sql_let(last_break, "l", body))
    return rows(f"IF(contains({text}, '\\n'), {spread_out}, {flat})")
