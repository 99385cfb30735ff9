"""Sensitive-data inventory over a corpus."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.text import inventory_snippet, string_map
from grainsieve.operators.lexical import Pattern, find_matches
from grainsieve.sources.corpus import to_lines
from grainsieve.sources.detectors import LITERAL_GUARDS, Detector, builtin_detectors, expand_words

# U+212A and U+017F fold onto k and s when case is ignored.
_FOLDING = (chr(0x212A), chr(0x17F))


def _word_boundary(pattern: str) -> str:
    return rf"(?i)\b(?:{pattern})\b"


def _folded(pattern: str) -> str:
    return "".join({"k": "[k\\x{212a}]", "s": "[s\\x{17f}]"}.get(c, c) for c in pattern)


def literal_patterns(detectors: Sequence[Detector]) -> list[Pattern]:
    none = ((), "", False)
    builtin = {d.id: d.literal_patterns for d in builtin_detectors()}
    out = []
    for d in detectors:
        for p in d.literal_patterns:
            any_of, guard, digits = LITERAL_GUARDS.get(d.id, none) if p in builtin.get(d.id, ()) else none
            out.append(Pattern(d.id, p, any_of=any_of, guard=guard, gate="digits" if digits else None))
    return out


def identifier_dictionary(detectors: Sequence[Detector]) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """Word -> detectors for patterns that are plain words; the other patterns stay regexes."""
    words: dict[str, list[str]] = {}
    rest: list[tuple[str, str]] = []
    for d in detectors:
        for p in d.identifier_patterns:
            expanded = expand_words(p)
            if expanded is None:
                rest.append((d.id, p))
                continue
            for w in expanded:
                owners = words.setdefault(w.lower(), [])
                if d.id not in owners:
                    owners.append(d.id)
    return words, rest


_TOKEN = "[A-Za-z0-9_]+"


def identifier_patterns(detectors: Sequence[Detector]) -> tuple[list[Pattern], dict[str, list[str]]]:
    """Identifier detectors as one token pattern, a word list, and a few regexes.

    A whole-word pattern made of word characters matches exactly one ASCII token, so those
    patterns become a word list (its size is fixed by the detectors) and a text is tokenised
    once, instead of meeting a hundred regexes.  Patterns that can span tokens, and texts with
    characters that fold onto ASCII letters, take the regex path.
    """
    words, rest = identifier_dictionary(detectors)
    patterns = [Pattern(_TOKEN, _TOKEN, gate="word")] if words else []
    patterns += [
        Pattern(d, _word_boundary(p), any_of=(_literal_head(p),), ignore_case_guard=True, gate="plain")
        for d, p in rest
    ]
    patterns += [
        Pattern(d.id, _word_boundary(_folded(p)), gate="folding")
        for d in detectors
        for p in d.identifier_patterns
    ]
    return patterns, words


def _literal_head(pattern: str) -> str:
    """The letters a pattern must start with; its guard."""
    head = ""
    for i, ch in enumerate(pattern):
        if not ch.isalpha() or pattern[i + 1 : i + 2] in ("?", "*", "{"):
            break
        head += ch
    return head.lower()


def raw_matches(lines: DataFrame, detectors: Sequence[Detector], kinds: Sequence[str]) -> DataFrame:
    """Match rows of all detectors, from one narrow pass over the lines."""
    folding = F.contains("line", F.lit(_FOLDING[0])) | F.contains("line", F.lit(_FOLDING[1]))
    patterns: list[Pattern] = []
    words: dict[str, list[str]] = {}
    if "literal" in kinds:
        patterns += [replace(p, key="literal " + p.key) for p in literal_patterns(detectors)]
    if "identifier" in kinds:
        ids, words = identifier_patterns(detectors)
        patterns += [replace(p, key="identifier " + p.key) for p in ids]
    word_list = ", ".join(f"'{w}'" for w in words) or "''"
    has_word = F.expr(f"exists(regexp_extract_all(line, '{_TOKEN}', 0), w -> lower(w) IN ({word_list}))")
    gates = {
        "digits": F.rlike(F.col("line"), F.lit(r"\d[\d.]")),
        "plain": ~folding,
        "folding": folding,
        "word": ~folding & has_word if words else F.lit(False),
    }
    found = find_matches(lines, patterns, gates=gates).select(
        "path", "line_no", "line",
        F.split_part("pattern_key", F.lit(" "), F.lit(1)).alias("match_kind"),
        F.split_part("pattern_key", F.lit(" "), F.lit(2)).alias("detector_id"),
        "start", "match",
    )
    if not words:
        return found
    # few rows are left here, so a constant map names the detectors of a word
    is_token = F.col("detector_id") == _TOKEN
    owners = string_map((w, "\n".join(ds)) for w, ds in words.items())
    found = found.filter(~is_token | F.expr(f"lower(match) IN ({word_list})"))
    owner = F.when(is_token, F.split(F.try_element_at(owners, F.lower("match")), "\n", -1)).otherwise(F.array("detector_id"))
    return found.select("path", "line_no", "line", "match_kind", F.explode(owner).alias("detector_id"), "start", "match")


def inventory_detections(
    files: DataFrame,
    detectors: Sequence[Detector] | None = None,
    kinds: Sequence[str] = ("identifier", "literal"),
) -> DataFrame:
    """One row per (file, line, column, detector, kind, match)."""
    detectors = builtin_detectors() if detectors is None else list(detectors)
    lines = to_lines(files, neighbours=False).filter(F.col("line") != "")
    found = raw_matches(lines, detectors, kinds)
    if _may_repeat(detectors):
        found = found.dropDuplicates(["path", "line_no", "start", "detector_id", "match_kind", "match"])

    def label(attr: str):
        return F.element_at(string_map((d.id, getattr(d, attr)) for d in detectors), F.col("detector_id"))

    return found.select(
        "detector_id",
        label("category").alias("category"),
        label("data_type").alias("data_type"),
        label("effective_severity").alias("severity"),
        "match_kind",
        F.col("path").alias("file"),
        F.col("line_no").alias("line"),
        (F.col("start") + 1).alias("column"),
        (F.col("start") + F.octet_length("match") + 1).alias("end_column"),
        "match",
        inventory_snippet(F.col("line")).alias("snippet"),
    )


def _may_repeat(detectors: Sequence[Detector]) -> bool:
    """Can two patterns of one detector report the same match?

    The built-in detectors cannot, so their rows need no distinct.
    """
    words, rest = identifier_dictionary(detectors)
    ids = [d.id for d in detectors]
    spanning = [d for d, _ in rest]
    if len(set(ids)) != len(ids) or len(set(spanning)) != len(spanning):
        return True
    if any(len(d.literal_patterns) > 1 for d in detectors):
        return True
    if any(d in owners and re.fullmatch(p, w, re.I) for d, p in rest for w, owners in words.items()):
        return True
    # the folding path tries every pattern by itself: two patterns must not share a word
    for d in detectors:
        seen: set[str] = set()
        for p in d.identifier_patterns:
            mine = {w.lower() for w in expand_words(p) or ()}
            if mine & seen:
                return True
            seen |= mine
    return False


def sort_detections(detections: DataFrame) -> DataFrame:
    return detections.orderBy("file", "line", "column", "detector_id")
