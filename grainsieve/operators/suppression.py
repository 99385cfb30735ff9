"""Inline suppression comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainsieve.functions.text import java_pattern, let, trim_space

# Fixed value: the directive.
DIRECTIVE = r"(?i)scanner-(di[s\x{17f}]able-(line|next-line)|expected(?:-next-line)?)\b([^*\n\r]*)"


def _rule_ids(raw: Column) -> Column:
    body = trim_space(F.regexp_replace(trim_space(raw), r"[*/]+$", ""))
    return F.filter(F.transform(F.split(body, "[,; \t]+", -1), trim_space), lambda x: x != "")


def directives(line: Column) -> Column:
    """Honoured directives of a line: array of (is_next, ids); no ids means every rule.

    A directive counts only when a comment opener stands before the first ``scanner-``.
    """
    regex = F.lit(java_pattern(DIRECTIVE))
    before = F.substring_index(F.lower(line), "scanner-", 1)
    in_comment = (
        F.contains(before, F.lit("//")) | F.contains(before, F.lit("#")) | F.contains(before, F.lit("/*"))
        | F.endswith(trim_space(before), F.lit("*"))
    )
    names = F.regexp_extract_all(line, regex, F.lit(1))
    found = let(
        F.regexp_extract_all(line, regex, F.lit(3)),
        lambda bodies: F.transform(
            names,
            lambda n, i: F.struct(
                F.contains(F.lower(n), F.lit("next-line")).alias("is_next"),
                _rule_ids(F.get(bodies, i)).alias("ids"),
            ),
        ),
    )
    present = F.contains(F.lower(line), F.lit("scanner-")) & in_comment
    return F.when(present, found).otherwise(F.array().cast("array<struct<is_next:boolean,ids:array<string>>>"))


def is_suppressed(line: Column, prev_line: Column, rule_id: Column) -> Column:
    """Does a directive on this line, or a next-line directive above it, cover the rule?"""
    def covers(d: Column) -> Column:
        return (F.size(d["ids"]) == 0) | F.array_contains(d["ids"], rule_id)

    here = F.exists(directives(line), lambda d: ~d["is_next"] & covers(d))
    above = F.exists(directives(F.coalesce(prev_line, F.lit(""))), lambda d: d["is_next"] & covers(d))
    return here | above
