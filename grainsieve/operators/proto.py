"""Prototype-key assignments, as an ordered event table per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.operators.lexical import Pattern
from grainsieve.sources.rules import Rule

# The tracked names and the rule's labels.
TRACKED = "payload|key"
PROTO_RULE = Rule(
    "proto-assignment", "HIGH", "JavaScript", "JavaScript", "HIGH",
    "A tracked key is used for a property assignment without a __proto__ check.",
    metadata={
        "category": "Prototype Pollution", "cwe": ["CWE-1321"], "owasp": ["A03:2021"],
        "remediation": "Reject __proto__, constructor and prototype as keys.",
    },
)
EVENT_PATTERNS = (
    Pattern("proto declare", rf"\b(?:var|let|const)\s+({TRACKED})\s*(?:=|;|,|$)", 1, any_of=("payload", "key")),
    Pattern("proto sanitize", rf"""\bif\s*\(\s*({TRACKED})\s*(?:[=!]==?|[<>]=?)\s*(?:'__proto__'|"__proto__")\s*\)""", 1,
            any_of=("__proto__",)),
    Pattern("proto sink", rf"[A-Za-z_$][\w$.]*\[\s*({TRACKED})\s*\]\s*=\s*[^=;\s][^;]*", 1, any_of=("payload", "key")),
)


def proto_events(matches: DataFrame) -> DataFrame:
    """declare / sanitize / sink events, from matches of the event patterns."""
    return matches.filter(F.col("rule_id").isin([p.key for p in EVENT_PATTERNS])).withColumns({
        "kind": F.col("rule_id"),
        "name": F.get("captures", 0),
        "pos": F.col("line_no").cast("long") * (1 << 31) + F.col("start"),
    })


def unsafe_sinks(events: DataFrame) -> DataFrame:
    """Sinks whose name was declared before and not sanitized since.

    Events of one (path, name) come from one source text, so a window never holds more than one
    row of the corpus produced.
    """
    before = Window.partitionBy("path", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("pos"))).over(before)
    state = events.withColumns({"_declared": latest("proto declare"), "_sanitized": latest("proto sanitize")})
    return state.filter(
        (F.col("kind") == "proto sink") & F.col("_declared").isNotNull()
        & (F.col("_sanitized").isNull() | (F.col("_sanitized") < F.col("_declared")))
    ).drop("_declared", "_sanitized")


def proto_matches(matches: DataFrame) -> DataFrame:
    """Unsafe sinks in the shape of rule matches."""
    return unsafe_sinks(proto_events(matches)).withColumn("rule_id", F.lit(PROTO_RULE.id)).select(*matches.columns)
