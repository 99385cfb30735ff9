"""Rules: the data model, rule files, and normalisation of rule tables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainsieve.functions.normalize import SEVERITY_RANK, clean_list
from grainsieve.functions.paths import LANGUAGE_ALIASES, LANGUAGE_DISPLAY, language_alias
from grainsieve.functions.text import is_blank, java_pattern, trim_space
from grainsieve.operators.lexical import Pattern
from grainsieve.session import local_table
from grainsieve.sources.rulepack import ARG, GAP, RULE_TEXT

_ALIAS_KEY = {alias: key for key, aliases in LANGUAGE_ALIASES.items() for alias in aliases}

# Severity and framework names of imported rule bundles.
BUNDLE_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
BUNDLE_FRAMEWORK = {
    "JavaScript": ("javascript", "js", "typescript", "ts", "jsx", "tsx"),
    "React": ("react",),
    "Angular": ("angular",),
    "Vue": ("vue",),
    "Node.js": ("node", "nodejs", "node.js"),
    "Express": ("express",),
    "Next.js": ("next", "nextjs", "next.js"),
}


@dataclass
class Rule:
    id: str
    severity: str
    framework: str = ""
    language: str = ""
    confidence: str = ""
    description: str = ""
    message: str = ""
    pattern: str = ""
    capture_names: list[str] = field(default_factory=list)
    finding_capture: str = ""
    requires_literal: list[str] = field(default_factory=list)
    scope: str = "line"
    tags: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    cwe: list[str] = field(default_factory=list)
    owasp: list[str] = field(default_factory=list)
    remediation: str = ""
    requires_dependency: list[str] = field(default_factory=list)
    ignore_if_literal: list[str] = field(default_factory=list)
    ignore_if_matches: dict[str, str] = field(default_factory=dict)
    require_if_matches: dict[str, str] = field(default_factory=dict)
    min_arg_count: int | None = None
    max_arg_count: int | None = None
    sink_capture: str = ""
    require_tainted: bool = False
    require_proven_tainted: bool = False
    sink_arg_index: int | None = None
    metadata: dict = field(default_factory=dict)

    @property
    def language_key(self) -> str:
        name = self.language.strip().lower()
        return _ALIAS_KEY.get(name, name)

    @property
    def effective_confidence(self) -> str:
        return self.confidence.upper() if self.confidence else "MEDIUM"

    @property
    def effective_description(self) -> str:
        return self.description.strip() or self.message.strip() or f"Rule {self.id.strip()} matched"

    def as_pattern(self, gate: str | None) -> Pattern:
        return Pattern(self.id, self.pattern, re.compile(self.pattern).groups,
                       any_of=tuple(self.requires_literal), gate=gate)


_LIST = T.ArrayType(T.StringType())
RULE_SCHEMA = T.StructType([
    T.StructField("rule_order", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("framework", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("effective_description", T.StringType()),
    T.StructField("capture_names", _LIST),
    T.StructField("finding_capture", T.StringType()),
    T.StructField("tags", _LIST),
    T.StructField("references", _LIST),
    T.StructField("cwe", _LIST),
    T.StructField("owasp", _LIST),
    T.StructField("remediation", T.StringType()),
    T.StructField("requires_dependency", _LIST),
    T.StructField("ignore_if_literal", _LIST),
    T.StructField("ignore_if_matches", T.MapType(T.StringType(), T.StringType())),
    T.StructField("require_if_matches", T.MapType(T.StringType(), T.StringType())),
    T.StructField("min_arg_count", T.IntegerType()),
    T.StructField("max_arg_count", T.IntegerType()),
    T.StructField("taint", T.StructType([
        T.StructField("sink_capture", T.StringType()),
        T.StructField("require_tainted", T.BooleanType()),
        T.StructField("require_proven_tainted", T.BooleanType()),
        T.StructField("sink_arg_index", T.IntegerType()),
    ])),
    T.StructField("metadata", T.StructType([
        T.StructField("category", T.StringType()),
        T.StructField("taxonomy", _LIST),
        T.StructField("cwe", _LIST),
        T.StructField("owasp", _LIST),
        T.StructField("references", _LIST),
        T.StructField("remediation", T.StringType()),
        T.StructField("confidence_rationale", T.StringType()),
    ])),
])


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a dimension table of known size (a local relation)."""
    rows = []
    for i, r in enumerate(rules):
        m = r.metadata
        meta = {c: m.get(c, []) for c in ("taxonomy", "cwe", "owasp", "references")}
        meta |= {c: m.get(c, "") for c in ("category", "remediation", "confidence_rationale")}
        rows.append({
            "rule_order": i, "rule_id": r.id, "severity": r.severity, "framework": r.framework,
            "language": r.language_key, "confidence": r.effective_confidence, "description": r.description,
            "effective_description": r.effective_description, "capture_names": r.capture_names,
            "finding_capture": r.finding_capture, "tags": r.tags, "references": r.references, "cwe": r.cwe,
            "owasp": r.owasp, "remediation": r.remediation, "requires_dependency": r.requires_dependency,
            "ignore_if_literal": r.ignore_if_literal,
            "ignore_if_matches": [(k, java_pattern(v)) for k, v in r.ignore_if_matches.items()],
            "require_if_matches": [(k, java_pattern(v)) for k, v in r.require_if_matches.items()],
            "min_arg_count": r.min_arg_count, "max_arg_count": r.max_arg_count,
            "taint": {
                "sink_capture": r.sink_capture, "require_tainted": r.require_tainted,
                "require_proven_tainted": r.require_proven_tainted, "sink_arg_index": r.sink_arg_index,
            },
            "metadata": meta,
        })
    return local_table(spark, rows, RULE_SCHEMA)


def builtin_rules() -> list[Rule]:
    rules = []
    for block in RULE_TEXT.strip().split("\n\n"):
        head, *rest = block.splitlines()
        rid, severity, framework, language, confidence, scope = (x.strip() for x in head.split("|"))
        rule = Rule(rid, severity, framework, language, confidence, scope=scope)
        for line in rest:
            kind, value = line[0], line[2:]
            if kind == "d":
                rule.description = value
            elif kind == "g":
                rule.requires_literal = ["use server"] if value == "use server" else value.split()
            elif kind == "p":
                rule.pattern = value.replace("<ARG>", ARG).replace("<GAP>", GAP)
            elif kind == "c":
                rule.capture_names = [n.lstrip("*") for n in value.split()]
                rule.finding_capture = next((n[1:] for n in value.split() if n[0] == "*"), "")
            else:
                _set_option(rule, *value.split("=", 1))
        rules.append(rule)
    return rules


def _set_option(rule: Rule, name: str, value: str) -> None:
    if name == "literal":
        rule.ignore_if_literal = value.split(",")
    elif name in ("ignore", "require"):
        capture, regex = value.split(":", 1)
        getattr(rule, f"{name}_if_matches")[capture] = regex
    elif name == "taint":
        capture, _, index = value.partition(",")
        rule.sink_capture, rule.require_tainted = capture, True
        rule.sink_arg_index = int(index) if index else None
    elif name == "dep":
        rule.requires_dependency = value.split(",")
    elif name == "tags":
        rule.tags = value.split(",")
    elif name in ("rcwe", "rowasp"):
        setattr(rule, name[1:], value.split(","))
    elif name == "rfix":
        rule.remediation = value
    else:
        key = {"cat": "category", "tax": "taxonomy", "fix": "remediation"}.get(name, name)
        rule.metadata[key] = value if name in ("cat", "fix") else value.split(",")


# --- rule files -----------------------------------------------------------------------------


def _strings(value) -> list[str]:
    if value is None:
        return []
    items = value if isinstance(value, list) else [value]
    for item in items:
        if isinstance(item, (list, dict)):
            raise ValueError(f"expected a string or a list of strings, got {value!r}")
    return [s for s in (str(v).strip() for v in items) if s]


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def load_rules(folder: str) -> list[Rule]:
    """Rules from the YAML files below ``folder``, in walk order (driver side: rule packs are tiny).

    A file with ``id`` and ``pattern`` is one rule; one with ``rules:`` is an imported bundle;
    anything else is skipped.  Bundle entries without id or a pattern that compiles are skipped.
    """
    import yaml

    rules: list[Rule] = []
    for base, dirs, names in os.walk(folder):
        dirs.sort()
        for name in sorted(names):
            if not name.endswith((".yaml", ".yml")):
                continue
            with open(os.path.join(base, name), encoding="utf-8") as f:
                doc = yaml.safe_load(f) or {}
            if doc.get("id") and doc.get("pattern"):
                rules.append(_native_rule(doc))
            else:
                rules += [r for r in map(_bundle_rule, doc.get("rules") or ()) if r is not None]
    return rules


def _native_rule(doc: dict) -> Rule:
    taint, meta = doc.get("taint") or {}, dict(doc.get("metadata") or {})
    for key in ("taxonomy", "cwe", "owasp", "references"):
        meta[key] = _strings(meta.get(key))
    return Rule(
        str(doc["id"]), str(doc.get("severity") or ""), str(doc.get("framework") or ""),
        str(doc.get("language") or ""), str(doc.get("confidence") or ""),
        str(doc.get("description") or ""), str(doc.get("message") or ""), doc["pattern"],
        _strings(doc.get("capture_names")), str(doc.get("finding_capture") or ""),
        _strings(doc.get("requires_literal")), str(doc.get("scope") or "line"),
        _strings(doc.get("tags")), _strings(doc.get("references")), _strings(doc.get("cwe")),
        _strings(doc.get("owasp")), str(doc.get("remediation") or ""),
        _strings(doc.get("requires_dependency")), _strings(doc.get("ignore_if_literal")),
        dict(doc.get("ignore_if_matches") or {}), dict(doc.get("require_if_matches") or {}),
        doc.get("min_arg_count"), doc.get("max_arg_count"),
        str(taint.get("sink_capture") or ""), bool(taint.get("require_tainted")),
        bool(taint.get("require_proven_tainted")), taint.get("sink_arg_index"), meta,
    )


def _bundle_rule(doc: dict) -> Rule | None:
    meta = doc.get("metadata") or {}
    candidates = [doc.get("query"), meta.get("query")]
    for key in ("pattern-either", "patterns"):
        candidates += [p.get("pattern") for p in doc.get(key) or () if isinstance(p, dict)]
    pattern = next((c.strip() for c in candidates if c and c.strip() and compiles(c.strip())), "")
    rid = str(doc.get("id") or "").strip()
    if not rid or not pattern:
        return None
    languages = [str(x).strip().lower() for x in doc.get("languages") or ()]
    explicit = str(meta.get("framework") or "").strip()
    framework = explicit or next(
        (f for x in languages for f, names in BUNDLE_FRAMEWORK.items() if x in names), "JavaScript"
    )
    keys = ([_ALIAS_KEY.get(explicit.lower())] if explicit else []) + [_ALIAS_KEY.get(x) for x in languages]
    language = next((LANGUAGE_DISPLAY[k] for k in keys if k), "JavaScript")
    severity = str(doc.get("severity") or "").strip().upper()
    severity = BUNDLE_SEVERITY.get(severity, severity if severity in SEVERITY_RANK else "MEDIUM")
    message = str(doc.get("message") or "").strip()
    return Rule(
        rid, severity, framework, language, str(meta.get("confidence") or "").strip(),
        message or str(meta.get("description") or "").strip() or f"Imported from bundle rule {rid}",
        message, pattern, tags=_strings(meta.get("tags")), references=_strings(meta.get("references")),
        cwe=_strings(meta.get("cwe")), owasp=_strings(meta.get("owasp")),
        remediation=str(meta.get("remediation") or "").strip(),
        requires_dependency=_strings(meta.get("requires_dependency")), metadata=dict(meta),
    )


# --- rule tables ----------------------------------------------------------------------------


def normalize_native_rules(df: DataFrame) -> DataFrame:
    """Defaults of native rule rows: language, confidence, description, clean lists."""
    blank = lambda c: is_blank(F.col(c))
    return df.withColumns({
        "language": language_alias(F.col("language")),
        "confidence": F.when(F.coalesce("confidence", F.lit("")) == "", "MEDIUM").otherwise(F.upper("confidence")),
        "effective_description": F.when(~blank("description"), trim_space(F.col("description")))
        .when(~blank("message"), trim_space(F.col("message")))
        .otherwise(F.concat(F.lit("Rule "), trim_space(F.col("id")), F.lit(" matched"))),
        **{c: clean_list(F.col(c)) for c in ("tags", "cwe", "owasp", "references") if c in df.columns},
    })


def _first_that_compiles():
    """The first pattern of each array that compiles, else null (nested, so that it is shipped by value)."""

    def check(arrays: pd.Series) -> pd.Series:
        import re

        def first(patterns) -> str | None:
            for p in patterns:
                try:
                    re.compile(p)
                except (re.error, TypeError):
                    continue
                return p
            return None

        return arrays.map(first)

    return F.pandas_udf(check, T.StringType())


def _first_of(values: Column, names: dict[str, str]) -> Column:
    """First element that has a name, mapped to it; null when none has."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    mapped = F.filter(F.transform(values, lambda v: F.try_element_at(table, F.lower(trim_space(v)))),
                      lambda v: v.isNotNull())
    return F.try_element_at(mapped, F.lit(1))


def import_bundle_rules(df: DataFrame) -> DataFrame:
    """Bundle rows (id, severity, message, query, pattern_either, patterns, languages, metadata_*)
    as rule rows; rows without an id or any pattern that compiles are dropped."""
    framework_names = {n: f for f, names in BUNDLE_FRAMEWORK.items() for n in names}
    language_names = {a: LANGUAGE_DISPLAY[k] for a, k in _ALIAS_KEY.items()}
    none = F.array().cast("array<string>")
    candidates = F.filter(
        F.transform(
            F.concat(
                F.array("query", "metadata_query"), F.coalesce("pattern_either", none), F.coalesce("patterns", none)
            ),
            lambda c: trim_space(F.coalesce(c, F.lit(""))),
        ),
        lambda c: c != "",
    )
    severity = F.upper(trim_space(F.coalesce("severity", F.lit(""))))
    bundle = F.create_map(*[F.lit(x) for kv in BUNDLE_SEVERITY.items() for x in kv])
    explicit = trim_space(F.coalesce("metadata_framework", F.lit("")))
    own = df.withColumn("id", trim_space(F.col("id"))).filter(~is_blank(F.col("id")))
    # each row is judged by its own candidates, so rows may repeat an id
    own = own.withColumn("pattern", _first_that_compiles()(candidates)).filter(F.col("pattern").isNotNull())
    message = trim_space(F.coalesce("message", F.lit("")))
    about = trim_space(F.coalesce("metadata_description", F.lit("")))
    return own.select(
        "id",
        F.coalesce(
            F.try_element_at(bundle, severity), F.when(severity.isin(*SEVERITY_RANK), severity), F.lit("MEDIUM")
        ).alias("severity"),
        F.when(explicit != "", explicit)
        .otherwise(F.coalesce(_first_of(F.col("languages"), framework_names), F.lit("JavaScript")))
        .alias("framework"),
        F.coalesce(
            F.when(explicit != "", _first_of(F.array(explicit), language_names)),
            _first_of(F.col("languages"), language_names),
            F.lit("JavaScript"),
        ).alias("language"),
        F.when(message != "", message).when(about != "", about)
        .otherwise(F.concat(F.lit("Imported from bundle rule "), F.col("id"))).alias("description"),
        "pattern",
    )
