"""SQL for the registered queries, over the given tables and the same derived inputs.

The statements are written for an engine with linear-time regexes, list functions and lambdas;
they follow the definitions, not the Spark plans.
"""

from __future__ import annotations

import re

from grainsieve.functions import paths as PA
from grainsieve.functions.normalize import CONFIDENCE_RANK, SEVERITY_RANK
from grainsieve.functions.text import SPACE_CLASS
from grainsieve.operators import taint as TA
from grainsieve.operators.packages import FRAMEWORK_PACKAGES
from grainsieve.operators.proto import EVENT_PATTERNS, PROTO_RULE
from grainsieve.plans import derived as D
from grainsieve.plans import reports as R
from grainsieve.plans.derived import quote as q
from grainsieve.plans.queries import ARG_RULE, FINDING_KEYS, NOW, PAGE_PROBES, TIMESTAMP
from grainsieve.sources import manifests as M
from grainsieve.sources import pages as PG
from grainsieve.sources.detectors import builtin_detectors
from grainsieve.sources.rules import BUNDLE_FRAMEWORK, BUNDLE_SEVERITY, builtin_rules

NL = "chr(10)"
ORACLES: dict[str, str] = {}


# --- building blocks ------------------------------------------------------------------------


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE_CLASS}]+', ''), '[{SPACE_CLASS}]+$', '')"


def squeeze(x: str) -> str:
    inner = f"regexp_replace({x}, '[{SPACE_CLASS}]+', ' ', 'g')"
    return trim(inner)


def blank(x: str) -> str:
    return f"({x} IS NULL OR {trim(x)} = '')"


def cut(x: str, n: int) -> str:
    """Trimmed and cut to n bytes; the bytes of a split character become U+FFFD each."""
    t = trim(x)
    return (
        f"(list_transform([{t}], lambda t: CASE WHEN strlen(t) > {n} THEN list_transform("
        f"[list_max(list_filter(range({n} // 4, {n} + 1), lambda k: strlen(left(t, k)) <= {n}))], "
        f"lambda k: left(t, k) || repeat(chr(65533), CAST({n} - strlen(left(t, k)) AS INT)) || '...')[1] ELSE t END)[1])"
    )


def fp(rule: str, path: str, code: str, *context: str) -> str:
    nul = "chr(0)"
    parts = [trim(rule), path, squeeze(code)]
    body = " || ".join(f"{p} || {nul}" for p in parts)
    for c in context:
        body += f" || coalesce({squeeze(c)} || {nul}, '')"
    return f"left(sha256({body}), 16)"


def case_map(x: str, pairs, default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs) + f" ELSE {default} END"


def language(path: str) -> str:
    ext = f"lower(regexp_extract({path}, '(\\.[^./]*)$', 1))"
    return case_map(ext, [(e, k) for k, es in PA.LANGUAGE_EXTENSIONS.items() for e in es])


LINES_TAIL = (
    "SELECT path, language, i AS line_no, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] END AS prev_line, ls[i + 1] AS next_line "
    "FROM (SELECT path, language, ls, unnest(range(1, len(ls) + 1)) AS i FROM "
    f"(SELECT path, language, string_split(content, {NL}) AS ls FROM files))"
)
DOCS = "SELECT 'documents/' || doc_id || '.txt' AS path, text AS content, NULL AS language FROM documents"
TEXTS = (
    DOCS + " UNION ALL SELECT 'pages/' || page_id || '.html', html, NULL FROM pages"
    " UNION ALL SELECT 'conversations/' || conv_id || '-' || turn || '.txt', text, NULL FROM conversations"
)
CODE = f"SELECT path, text AS content, {language('path')} AS language FROM ({D.CODE_FILES.sql})"


def with_lines(files: str) -> str:
    return f"WITH files AS MATERIALIZED ({files}), lines AS MATERIALIZED ({LINES_TAIL})"


def _bytes(list_expr: str, unit: str = "strlen(x)") -> str:
    return f"coalesce(list_sum(list_transform({list_expr}, lambda x: {unit})), 0)"


def all_matches(source: str, key: str, pattern: str, caps: int, where: str = "true", text: str = "line") -> str:
    """Every match of a pattern with its byte offset."""
    p = q(pattern)
    caps_sql = ", ".join(f"regexp_extract_all({text}, {p}, {k}) AS c{k}" for k in range(1, caps + 1))
    cap_list = "[" + ", ".join(f"coalesce(c{k}[i], '')" for k in range(1, caps + 1)) + "]" if caps else "CAST([] AS VARCHAR[])"
    return (
        f"SELECT path, language, {q(key)} AS rule_id, line_no, line, prev_line, next_line, m[i] AS match, "
        f"CAST({_bytes('g[1:i]')} + {_bytes('m[1:i - 1]')} AS BIGINT) AS start, {cap_list} AS captures, 0 AS breaks "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, {p}) AS m, "
        f"regexp_split_to_array({text}, {p}) AS g{', ' + caps_sql if caps else ''} FROM {source} "
        f"WHERE {where} AND regexp_matches({text}, {p})))"
    )


def file_matches(key: str, pattern: str, caps: int, where: str) -> str:
    p = q(pattern)
    caps_sql = ", ".join(f"regexp_extract_all(content, {p}, {k}) AS c{k}" for k in range(1, caps + 1))
    cap_list = "[" + ", ".join(f"coalesce(c{k}[i], '')" for k in range(1, caps + 1)) + "]" if caps else "CAST([] AS VARCHAR[])"
    at = f"len(string_split(prefix, {NL}))"
    return (
        f"SELECT path, language, {q(key)} AS rule_id, {at} AS line_no, string_split(content, {NL})[{at}] AS line, "
        f"CASE WHEN {at} > 1 THEN string_split(content, {NL})[{at} - 1] END AS prev_line, string_split(content, {NL})[{at} + 1] AS next_line, "
        f"m[i] AS match, strlen(string_split(prefix, {NL})[-1]) AS start, {cap_list} AS captures, "
        f"len(string_split(m[i], {NL})) - 1 AS breaks "
        f"FROM (SELECT *, left(content, CAST({_bytes('g[1:i]', 'length(x)')} + {_bytes('m[1:i - 1]', 'length(x)')} AS BIGINT)) AS prefix "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(content, {p}) AS m, "
        f"regexp_split_to_array(content, {p}) AS g{', ' + caps_sql if caps else ''} FROM files "
        f"WHERE {where} AND regexp_matches(content, {p}))))"
    )


def rule_matches(rules) -> str:
    parts = []
    for r in rules:
        where = f"language = {q(r.language_key)}"
        n = re.compile(r.pattern).groups
        parts.append(all_matches("lines", r.id, r.pattern, n, where) if r.scope == "line" else file_matches(r.id, r.pattern, n, where))
    return " UNION ALL ".join(parts)


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(rows_) + ")" for rows_ in rows)


def sql_list(items) -> str:
    return "CAST([" + ", ".join(q(i) for i in items) + "] AS VARCHAR[])"


# --- lines and scalars ----------------------------------------------------------------------

ORACLES["corpus_lines"] = f"{with_lines(DOCS)} SELECT path, line_no, line, prev_line, next_line FROM lines"
ORACLES["size_cap"] = f"SELECT path, CAST(strlen(content) AS BIGINT) AS size FROM ({DOCS}) WHERE strlen(content) <= 4096"
ORACLES["snippet"] = f"{with_lines(DOCS)} SELECT path, line_no, {cut('line', 120)} AS snippet, {cut('line', 200)} AS inventory_snippet FROM lines"
_HL = r"\b\d{2,}\b|\S+@\S+"


def marked_line(start: str, stop: str) -> str:
    """The line with the marker around bytes [start, stop); offsets become character counts."""
    chars = lambda b: f"list_filter(range(0, length(line) + 1), lambda k: strlen(left(line, k)) = {b})[1]"
    return (
        f"list_transform([[{chars(start)}, {chars(stop)}]], lambda p: left(line, p[1]) || '[[DANGEROUS]]' || "
        f"substr(line, p[1] + 1, p[2] - p[1]) || '[[/DANGEROUS]]' || substr(line, p[2] + 1))[1]"
    )


ORACLES["highlight"] = (
    f"{with_lines(DOCS)} SELECT path, line_no, start, {cut('marked', 120)} AS highlighted FROM "
    f"(SELECT *, {marked_line('start', 'start + strlen(match)')} AS marked FROM ({all_matches('lines', 'N', _HL, 0)}))"
)
ORACLES["fingerprints"] = (
    f"{with_lines(DOCS)} SELECT path, line_no, " + fp("' LINE '", "substr(path, 11)", "line", "prev_line", "next_line") + " AS fingerprint FROM lines"
)
ORACLES["language_for_path"] = f"SELECT path, {language('path')} AS language FROM ({D.PATHS.sql})"
_alias = case_map(f"lower({trim('name')})", [(a, k) for k, al in PA.LANGUAGE_ALIASES.items() for a in al], f"lower({trim('name')})")
ORACLES["language_alias"] = f"SELECT o_orderkey, {_alias} AS language FROM ({D.LANGUAGE_NAMES.sql})"


def _any_segment(path: str, names) -> str:
    return " OR ".join(f"contains({path}, '/{n}/') OR starts_with({path}, '{n}/')" for n in names)


_base = "string_split(lower(path), '/')[-1]"
_is_test = f"(contains({_base}, '.test.') OR contains({_base}, '.spec.') OR {_any_segment('lower(path)', PA.TEST_SEGMENTS)})"
_is_vendored = (
    "(" + " OR ".join(f"ends_with({_base}, '{e}')" for e in (".min.js", ".min.mjs", ".min.cjs", ".d.ts"))
    + f" OR {_any_segment('lower(path)', PA.VENDORED_SEGMENTS)})"
)
_pruned = lambda names: f"(list_has_any(string_split(path, '/')[1:-2], {sql_list(names)}))"
_lang = language("path")
_V, _T = PA.PRUNED_VENDORED_DIRS, PA.TEST_SEGMENTS
ORACLES["path_filters"] = (
    f"SELECT path, {_is_test} AS is_test, {_is_vendored} AS is_vendored, {_pruned(_V + _T)} AS is_pruned, "
    f"({_lang} IS NOT NULL AND NOT {_is_test} AND NOT {_is_vendored} AND NOT {_pruned(_V + _T)}) AS scanned, "
    f"({_lang} IS NOT NULL AND NOT {_is_vendored} AND NOT {_pruned(_V)}) AS scanned_with_tests, "
    f"({_lang} IS NOT NULL AND NOT {_is_test} AND NOT {_pruned(_T)}) AS scanned_with_vendored FROM ({D.PATHS.sql})"
)
_ext = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
ORACLES["inventory_paths"] = (
    f"SELECT path, ({_lang} IS NOT NULL OR list_contains({sql_list(PA.INVENTORY_EXTENSIONS)}, {_ext})) AS default_set, "
    f"({_lang} IS NOT NULL OR list_contains({sql_list(PA.INVENTORY_EXTENSIONS + ('.gz',))}, {_ext})) AS with_extra FROM ({D.PATHS.sql})"
)
ORACLES["rel_path"] = f"SELECT path, CASE WHEN starts_with(path, 'src/') THEN substr(path, 5) ELSE path END AS rel_path FROM ({D.PATHS.sql})"
_roots = f"SELECT DISTINCT regexp_replace({trim('path')}, '/+$', '') AS root FROM ({D.EXCLUDED.sql}) WHERE {trim('path')} <> ''"
ORACLES["excluded_paths"] = (
    f"SELECT path FROM ({D.CODE_FILES.sql}) f WHERE NOT EXISTS (SELECT 1 FROM ({_roots}) r WHERE f.path = r.root OR starts_with(f.path, r.root || '/'))"
)
_entries = f"SELECT DISTINCT {trim('value')} AS e FROM ({D.CHANGED_LINES.sql}) WHERE {trim('value')} <> '' AND NOT starts_with({trim('value')}, '#')"
_fixed_abs = "replace(e, '/abs/./x/../', '/abs/')"
ORACLES["changed_files_parse"] = (
    f"SELECT DISTINCT CASE WHEN starts_with(e, '/') THEN {_fixed_abs} WHEN c.path IS NOT NULL THEN '/work/t/' || e ELSE '/home/u/' || e END AS path "
    f"FROM ({_entries}) LEFT JOIN (SELECT DISTINCT path FROM ({D.CODE_FILES.sql})) c ON c.path = e"
)
ORACLES["changed_files"] = (
    f"SELECT '/' || path AS path FROM ({D.CODE_FILES.sql}) WHERE path IN (SELECT CASE WHEN starts_with(e, '/') THEN substr({_fixed_abs}, 2) ELSE e END FROM ({_entries}))"
)
_clean_list = lambda c: f"list_filter(list_transform({c}, lambda v: {trim('v')}), lambda v: v <> '')"
_joined_clean = lambda c: f"CASE WHEN len({_clean_list(c)}) > 0 THEN array_to_string({_clean_list(c)}, ';') END"
_kind = f"CASE WHEN {blank('kind')} THEN 'code' ELSE lower({trim('kind')}) END"
_conf = lambda c: f"CASE WHEN {blank(c)} THEN 'MEDIUM' ELSE upper({trim(c)}) END"
_frame = lambda c: f"CASE WHEN {blank(c)} THEN 'JavaScript' ELSE {c} END"
_sevs = "('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')"
ORACLES["normalize_fields"] = (
    f"SELECT file, line, {_kind} AS kind, {_frame('framework')} AS framework, {_conf('confidence')} AS confidence, "
    f"CASE WHEN upper({trim('severity')}) IN {_sevs} THEN upper({trim('severity')}) ELSE 'MEDIUM' END AS severity, "
    f"{_joined_clean('tags')} AS tags FROM ({D.FINDINGS.sql})"
)
_level = lambda s: f"CASE upper({trim(s)}) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END"
_precision = lambda c: f"CASE {_conf(c)} WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low' ELSE 'medium' END"
_secsev = lambda s: f"CASE upper({trim(s)}) WHEN 'CRITICAL' THEN '9.0' WHEN 'HIGH' THEN '8.0' WHEN 'MEDIUM' THEN '5.0' ELSE '3.0' END"
ORACLES["sarif_levels"] = (
    f"SELECT file, line, {_level('severity')} AS level, {_precision('confidence')} AS precision, {_secsev('severity')} AS security_severity FROM ({D.FINDINGS.sql})"
)
_rank = lambda s, ranks: f"CASE upper({s}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 0 END"
_gate = lambda sev, conf: f"{_rank('severity', SEVERITY_RANK)} >= {sev} AND {_rank('confidence', CONFIDENCE_RANK)} >= {conf}"
ORACLES["severity_gate"] = f"SELECT file, line, severity, confidence FROM ({D.FINDINGS.sql}) WHERE {_gate(2, 1)}"

# --- inventory ------------------------------------------------------------------------------


def detections(files: str) -> str:
    parts = []
    for d in builtin_detectors():
        for kind, pats in (("identifier", [rf"(?i)\b(?:{p})\b" for p in d.identifier_patterns]), ("literal", d.literal_patterns)):
            for p in pats:
                parts.append(
                    f"SELECT {q(d.id)} AS detector_id, {q(d.category)} AS category, {q(d.data_type)} AS data_type, {q(d.effective_severity)} AS severity, "
                    f"{q(kind)} AS match_kind, path AS file, line_no AS line, start + 1 AS \"column\", start + strlen(match) + 1 AS end_column, match, "
                    f"{cut('line', 200)} AS snippet FROM ({all_matches('lines', d.id, p, 0, where='true')})"
                )
    return f"{with_lines(files)}, det AS MATERIALIZED (SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + "))"


_DET = detections(TEXTS)
ORACLES["inventory_detections"] = f"{_DET} SELECT * FROM det"
ORACLES["inventory_csv_rows"] = ORACLES["inventory_detections"]
ORACLES["inventory_identifiers"] = f"{detections(CODE)} SELECT * FROM det"
ORACLES["inventory_summary"] = f"{_DET} SELECT category, data_type, severity, count(*) AS occurrences, count(DISTINCT file) AS files FROM det GROUP BY ALL"
ORACLES["inventory_by_category"] = f"{_DET} SELECT category, count(*) AS count FROM det GROUP BY ALL"
ORACLES["inventory_by_type"] = f"{_DET} SELECT data_type, count(*) AS count FROM det GROUP BY ALL"
ORACLES["inventory_totals"] = f"{_DET} SELECT count(*) AS total_detections, count(DISTINCT file) AS files_with_data FROM det"


def json_map(key: str, source: str) -> str:
    """A JSON object of counts with sorted keys."""
    return f"(SELECT '{{' || string_agg(to_json({key}) || ':' || n, ',' ORDER BY {key}) || '}}' FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY 1))"


ORACLES["inventory_json_header"] = (
    f"{_DET} SELECT '{{\"timestamp\":\"{TIMESTAMP}\",\"target_directory\":\"corpus\",\"total_detections\":' || count(*) "
    f"|| coalesce(',\"category_summary\":' || {json_map('category', 'det')}, '') || coalesce(',\"data_type_summary\":' || {json_map('data_type', 'det')}, '') "
    f"|| CASE WHEN count(*) > 0 THEN ',\"files_with_data\":' || count(DISTINCT file) ELSE '' END || '}}' AS header FROM det"
)

# --- rules ----------------------------------------------------------------------------------

_native_alias = case_map(f"lower({trim('language')})", [(a, k) for k, al in PA.LANGUAGE_ALIASES.items() for a in al], f"lower({trim('language')})")
_described = (
    f"CASE WHEN NOT {blank('description')} THEN {trim('description')} WHEN NOT {blank('message')} THEN {trim('message')} ELSE 'Rule ' || {trim('id')} || ' matched' END"
)
_native_conf = "CASE WHEN confidence = '' THEN 'MEDIUM' ELSE upper(confidence) END"
ORACLES["rules_normalized"] = (
    f"SELECT id, {_native_alias} AS language, {_native_conf} AS confidence, {_described} AS effective_description, {_joined_clean('tags')} AS tags FROM ({D.NATIVE_RULES.sql})"
)
_own_id = f"CASE WHEN {trim('id')} <> '' THEN {trim('id')} || (CASE WHEN ends_with(id, ' ') THEN ' ' ELSE '' END) || '/' || part ELSE '' END"
_low = lambda v: f"lower({trim(v)})"
_names = [(n, f) for f, ns in BUNDLE_FRAMEWORK.items() for n in ns]
_lang_names = [(a, PA.LANGUAGE_DISPLAY[k]) for k, al in PA.LANGUAGE_ALIASES.items() for a in al]
_first = lambda lst, pairs: f"list_filter(list_transform({lst}, lambda v: {case_map(_low('v'), pairs)}), lambda v: v IS NOT NULL)[1]"
_bundle_sev = case_map(f"upper({trim('severity')})", list(BUNDLE_SEVERITY.items()) + [(s, s) for s in SEVERITY_RANK], "'MEDIUM'")
ORACLES["bundle_rules"] = (
    f"SELECT id, {_bundle_sev} AS severity, CASE WHEN {trim('metadata_framework')} <> '' THEN {trim('metadata_framework')} "
    f"ELSE coalesce({_first('languages', _names)}, 'JavaScript') END AS framework, "
    f"coalesce(CASE WHEN {trim('metadata_framework')} <> '' THEN {case_map(_low('metadata_framework'), _lang_names)} END, {_first('languages', _lang_names)}, 'JavaScript') AS language, "
    f"CASE WHEN {trim('message')} <> '' THEN {trim('message')} WHEN {trim('metadata_description')} <> '' THEN {trim('metadata_description')} ELSE 'Imported from bundle rule ' || id END AS description, "
    "pattern FROM (SELECT *, list_filter(list_transform([query, metadata_query] || pattern_either || patterns, "
    f"lambda c: {trim('c')}), lambda c: c <> '' AND NOT starts_with(c, '(('))[1] AS pattern FROM (SELECT * REPLACE ("
    f"CASE WHEN {trim('id')} <> '' THEN regexp_replace(id, '^ +', '') || '/' || part ELSE '' END AS id) FROM ({D.BUNDLE_RULES.sql}))) WHERE id <> '' AND pattern IS NOT NULL"
)
_deps = f"SELECT package FROM ({D.PACKAGES.sql}) UNION SELECT 'pkg#' || right(id, 1) FROM ({D.ADVISORIES_B.sql})"
ORACLES["dependency_gate"] = (
    f"SELECT id AS rule_id, array_to_string(requires_dependency, ';') AS requires_dependency FROM ({D.NATIVE_RULES.sql}) "
    f"WHERE list_has_any(requires_dependency, (SELECT list(package) FROM ({_deps})))"
)
_flat = "path, rule_id, line_no, start + 1 AS \"column\", match, array_to_string(captures, '|') AS captures"
_RULES = builtin_rules()
_CODE_MATCHES = f"{with_lines(CODE)}, matches AS MATERIALIZED ({rule_matches(_RULES)})"
ORACLES["rule_scan"] = f"{_CODE_MATCHES} SELECT {_flat} FROM matches"
_INLINE = (
    "SELECT 'pages/' || page_id || '/inline_1.js' AS path, 'javascript' AS language, regexp_extract(html, '(?is)<script[^>]*>(.*?)</script', 1) AS content FROM pages"
)
ORACLES["rule_scan_pages"] = (
    f"{with_lines(_INLINE)} SELECT {_flat} FROM (" + " UNION ALL ".join(all_matches("lines", p.key, p.pattern, p.captures) for p in PAGE_PROBES) + ")"
)


def rule_values(rules) -> str:
    rows = []
    for r in rules:
        m = r.metadata
        at = r.capture_names.index(r.finding_capture) + 1 if r.finding_capture else 0
        rows.append([
            q(r.id), q(r.severity), q(r.framework), q(r.effective_confidence), sql_list(r.capture_names), str(at), sql_list(r.tags),
            q(m.get("category", "")), sql_list(m.get("cwe", [])), sql_list(m.get("owasp", [])), sql_list(m.get("taxonomy", [])), q(m.get("remediation", "")),
            sql_list(r.ignore_if_literal),
            q(next(iter(r.ignore_if_matches), "")), q(next(iter(r.ignore_if_matches.values()), "")),
            q(next(iter(r.require_if_matches), "")), q(next(iter(r.require_if_matches.values()), "")),
        ])
    return (
        f"({values(rows)}) AS rules(rid, severity, framework, confidence, names, fin, tags, category, cwe, owasp, taxonomy, remediation, "
        "literal, ignore_name, ignore_re, require_name, require_re)"
    )


_own = "(fin > 0 AND coalesce(captures[fin], '') <> '')"
_raw = "captures[fin]"
_col0 = f"CASE WHEN {_own} THEN start + strlen(match) - strlen({_raw}) ELSE start END"
_end0 = f"CASE WHEN breaks > 0 THEN strlen(string_split(match, {NL})[-1]) WHEN {_own} THEN start + strlen(match) - strlen({_raw}) + strlen({trim(_raw)}) ELSE start + strlen(match) END"
_code = trim(f"(CASE WHEN {_own} THEN {_raw} ELSE match END)")
_LOCATED = (
    f"SELECT *, {_code} AS matched_code, {_col0} AS c0, {_end0} AS e0, {cut('line', 120)} AS snippet FROM matches JOIN {rule_values(_RULES)} ON rid = rule_id"
)
_highlighted = (
    f"CASE WHEN breaks > 0 THEN '[[DANGEROUS]]' || {cut('line', 120)} || '[[/DANGEROUS]] (lines ' || line_no || '-' || (line_no + breaks) || ')' "
    f"ELSE {cut(marked_line('c0', 'e0'), 120)} END"
)
_enriched = {
    "file": "path", "line": "line_no", "column": "c0 + 1", "end_line": "line_no + breaks", "end_column": "e0 + 1", "highlighted_snippet": _highlighted,
    "fingerprint": fp("rule_id", "path", "matched_code", "prev_line", "next_line"),
}
ORACLES["findings_enriched"] = (
    f"{_CODE_MATCHES} SELECT " + ", ".join(f"{_enriched.get(c, c)} AS \"{c}\"" for c in FINDING_KEYS)
    + ", " + ", ".join(f"array_to_string({c}, ';') AS {c}" for c in ("tags", "cwe", "owasp", "taxonomy"))
    + f" FROM ({_LOCATED})"
)

# --- expression classes ---------------------------------------------------------------------

# The derived inputs nest less deeply than these patterns reach; the engine itself has no such bound.
_ROUNDS = 6
_MASK = ((r"\([^()\[\]{}]*\)", "@"), (r"\[[^()\[\]{}]*\]", "#"), (r"\{[^()\[\]{}]*\}", "'"))
_TEXT = r""""[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|`[^`]*`"""
_INNER = r"""[^()\[\]{}"'`]*"""
_LEVEL = rf"[(\[{{]{_INNER}(?:(?:{_TEXT}){_INNER})*[)\]}}]"
for _ in range(2):
    _LEVEL = rf"[(\[{{]{_INNER}(?:(?:{_TEXT}|{_LEVEL}){_INNER})*[)\]}}]"
_ARGUMENT = rf"""(?:[^()\[\]{{}},"'`]|{_TEXT}|{_LEVEL})+"""


def _steps(x: str, steps) -> str:
    for p, to in steps:
        x = f"regexp_replace({x}, {q(p)}, {q(to)}, 'g')"
    return x


def plain(x: str) -> str:
    return f"regexp_replace({_steps(x, TA.TEMPLATE_STEPS)}, {q(TA.STRING)}, '\"\"', 'g')"


def mask_cte(source: str, expr: str, out: str) -> str:
    """Add ``out``: the masked form of ``expr`` (one projection per round keeps the text short)."""
    sql = f"SELECT *, {plain(expr)} AS {out}_0 FROM ({source})"
    for i in range(_ROUNDS):
        sql = f"SELECT *, {_steps(f'{out}_{i}', _MASK)} AS {out}_{i + 1} FROM ({sql})"
    chained = f"replace({out}_{_ROUNDS}, '?.', '.')"
    return f"SELECT *, {trim(chained)} AS {out} FROM ({sql})"


_NAME = f"^{TA.IDENT}$"
_KW = sql_list(TA.KEYWORDS)


def names_sql(x: str) -> str:
    text = f"regexp_replace(replace({plain(x)}, '...', ' '), {q(TA.OBJECT_KEY)}, '\\1', 'g')"
    return f"list_distinct(list_filter(regexp_extract_all({text}, {q(TA.REFERENCE)}, 1), lambda n: NOT list_contains({_KW}, n)))"


def facts(source: str, expr: str = "expr") -> str:
    """Add base, ids, pass_ids, all_ids of an expression column."""
    sql = f"SELECT *, {trim(expr)} AS u0 FROM ({source})"
    for i in range(2):
        sql = mask_cte(sql, f"u{i}", f"w{i}")
        sql = f"SELECT *, CASE WHEN w{i} = '@' THEN {trim(f'substr(u{i}, 2, length(u{i}) - 2)')} ELSE u{i} END AS u{i + 1} FROM ({sql})"
    sql = mask_cte(sql, "u2", "mk")
    _unary = f"regexp_replace(p, {q(TA.UNARY)}, '')"
    sql = (
        f"SELECT *, CASE WHEN regexp_matches(u2, {q(TA.REGEX_LITERAL)}) THEN ['true'] WHEN regexp_matches(mk, {q(TA.NOT_SIMPLE)}) THEN ['x@@'] ELSE "
        f"list_filter(list_transform(regexp_split_to_array(mk, {q(TA.BINARY)}), lambda p: {trim(_unary)}), lambda p: p <> '') END AS parts FROM ({sql})"
    )
    core = f"regexp_replace(p, {q(TA.PASS_SUFFIX)}, '')"
    is_name = f"(regexp_matches(p, {q(_NAME)}) AND NOT list_contains({_KW}, p))"
    tainted = f"regexp_matches(p, {q(TA.TAINTED_PART)})"
    passing = f"({core} <> p AND regexp_matches({core}, {q(_NAME)}) AND NOT list_contains({_KW}, {core}) AND NOT {tainted})"
    rank = (
        f"CASE WHEN regexp_matches(p, {q(TA.CONST_PART)}) THEN 0 WHEN regexp_matches({core}, {q(TA.SANITIZED_PART)}) THEN 2 "
        f"WHEN {tainted} THEN 3 WHEN {is_name} OR {passing} THEN NULL ELSE 1 END"
    )
    return (
        f"SELECT *, list_max(list_transform(parts, lambda p: {rank})) AS base, list_distinct(list_filter(parts, lambda p: {is_name})) AS ids, "
        f"list_distinct(list_transform(list_filter(parts, lambda p: {passing} AND NOT {is_name}), lambda p: {core})) AS pass_ids, {names_sql('u2')} AS all_ids FROM ({sql})"
    )


_sorted = lambda c: f"array_to_string(list_sort({c}), ',')"
_literal = "(coalesce(base, 1) = 0 AND len(ids) = 0 AND len(pass_ids) = 0)"
ORACLES["taint_classify"] = (
    f"SELECT file, pos, CAST(base AS BIGINT) AS base, {_sorted('ids')} AS ids, {_sorted('pass_ids')} AS pass_ids, {_literal} AS is_literal FROM ({facts(D.STATEMENTS.sql)})"
)
ORACLES["taint_names"] = f"SELECT file, pos, {_sorted(names_sql('target'))} AS bound, {_sorted(names_sql('expr'))} AS referenced FROM ({D.STATEMENTS.sql})"


def named(n: str) -> str:
    """The last non-empty capture of a name, null without one."""
    c = trim("captures[i]")
    return f"list_transform(list_filter(range(1, len(names) + 1), lambda i: names[i] = {n} AND {c} <> ''), lambda i: {c})[-1]"


_lit_src = f"SELECT *, {named('literal[1]')} AS lit_expr FROM matches JOIN {rule_values(_RULES)} ON rid = rule_id"
ORACLES["capture_filters"] = (
    f"{_CODE_MATCHES} SELECT {_flat} FROM ({facts(_lit_src, 'lit_expr')}) WHERE (lit_expr IS NULL OR NOT {_literal}) "
    f"AND (ignore_name = '' OR NOT coalesce(regexp_matches({named('ignore_name')}, ignore_re), false)) "
    f"AND (require_name = '' OR coalesce(regexp_matches({named('require_name')}, require_re), false))"
)
_args = f"list_filter(list_transform(regexp_extract_all({trim('captures[2]')}, {q(_ARGUMENT)}), lambda a: {trim('a')}), lambda a: a <> '')"
ORACLES["arg_count"] = (
    f"{with_lines(CODE)} SELECT path, line_no, start + 1 AS \"column\", CASE WHEN {trim('captures[2]')} <> '' THEN len({_args}) END AS n_args "
    f"FROM ({all_matches('lines', ARG_RULE.id, ARG_RULE.pattern, 2, where='language = ' + q('javascript'))}) "
    f"WHERE {trim('captures[2]')} = '' OR len({_args}) BETWEEN 1 AND 2"
)
_closer = "CASE t[i] WHEN '(' THEN ')' WHEN '[' THEN ']' WHEN '{' THEN '}' END"
ORACLES["argument_split"] = f"""
WITH RECURSIVE src AS (SELECT args, regexp_extract_all(args, {q(TA.ARGUMENT_PIECES)}) AS t FROM (SELECT DISTINCT args FROM ({D.ARGUMENTS.sql}))),
walk AS (
  SELECT args, t, 0 AS i, '' AS open, 1 AS arg, '' AS piece FROM src
  UNION ALL
  SELECT args, t, i, CASE WHEN {_closer} IS NOT NULL THEN open || {_closer} WHEN t[i] IN (')', ']', '}}') AND contains(open, t[i]) THEN left(open, length(open) - instr(reverse(open), t[i])) ELSE open END,
    CASE WHEN t[i] = ',' AND open = '' THEN arg + 1 ELSE arg END, CASE WHEN t[i] = ',' AND open = '' THEN '' ELSE t[i] END
  FROM (SELECT args, t, i + 1 AS i, open, arg FROM walk WHERE i < len(t))
), parts AS (
  SELECT args, arg, {trim("string_agg(piece, '' ORDER BY i)")} AS argument FROM walk GROUP BY args, arg
)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY arg) AS place, argument FROM ({D.ARGUMENTS.sql}) JOIN parts USING (args) WHERE argument <> ''"""
_DIR = r"(?i)scanner-(disable-(line|next-line)|expected(?:-next-line)?)\b([^*\n\r]*)"


def covers(line: str, nxt: bool) -> str:
    before = f"string_split(lower({line}), 'scanner-')[1]"
    comment = f"(contains({before}, '//') OR contains({before}, '#') OR contains({before}, '/*') OR ends_with({trim(before)}, '*'))"


    def ids(x: str) -> str:
        body = trim(f"regexp_replace({trim(x)}, '[*/]+$', '')")
        return f"list_filter(list_transform(regexp_split_to_array({body}, '[,; \\t]+'), lambda t: {trim('t')}), lambda t: t <> '')"

    bodies, kinds = f"regexp_extract_all({line}, {q(_DIR)}, 3)", f"regexp_extract_all({line}, {q(_DIR)}, 1)"
    hit = f"(len({ids(f'{bodies}[i]')}) = 0 OR list_contains({ids(f'{bodies}[i]')}, rule_id))"
    side = f"contains(lower({kinds}[i]), 'next-line')" if nxt else f"NOT contains(lower({kinds}[i]), 'next-line')"
    return f"(contains(lower({line}), 'scanner-') AND {comment} AND len(list_filter(range(1, len({kinds}) + 1), lambda i: {side} AND {hit})) > 0)"


ORACLES["suppressions"] = (
    f"{_CODE_MATCHES} SELECT path, rule_id, line_no, start + 1 AS \"column\", ({covers('line', False)} OR coalesce({covers('prev_line', True)}, false)) AS suppressed "
    "FROM matches"
)
_events = " UNION ALL ".join(all_matches("lines", p.key, p.pattern, p.captures, "language = 'javascript'") for p in EVENT_PATTERNS)
_last = lambda kind: (
    f"(SELECT max(e.line_no * 2147483648 + e.start) FROM ev e WHERE e.path = s.path AND e.captures[1] = s.captures[1] AND e.rule_id = '{kind}' "
    "AND e.line_no * 2147483648 + e.start < s.line_no * 2147483648 + s.start)"
)
ORACLES["proto_assignment"] = (
    f"{with_lines(CODE)}, ev AS MATERIALIZED ({_events}) SELECT path, line_no, start + 1 AS \"column\", match FROM "
    f"(SELECT *, {_last('proto declare')} AS d, {_last('proto sanitize')} AS z FROM ev s WHERE s.rule_id = 'proto sink') WHERE d IS NOT NULL AND (z IS NULL OR z < d)"
)

# --- the composed scan ----------------------------------------------------------------------

_SCANNED = f"{_lang} IS NOT NULL AND NOT {_is_test} AND NOT {_is_vendored} AND NOT {_pruned(_V + _T)}"
_PROTO_ROWS = (
    f"SELECT * EXCLUDE (d, z) REPLACE ({q(PROTO_RULE.id)} AS rule_id) FROM (SELECT *, {_last('proto declare')} AS d, {_last('proto sanitize')} AS z FROM ev s WHERE s.rule_id = 'proto sink') "
    "WHERE d IS NOT NULL AND (z IS NULL OR z < d)"
)
_SCAN_SOURCE = f"SELECT *, {named('literal[1]')} AS lit_expr FROM (SELECT * FROM matches UNION ALL BY NAME {_PROTO_ROWS}) JOIN {rule_values([*_RULES, PROTO_RULE])} ON rid = rule_id"
_SCAN_KEPT = (
    f"SELECT * FROM ({facts(_SCAN_SOURCE, 'lit_expr')}) WHERE (lit_expr IS NULL OR NOT {_literal}) AND (ignore_name = '' OR NOT coalesce(regexp_matches({named('ignore_name')}, ignore_re), false)) "
    f"AND (require_name = '' OR coalesce(regexp_matches({named('require_name')}, require_re), false)) AND NOT ({covers('line', False)} OR coalesce({covers('prev_line', True)}, false)) AND {_gate(2, 2)}"
)
_scan_columns = _enriched | {"fingerprint": fp("rule_id", "CASE WHEN starts_with(path, 'src/') THEN substr(path, 5) ELSE path END", "matched_code", "prev_line", "next_line")}
ORACLES["rule_scan_findings"] = (
    with_lines(f"SELECT * FROM ({CODE}) WHERE {_SCANNED}") + f", matches AS MATERIALIZED ({rule_matches(_RULES)}), ev AS MATERIALIZED ({_events}) SELECT "
    + ", ".join(f"{_scan_columns.get(c, c)} AS \"{c}\"" for c in FINDING_KEYS) + ", array_to_string(cwe, ';') AS cwe FROM "
    f"(SELECT *, {_code} AS matched_code, {_col0} AS c0, {_end0} AS e0, {cut('line', 120)} AS snippet FROM ({_SCAN_KEPT}))"
)

# --- propagation ----------------------------------------------------------------------------

_FACTS = f"facts AS MATERIALIZED (SELECT file, pos, base, ids, pass_ids, all_ids, {names_sql('target')} AS targets FROM ({facts(D.STATEMENTS.sql)}))"
_DEFS = "defs AS MATERIALIZED (SELECT file, pos, unnest(targets) AS name FROM facts)"
_USES = (
    "links AS MATERIALIZED (SELECT u.file, u.pos, u.name, max(d.pos) AS def_pos FROM (SELECT file, pos, unnest(all_ids) AS name FROM facts) u "
    "LEFT JOIN defs d ON d.file = u.file AND d.name = u.name AND d.pos < u.pos GROUP BY ALL)"
)
ORACLES["reaching_defs"] = f"WITH {_FACTS}, {_DEFS}, {_USES} SELECT file, pos, name, def_pos FROM links"


def rank_sql(base: str, ids: str, pass_ids: str, all_ids: str, states: str) -> str:
    """Rank from a map of states."""
    st = lambda n: f"coalesce({states}[{n}], 1)"
    direct = (
        f"coalesce(list_max([{base}] || list_transform({ids}, lambda n: {st('n')}) || list_transform({pass_ids}, lambda n: CASE WHEN {st('n')} = 2 THEN 2 ELSE 1 END)), 1)"
    )
    fallback = f"coalesce(list_max(list_transform({all_ids}, lambda n: {st('n')})), 1)"
    return f"CASE WHEN {direct} <> 1 THEN {direct} ELSE {fallback} END"


_EMPTY = "CAST(map([], []) AS MAP(VARCHAR, INTEGER))"
_SOLVED = (
    f"WITH RECURSIVE {_FACTS}, {_DEFS}, {_USES}, need AS MATERIALIZED (SELECT file, pos, count(def_pos) AS n FROM links GROUP BY ALL), "
    "solved(file, pos, rank) USING KEY (file, pos) AS ("
    f"SELECT f.file, f.pos, CAST({rank_sql('base', 'ids', 'pass_ids', 'all_ids', _EMPTY)} AS INTEGER) FROM facts f LEFT JOIN need k ON k.file = f.file AND k.pos = f.pos WHERE coalesce(k.n, 0) = 0 "
    f"UNION SELECT file, pos, CAST({rank_sql('base', 'ids', 'pass_ids', 'all_ids', 'states')} AS INTEGER) FROM ("
    "SELECT f.file, f.pos, any_value(f.base) AS base, any_value(f.ids) AS ids, any_value(f.pass_ids) AS pass_ids, any_value(f.all_ids) AS all_ids, "
    "map(list(l.name), list(s.rank)) AS states FROM facts f JOIN need k ON k.file = f.file AND k.pos = f.pos AND k.n > 0 "
    "JOIN links l ON l.file = f.file AND l.pos = f.pos JOIN recurring.solved s ON s.file = l.file AND s.pos = l.def_pos "
    "WHERE NOT EXISTS (SELECT 1 FROM recurring.solved x WHERE x.file = f.file AND x.pos = f.pos) "
    "GROUP BY f.file, f.pos HAVING count(*) = any_value(k.n)))"
)
ORACLES["taint_propagate"] = f"{_SOLVED} SELECT f.file, f.pos, {_sorted('targets')} AS targets, CAST(rank AS BIGINT) AS rank FROM facts f LEFT JOIN solved s ON s.file = f.file AND s.pos = f.pos"
ORACLES["taint_jumps"] = ORACLES["taint_propagate"]
_FINAL = "finals AS MATERIALIZED (SELECT d.file, d.name, max_by(s.rank, s.pos) AS rank FROM defs d JOIN solved s ON s.file = d.file AND s.pos = d.pos GROUP BY ALL)"
ORACLES["taint_final"] = f"{_SOLVED}, {_FINAL} SELECT file, name, CAST(rank AS BIGINT) AS rank FROM finals"
_sink_args = f"list_filter(list_transform(regexp_extract_all(expr, {q(_ARGUMENT)}), lambda a: {trim('a')}), lambda a: a <> '')"
_chosen = (
    f"CASE WHEN NOT is_args THEN [expr] WHEN sink_arg_index IS NOT NULL THEN (CASE WHEN sink_arg_index < len({_sink_args}) THEN [{_sink_args}[sink_arg_index + 1]] ELSE [] END) ELSE {_sink_args} END"
)
_SINK_FACTS = facts(f"SELECT sink_id, file, unnest({_chosen}) AS arg FROM ({D.SINKS.sql}) WHERE expr <> '' AND require_tainted AND language = 'javascript'", "arg")
ORACLES["taint_gate"] = (
    f"{_SOLVED}, {_FINAL}, states AS MATERIALIZED (SELECT file, map(list(name), list(rank)) AS states FROM finals GROUP BY file), "
    f"ranked AS (SELECT sink_id, max({rank_sql('base', 'ids', 'pass_ids', 'all_ids', 'coalesce(states, ' + _EMPTY + ')')}) AS r FROM ({_SINK_FACTS}) a LEFT JOIN states t ON t.file = a.file GROUP BY sink_id) "
    f"SELECT s.sink_id, rule_id, CASE WHEN require_tainted AND language = 'javascript' AND expr <> '' THEN coalesce(r, 1) END AS sink_rank FROM ({D.SINKS.sql}) s LEFT JOIN ranked k ON k.sink_id = s.sink_id "
    "WHERE NOT require_tainted OR language <> 'javascript' OR (expr = '' AND NOT require_proven_tainted) "
    "OR (expr <> '' AND CASE WHEN require_proven_tainted THEN coalesce(r, 1) = 3 ELSE coalesce(r, 1) NOT IN (0, 2) END)"
)

# --- baseline and reports -------------------------------------------------------------------

_BASE = (
    "SELECT DISTINCT " + trim("f") + " AS fingerprint FROM (SELECT unnest(CASE WHEN starts_with(value, '[') THEN CAST(json(value) AS VARCHAR[]) "
    "WHEN value <> '' THEN coalesce(CAST(json_extract(json(value), '$.fingerprints') AS VARCHAR[]), []) ELSE [] END) AS f FROM "
    f"({D.BASELINE_DOCS.sql})) WHERE {trim('f')} <> ''"
)
ORACLES["baseline_load"] = _BASE
ORACLES["baseline_build"] = f"{with_lines(DOCS)} SELECT DISTINCT " + fp("'LINE'", "''", "line") + " AS fingerprint FROM lines WHERE line <> ''"
ORACLES["baseline_kept"] = f"SELECT file, line, fingerprint FROM ({D.FINDINGS.sql}) WHERE {blank('fingerprint')} OR {trim('fingerprint')} NOT IN ({_BASE})"
ORACLES["baseline_matched"] = f"SELECT file, line, fingerprint FROM ({D.FINDINGS.sql}) WHERE NOT {blank('fingerprint')} AND {trim('fingerprint')} IN ({_BASE})"
_fps = f"SELECT DISTINCT {trim('fingerprint')} AS k FROM ({D.FINDINGS.sql}) WHERE NOT {blank('fingerprint')}"
_head = "'{' || " + NL + " || '  \"version\": 1,' || " + NL + f" || '  \"generated_at\": \"{TIMESTAMP}\",' || " + NL + " || '  \"fingerprints\": ['"
ORACLES["baseline_doc"] = (
    f"SELECT 0 AS part, '' AS key, {_head} AS line UNION ALL SELECT 1, k, '    \"' || k || '\"' || CASE WHEN k = max(k) OVER () THEN '' ELSE ',' END FROM ({_fps}) "
    f"UNION ALL SELECT 2, '', '  ]' || {NL} || '}}'"
)
ORACLES["report_totals"] = (
    f"SELECT count(*) AS total_findings, count(*) FILTER ({_kind} = 'code') AS code_findings, count(*) FILTER ({_kind} = 'dependency') AS dependency_findings FROM ({D.FINDINGS.sql})"
)
_or = lambda c, d: f"CASE WHEN {c} = '' THEN '{d}' ELSE {c} END"
ORACLES["framework_summary"] = (
    f"SELECT {_or('kind', 'code')} AS kind, {_or('framework', 'JavaScript')} AS framework, severity, {_or('confidence', 'MEDIUM')} AS confidence, count(*) AS count FROM ({D.FINDINGS.sql}) GROUP BY ALL"
)
_FW = f"(SELECT {_or('framework', 'JavaScript')} AS framework FROM ({D.FINDINGS.sql}))"
_CATS = f"(SELECT {trim('category')} AS category FROM ({D.FINDINGS.sql}) WHERE NOT {blank('category')})"
ORACLES["framework_counts"] = f"SELECT framework, count(*) AS count FROM {_FW} GROUP BY ALL"
ORACLES["category_counts"] = f"SELECT category, count(*) AS count FROM {_CATS} GROUP BY ALL"
ORACLES["report_json_header"] = (
    f"SELECT '{{\"timestamp\":\"{TIMESTAMP}\",\"target_directory\":\"corpus\",\"total_findings\":' || total_findings || ',\"code_findings\":' || code_findings "
    f"|| ',\"dependency_findings\":' || dependency_findings || ',\"framework_summary\":' || {json_map('framework', _FW)} || ',\"finding_category_summary\":' || {json_map('category', _CATS)} || '}}' AS header "
    f"FROM ({ORACLES['report_totals']})"
)
_csv = {
    "kind": _kind, "framework": _or("framework", "JavaScript"), "confidence": _or("confidence", "MEDIUM"),
    **{c: f"array_to_string({c}, ';')" for c in ("tags", "taxonomy", "cwe", "owasp", "fixed_versions")},
    "references": "array_to_string(\"references\", ';')",
}
ORACLES["findings_csv_rows"] = "SELECT " + ", ".join((_csv.get(c) or f'"{c}"') + f' AS "{c}"' for c in R.FINDINGS_CSV) + f" FROM ({D.FINDINGS.sql})"
_sarif_rules = values([[q(r.id), q(r.effective_description), sql_list(r.tags), sql_list(r.cwe), sql_list(r.owasp)] for r in _RULES])
_none_empty = lambda c: f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, ';') END"
ORACLES["sarif_results"] = (
    f"SELECT rule_id, {_level('severity')} AS level, CASE WHEN r.d IS NOT NULL THEN r.d WHEN NOT {blank('snippet')} THEN snippet ELSE rule_id END AS message, "
    f"CASE WHEN starts_with(file, 'src/') THEN substr(file, 5) ELSE file END AS uri, line AS start_line, \"column\" AS start_column, end_line, end_column, "
    f"CASE WHEN NOT {blank('snippet')} THEN snippet END AS snippet, {_frame('framework')} AS framework, upper({trim('severity')}) AS severity, {_conf('confidence')} AS confidence, "
    f"{_none_empty('r.tags')} AS tags, {_none_empty('r.cwe')} AS cwe, {_none_empty('r.owasp')} AS owasp, CASE WHEN NOT {blank('fingerprint')} THEN fingerprint END AS fingerprint "
    f"FROM ({D.FINDINGS.sql}) f LEFT JOIN ({_sarif_rules}) AS r(id, d, tags, cwe, owasp) ON r.id = f.rule_id"
)
ORACLES["sarif_rules"] = (
    f"SELECT 'R' || (n % 700) AS id, max_by(d, n) AS name, max_by(d, n) AS help, max_by(t, n) AS tags, max_by(p, n) AS precision, '8.0' AS security_severity, 'JavaScript' AS framework, "
    "max_by(c, n) AS confidence, 'CWE-1' AS cwe, CAST(NULL AS VARCHAR) AS owasp, CAST(NULL AS VARCHAR) AS \"references\" FROM "
    f"(SELECT CAST(substr({trim('id')}, 3) AS BIGINT) AS n, {_described} AS d, coalesce({_joined_clean('tags')}, chr(1)) AS t, {_native_conf} AS c, "
    f"CASE {_native_conf} WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low' ELSE 'medium' END AS p FROM ({D.NATIVE_RULES.sql})) GROUP BY 1"
)
ORACLES["sarif_rules"] = f"SELECT * REPLACE (nullif(tags, chr(1)) AS tags) FROM ({ORACLES['sarif_rules']})"
ORACLES["sarif_document"] = (
    "SELECT rule_id, level, message, uri, start_line, end_column, snippet, framework, severity, tags, fingerprint, count(*) AS results "
    f"FROM ({ORACLES['sarif_results']}) GROUP BY ALL"
)

# --- versions and packages ------------------------------------------------------------------


def clean_version(v: str) -> str:
    return f"regexp_replace(regexp_replace(trim({v}), '^[=v]+\\s*', ''), '\\+.*$', '')"


def vkey(v: str) -> str:
    """Sortable key of a version (struct of number list, release flag, pre-release list)."""
    c = clean_version(v)
    core, pre = f"string_split({c}, '-')[1]", f"(CASE WHEN contains({c}, '-') THEN substr({c}, length(string_split({c}, '-')[1]) + 2) ELSE '' END)"
    nums = f"list_transform(string_split({core}, '.'), lambda p: coalesce(try_cast(nullif(regexp_extract(p, '^([0-9]{{1,18}})', 1), '') AS BIGINT), 0))"
    padded = f"({nums} || [CAST(0 AS BIGINT), 0, 0, 0][1:greatest(4 - len(string_split({core}, '.')), 0)])"
    num = "regexp_matches(p, '^[0-9]{1,18}$')"
    parts = (
        f"(CASE WHEN {pre} = '' THEN CAST([] AS STRUCT(alpha BOOLEAN, num BIGINT, str VARCHAR)[]) ELSE list_transform(string_split({pre}, '.'), lambda p: "
        f"{{'alpha': NOT {num}, 'num': CASE WHEN {num} THEN CAST(p AS BIGINT) ELSE 0 END, 'str': CASE WHEN {num} THEN '' ELSE p END}}) END)"
    )
    return f"{{'nums': {padded}, 'is_release': {pre} = '', 'pre': {parts}}}"


ORACLES["version_order"] = (
    "SELECT version, array_to_string(k.nums, '.') AS nums, k.is_release AS is_release, array_to_string(list_transform(k.pre, lambda p: (CASE WHEN p.alpha THEN 'a' ELSE 'n' END) || p.num || p.str), '/') AS pre, "
    f"(k < {vkey(q('3.4.0'))}) AS below, (k < {vkey(q('2.2.2-rc.9'))}) AS below_pre FROM (SELECT version, {vkey('version')} AS k FROM (SELECT DISTINCT version FROM ({D.VERSION_LIST.sql})))"
)
_terms = "list_filter(regexp_split_to_array(regexp_replace(trim(c), '([<>=])\\s+', '\\1', 'g'), '[\\s,]+'), lambda t: t <> '')"
_term = lambda ops: f"list_filter({_terms}, lambda t: list_contains({sql_list(ops)}, regexp_extract(t, '^([<>=]*)', 1)))"
_LO, _HI = _term((">", ">=", "=", "==", "")), _term(("<", "<=", "=", "==", ""))
# every constraint of the derived table has at most one term per side
_ver = lambda t: f"regexp_replace({t}, '^[<>=]*', '')"
_op = lambda t: f"regexp_extract({t}, '^([<>=]*)', 1)"
_RANGES_A = (
    f"SELECT id AS advisory_id, ecosystem, package, severity, title, description, aliases, cwe, \"references\", source, '' AS cvss, CAST(n - 1 AS BIGINT) AS range_no, "
    f"{_ver(_LO + '[1]')} AS lo, coalesce({_op(_LO + '[1]')} <> '>', false) AS lo_inclusive, {_ver(_HI + '[1]')} AS hi, coalesce({_op(_HI + '[1]')} <> '<', false) AS hi_inclusive, fixed_version FROM "
    f"(SELECT *, affected_versions[n] AS c FROM (SELECT *, unnest(range(1, len(affected_versions) + 1)) AS n FROM ({D.ADVISORIES_A.sql})))"
)
_RANGES_B = (
    "SELECT id, 'npm', _package, severity, title, description, aliases, CAST([] AS VARCHAR[]), \"references\", '', '', CAST(n - 1 AS BIGINT), nullif(string_split(r, ',')[1], ''), true, "
    "nullif(string_split(r, ',')[2], ''), false, coalesce(nullif(string_split(r, ',')[2], ''), '') FROM "
    f"(SELECT *, string_split(_ranges, '|')[n] AS r FROM (SELECT *, unnest(range(1, len(string_split(_ranges, '|')) + 1)) AS n FROM ({D.ADVISORIES_B.sql})))"
)
_RANGES = f"{_RANGES_A} UNION ALL {_RANGES_B}"
ORACLES["advisory_ranges"] = f"SELECT advisory_id, ecosystem, package, range_no, lo, lo_inclusive, hi, hi_inclusive, fixed_version FROM ({_RANGES})"
_exact = "regexp_matches(trim(declared_version), '^[=v]*[0-9]+(\\.[0-9]+)*([-+][0-9A-Za-z.+-]*)?$')"
_VERSIONED = (
    f"SELECT *, CASE WHEN resolved_version <> '' THEN {clean_version('resolved_version')} WHEN {_exact} THEN {clean_version('declared_version')} END AS version FROM ({D.PACKAGES.sql})"
)
_MATCHES = (
    f"WITH pk AS MATERIALIZED (SELECT * FROM ({_VERSIONED}) WHERE version IS NOT NULL), vs AS MATERIALIZED (SELECT *, {vkey('version')} AS k FROM (SELECT DISTINCT ecosystem, package, version FROM pk)), "
    f"rg AS MATERIALIZED (SELECT *, CASE WHEN lo IS NOT NULL THEN {vkey('lo')} END AS lk, CASE WHEN hi IS NOT NULL THEN {vkey('hi')} END AS hk FROM ({_RANGES})), "
    "hits AS MATERIALIZED (SELECT vs.ecosystem, vs.package, vs.version, advisory_id, min_by({'f': fixed_version, 'a': aliases, 's': severity, 't': title, 'd': description, 'src': source, 'r': \"references\", 'c': cwe}, range_no) AS a "
    "FROM vs JOIN rg ON rg.ecosystem = vs.ecosystem AND rg.package = vs.package AND (lo IS NULL OR k > lk OR (lo_inclusive AND k = lk)) AND (hi IS NULL OR k < hk OR (hi_inclusive AND k = hk)) GROUP BY ALL), "
    "mt AS MATERIALIZED (SELECT pk.ecosystem, pk.package, pk.version, a.f AS fixed_version, relationship, dependency_path, project_path, manifest_path, scope, advisory_id, a.a AS aliases, a.s AS severity, "
    "a.t AS title, a.d AS description, a.src AS source, '' AS cvss, a.r AS \"references\", CASE WHEN a.f <> '' THEN 'Upgrade ' || pk.package || ' to ' || a.f || ' or later.' ELSE '' END AS remediation, "
    "CASE WHEN relationship = 'transitive' THEN 'indirect' ELSE 'direct' END AS reachability, a.c AS cwe FROM pk JOIN hits h ON h.ecosystem = pk.ecosystem AND h.package = pk.package AND h.version = pk.version)"
)
ORACLES["advisory_matches"] = (
    f"{_MATCHES} SELECT ecosystem, package, version, fixed_version, relationship, dependency_path, project_path, scope, advisory_id, severity, remediation, reachability FROM mt"
)
ORACLES["advisory_csv_rows"] = (
    f"{_MATCHES} SELECT * EXCLUDE (cwe) REPLACE (array_to_string([advisory_id] || aliases, ';') AS aliases, array_to_string(\"references\", ';') AS \"references\") FROM mt"
)
ORACLES["advisory_summary"] = (
    f"{_MATCHES} SELECT 'oss_vulnerabilities' AS category, metric, value FROM (SELECT 'total_findings' AS metric, count(*) AS value FROM mt "
    "UNION ALL SELECT 'severity_' || severity, count(*) FROM mt GROUP BY severity UNION ALL SELECT 'relationship_' || relationship, count(*) FROM mt GROUP BY relationship)"
)
_active = f"SELECT id, nullif(package, '') AS package FROM ({D.POLICY.sql}) WHERE expiry = '' OR CAST(nullif(expiry, '') AS TIMESTAMP) >= TIMESTAMP '{NOW}'"
_ignored = f"(advisory_id IN (SELECT id FROM ({_active}) WHERE package IS NULL) OR (advisory_id, package) IN (SELECT (id, package) FROM ({_active}) WHERE package IS NOT NULL))"
ORACLES["advisory_policy"] = f"{_MATCHES} SELECT advisory_id, package, version, project_path, CASE WHEN {_ignored} THEN 'dropped' ELSE 'kept' END AS outcome FROM mt"
ORACLES["dependency_findings"] = (
    f"{_MATCHES} SELECT 'dependency' AS kind, manifest_path AS file, advisory_id AS rule_id, severity, ecosystem AS framework, 'HIGH' AS confidence, package AS package_name, version AS declared_version, project_path, remediation, "
    + fp("advisory_id", "CASE WHEN starts_with(manifest_path, 'proj/') THEN substr(manifest_path, 6) ELSE manifest_path END", "package || '@' || version")
    + " AS fingerprint, CASE WHEN fixed_version <> '' THEN fixed_version ELSE '' END AS fixed_versions, array_to_string(cwe, ';') AS cwe FROM mt"
)
ORACLES["all_findings"] = (
    f"{_MATCHES} SELECT kind, severity, count(*) AS count FROM (SELECT {_kind} AS kind, severity FROM ({D.FINDINGS.sql}) WHERE {_gate(1, 1)} UNION ALL SELECT 'dependency', severity FROM mt WHERE {_rank('severity', SEVERITY_RANK)} >= 1) GROUP BY ALL"
)


def category_gate(cats) -> str:
    n = f"(SELECT count(*) FROM ({D.FINDINGS.sql}) WHERE list_contains({sql_list(cats)}, upper({trim('category')})))"
    return n


def gate_row(name: str, n: str, order: int) -> str:
    return f"SELECT '{name}' AS gate, {n} > 0 AS failed, {n} AS n, CAST({order} AS BIGINT) AS gate_order"


_sev_gate = lambda r: f"(SELECT count(*) FROM mt WHERE {_rank('severity', SEVERITY_RANK)} >= {r})"
ORACLES["gate_categories"] = gate_row("categories", category_gate(("SECRETS EXPOSURE", "INJECTION", "PRIVACY RISK")), 1)
ORACLES["gate_advisory_severity"] = f"{_MATCHES} {gate_row('advisories', _sev_gate(3), 2)}"
ORACLES["gates"] = (
    f"{_MATCHES}, gt AS (" + " UNION ALL ".join([
        gate_row("categories", category_gate(("SECRETS EXPOSURE", "NO SUCH", "PRIVACY RISK")), 1),
        gate_row("advisories", _sev_gate(4), 2),
        gate_row("new_findings", f"(SELECT count(*) FROM ({ORACLES['baseline_kept']}))", 3),
    ]) + ") SELECT *, coalesce(gate_order = (SELECT min(gate_order) FROM gt WHERE failed), false) AS decides FROM gt"
)
_fw_map = case_map("package", FRAMEWORK_PACKAGES.items())
_FRAMEWORKS = f"SELECT f AS framework, count(*) AS package_count, regexp_replace(lower(f), '[^a-z0-9]', '', 'g') AS slug FROM (SELECT {_fw_map} AS f FROM ({D.PACKAGES.sql})) WHERE f IS NOT NULL GROUP BY f"
ORACLES["frameworks"] = _FRAMEWORKS
_dev = "scope IN ('devDependencies', 'cargo:dev-dependencies')"
_inv = {
    "total_projects": "count(DISTINCT project_path)", "total_packages": "count(*)", "dependencies": f"count(*) FILTER (NOT {_dev})", "dev_dependencies": f"count(*) FILTER ({_dev})",
    "resolved_versions": "count(*) FILTER (resolved_version <> '')", "transitive_dependencies": "count(*) FILTER (relationship = 'transitive')",
}
ORACLES["package_summary"] = (
    f"{_MATCHES}, fw AS ({_FRAMEWORKS}) " + " UNION ALL ".join(
        [f"SELECT 'inventory' AS category, '{m}' AS metric, CAST({e} AS VARCHAR) AS value FROM ({D.PACKAGES.sql})" for m, e in _inv.items()]
        + ["SELECT 'frameworks', 'count', CAST(count(*) AS VARCHAR) FROM fw", "SELECT 'frameworks', 'names', string_agg(framework, ';' ORDER BY framework) FROM fw",
           "SELECT 'frameworks', 'package_count_' || slug, CAST(package_count AS VARCHAR) FROM fw", "SELECT 'advisories', 'match_count', CAST(count(*) AS VARCHAR) FROM mt"]
        + [f"SELECT 'advisories', 'severity_{s.lower()}', CAST(count(*) FILTER (upper(severity) = '{s}') AS VARCHAR) FROM mt" for s in SEVERITY_RANK]
    )
)
_COMP = (
    "SELECT id AS rule_id, CASE WHEN lower(ecosystem) = 'rust' THEN 'cargo' ELSE lower(ecosystem) END AS ecosystem, package, unnest(versions) AS version, severity, description, source, "
    f"'domain:' || _ioc_values[1] || ';ip:' || _ioc_values[2] AS iocs FROM ({D.COMPROMISED.sql})"
)
ORACLES["compromised_rules"] = _COMP
_CM = (
    f"SELECT p.ecosystem, p.package, p.version, project_path, manifest_path, scope, rule_id, severity, description, iocs, source FROM ({_VERSIONED}) p "
    f"JOIN (SELECT * REPLACE ({clean_version('version')} AS version) FROM ({_COMP})) c ON c.ecosystem = p.ecosystem AND c.package = p.package AND c.version = p.version"
)
ORACLES["compromised_matches"] = f"SELECT * EXCLUDE (iocs) FROM ({_CM})"
ORACLES["compromised_csv_rows"] = _CM
ORACLES["intel_merge"] = (
    f"WITH feed AS (SELECT 'ADV-' || (CAST(substr(id, 6) AS BIGINT) * 2) AS id, CASE WHEN lower(ecosystem) = 'rust' THEN 'cargo' ELSE lower(ecosystem) END AS ecosystem, package, 'feed' AS source FROM ({D.COMPROMISED.sql})) "
    f"SELECT id, ecosystem, package, source FROM feed UNION ALL SELECT id, ecosystem, package, 'seed' FROM ({D.ADVISORIES_A.sql}) WHERE id NOT IN (SELECT id FROM feed)"
)
ORACLES["package_table"] = f"SELECT '| ' || concat_ws(' | ', project_path, scope, package, declared_version) || ' |' AS line FROM ({D.PACKAGES.sql})"
ORACLES["intel_written"] = ORACLES["intel_merge"]
_json_texts = lambda columns, lists: ", ".join(f"coalesce(\"{c}\", '') AS \"{c}\"" for c in columns if c not in lists)
ORACLES["advisory_json_rows"] = f"{_MATCHES} SELECT {_json_texts(R.ADVISORY_CSV, ('aliases', 'references'))} FROM mt"
ORACLES["compromised_json_rows"] = f"SELECT {_json_texts(R.COMPROMISED_CSV, ('iocs',))} FROM ({_CM})"

# --- manifests ------------------------------------------------------------------------------

_mf = lambda name: f"SELECT path, text AS content, regexp_replace(path, '/[^/]*$', '') AS project FROM ({D.MANIFEST_TABLES[name].sql})"


def manifest_row(eco: str, scope: str, package: str, version: str, source: str, rel: str = "'direct'") -> str:
    return f"SELECT {q(eco)} AS ecosystem, project AS project_path, path AS manifest_path, {scope} AS scope, {package} AS package, {version} AS declared_version, {rel} AS relationship FROM {source}"


_npm = " UNION ALL ".join(
    manifest_row("npm", q(s), "k", f"json_extract_string(content, '$.{s}.\"' || k || '\"')", f"(SELECT *, unnest(json_keys(content, '$.{s}')) AS k FROM ({_mf('package.json')}))")
    for s in M.NPM_SCOPES
)
_line_src = lambda name: f"(SELECT path, project, unnest(string_split(content, {NL})) AS l FROM ({_mf(name)}))"
_rq = lambda k: f"coalesce(regexp_extract(l, {q(M.REQUIREMENT)}, {k}), '')"
_pip = manifest_row("pip", "'pip:dependencies'", _rq(1), f"CASE WHEN {_rq(2)} IN ('==', '===') THEN {_rq(3)} ELSE {_rq(2)} || {_rq(3)} END", _line_src("requirements.txt") + f" WHERE regexp_matches(l, {q(M.REQUIREMENT)})")
_go = manifest_row("go", "'go:dependencies'", f"regexp_extract(l, {q(M.GO_REQUIRE)}, 1)", f"regexp_extract(l, {q(M.GO_REQUIRE)}, 2)",
                   _line_src("go.mod") + f" WHERE regexp_matches(l, {q(M.GO_REQUIRE)}) AND NOT contains(l, '=>')", "CASE WHEN contains(l, '// indirect') THEN 'transitive' ELSE 'direct' END")
_sections = f"(SELECT path, project, trim(string_split(s, ']')[1]) AS sec, unnest(string_split(s, {NL})) AS l FROM (SELECT path, project, unnest(string_split({NL} || content, {NL} || '[')) AS s FROM ({_mf('Cargo.toml')})))"
_cargo = manifest_row("cargo", "'cargo:' || sec", f"regexp_extract(l, {q(M.CARGO_LINE)}, 1)", f"regexp_extract(l, {q(M.CARGO_LINE)}, 2) || regexp_extract(l, {q(M.CARGO_LINE)}, 3)",
                      _sections + f" WHERE sec IN ('dependencies', 'dev-dependencies', 'build-dependencies') AND regexp_matches(l, {q(M.CARGO_LINE)})")
ORACLES["packages_npm"], ORACLES["packages_requirements"], ORACLES["packages_gomod"], ORACLES["packages_cargo"] = _npm, _pip, _go, _cargo
_more = lambda name: f"SELECT path, text AS content, regexp_replace(path, '/[^/]*$', '') AS project FROM ({D.MORE_MANIFESTS[name].sql})"
_cargo_parts = (
    f"(SELECT path, project, s, trim(string_split(s, ']')[1]) AS sec FROM (SELECT path, project, unnest(string_split({NL} || content, {NL} || '[')) AS s FROM ({_more('Cargo.toml')})))"
)
_renamed = lambda x, name: f"CASE WHEN regexp_matches({x}, {q(M.CARGO_RENAME)}) THEN regexp_extract({x}, {q(M.CARGO_RENAME)}, 1) ELSE {name} END"
_cargo_kind = f"'cargo:' || regexp_extract(sec, {q(M.CARGO_SECTION)}, 1)"
_cargo_table = f"coalesce(regexp_extract(sec, {q(M.CARGO_SECTION)}, 2), '')"
ORACLES["packages_cargo_tables"] = (
    manifest_row("cargo", _cargo_kind, _renamed("l", f"regexp_extract(l, {q(M.CARGO_LINE)}, 1)"), f"regexp_extract(l, {q(M.CARGO_LINE)}, 2) || regexp_extract(l, {q(M.CARGO_LINE)}, 3)",
                 f"(SELECT *, unnest(string_split(s, {NL})) AS l FROM {_cargo_parts} WHERE regexp_matches(sec, {q(M.CARGO_SECTION)}) AND {_cargo_table} = '') WHERE regexp_matches(l, {q(M.CARGO_LINE)})")
    + " UNION ALL " + manifest_row("cargo", _cargo_kind, _renamed("s", _cargo_table), f"coalesce(regexp_extract(s, {q(M.CARGO_VERSION)}, 1), '')",
                                   f"{_cargo_parts} WHERE regexp_matches(sec, {q(M.CARGO_SECTION)}) AND {_cargo_table} <> ''")
)
_go_lines = f"(SELECT path, project, unnest(string_split(content, {NL})) AS l FROM ({_more('go.mod')}))"
_gx = lambda p, k: f"coalesce(regexp_extract(l, {q(p)}, {k}), '')"
_go_rows = (
    f"(SELECT r.*, s.new, s.v FROM (SELECT path, project, l, {_gx(M.GO_REQUIRE, 1)} AS m, {_gx(M.GO_REQUIRE, 2)} AS mv FROM {_go_lines} WHERE regexp_matches(l, {q(M.GO_REQUIRE)}) AND NOT contains(l, '=>')) r "
    f"LEFT JOIN (SELECT path, {_gx(M.GO_REPLACE, 1)} AS old, {_gx(M.GO_REPLACE, 2)} AS old_at, {_gx(M.GO_REPLACE, 3)} AS new, {_gx(M.GO_REPLACE, 4)} AS v FROM {_go_lines} WHERE regexp_matches(l, {q(M.GO_REPLACE)})) s "
    "ON s.path = r.path AND s.old = r.m AND (s.old_at = '' OR s.old_at = r.mv) QUALIFY row_number() OVER (PARTITION BY r.path, r.m, r.mv ORDER BY coalesce(s.old_at, '') <> '' DESC) = 1)"
)
ORACLES["packages_go_replaced"] = manifest_row(
    "go", "'go:dependencies'", "CASE WHEN new IS NULL OR regexp_matches(new, '^[./]') THEN m ELSE new END", "CASE WHEN new IS NULL THEN mv WHEN regexp_matches(new, '^[./]') THEN '' ELSE v END",
    _go_rows, "CASE WHEN contains(l, '// indirect') THEN 'transitive' ELSE 'direct' END")
_LOCKS = (
    "SELECT project AS project_path, substr(k, 14) AS package, json_extract_string(content, '$.packages.\"' || k || '\".version') AS locked_version, 'package-lock.json' AS version_source "
    f"FROM (SELECT *, unnest(json_keys(content, '$.packages')) AS k FROM ({_mf('package-lock.json')})) WHERE starts_with(k, 'node_modules/') AND NOT contains(substr(k, 14), '/node_modules/') "
    f"UNION ALL SELECT project, unnest(regexp_extract_all(content, {q(M.PNPM_ENTRY)}, 1)), unnest(regexp_extract_all(content, {q(M.PNPM_ENTRY)}, 2)), 'pnpm-lock.yaml' FROM ({_mf('pnpm-lock.yaml')})"
)
ORACLES["package_locks"] = _LOCKS
_RESOLVED = (
    f"SELECT n.*, coalesce(l.v.locked_version, '') AS resolved_version, coalesce(l.v.version_source, '') AS version_source FROM ({_npm}) n LEFT JOIN (SELECT project_path, package, "
    f"min_by({{'locked_version': locked_version, 'version_source': version_source}}, version_source) AS v FROM ({_LOCKS}) GROUP BY ALL) l ON l.project_path = n.project_path AND l.package = n.package "
    f"UNION ALL SELECT *, '', '' FROM ({_pip} UNION ALL {_go} UNION ALL {_cargo})"
)
ORACLES["package_resolution"] = _RESOLVED
ORACLES["package_csv_rows"] = f"SELECT project_path, scope, package, declared_version, resolved_version, version_source FROM ({_RESOLVED})"

# --- lock files as graphs -------------------------------------------------------------------

_lock_text = "(SELECT path AS lock_path, CASE WHEN json_valid(text) THEN CAST(text AS JSON) ELSE CAST('{}' AS JSON) END AS j FROM (" + D.LOCK_GRAPHS.sql + "))"
_map = lambda j, key: f"unnest(map_entries(CAST(json_extract({j}, '$.{key}') AS MAP(VARCHAR, JSON))))"
_wanted = lambda table, kinds, field_: " UNION ALL ".join(
    f"SELECT lock_path, node AS source, {q(kind)} AS kind, w.key AS package, json_extract_string(w.value, '$') AS wanted FROM (SELECT lock_path, node, {_map('j', field_ or kind)} AS w FROM {table} WHERE json_exists(j, '$.{field_ or kind}'))"
    for kind in kinds
)
_LOCK_PROJECT_ROWS = " UNION ALL ".join(
    f"SELECT project, {q(s_)} AS kind, w.key AS package, json_extract_string(w.value, '$') AS wanted FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS project, {_map('CAST(text AS JSON)', s_)} AS w FROM ({D.LOCK_PROJECTS.sql}) WHERE json_exists(text, '$.{s_}'))"
    for s_ in M.NPM_SCOPES
)
_LOCK_CTE = f"""locks AS (SELECT * FROM {_lock_text}),
flat AS (SELECT lock_path, e.key AS node, e.value AS j FROM (SELECT lock_path, {_map('j', 'packages')} AS e FROM locks WHERE json_exists(j, '$.packages'))),
old AS (SELECT * FROM locks WHERE NOT json_exists(j, '$.packages') AND json_exists(j, '$.dependencies')),
nested AS (
  SELECT lock_path, 'node_modules/' || e.key AS node, e.value AS j FROM (SELECT lock_path, {_map('j', 'dependencies')} AS e FROM old)
  UNION ALL
  SELECT lock_path, node || '/node_modules/' || e.key, e.value FROM (SELECT lock_path, node, {_map('j', 'dependencies')} AS e FROM nested WHERE json_exists(j, '$.dependencies'))
),
nodes AS (
  SELECT lock_path, node, json_extract_string(j, '$.version') AS version, CASE WHEN json_extract_string(j, '$.link') = 'true' THEN json_extract_string(j, '$.resolved') END AS link_to FROM flat
  UNION ALL SELECT lock_path, node, json_extract_string(j, '$.version'), NULL FROM nested UNION ALL SELECT lock_path, '', NULL, NULL FROM old
),
wanted AS (
  {_wanted('flat', M.NPM_SCOPES, '')} UNION ALL {_wanted('nested', ('dependencies',), 'requires')}
  UNION ALL SELECT lock_path, '', r.kind, r.package, r.wanted FROM old JOIN ({_LOCK_PROJECT_ROWS}) r ON r.project = regexp_replace(lock_path, '/[^/]*$', '')
),
near AS (
  SELECT w.lock_path, w.source, w.package, w.kind, w.wanted, arg_max({{'target': coalesce(n.link_to, n.node), 'version': n.version}}, length(n.node)) AS n
  FROM (SELECT *, 'node_modules/' || package AS tail FROM wanted) w JOIN nodes n ON n.lock_path = w.lock_path AND ends_with(n.node, tail)
    AND (n.node = tail OR (ends_with(left(n.node, length(n.node) - length(tail)), '/') AND starts_with(w.source || '/', left(n.node, length(n.node) - length(tail)))))
  GROUP BY ALL
),
edges AS (
  SELECT w.*, n.n.target AS target, coalesce(n.n.version, o.version) AS version FROM wanted w LEFT JOIN near n USING (lock_path, source, package, kind, wanted)
  LEFT JOIN nodes o ON o.lock_path = w.lock_path AND o.node = n.n.target AND NOT contains('/' || o.node || '/', '/node_modules/')
),
ways AS (
  SELECT lock_path, source AS importer, target, [package] AS names, kind, wanted, version, [source, target] AS seen
  FROM edges WHERE target IS NOT NULL AND target <> source AND NOT contains('/' || source || '/', '/node_modules/')
  UNION ALL
  SELECT w.lock_path, w.importer, e.target, list_append(w.names, e.package), w.kind, e.wanted, e.version, list_append(w.seen, e.target)
  FROM ways w JOIN edges e ON e.lock_path = w.lock_path AND e.source = w.target
  WHERE e.target IS NOT NULL AND NOT list_contains(w.seen, e.target) AND NOT (e.kind = 'devDependencies' AND NOT contains('/' || e.source || '/', '/node_modules/'))
),
paths AS (
  SELECT lock_path, importer, target, names[len(names)] AS package, version, kind, wanted, len(names) AS depth, array_to_string(names, '>') AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY lock_path, importer, target ORDER BY len(names), names, kind, wanted, version) AS r FROM ways) WHERE r = 1
),
locked AS (
  SELECT 'npm' AS ecosystem, regexp_replace(lock_path, '/[^/]*$', '') || CASE WHEN importer = '' THEN '' ELSE '/' || importer END AS project_path, lock_path AS manifest_path, kind AS scope, package,
    wanted AS declared_version, coalesce(version, '') AS resolved_version, regexp_replace(lock_path, '^.*/', '') AS version_source,
    CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS relationship, path AS dependency_path FROM paths
)"""
ORACLES["packages_lock_graph"] = f"WITH RECURSIVE {_LOCK_CTE} SELECT lock_path, source, package, kind, wanted, target, version FROM edges"
ORACLES["dependency_paths"] = f"WITH RECURSIVE {_LOCK_CTE} SELECT * FROM paths"
ORACLES["package_inventory"] = f"""WITH RECURSIVE {_LOCK_CTE},
own AS (SELECT project_path, package, min({{'s': version_source, 'v': resolved_version}}) AS l FROM locked WHERE relationship = 'direct' GROUP BY ALL)
SELECT 'npm' AS ecosystem, r.project AS project_path, r.project || '/package.json' AS manifest_path, r.kind AS scope, r.package, r.wanted AS declared_version, coalesce(l.v, '') AS resolved_version,
  coalesce(l.s, '') AS version_source, 'direct' AS relationship, r.package AS dependency_path FROM ({_LOCK_PROJECT_ROWS}) r LEFT JOIN own ON own.project_path = r.project AND own.package = r.package
UNION ALL SELECT * FROM locked WHERE relationship = 'transitive'"""


# --- pages ----------------------------------------------------------------------------------


def attribute(name: str) -> str:
    p = q(PG.attribute_pattern(name))
    value = " || ".join(f"coalesce(regexp_extract(attrs, {p}, {k}), '')" for k in (1, 2, 3))
    name = "r[2:-2]"
    number = f"CASE WHEN starts_with(lower({name}), '#x') THEN CAST('0x' || {name}[3:] AS BIGINT) ELSE CAST({name}[2:] AS BIGINT) END"
    spelled = f"CASE WHEN starts_with({name}, '#') THEN (CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INTEGER)) ELSE chr(65533) END) ELSE {case_map(name, list(PG.ENTITIES.items()))} END"
    refs, pieces = f"list_transform(regexp_extract_all(({value}), {q(PG.REFERENCE)}), lambda r: {spelled})", f"regexp_split_to_array(({value}), {q(PG.REFERENCE)})"
    return trim(f"array_to_string(list_transform(list_zip({pieces}, {refs}), lambda z: z[1] || coalesce(z[2], '')), '')")


_texts = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in PG.TEXT_ELEMENTS)
_script = q(rf"""(?is)<!--.*?(?:-->|\z)|{_texts}|<script\b((?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)(?:</script\s*>|\z)""")
_TAGS_SQL = (
    f"SELECT page_id, url, as_[i] AS attrs, bs[i] AS raw_body, i FROM (SELECT *, unnest(range(1, len(as_) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(doc, {_script}, 1) AS as_, "
    f"regexp_extract_all(doc, {_script}, 2) AS bs FROM (SELECT page_id, url, html AS doc FROM ({D.PAGES.sql}) WHERE regexp_matches(url, '^(?i)https?:'))))"
)
_KEPT = (
    "SELECT page_id, url, src, CASE WHEN src = '' THEN body ELSE '' END AS body, CASE WHEN src = '' THEN 'inline' ELSE 'external' END AS kind, "
    "row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos, CASE WHEN src = '' THEN count(*) FILTER (src = '') OVER (PARTITION BY page_id ORDER BY i) END AS inline_no FROM "
    f"(SELECT page_id, url, i, lower({attribute('type')}) AS type, {attribute('src')} AS src, {trim('raw_body')} AS body FROM ({_TAGS_SQL})) "
    f"WHERE list_contains({sql_list(PG.SCRIPT_TYPES)}, type) AND (src <> '' OR body <> '')"
)


def rx(x: str, p: str, k: int = 1) -> str:
    return f"coalesce(regexp_extract({x}, {q(p)}, {k}), '')"


_SCH, _AUTH = r"^([A-Za-z][A-Za-z0-9+.-]*):", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_upath = lambda u: rx(f"regexp_replace({u}, '[?#].*$', '')", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$")
_host = lambda u: rx(rx(u, _AUTH), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)")
_port = lambda u: rx(rx(u, _AUTH), r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*):([0-9]*)$")


def no_dots(path: str) -> str:
    """Dot segments removed, folding over the segments."""
    segs = f"string_split({path}, '/')"
    kept = (
        f"list_reduce(list_transform({segs}, lambda s: [s]), lambda acc, s: CASE WHEN s[1] = '.' THEN acc WHEN s[1] = '..' THEN acc[1:-2] ELSE acc || s END, CAST([] AS VARCHAR[]))"
    )
    return f"regexp_replace('/' || array_to_string({kept}, '/') || CASE WHEN {segs}[-1] IN ('.', '..') THEN '/' ELSE '' END, '^//', '/')"


_tail = lambda u: rx(u, r"^[^?#]*([?#].*)?$")
_base_url = f"lower({rx('url', _SCH)}) || '://' || {rx('url', _AUTH)}"
_abs = lambda u: (
    f"CASE WHEN regexp_matches({u}, {q(_AUTH)}) THEN lower({rx(u, _SCH)}) || '://' || {rx(u, _AUTH)} || CASE WHEN {_upath(u)} = '' THEN '' ELSE {no_dots(_upath(u))} END || {_tail(u)} ELSE {u} END"
)
_rpath = rx("src", r"^([^?#]*)")
_folder = f"regexp_replace({_upath('url')}, '[^/]*$', '')"
_bquery = rx("url", r"^[^?#]*(\?[^#]*)?")
_resolved = (
    f"CASE WHEN regexp_matches(src, {q(_SCH)}) THEN {_abs('src')} WHEN starts_with(src, '//') THEN " + _abs(f"(lower({rx('url', _SCH)}) || ':' || src)")
    + f" WHEN {_rpath} = '' THEN {_base_url} || CASE WHEN {_upath('url')} = '' THEN '' ELSE {no_dots(_upath('url'))} END || CASE WHEN starts_with({_tail('src')}, '?') THEN {_tail('src')} ELSE {_bquery} || {_tail('src')} END "
    f"WHEN starts_with(src, '/') THEN {_base_url} || {no_dots(_rpath)} || {_tail('src')} ELSE {_base_url} || {no_dots(f'({_folder} || {_rpath})')} || {_tail('src')} END"
)
_bad = f"(kind = 'external' AND regexp_matches(regexp_replace({_rpath}, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '%'))"
_RES = (
    f"SELECT * FROM (SELECT *, CASE WHEN {_bad} THEN 'invalid URL escape' END AS url_error, CASE WHEN kind = 'inline' THEN NULL WHEN {_bad} THEN src ELSE {_resolved} END AS source_url FROM ({_KEPT})) "
    f"WHERE kind = 'inline' OR url_error IS NOT NULL OR lower({rx('source_url', _SCH)}) IN ('http', 'https')"
)
_same = (
    f"(source_url IS NOT NULL AND lower({rx('url', _SCH)}) = lower({rx('source_url', _SCH)}) AND lower({_host('url')}) = lower({_host('source_url')}) AND {_port('url')} = {_port('source_url')})"
)
ORACLES["page_scripts"] = f"SELECT page_id, pos, kind, src, body, inline_no, source_url, url_error, {_same} AS same_origin FROM ({_RES})"
_decoded = f"url_decode(replace({_upath('source_url')}, '+', '%2B'))"
_stripped = "regexp_replace(dp, '/+$', '')"
_safe0 = f"CASE WHEN dp = '' THEN '.' WHEN {_stripped} = '' THEN '/' ELSE string_split({_stripped}, '/')[-1] END"
_NAMED = (
    f"SELECT * EXCLUDE (dp, b0, b1, nm), CASE WHEN kind = 'inline' THEN 'inline_' || inline_no || '.js' WHEN url_error IS NOT NULL THEN '' ELSE (list_transform([row_number() OVER (PARTITION BY page_id, kind, url_error IS NULL, nm ORDER BY pos)], "
    "lambda n: CASE WHEN n = 1 THEN nm ELSE left(nm, length(nm) - length(regexp_extract(nm, '(\\.[^.]*)$', 1))) || '_' || n || regexp_extract(nm, '(\\.[^.]*)$', 1) END)[1]) END AS local_file FROM "
    "(SELECT *, regexp_replace(CASE WHEN regexp_matches(lower(b1), '\\.[mc]?js$') THEN b1 ELSE b1 || '.js' END, '[^A-Za-z0-9._-]', '_', 'g') AS nm FROM "
    "(SELECT *, CASE WHEN b0 IN ('', '.') THEN left(sha256(source_url), 16) || '.js' ELSE b0 END AS b1 FROM "
    f"(SELECT *, replace(replace(replace({trim(_safe0)}, '..', '_'), '/', '_'), chr(92), '_') AS b0 FROM (SELECT *, CASE WHEN kind = 'external' AND url_error IS NULL THEN {_decoded} ELSE '' END AS dp FROM ({_RES})))))"
)
ORACLES["script_names"] = f"SELECT page_id, pos, kind, local_file FROM ({_NAMED})"
_RESOURCES = (
    "SELECT url, CASE WHEN length(url) % 5 = 1 THEN 404 WHEN length(url) % 5 = 2 THEN 204 ELSE 200 END AS status, length(url) % 4 * strlen(url) AS size FROM "
    "(SELECT DISTINCT source_url AS url FROM nm WHERE kind = 'external' AND url_error IS NULL) WHERE length(url) % 5 <> 0"
)
_MANIFEST = (
    f"WITH nm AS MATERIALIZED ({_NAMED}), rs AS MATERIALIZED ({_RESOURCES}), mf AS MATERIALIZED (SELECT page_id, pos, local_file, source_url, kind, CASE WHEN kind = 'external' AND url_error IS NULL THEN status END AS http_status, "
    "CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN kind = 'external' THEN size ELSE strlen(body) END AS BIGINT) AS bytes, error FROM (SELECT *, CASE WHEN kind = 'inline' THEN NULL WHEN url_error IS NOT NULL THEN url_error "
    "WHEN status IS NULL THEN 'not fetched' WHEN size > 120 THEN 'response exceeded max bytes (120)' WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status END AS error FROM nm LEFT JOIN rs ON rs.url = nm.source_url))"
)
ORACLES["script_manifest"] = f"{_MANIFEST} SELECT * FROM mf"
ORACLES["script_saved"] = f"{_MANIFEST} SELECT page_id, count(*) AS scripts, count(*) FILTER (error IS NULL) AS saved FROM mf GROUP BY page_id"
ORACLES["script_manifest_docs"] = (
    f"{_MANIFEST} SELECT p.page_id, p.url AS page_url, count(mf.page_id) AS files FROM pages p LEFT JOIN mf ON mf.page_id = p.page_id GROUP BY ALL"
)
