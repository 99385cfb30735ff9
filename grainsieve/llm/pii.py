"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans.  The field runs over the tokens that can be part of an entity (those
that hold a digit or an ``@``; every other token is outside by definition).  Neighbouring tokens share
chain potentials, tokens that are equal or similar share skip potentials however far apart they stand,
and loopy sum-product message passing carries a sure label to its repetitions.  The
tokens of base spans are clamped to their kind, so the field only adds spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from grainsieve.llm.tables import field, smallest_hashes, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")

#: Documents that the field is fitted on, and tokens taken from each.
SAMPLE_DOCS = 1500
SAMPLE_TOKENS = 200
TOLERANCE = 1e-5
SKIP_WEIGHT = 2.0
CHAIN_WEIGHT = 0.5
THRESHOLD = 0.9

_TOKEN = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_EDGE = " \t\n\r\v\f.,;:!?\"'<>[]{}|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; each ``@`` is tried once with the whole run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL_END.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base spans, in the order of the digest."""
    spans = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) < 5 else p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def tokens(text: str) -> list[tuple[int, int]]:
    """Space-separated tokens with a digit or ``@``, without punctuation at their ends."""
    out, end = [], 0
    for hit in _TOKEN.finditer(text):
        if hit.start() < end:
            continue
        a = hit.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        space = _SPACE.search(text, hit.end())
        end = space.start() if space else len(text)
        part = text[a:end]
        left = len(part) - len(part.lstrip(_EDGE))
        out.append((a + left, a + len(part.rstrip(_EDGE))))
    return [(a, b) for a, b in out if a < b]


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """What a token's own form and its neighbours say, one row a token."""
    rows = np.zeros((len(spans), 20), dtype=np.float32)
    for row, (a, b) in zip(rows, spans, strict=True):
        token = text[a:b]
        digits = "".join(c for c in token if c in "0123456789")
        n, letters = len(digits), sum(c.isalpha() for c in token)
        rows_of = [
            1, "@" in token, token.count("@") == 1 and "." in token[token.find("@"):], token.count(".") == 3, n == len(token),
            n <= 2, 3 <= n <= 4, 5 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n > 19, 14 <= n <= 19 and luhn(digits),
            token[0] == "+", token[0] == "(" or token[-1] == ")", "-" in token, letters > 0, letters > n,
            bool(IP.fullmatch(token)), a > 0 and text[a - 1] in "\"'=", text[max(0, a - 3) : a].endswith(") "),
        ]
        row[:] = rows_of
    return rows


def skip_keys(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """Names under which tokens are the same or similar: lower-case form, and the last seven digits of long numbers."""
    out = []
    for a, b in spans:
        token = text[a:b].lower()
        digits = "".join(c for c in token if c in "0123456789")
        out.append([token] + ([digits[-7:]] if len(digits) >= 7 else []))
    return out


def fit(rows: np.ndarray, labels: np.ndarray, steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Node weights (features x labels; label 0 is outside) by gradient ascent on the tokens' likelihood."""
    weights = np.zeros((rows.shape[1], len(KINDS) + 1))
    target = np.eye(len(KINDS) + 1)[labels]
    for step in range(steps):
        scores = rows @ weights
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights += (2.0 / (1 + step / 100)) * (rows.T @ (target - p) / len(rows) - decay * weights)
    return weights


def marginals(node: np.ndarray, edges: np.ndarray, strength: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Loopy sum-product on agreement potentials; node: log potentials, edges: pairs of tokens.

    Messages run along both directions of all edges at once, damped by half, until none changes by more
    than ``tolerance``; an edge rests until the belief at its source moves again.  Should messages never
    settle, they end after far more rounds than any path through the edges needs.
    """
    if not len(node):
        return node
    source, sink = np.concatenate([edges, edges[:, ::-1]]).T if len(edges) else (np.empty(0, int), np.empty(0, int))
    agree = np.exp(np.concatenate([strength, strength]))[:, None] - 1
    reverse = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), node.shape[1]))
    belief = node.copy()
    active = np.arange(len(source))
    for _ in range(1000 + 20 * len(edges)):
        if not len(active):
            break
        out = belief[source[active]] - messages[reverse[active]]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
        new = np.log1p(agree[active] * out)
        step = 0.5 * (new - new.max(axis=1, keepdims=True) - messages[active])
        messages[active] += step
        np.add.at(belief, sink[active], step)
        moved = active[np.abs(step).max(axis=1) > tolerance]
        awake = np.zeros(len(node), dtype=bool)
        awake[sink[moved]] = True
        awake = awake[source]
        awake[moved] = True
        active = np.flatnonzero(awake)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """The kind (from 1) of the base span that overlaps each token, the first one if several, else 0."""
    out = np.zeros(len(spans), dtype=np.int64)
    for kind in range(len(KINDS) - 1, -1, -1):
        own = [(s, e) for s, k, e in base if k == kind]
        starts, ends = np.array([s for s, _ in own]), np.array([e for _, e in own])
        if len(own) and len(spans):
            at = np.array(spans)
            i = np.searchsorted(ends, at[:, 0], side="right")
            hit = (i < len(own)) & (starts[np.minimum(i, len(own) - 1)] < at[:, 1])
            out[hit] = kind + 1
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that the field finds besides the base ones; neighbours of one kind are one span."""
    at = tokens(text)
    known = labels_of(at, base)
    if not at or (known > 0).all():
        return []
    node = features(text, at) @ weights
    node -= np.log(np.exp(node - node.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + node.max(axis=1, keepdims=True)
    clamped = np.flatnonzero(known)
    node[clamped] = -30.0
    node[clamped, known[clamped]] = 0.0
    edges, strength, last = [], [], {}
    for i, keys in enumerate(skip_keys(text, at)):
        if i and at[i][0] - at[i - 1][1] <= 1:
            edges.append((i - 1, i))
            strength.append(CHAIN_WEIGHT)
        for key in keys:
            if key in last:
                edges.append((last[key], i))
                strength.append(SKIP_WEIGHT)
            last[key] = i
    p = marginals(node, np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(strength))
    out: list[tuple[int, int, int]] = []
    before = -2
    for i in np.flatnonzero((known == 0) & (p[:, 1:].max(axis=1) >= THRESHOLD)).tolist():
        kind, (a, b) = int(p[i, 1:].argmax()), at[i]
        if out and before == i - 1 and out[-1][1] == kind and a - out[-1][2] <= 1:
            out[-1] = (out[-1][0], kind, b)
        else:
            out.append((a, kind, b))
        before = i
    return out


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> np.ndarray | None:
    """Fit the token weights on a bounded sample, labelled by the base patterns; None without tokens.

    Of the distinct texts with candidate tokens, those with the ``sample_docs`` smallest hashes are
    drawn, and ``SAMPLE_TOKENS`` tokens of each are used.
    """
    texts = docs.select(text_or_empty(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    drawn = smallest_hashes(texts, "text", sample_docs)
    if drawn is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for text in batch.column(0).to_pylist():
                at = tokens(text)[:SAMPLE_TOKENS]
                rows += features(text, at).tolist()
                labels += labels_of(at, base_spans(text)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), pa.array(labels, pa.int64())], ["row", "label"])

    found = drawn.mapInArrow(run, "row array<float>, label bigint").toPandas()
    if not len(found):
        return None
    order = np.lexsort([*np.stack(found["row"].to_numpy()).T, found["label"].to_numpy()])
    return fit(np.stack(found["row"].to_numpy())[order].astype(np.float64), found["label"].to_numpy()[order])


def find(text: str, weights: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, each (start, kind index, end)."""
    base = base_spans(text)
    return base, sorted(base + (added_spans(text, base, weights) if weights is not None else []))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the digest of the base spans, and all spans of every whole text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.  A null text is empty and
    has no spans; null and repeated ids are passed through; an empty table gives no rows.  Offsets are
    code points, ends exclusive.  Rows stay where they are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, all_ = find(text, weights) if text else ([], [])
                counts.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(all_))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    text = text_or_empty(text_col)
    return docs.select(field(id_col).alias("doc_id"), F.when(text.rlike("[0-9@]"), text).alias("text")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k]}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text") -> DataFrame:
    """Replace the spans in every text; all columns and rows stay, a null text stays null."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields[:at], docs.schema.fields[at].__class__(text_col, StringType(), True), *docs.schema.fields[at + 1 :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redact_text(t, find(t, weights)[1]) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    # names that need quotes would not pass: columns go by position
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)
