"""Language identification by a blended-spectrum string kernel.

Two texts are compared by the byte n-grams that occur in both, for each n by itself and normalised
by the texts' own numbers of n-grams.  Landmark texts stand for the kernel's feature space (Nyström),
and one ridge regression for each language is fitted against the rest.  The fitted function is linear
in the presence of n-grams, so a batch of texts is scored by one product of its sparse presence
matrix with a matrix of n-gram weights.

Every label of the table is learned.  The languages share fixed numbers of landmarks and of fitted
texts, so the model stays bounded; with many languages it is kept as landmarks and their coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.tables import field, text_or_empty
from grainsieve.llm.words import text_chunks

#: Texts per language that are fitted on, how many of them are landmarks, and how many of both all languages share.
SAMPLE_TEXTS = 300
LANDMARKS = 60
ALL_SAMPLE_TEXTS = 19_200
ALL_LANDMARKS = 960
#: Texts that every language is fitted on, however many languages there are, and languages with n-gram weights of their own.
LEAST_TEXTS = 16
DENSE_LANGUAGES = 64
RIDGE = 1e-2
BITS = 16
UNDETERMINED = "und"

#: Everything but letters, in ASCII, is a space; other bytes belong to letters of other scripts.
_NORMAL = np.full(256, 32, dtype=np.uint32)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def _codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the 2-, 3- and 4-grams that start at each byte, below 2^BITS each."""
    b = _NORMAL[data]
    two = b[:-1] << np.uint32(8) | b[1:]
    three = (two[:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    four = (two[:-2] << np.uint32(16) | two[2:]) * np.uint32(2246822519) >> np.uint32(32 - BITS)
    return [two, three, four]


ORDERS = 3


def present(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """For each text, the sorted codes of its n-grams, a list for each order."""
    seen = np.zeros(1 << BITS, dtype=bool)
    for _, data, offsets in text_chunks(texts):
        codes = _codes(data) if len(data) >= 4 else [np.empty(0, dtype=np.uint32)] * ORDERS
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = []
            for n, all_ in enumerate(codes, 2):
                part = all_[a : max(a, b - n + 1)]
                seen[part] = True
                found = np.flatnonzero(seen)
                seen[found] = False
                own.append(found)
            yield own


class Landmarks:
    """The n-grams of the landmark texts, a run of codes for each landmark and order."""

    def __init__(self, features: list[list[np.ndarray]]):
        self.count = len(features)
        self.sizes = [np.array([len(own[n]) for own in features]) for n in range(ORDERS)]
        self.codes = [np.concatenate([own[n] for own in features]).astype(np.uint16) for n in range(ORDERS)]

    def kernel(self, batch: list[list[np.ndarray]]) -> np.ndarray:
        """Kernel values, texts x landmarks."""
        out = np.zeros((len(batch), self.count))
        seen = np.zeros(1 << BITS, dtype=np.int32)
        for n, (sizes, codes) in enumerate(zip(self.sizes, self.codes, strict=True)):
            has = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[has]
            for row, own in enumerate(batch):
                if len(own[n]) and len(has):
                    seen[own[n]] = 1
                    out[row, has] += np.add.reduceat(seen[codes], starts) / np.sqrt(sizes[has] * float(len(own[n])))
                    seen[own[n]] = 0
        return out / ORDERS

    def weights(self, beta: np.ndarray) -> list[np.ndarray]:
        """For each order the weights of its n-grams (codes x languages)."""
        out = []
        for sizes, codes in zip(self.sizes, self.codes, strict=True):
            total = np.zeros((1 << BITS, beta.shape[1]))
            end = 0
            for k, size in enumerate(sizes.tolist()):
                total[codes[end : end + size]] += beta[k] / np.sqrt(max(size, 1))
                end += size
            out.append(total.astype(np.float32))
        return out


@dataclass
class Model:
    """Languages in order, and for each order the weights of its n-grams (codes x languages).

    With many languages, instead of weights the landmarks and their coefficients (landmarks x languages).
    """

    languages: list[str]
    weights: list[np.ndarray] | None
    landmarks: Landmarks | None = None
    beta: np.ndarray | None = None

    def best(self, texts: pa.Array, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The language of the largest regression value of each text, the first of equal ones, and that value."""
        which, value = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        batch: list[list[np.ndarray]] = []
        first = 0

        def settle() -> None:
            values = self._product(batch)
            which[first : first + len(batch)] = values.argmax(axis=1)
            value[first : first + len(batch)] = values.max(axis=1)

        for own in present(texts):
            batch.append(own)
            if len(batch) == rows:
                settle()
                first, batch = first + rows, []
        if batch:
            settle()
        return which, value

    def _product(self, batch: list[list[np.ndarray]]) -> np.ndarray:
        if self.weights is None:
            return self.landmarks.kernel(batch) @ self.beta
        total = np.zeros((len(batch), len(self.languages)))
        for n, weights in enumerate(self.weights):
            sizes = np.array([len(own[n]) for own in batch])
            has = np.flatnonzero(sizes)
            if len(has):
                columns = np.concatenate([own[n] for own in batch])
                starts = (np.cumsum(sizes) - sizes)[has]
                total[has] += np.add.reduceat(weights[columns], starts, axis=0) / np.sqrt(sizes[has])[:, None]
        return total / ORDERS


def fit(languages: list[str], features: list[list[np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE,
        all_landmarks: int = ALL_LANDMARKS) -> Model:
    """Fit on texts given as their n-gram codes.

    The first ``landmarks`` texts of each language are landmarks; where that makes more than
    ``all_landmarks``, the languages take turns until there are as many.
    """
    names = sorted(set(languages))
    at = {name: k for k, name in enumerate(names)}
    rank: dict[str, int] = {}
    turns = []
    for i, language in enumerate(languages):
        rank[language] = rank.get(language, 0) + 1
        if rank[language] <= landmarks:
            turns.append((rank[language], i))
    chosen = sorted(i for _, i in sorted(turns)[:all_landmarks])
    kept = Landmarks([features[i] for i in chosen])
    left, right = np.zeros((len(chosen), len(chosen))), np.zeros((len(chosen), len(names)))
    among = np.zeros_like(left)
    place = {i: k for k, i in enumerate(chosen)}
    for first in range(0, len(features), 1024):
        kernel = kept.kernel(features[first : first + 1024])
        rows = np.arange(first, first + len(kernel))
        target = np.zeros((len(kernel), len(names)))
        target[rows - first, [at[languages[i]] for i in rows.tolist()]] = 1
        left += kernel.T @ kernel
        right += kernel.T @ target
        for i in rows.tolist():
            if i in place:
                among[place[i]] = kernel[i - first]
    left += ridge * among + 1e-8 * len(features) * np.eye(len(chosen))
    beta = np.linalg.solve(left, right)
    if len(names) > DENSE_LANGUAGES:
        return Model(names, None, kept, beta)
    return Model(names, kept.weights(beta))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(field(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_texts: int = SAMPLE_TEXTS, all_sample_texts: int = ALL_SAMPLE_TEXTS) -> Model | None:
    """Learn every label from a bounded sample of labelled rows that are not held out.

    Counts by language cover all rows with a letter; of each language about ``sample_texts`` texts are
    drawn by a hash of the id, or its share of ``all_sample_texts`` but not below ``LEAST_TEXTS``; all
    texts of a language that has no more than twice those.  Returns None without labelled texts.
    """
    usable = docs.select(field(id_col).alias("id"), field(lang_col).cast("string").alias("lang"), F.lower(text_or_empty(text_col)).alias("text")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id") & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    span = 1 << 30
    share = max(LEAST_TEXTS, min(sample_texts, all_sample_texts // len(counts)))
    limits = {row["lang"]: span if row["count"] <= 2 * LEAST_TEXTS else int(span * min(1.0, share / row["count"])) for row in counts}
    # a table of languages, not of rows
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("lang"))
    drawn = usable.where(F.pmod(F.xxhash64("id"), F.lit(span)) < limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(present(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([f[n] for f in found], pa.list_(pa.int32())) for n in range(ORDERS)]],
                ["id", "lang", *[f"codes{n}" for n in range(ORDERS)]])

    kind = usable.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang string, " + ", ".join(f"codes{n} array<int>" for n in range(ORDERS))
    sample = drawn.mapInArrow(run, schema).toPandas().sort_values(["lang", "id"])
    if not len(sample):
        return None
    features = [[np.asarray(row[n]).astype(np.uint16) for n in range(ORDERS)] for row in sample[[f"codes{n}" for n in range(ORDERS)]].to_numpy()]
    return fit(sample["lang"].tolist(), features)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row; all other columns stay.

    A null text and a text without a letter get ``und`` and 0, as does every row without a model.
    Equal scores go to the language that sorts first.
    """
    taken = docs.columns
    pred, score = (_free(taken, name) for name in ("lang_pred", "score"))
    if model is None:
        return docs.withColumns({pred: F.lit(UNDETERMINED), score: F.lit(0.0)})
    # DENSE_LANGUAGES x 3 x 2^16 numbers at most, or the n-grams of ALL_LANDMARKS texts and ALL_LANDMARKS x languages numbers
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double>")
    def classify(texts: pa.Array) -> pa.Array:
        fitted = shared.value
        best, values = fitted.best(texts)
        known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
        names = [fitted.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
        top = np.where(known, np.clip(values, 0.0, 1.0), 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(top, pa.float64())], ["lang", "score"])

    # only the lower-cased text goes to Python, and a null where there is nothing to classify; a UDF that counts as
    # deterministic would run once more for each filter on its result
    text = text_or_empty(text_col)
    found = _free([*taken, pred, score], "found")
    classified = docs.withColumn(found, classify.asNondeterministic()(F.when(text.rlike(r"\p{L}"), F.lower(text))))
    return classified.select(*[field(c) for c in taken], field(found)["lang"].alias(pred), field(found)["score"].alias(score))


def _free(taken: list[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name
