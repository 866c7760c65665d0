"""Language identification in two steps: the family, then one language of it.

Texts become hashed byte n-grams (lower case, anything but letters a blank), square
roots of relative frequencies, length 1. Linear support vector machines tell the
families apart (one against the rest); within a family one machine for each pair of
languages votes. The machines are trained here, on at most ``PER_LANGUAGE`` labelled
documents of each language, chosen by a hash of the id; whole texts are read both for
training and prediction.

How it runs: training gathers at most ``PER_LANGUAGE`` vectors of each language on the
driver (10 KB each) and solves there. Prediction is one narrow pass, in slices of
bounded size; the weights it carries are bounded by the number of languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0. A null
language labels nothing. Without any label everything is ``und``; with one language
it is the only answer. A null id is never held out and never trained on. Repeated rows
are predicted like others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import textkit
from linkloom.llm.common import crc_of_id, ready_for_python

PER_LANGUAGE = 500
TRIGRAMS, BIGRAMS = 1 << 12, 1 << 10
UNKNOWN = "und"
#: Families of closely related languages; a language outside them is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def slice_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of n-gram features for each text of a slice of lower-cased UTF-8."""
    rows = len(offsets) - 1
    clean = np.where(_LETTER[data], data, np.uint8(32)).astype(np.uint32)
    doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    parts = []
    for n, buckets in ((3, TRIGRAMS), (2, BIGRAMS)):
        count = max(0, len(clean) - n + 1)
        code = clean[:count].copy()
        for k in range(1, n):
            code = code * np.uint32(256) + clean[k : k + count]
        blank = np.uint32(sum(32 << (8 * k) for k in range(n)))
        use = (doc[:count] == doc[n - 1 :]) & (code != blank) if count else np.empty(0, bool)
        shift = np.uint32(32 - buckets.bit_length() + 1)
        bucket = (code[use] * np.uint32(2654435761)) >> shift
        counts = np.bincount(doc[:count][use] * buckets + bucket, minlength=rows * buckets).reshape(rows, buckets)
        part = counts.astype(np.float32)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
        parts.append(np.sqrt(part))
    return np.hstack(parts) / np.float32(np.sqrt(2))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in textkit.slices(batch.column("text")):
            rows = slice_features(data, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").slice(a, b - a),
                    batch.column("order").slice(a, b - a),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                ["lang", "order", "vector"],
            )


def svm(x1: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, classes weighted alike.

    The last column of ``x1`` holds ones. Accelerated gradient steps; the step size comes from the largest singular value.
    """
    n = len(x1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * n
    v = np.ones(x1.shape[1], np.float32)
    for _ in range(10):
        v = x1.T @ (x1 @ v)
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1.0 / (1.0 + 2.0 * c * float(weight.max()) * top)
    w = z = np.zeros(x1.shape[1], np.float32)
    for k in range(steps):
        short = np.maximum(0, 1 - y * (x1 @ z))
        step = z - rate * (z - 2.0 * c * (x1.T @ (weight * y * short)))
        z = step + (k / (k + 3)) * (step - w)
        w = step.astype(np.float32)
        z = z.astype(np.float32)
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """Families with their languages; weights of the machines over families and over pairs."""

    families: list[list[str]]
    family_weights: np.ndarray
    family_offsets: np.ndarray
    pairs: list[list[tuple[int, int, np.ndarray, float]]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language names and scores in 0..1: trust in the family times trust in the language."""
        n = len(x)
        if not self.families:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        if len(self.families) == 1:
            best, score = np.zeros(n, int), np.ones(n)
        else:
            margins = x @ self.family_weights.T + self.family_offsets
            best = margins.argmax(axis=1)
            score = _trust(margins[np.arange(n), best])
        names = np.empty(n, object)
        for f, languages in enumerate(self.families):
            mine = np.flatnonzero(best == f)
            if len(mine):
                names[mine], inner = self._within(f, x[mine])
                score[mine] = score[mine] * inner
        return names, score

    def _within(self, f: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        languages = self.families[f]
        votes = np.zeros((len(x), len(languages)))
        least = np.full((len(x), len(languages)), np.inf)
        for i, j, w, b in self.pairs[f]:
            m = x @ w + b
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        # ties of votes go to the language whose worst margin is best
        order = votes + 0.5 * np.tanh(np.where(np.isinf(least), 0, least))
        win = order.argmax(axis=1)
        inner = _trust(least[np.arange(len(x)), win])
        return np.array(languages, object)[win], inner


def _trust(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-3.0 * margin))


def fit(x1: np.ndarray, labels: list[str], families: dict = FAMILIES) -> LanguageModel:
    """The model learned from rows of features, with a last column of ones, and their languages."""
    of = {language: name for name, members in families.items() for language in members}
    groups: dict[str, set] = {}
    for label in labels:
        groups.setdefault(of.get(label, f"only {label}"), set()).add(label)
    names = sorted(groups)
    members = [sorted(groups[g]) for g in names]
    y = np.array(labels, object)
    mine = np.array([names.index(of.get(label, f"only {label}")) for label in labels], dtype=int)
    machines = [svm(x1, np.where(mine == f, 1, -1).astype(np.float32)) for f in range(len(names))] if len(names) > 1 else []
    pairs = []
    # the rows of a pair are put into one block, whatever the number of pairs
    sizes = sorted(Counter(labels).values())
    block = np.empty((sum(sizes[-2:]) if len(labels) > max(sizes) else 0, x1.shape[1]), np.float32)
    for languages in members:
        own = []
        for i, j in combinations(range(len(languages)), 2):
            use = np.flatnonzero((y == languages[i]) | (y == languages[j]))
            # "clip" writes straight into the block, without a copy between
            w, b = svm(np.take(x1, use, axis=0, out=block[: len(use)], mode="clip"), np.where(y[use] == languages[i], 1, -1).astype(np.float32))
            own.append((i, j, w, b))
        pairs.append(own)
    return LanguageModel(
        members,
        np.array([m[0] for m in machines], np.float32).reshape(len(machines), x1.shape[1] - 1),
        np.array([m[1] for m in machines], np.float32),
        pairs,
    )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` texts of each language, those with the least hash of the id.

    Rows of one id and text are one text, whatever their number. What comes to the driver is
    a count per language and ``per_language`` vectors of each, as the model has weights of each.
    """
    ready_for_python(docs.sparkSession)
    d = docs.select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(7), F.col(id_col)).alias("order"),
        F.xxhash64(F.lit(8), F.col(text_col)).alias("same"),
    ).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.approx_count_distinct("order", 0.02).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.empty((0, 0)), np.empty(0), [])
    # hashes below the bound hold about twice what is needed, so few rows are sorted; ids are counted, not rows
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2.0 * per_language + 50) / n))).otherwise(share)
    near = d.where(F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)) <= share)
    once = near.groupBy("lang", "order", "same").agg(F.first("text").alias("text"))
    place_of = F.row_number().over(Window.partitionBy("lang").orderBy("order", "same"))
    chosen = once.withColumn("at", place_of).where(F.col("at") <= per_language)
    vectors = chosen.select(F.lower("text").alias("text"), "lang", "order").mapInArrow(_vectors, "lang string, order long, vector binary")
    # vectors lie in one growing block, which goes back to the system whole
    data, place = bytearray(), {}
    for k, r in enumerate(vectors.toLocalIterator()):
        place.setdefault(r["lang"], []).append((r["order"], k))
        data += r["vector"]
    if not place:
        return LanguageModel([], np.empty((0, 0)), np.empty(0), [])
    rows = [(lang, k) for lang in sorted(place) for _, k in sorted(place[lang])[:per_language]]
    total = sum(map(len, place.values()))
    given = np.frombuffer(data, np.float16).reshape(total, -1)
    # the one copy that all machines learn from, with its ones
    x1 = np.ones((len(rows), given.shape[1] + 1), np.float32)
    for at, (_, k) in enumerate(rows):
        x1[at, :-1] = given[k]
    del data, given
    return fit(x1, [lang for lang, _ in rows])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, rows and other columns as they are."""
    spark = docs.sparkSession
    ready_for_python(spark)
    carried = spark.sparkContext.broadcast(model)
    schema = docs.schema
    names = [f.name for f in schema.fields if f.name not in ("lang_pred", "score")]
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    given = docs.select(*[F.col(f"`{n}`") for n in names], F.when(has_letter, F.lower(F.col(text_col))).alias("__features"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__features")
            known = np.asarray(column.is_valid())
            for a, b, data, offsets in textkit.slices(column):
                languages, scores = carried.value.predict(slice_features(data, offsets))
                languages[~known[a:b]] = UNKNOWN
                scores = np.where(known[a:b], scores, 0.0)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                    [*names, "lang_pred", "score"],
                )

    return given.mapInArrow(apply, f"{types}, lang_pred string, score double")


def held_out(doc_id) -> object:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def train_allowed(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: those not held out, with an id."""
    return docs.where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) != 1)
