"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed words."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]+")


class Features(dict):
    """Two feature numbers per word: of its letters in lower case, and of its look (case and other characters)."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: bytes) -> tuple[int, int]:
        text = word.decode()
        core = "".join(LETTER.findall(text)).lower()
        look = LETTER.sub("a", text) if not text.isdigit() else "0"
        case = "U" if len(text) > 1 and text.isupper() else "l"
        self[word] = pair = tuple(xxhash.xxh3_64_intdigest(x) % self.size for x in (f"w{core}", f"s{case}{look[:12]}"))
        return pair

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of a whole text: log(1 + count) per different word, log(1 + per mille) per look."""
        count = Counter(text.encode().split())
        if len(self) > 400_000:
            self.clear()
        if not count:
            return np.zeros(0, np.int64), np.zeros(0)
        pairs = np.array([self[w] for w in count], np.int64)
        n = np.fromiter(count.values(), np.float64, len(count))
        looks, which = np.unique(pairs[:, 1], return_inverse=True)
        share = np.bincount(which, n) / n.sum()
        return np.concatenate([pairs[:, 0], looks]), np.concatenate([np.log1p(n), np.log1p(1000 * share)])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . features); the thresholds are in order, the weights are shared."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, per row."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(index: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, grades: int, size: int, ridge: float, steps: int, rate: float) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by ``steps`` full-batch Adam steps. Threshold gaps are exponentials, so they stay
    in order. Grades weigh in inverse proportion to the root of their frequency."""
    n = len(grade)
    known, index = np.unique(index, return_inverse=True)
    index = index.astype(np.int32)
    frequency = np.bincount(grade, minlength=grades) / max(n, 1)
    weight = 1 / np.sqrt(np.maximum(frequency, 1e-6))[grade]
    weight = weight / weight.sum() if n else weight
    w, cut = np.zeros(len(known)), np.concatenate([[-1.0], np.zeros(grades - 2)])
    m = [np.zeros_like(w), np.zeros_like(cut)]
    v = [np.zeros_like(w), np.zeros_like(cut)]
    for t in range(1, steps + 1 if n else 1):
        theta = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        s = np.bincount(row, w[index] * value, minlength=n)
        hi, lo = (sigmoid(bounds[grade + i] - s) for i in (1, 0))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = weight * (dhi - dlo)  # of the negative log likelihood
        dw = np.bincount(index, ds[row] * value, minlength=len(known)) + ridge * w
        dt = np.zeros(grades + 1)
        np.add.at(dt, grade + 1, -weight * dhi)
        np.add.at(dt, grade, weight * dlo)
        onward = np.cumsum(dt[1:grades][::-1])[::-1]
        dc = np.concatenate([onward[:1], onward[1:] * np.exp(cut[1:])])
        for k, (x, g) in enumerate(((w, dw), (cut, dc))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(size)
    full[known] = w
    return OrdinalModel(full, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])))


def learn(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, grades: int = 3, sample: int = 16_000, size: int = 1 << 18, ridge: float = 2e-4, least: int = 4, steps: int = 120, rate: float = 0.1, seed: int = 31) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents, those with the least hash of their id: the one bounded sample, whatever the
    size of the tables. Features of fewer than ``least`` of them are left out. The features meet in one task; the driver gets
    the weights."""
    rated = ratings.where(F.col(grade_col).between(0, grades - 1)).select(F.col(id_col).alias("rated"), F.col(grade_col).cast("int").alias("grade"))
    drawn = rated.where("rated is not null").groupBy("rated").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64(F.lit(seed), "rated"), "rated").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("rated"))

    def features(batches):
        known = Features(size)
        for batch in batches:
            rows = [(*known.of(t or ""), g, i) for t, g, i in zip(*[batch.column(c).to_pylist() for c in ("text", "grade", "id")])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[3] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                ["id", "grade", "index", "value"],
            )

    def fit(batches):
        rows = [r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("id", "grade")], b.column("index"), b.column("value"))]
        rows.sort(key=lambda r: r[:2])  # the same sums whichever task was first
        index = [r[2].values.to_numpy() for r in rows]
        value = [r[3].values.to_numpy() for r in rows]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i in index])
        flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        index, value = flat(index, np.int32), flat(value, np.float32)
        often = np.bincount(index, minlength=size)[index] >= least
        model = fit_ordinal(index[often], value[often], row[often], np.array([r[1] for r in rows], np.int64), grades, size, ridge, steps, rate)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.thresholds.tolist()])], ["weights", "thresholds"])

    made = texts.select("id", "text", "grade").mapInArrow(features, "id long, grade int, index array<int>, value array<float>")
    got = made.repartition(1).mapInArrow(fit, "weights binary, thresholds array<double>").first()
    return OrdinalModel(np.frombuffer(got["weights"], "<f4").astype(np.float64), np.array(got["thresholds"]))


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """Expected grade, P(grade >= 1) ... P(grade >= top) and kept (the last is at least ``keep``) per row of ``docs``."""
    size, weights, cuts = len(model.weights), model.weights.astype("<f4"), model.thresholds

    def run(batches):
        known = Features(size)
        for batch in batches:
            scores = []
            for t in batch.column(1).to_pylist():
                index, value = known.of(t or "")
                scores.append(float(weights[index] @ value) if len(index) else 0.0)
            above = OrdinalModel(weights, cuts).above(np.array(scores))
            cols = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above.tolist(), pa.list_(pa.float64())), pa.array(above[:, -1]), pa.array(above[:, -1] >= keep)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "expected_grade", "p_at_least", "p_top", "kept"])

    made = f"`{id_col}` long, expected_grade double, p_at_least array<double>, p_top double, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, made)


def classify(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, keep: float = 0.5, **options) -> DataFrame:
    """Learn from ``ratings`` (id, grade from 0 to ``grades`` - 1) and grade every document.

    Returns id, expected_grade, p_at_least, p_top, kept; other columns are not read.

    * Null or empty text: no features, score 0. Null ids are graded but never rated. Ratings that are null or out of range
      are left out; of several for one id the lowest counts. Without any rating all weights are 0.
    * Repeated rows are graded each; an empty table gives no rows."""
    return grade_documents(docs, learn(docs, ratings, id_col, text_col, grade_col, grades, **options), id_col, text_col, keep)
