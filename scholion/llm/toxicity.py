"""Severity of toxicity by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.workers import lean

EDGES = "\"'()[]{}<>.,;:!?*#$%&|-_"


def word_features(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text, without punctuation at their ends."""
    return {w.strip(EDGES) for w in set((text or "").lower().split())}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - w x): all thresholds share the weights."""

    weights: dict[str, float]
    thresholds: list[float]

    def chances(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return (1.0 - _sigmoid(np.array(self.thresholds) - score)).tolist()


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, n_columns: int, grades: np.ndarray, penalty: float = 0.1, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood.

    rows, columns: places of the ones in the feature matrix. Thresholds are a first one and positive gaps, so they
    stay in order. Gradient steps with momentum and scaling (Adam), full batch.
    """
    n, levels = len(grades), int(grades.max()) + 1
    seen = np.array([(grades <= k).mean() for k in range(levels - 1)])
    start = np.log(seen / (1 - seen))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(n_columns), start[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cut = theta[:n_columns], np.cumsum(np.concatenate([theta[n_columns : n_columns + 1], np.exp(theta[n_columns + 1 :])]))
        eta = np.bincount(rows, w[columns], n)
        bounds = np.concatenate([[-np.inf], cut, [np.inf]])
        high, low = _sigmoid(np.minimum(bounds[grades + 1], 1e9) - eta), _sigmoid(np.maximum(bounds[grades], -1e9) - eta)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        g_eta = dh - dl  # of the negative log-likelihood
        g_cut = np.array([dl[grades == k + 1].sum() - dh[grades == k].sum() for k in range(levels - 1)])
        back = np.cumsum(g_cut[::-1])[::-1]  # a gap moves its threshold and all above
        grad = np.concatenate([np.bincount(columns, g_eta[rows], n_columns) + penalty * w, back[:1], back[1:] * np.exp(theta[n_columns + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_columns], np.cumsum(np.concatenate([theta[n_columns : n_columns + 1], np.exp(theta[n_columns + 1 :])]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, grade: Column, sample: int = 6000, vocabulary: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """Fit on a bounded sample of labelled documents: about ``sample`` of them, those with the smallest hashes of the id.

    grade: the severity, 0 and up, as an expression over ``labels``. The ``vocabulary`` words of the sample whose
    presence differs most between grade 0 and the rest become features. None if fewer than two grades are seen.
    """
    rank = F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 30))
    total = max(1, labels.count())
    chosen = labels.select(F.col(id_col).alias("id_"), grade.cast("int").alias("grade"), rank.alias("rank")).where("id_ is not null and grade >= 0")
    chosen = chosen.where(F.col("rank") < F.lit(float(1 << 30) * min(1.0, sample / total))).orderBy("rank", "id_").limit(2 * sample)
    texts = docs.select(F.col(id_col).alias("own_"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("own_") == F.col("id_")).select("id_", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(w for w in word_features(t) if 1 < len(w) <= 64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["id", "grade", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.mapInArrow(lean(run), f"id {kind}, grade int, words array<string>").persist()
    grades = [r.grade for r in rows.select("grade").collect()]
    if len(set(grades)) < 2:
        rows.unpersist()
        return None
    bad = sum(g > 0 for g in grades)
    counts = rows.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.sum((F.col("grade") > 0).cast("double")).alias("n1"), F.sum((F.col("grade") == 0).cast("double")).alias("n0"))
    p1, p0 = F.col("n1") / F.lit(float(bad)), F.col("n0") / F.lit(float(max(1, len(grades) - bad)))
    counts = counts.where(F.col("n1") + F.col("n0") >= max(4.0, len(grades) / 400)).withColumn("z", F.abs(p1 - p0) / F.sqrt((p1 + p0) / 2 + 1e-3))
    words = [r.word for r in counts.orderBy(F.desc("z"), "word").limit(vocabulary).collect()]
    index = {w: k for k, w in enumerate(words)}
    only = F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")
    data = rows.select("grade", F.array_intersect("words", only).alias("words"), "id").orderBy("id", "grade").collect()
    rows.unpersist()
    order = {g: k for k, g in enumerate(sorted({r.grade for r in data}))}
    at = np.array([k for k, r in enumerate(data) for _ in r.words], np.int64)
    columns = np.array([index[w] for r in data for w in r.words], np.int64)
    w, cut = fit_ordinal(at, columns, len(words), np.array([order[r.grade] for r in data]))
    return OrdinalModel({x: float(v) for x, v in zip(words, w, strict=True) if abs(v) > 1e-3}, cut.tolist())


def predict_severity(docs: DataFrame, model: OrdinalModel | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, expected_severity, toxic) of each whole text.

    severity: the grade whose cumulative chance reaches one half; expected_severity: the mean of the grades; toxic: the
    chance of any grade above 0 reaches ``threshold``. Null and empty texts have no features. Without a model all are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds) if model else ({}, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        own = OrdinalModel(weights, thresholds)
        keys = frozenset(weights)
        for batch in batches:
            grade, mean, toxic = [], [], []
            for text in batch.column(1):
                found = keys & word_features(text.as_py())
                up = own.chances(sum(weights[w] for w in sorted(found))) if thresholds else []
                grade.append(sum(p >= 0.5 for p in up))
                mean.append(float(sum(up)))
                toxic.append(bool(up) and up[0] >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade, pa.int32()), pa.array(mean, pa.float64()), pa.array(toxic, pa.bool_())], ["doc_id", "severity", "expected_severity", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, severity int, expected_severity double, toxic boolean")
