"""Quality classifier: naive Bayes support vectors.

Texts are indicators of hashed n-grams. Each n-gram is scaled by its log-count ratio, the logarithm
of how much more often documents of label 1 have it than those of label 0. On these a linear model
with hinge loss is fitted by dual coordinate descent. Margins become probabilities by a logistic
curve fitted to margins of documents that the model in question did not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.features import DIMENSIONS, SAMPLE, Rows, folds, labelled_sample, sigmoid, style_features
from ledgermatch.llm.linear import log_count_ratios, logistic_curve, support_vectors
from ledgermatch.llm.textscan import as_bytes, map_rows

#: Of the sample, for the logistic curve.
FOLDS = 3


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def score(self, data: bytes) -> float:
        margin = float(self.weights[style_features(data)].sum(dtype=np.float64)) + self.bias
        return float(sigmoid(np.float64(self.slope * margin + self.shift)))


def fit(rows: Rows, labels: np.ndarray) -> QualityModel:
    """A model of label 1 against label 0. With one class only, or no rows at all, every text has the
    smoothed share of label 1 as its score."""
    y = np.where(labels > 0, 1.0, -1.0)
    ones, zeros = int((y > 0).sum()), int((y < 0).sum())
    if min(ones, zeros) < FOLDS:
        return QualityModel(np.zeros(DIMENSIONS), 0.0, 1.0, float(np.log((ones + 1) / (zeros + 1))))

    def model(at: np.ndarray) -> tuple[np.ndarray, float]:
        own = rows.take(at)
        w, v = support_vectors(own, log_count_ratios(own, y[at]), np.ones((len(at), 1)), y[at])
        return w, float(v[0])

    fold, margins = folds(len(rows), FOLDS), np.zeros(len(rows))
    for k in range(FOLDS):
        w, bias = model(np.flatnonzero(fold != k))
        margins[fold == k] = rows.take(np.flatnonzero(fold == k)).dot(w) + bias
    w, bias = model(np.arange(len(rows)))
    return QualityModel(w, bias, *logistic_curve(margins, y))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` of the labelled documents. Rows without label are left out."""
    values, rows = labelled_sample(docs, labels, [label], style_features, sample)
    return fit(rows, values[:, 0])


def score(
    docs: DataFrame, model: QualityModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``carry`` and ``score`` (0 to 1) for every row; nothing but the text has a part in it.
    Null and empty texts have the score of a text without n-grams."""
    shared, kinds = docs.sparkSession.sparkContext.broadcast(model), dict(docs.dtypes)

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        scores = [shared.value.score(x or b"") for x in as_bytes(batch.column("__text"))]
        return {c: batch.column(c) for c in carry} | {"score": scores}

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "score double"])
    return map_rows(docs.select(*carry, F.col(text).alias("__text")), make, schema)
