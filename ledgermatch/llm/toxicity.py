"""Toxicity by classifier chains.

Categories are predicted in a fixed order. The model of each is linear in hashed word indicators,
scaled by their log-count ratios, and in the log-odds predicted for all categories before it. Models
later in the chain are trained on out-of-fold predictions of the earlier ones: each document's earlier
log-odds come from models that did not see it, as will be the case for new documents. The same
predictions give the logistic curve that makes margins probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.features import DIMENSIONS, SAMPLE, Rows, folds, labelled_sample, sigmoid, word_features
from ledgermatch.llm.linear import log_count_ratios, logistic_curve, support_vectors
from ledgermatch.llm.textscan import as_bytes, map_rows

FOLDS = 3
#: Log-odds of earlier categories are kept within this.
BOUND = 6.0


class Linear:
    """Log-odds: a slope and a shift on the sum of weights of words and of earlier log-odds."""

    def __init__(self, words: np.ndarray, more: np.ndarray):
        self.words, self.more, self.slope, self.shift = words, more, 1.0, 0.0

    def margins(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return rows.dot(self.words) + _with_one(earlier) @ self.more

    def odds(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margins(rows, earlier) + self.shift, -BOUND, BOUND)


def _with_one(earlier: np.ndarray) -> np.ndarray:
    return np.concatenate([earlier, np.ones((len(earlier), 1))], axis=1)


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Hinge loss on indicators scaled by log-count ratios, and on earlier log-odds as they are."""
    return Linear(*support_vectors(rows, log_count_ratios(rows, y), _with_one(earlier), y))


def fit_category(rows: Rows, earlier: np.ndarray, label: np.ndarray) -> tuple[Linear, np.ndarray]:
    """A category's model, and the log-odds of each document by a model that did not see it. Labels of
    one kind only, or next to none of the other, give the smoothed share of label 1."""
    y, n, fold = np.where(label > 0, 1.0, -1.0), len(label), folds(len(label), FOLDS)
    if min((y > 0).sum(), (y < 0).sum()) < 2 * FOLDS:
        model = Linear(np.zeros(DIMENSIONS), np.zeros(earlier.shape[1] + 1))
        model.shift = float(np.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1)))
        return model, model.odds(rows, earlier)
    margins = np.zeros(n)
    for k in range(FOLDS):
        seen, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        margins[rest] = fit_linear(rows.take(seen), earlier[seen], y[seen]).margins(rows.take(rest), earlier[rest])
    model = fit_linear(rows, earlier, y)
    model.slope, model.shift = logistic_curve(margins, y)
    return model, np.clip(model.slope * margins + model.shift, -BOUND, BOUND)


class Chain:
    """Models of the categories in their order."""

    def __init__(self, names: list[str], models: list[Linear]):
        self.names, self.models = names, models

    def probabilities(self, rows: Rows) -> np.ndarray:
        earlier = np.zeros((len(rows), 0))
        for model in self.models:
            earlier = np.concatenate([earlier, model.odds(rows, earlier)[:, None]], axis=1)
        return sigmoid(earlier)


def fit_chain(names: list[str], rows: Rows, labels: np.ndarray) -> Chain:
    """``labels``: a column of 0 and 1 for each category, in chain order."""
    models: list[Linear] = []
    unseen = np.zeros((len(rows), 0))
    for c in range(len(names)):
        model, odds = fit_category(rows, unseen, labels[:, c])
        models.append(model)
        unseen = np.concatenate([unseen, odds[:, None]], axis=1)
    return Chain(list(names), models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> Chain:
    """Fit on at most ``sample`` labelled documents; ``categories`` are columns of ``labels`` with 0 and
    1, in chain order. Rows that lack a label are left out; without any rows every text gets 0.5."""
    values, rows = labelled_sample(docs, labels, list(categories), word_features, sample)
    return fit_chain(list(categories), rows, values)


def predict(docs: DataFrame, chain: Chain, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` and ``p_<category>`` for every row. Null and empty texts have the probabilities
    of a text without words."""
    shared, kinds = docs.sparkSession.sparkContext.broadcast(chain), dict(docs.dtypes)

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        found = [word_features(x or b"") for x in as_bytes(batch.column("__text"))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        p = shared.value.probabilities(Rows(np.concatenate([np.zeros(0, np.int32), *found]), offsets))
        return {c: batch.column(c) for c in carry} | {f"p_{c}": p[:, k] for k, c in enumerate(shared.value.names)}

    schema = [*(f"`{c}` {kinds[c]}" for c in carry), *(f"p_{c} double" for c in chain.names)]
    return map_rows(docs.select(*carry, F.col(text).alias("__text")), make, ", ".join(schema))
