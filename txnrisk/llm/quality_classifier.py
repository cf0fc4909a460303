"""Quality scores by regularised quadratic discriminants over document statistics.

Each class is a normal density over transformed statistics. Its covariance is shrunk towards the pooled
variances, so a class without spread in some column, or with few rows, stays usable. A score is a logistic
of the difference of the two log densities: Mahalanobis lengths by cached Cholesky factors,
log-determinants and priors. Real statistics have longer tails than normal ones, so the difference is damped, and
the point that scores ``cut_score`` lies midway between the classes' tails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from txnrisk.llm.docstats import FEATURES, statistics
from txnrisk.llm.labelled import training_labels
from txnrisk.llm.texts import raw_text

WIDTH = len(FEATURES)


@dataclass
class Discriminant:
    """Two shrunk normal densities; index 1 is the good class."""

    means: np.ndarray
    factors: np.ndarray  # inverted Cholesky factors
    constants: np.ndarray  # log prior less half the log-determinant
    damping: float = 0.1
    cut: float = 0.0
    cut_score: float = 0.7
    only: float | None = None  # the score of everything if a class is missing

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of the good class less that of the bad one, priors included."""
        density = [
            self.constants[k] - 0.5 * np.square((x - self.means[k]) @ self.factors[k].T).sum(axis=1)
            for k in (0, 1)
        ]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        odds = self.damping * (self.difference(x) - self.cut)
        odds += np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def from_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float) -> Discriminant:
    """From (rows, means, covariances) of the classes 0 and 1."""
    n = np.array([moments[k][0] if k in moments else 0.0 for k in (0, 1)])
    if n.min() == 0:
        nothing = np.zeros((2, WIDTH))
        flat = np.zeros((2, WIDTH, WIDTH))
        return Discriminant(nothing, flat, np.zeros(2), only=float((n[1] + 1) / (n.sum() + 2)))
    spreads = [moments[k][2] for k in (0, 1)]
    pooled = np.diag(np.diag((n[0] * spreads[0] + n[1] * spreads[1]) / n.sum())) + 1e-4 * np.eye(WIDTH)
    factors, constants = [], []
    for k in (0, 1):
        weight = max(shrink, WIDTH / (WIDTH + n[k]))
        root = np.linalg.cholesky((1 - weight) * spreads[k] + weight * pooled)
        factors.append(np.linalg.inv(root))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(root)).sum())
    means = np.array([moments[k][1] for k in (0, 1)])
    return Discriminant(means, np.array(factors), np.array(constants))


def fit(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    shrink: float = 0.1,
    cut_score: float = 0.7,
    tail: float = 0.001,
) -> Discriminant:
    """Fits ``document_statistics`` of every labelled row that is not held out, see ``training_labels``.

    Means and products are aggregated in Spark; two rows of fixed width reach the driver, then two
    quantiles of the difference. Without rows of both classes everything gets the smoothed share.
    """
    stats = stats.join(training_labels(labels, id_col, label_col), "id").select("label", *FEATURES)
    pairs = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
    sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs]
    moments = {}
    for row in stats.groupBy("label").agg(F.count("*").alias("n"), *sums).collect():
        spread = np.zeros((WIDTH, WIDTH))
        for i, j in pairs:
            spread[i, j] = spread[j, i] = row[f"c{i}_{j}"]
        moments[row["label"]] = (float(row["n"]), np.array([row[f"m{i}"] for i in range(WIDTH)]), spread)
    model = from_moments(moments, shrink)
    model.cut_score = cut_score
    if model.only is None:
        model.cut = _cut(stats, model, tail)
    return model


def _cut(stats: DataFrame, model: Discriminant, tail: float) -> float:
    """Midway between the upper tail of the bad class and the lower tail of the good one."""

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [batch.column(0), pa.array(model.difference(_matrix(batch)))]
            yield pa.RecordBatch.from_arrays(made, names=["label", "gap"])

    gaps = stats.mapInArrow(differences, "label int, gap double")
    ends = gaps.groupBy("label").agg(F.percentile_approx("gap", [tail, 1 - tail], 10_000).alias("q"))
    q = {row["label"]: row["q"] for row in ends.collect()}
    return (q[0][1] + q[1][0]) / 2


def score_documents(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score double) for every row of ``document_statistics``; an empty text has a score too.

    Labels, language, source and id are no inputs. Repeated rows stay; an empty table gives no rows.
    Only ``id`` and the feature columns are read, so other columns of any name are passed over. Very
    long texts arrive as their statistics, one row each.
    """
    kind = stats.schema["id"].dataType

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    schema = StructType([StructField("id", kind), StructField("score", DoubleType())])
    return stats.select("id", *FEATURES).mapInArrow(scores, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The feature columns, which follow the first column, as rows."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)


def score_of(text_col: str, model: Discriminant) -> Column:
    """The score as a column, for filters that keep whole rows."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t)[1] for t in texts]).reshape(-1, WIDTH)))

    return scored(raw_text(text_col))
