"""Document quality by a regularised quadratic discriminant.

A text becomes a short vector of statistics, each moved to a scale on which it is roughly normal.  For each class the mean
and the covariance, shrunk towards a multiple of the unit matrix and the pooled covariance, are fitted on a bounded sample; the
score comes from the difference of the two Mahalanobis log densities, computed with Cholesky factors kept in the model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberflow.llm.common import calibrate, labelled_sample, sigmoid

#: Labelled documents that the discriminant is fitted on.
SAMPLE_ROWS = 20_000
SHRINKAGES = (0.02, 0.1, 0.3)
FOLDS = 4

STATISTICS = (
    "words", "length_of_words", "distinct_words", "repeats", "upper", "digits", "symbols", "pipes", "marks", "ends",
    "lines", "distinct_lines", "busiest_line", "letters_entropy", "other_bytes", "doubled_marks",
)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; null and empty texts have defined values."""
    text = text or ""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words, size = text.split(), max(int(data.sum()), 1)
    n = max(len(words), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    upper, lower, digits = int(data[65:91].sum()), int(data[97:123].sum()), int(data[48:58].sum())
    full = int(data[[33, 44, 46, 58, 59, 63]].sum())
    symbols = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum()) - full - int(data[124])
    letters = data[97:123] + data[65:91]
    share = letters[letters > 0] / max(int(letters.sum()), 1)
    worst = 0.0
    for line in lines[:1] if len(lines) == 1 else lines:
        own = line.split()
        if len(own) >= 4:
            worst = max(worst, 1 - len(set(own)) / len(own) ** 0.9)
    root = math.sqrt
    return [
        math.log1p(len(words)),
        math.log1p(len(text) / n),
        root(len(set(words)) / n ** 0.9),
        root(sum(map(eq, words, words[1:])) / n),
        root(upper / max(upper + lower, 1)),
        root(digits / size),
        root(symbols / size),
        root(int(data[124]) / n),
        root(full / n),
        root(text.count(".") / n),
        math.log1p(100 * len(lines) / n),
        root(len(set(lines)) / max(len(lines), 1)),
        worst,
        float(-(share * np.log(share)).sum()) if len(share) else 0.0,
        root(int(data[128:].sum()) / size),
        root((text.count("!!") + text.count("??") + text.count("..")) / n),
    ]


def matrix(texts: pd.Series | list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


@dataclass
class QualityModel:
    """Means and Cholesky factors of both classes in standardised space, and the curve from log-density difference to score."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    intercept: float
    slope: float

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, signed root beyond 1 so that far outliers stay finite."""
        z, density = (rows - self.centre) / self.scale, []
        for mean, factor in zip(self.means, self.factors, strict=True):
            white = np.linalg.solve(factor, (z - mean).T)
            density.append(-0.5 * (white**2).sum(0) - np.log(np.diag(factor)).sum())
        gap = density[1] - density[0]
        return np.sign(gap) * (np.sqrt(1 + np.abs(gap)) - 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + self.slope * self.difference(rows)) if len(rows) else np.zeros(0)


def _discriminant(rows: np.ndarray, labels: np.ndarray, shrinkage: float) -> QualityModel:
    centre, scale = rows.mean(0), rows.std(0) + 1e-6
    z, d = (rows - centre) / scale, rows.shape[1]
    pooled = sum(np.cov(z[labels == c].T, bias=True) * (labels == c).mean() for c in (0, 1))
    means, factors = [], []
    for c in (0, 1):
        own = z[labels == c]
        cov = np.cov(own.T, bias=True) if len(own) > 1 else pooled
        weight = shrinkage + (1 - shrinkage) * d / (d + len(own))  # few rows lean on the pooled covariance
        cov = (1 - weight) * cov + weight * (0.5 * pooled + 0.5 * np.eye(d) * np.trace(cov) / d)
        means.append(own.mean(0))
        factors.append(np.linalg.cholesky(cov + 1e-4 * np.eye(d)))
    return QualityModel(centre, scale, means, factors, 0.0, 1.0)


def fit_matrix(rows: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Choose the shrinkage by held-out log loss over fixed folds, then fit on all rows and calibrate on out-of-fold differences."""
    d = len(STATISTICS)
    if len(rows) == 0 or min((labels == 0).sum(), (labels == 1).sum()) < 2 * FOLDS:
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        unit = [np.eye(d), np.eye(d)]
        return QualityModel(np.zeros(d), np.ones(d), [np.zeros(d), np.zeros(d)], unit, float(np.log(rate / (1 - rate))), 0.0)
    fold, best = np.arange(len(rows)) % FOLDS, None
    for shrinkage in SHRINKAGES:
        apart = np.zeros(len(rows))
        for k in range(FOLDS):
            if min((labels[fold != k] == c).sum() for c in (0, 1)) < 2:
                continue
            apart[fold == k] = _discriminant(rows[fold != k], labels[fold != k], shrinkage).difference(rows[fold == k])
        a, b = calibrate(apart, labels)
        guess = np.clip(sigmoid(a + b * apart), 1e-9, 1 - 1e-9)
        loss = -(labels * np.log(guess) + (1 - labels) * np.log(1 - guess)).mean()
        if best is None or loss < best[0]:
            best = (loss, shrinkage, a, b)
    model = _discriminant(rows, labels, best[1])
    model.intercept, model.slope = best[2], best[3]
    return model


def fit(documents: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents (doc_id, quality) whose crc32(doc_id) mod ``parts`` is not ``part``.

    Only their statistics reach the driver.  With too few rows of a class the score is that class's share for every text.
    """
    sample = labelled_sample(documents, labels, "quality", parts, part, rows)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts)), dtype=object)

    found = sample.select("doc_id", "label", measured("text").alias("x")).toPandas().sort_values("doc_id")
    return fit_matrix(np.array(found["x"].tolist(), float).reshape(-1, len(STATISTICS)), found["label"].to_numpy(float))


def scorer(model: QualityModel) -> Callable[[Column], Column]:
    """Column function: text to score in 0..1; null reads as the empty text."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)), dtype="float64")

    return score
