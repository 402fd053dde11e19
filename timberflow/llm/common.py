"""Helpers that several operators share: lineage cuts, bounded labelled samples, a two-parameter calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow.session import materialize

__all__ = ["calibrate", "held_out", "labelled_sample", "materialize", "sigmoid", "small_batches", "table", "text_of"]


def small_batches(spark: SparkSession, rows: int = 512) -> SparkSession:
    """Let Python workers get at most ``rows`` rows at a time, as one row may be a long text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's decimal text falls in the part that is kept from fitting; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out part.

    The labels' ids are taken in the order of their hash, so the bound holds before any text is read; that
    is also what bounds the broadcast.  A repeated id counts once, with its smallest text and label.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    return (
        documents.select("doc_id", text_of().alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("label").alias("label"))
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def calibrate(values: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope of a ridge-penalised logistic regression of the label on one value (Newton steps)."""
    values, labels = np.asarray(values, float), np.asarray(labels, float)
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
    weights = np.array([np.log(rate / (1 - rate)), 0.0])
    if len(labels) == 0 or labels.min() == labels.max():
        return float(weights[0]), 0.0
    design = np.column_stack([np.ones_like(values), values])
    penalty = ridge * len(labels) * np.diag([1e-3, 1.0])
    for _ in range(rounds):
        guess = sigmoid(design @ weights)
        gradient = design.T @ (guess - labels) + penalty @ weights
        curve = (design * (guess * (1 - guess))[:, None]).T @ design + penalty + 1e-9 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        weights = weights - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0]), float(weights[1])
