"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all labelled rows that are not held out; each covariance is shrunk
towards the pooled one and that towards a diagonal. A score is the logistic of the difference of the classes' Mahalanobis
log densities, each from a Cholesky factor that is computed once and shipped to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, small_batches, text_bytes, write_table
from .text_stats import FEATURES, features

#: Weight of the pooled covariance in a class's, and of the diagonal in the pooled one.
POOLED, DIAGONAL = 0.1, 0.1
#: The log-density difference is divided by this before the logistic, which keeps scores from rounding to 0 and 1.
TEMPERATURE = float(len(FEATURES))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def text_features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hashes = WordHashes()
    for series in texts:
        yield series.map(lambda data: features(data, hashes))


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 3, is 1. A null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Discriminant:
    """log p(x | 1) P(1) - log p(x | 0) P(0) of scaled features, from inverse Cholesky factors."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    constant: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        d0, d1 = (((z - m) @ w.T) ** 2 for m, w in zip(self.means, self.whiten, strict=True))
        return 0.5 * (d0.sum(axis=1) - d1.sum(axis=1)) + self.constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / TEMPERATURE, -700, 700)))


def class_sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each class of (label, features): the sum of (1, x)(1, x)', added up by task and then by entry."""
    d = len(FEATURES) + 1

    def partial(it):
        sums = np.zeros((2, d, d))
        for batch in it:
            if batch.num_rows:
                label = batch.column(0).to_numpy()
                x = np.column_stack([np.ones(batch.num_rows), np.array(batch.column(1).to_pylist(), float)])
                for k in (0, 1):
                    sums[k] += x[label == k].T @ x[label == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], d * d)), pa.array(np.tile(np.arange(d * d), 2)), pa.array(sums.ravel())], names=["label", "entry", "value"])

    added = rows.mapInArrow(partial, "label long, entry long, value double").groupBy("label", "entry").agg(F.sum("value").alias("value"))
    out = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for r in added.collect():
        out[r["label"]][r["entry"]] = r["value"]
    return {k: v.reshape(d, d) for k, v in out.items()}


def fit(featured: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The discriminant learned from (doc_id, features) and (doc_id, quality); None without both classes.

    Labels other than 0 and 1 are ignored; a document labelled both ways counts once in each class.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("long").alias("label")).distinct()
    sums = class_sums(featured.where(~held_out()).select("doc_id", "features").join(marks, "doc_id").select("label", "features"))
    n = [sums[k][0, 0] for k in (0, 1)]
    if min(n) < 2:
        return None
    total = sums[0] + sums[1]
    center = total[0, 1:] / total[0, 0]
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - center**2, 1e-6))
    means = [(sums[k][0, 1:] / n[k] - center) / scale for k in (0, 1)]
    scatter = [(sums[k][1:, 1:] / n[k] - np.outer(sums[k][0, 1:], sums[k][0, 1:]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / sum(n)
    pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(center))
    factors = [np.linalg.cholesky((1 - POOLED) * s + POOLED * pooled) for s in scatter]
    logdet = [2 * np.log(np.diag(f)).sum() for f in factors]
    constant = 0.5 * (logdet[0] - logdet[1]) + float(np.log(n[1] / n[0]))
    return Discriminant(center, scale, means, [np.linalg.inv(f) for f in factors], constant)


def score_column(model: Discriminant | None, column: str = "features") -> Column:
    """The score of a column of features: 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(series: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(series.tolist(), float)) if len(series) else [], dtype=float)

    return score(F.col(column))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id long, text), learned from ``labels`` (doc_id, quality).

    Only statistics of the text are inputs of a score. Null texts count as empty; empty texts are scored like others;
    repeated rows give a row each; a null doc_id is not held out and never labelled; other columns are ignored. Without
    labelled rows of both classes every score is 0.5.
    """
    small_batches(docs.sparkSession)
    featured = write_table(docs.select(F.col("doc_id").cast("long"), text_features(text_bytes()).alias("features")), "features")
    out = featured.select("doc_id", held_out().alias("held_out"), score_column(fit(featured, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that score 0.5 or more."""
    small_batches(docs.sparkSession)
    columns, name = docs.columns, "features"
    while name in columns:
        name += "_"
    featured = write_table(docs.withColumn(name, text_features(text_bytes())), "featured")
    model = fit(featured.select(F.col("doc_id"), F.col(name).alias("features")), labels)
    return featured.where(score_column(model, name) >= 0.5).select(columns)
