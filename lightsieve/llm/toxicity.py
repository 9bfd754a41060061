"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives, all other text is unlabelled. With the class prior p, the risk of a
score f is  p * R(f is positive | positives) + max(0, R(f is negative | unlabelled) - p * R(f is negative | positives)),
so what the unlabelled rows hold of positives is taken off again, and never below zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.llm.textmodel import WordScores, bounded_sample, fit_linear, fold, sigmoid, sparse_features, sparse_rows

MOST_POSITIVE = 1500
MOST_UNLABELLED = 3500
STEPS = 64  # bins a unit of the score, in which the level is sought
FURTHEST = 30  # scores beyond are counted there


def nnpu_gradient(positive: np.ndarray, prior: float):
    """Derivative of the non-negative risk with the logistic loss. positive: which rows are confirmed examples."""
    n_p, n_u = positive.sum(), (~positive).sum()

    def gradient(scores: np.ndarray) -> np.ndarray:
        s = sigmoid(scores)
        negative_loss = np.logaddexp(0, scores)
        rest = negative_loss[~positive].mean() - prior * negative_loss[positive].mean()
        g = np.zeros(len(scores))
        if rest >= 0:
            g[positive] = prior / n_p * ((s[positive] - 1) - s[positive])
            g[~positive] = s[~positive] / n_u
        else:  # the estimate fell below zero: step back on that part
            g[positive] = prior / n_p * s[positive]
            g[~positive] = -s[~positive] / n_u
        return g

    return gradient


def decision_level(bins: pd.DataFrame) -> float:
    """Where recall**2 / share of all rows above is largest; 0 when that is not defined.

    The middle of all levels that are within a standard error of the best, since few confirmed rows make the curve
    rugged. bins: (bin, n, positive), rows and confirmed ones whose score is in [bin / STEPS, (bin + 1) / STEPS).
    """
    bins = bins.sort_values("bin", ascending=False)
    at, n, positive = (bins[c].to_numpy(float) for c in ("bin", "n", "positive"))
    confirmed = positive.sum()
    if not confirmed or confirmed == n.sum():
        return 0.0
    recall, share = np.cumsum(positive) / confirmed, (np.cumsum(n) + 1.0) / n.sum()
    merit = recall**2 / share
    best = int(np.argmax(merit))
    error = 2 * np.sqrt(max(1 - recall[best], 1 / confirmed) / (recall[best] * confirmed))
    near = np.flatnonzero(merit >= (1 - error) * merit[best])
    below = at[near[-1] + 1] + 1 if near[-1] + 1 < len(at) else at[near[-1]]
    return float((at[near[0]] + (at[near[-1]] + below) / 2) / 2 / STEPS)


def _fit(rows: pd.DataFrame, prior: float) -> tuple[np.ndarray, float]:
    """Weights and offset."""
    y = rows["y"].to_numpy(bool)
    if not y.any() or y.all():
        return np.zeros(1), -30.0
    return fit_linear(sparse_rows(rows["place"].tolist(), rows["value"].tolist()), nnpu_gradient(y, prior))


def _levelled(model: tuple[np.ndarray, float], bins: pd.DataFrame) -> tuple[np.ndarray, float]:
    """The model with its offset moved so that the decision level scores 0.5."""
    return model[0], model[1] - decision_level(bins)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """(id_col, held_out, score, predicted), one row for each input row.

    The fit uses at most most_positive confirmed documents and most_unlabelled of all, of folds 2 and up. The level of
    0.5 comes from counts over all rows of fold 1, the class prior from all labels of the folds but 0: it is the share
    of toxic among them. Fold 0 is held out. Scores see the text alone. Null and empty texts get the score of the
    offset, long ones are scored whole. Null labels count as none; without any positive all score 0. Null ids are
    held_out = false and never learned from. Rows that repeat an id are scored one by one; an empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ident, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    learn = docs.select(ident.alias("id"), text.alias("text")).filter(F.col("id").isNotNull()).withColumn("fold", fold(F.col("id"))).filter("fold <> 0")
    known = labels.select(ident.alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("fold", fold(F.col("id"))).filter("fold <> 0").groupBy("id", "fold").agg(F.max("label").alias("label"))
    total, toxic = known.agg(F.count("*"), F.sum("label")).first()
    fitted = (np.zeros(1), -30.0)
    if toxic:
        positive = bounded_sample(known.filter("label = 1 and fold > 1").select("id"), "id", most_positive, "positive")
        # of all rows, confirmed ones too: the prior is theirs
        others = bounded_sample(learn.filter("fold > 1").select("id").distinct(), "id", most_unlabelled, "unlabelled")
        chosen = F.broadcast(positive.withColumn("y", F.lit(True)).unionByName(others.withColumn("y", F.lit(False))))  # bounded by the two limits
        # of rows that share a chosen id one is learned from, so what is fitted is bounded whatever ids repeat
        rows = learn.join(chosen, "id").select("id", "y", F.xxhash64("text").alias("h"), sparse_features(F.col("text")).alias("words")).groupBy("id", "y").agg(F.min(F.struct("h", "words")).alias("r"))
        fitted = _fit(rows.select("y", "r.words.place", "r.words.value").toPandas(), toxic / total)  # features alone; the texts stay on the executors
        aside = learn.filter("fold = 1").select("id", _scores(spark, fitted)(F.col("text")).alias("s"))
        confirmed = known.filter("label = 1 and fold = 1").select("id", F.lit(1).alias("y"))
        bins = aside.join(confirmed, "id", "left").groupBy(F.floor(F.greatest(F.least("s", F.lit(FURTHEST)), F.lit(-FURTHEST)) * STEPS).alias("bin"))
        fitted = _levelled(fitted, bins.agg(F.count("*").alias("n"), F.count("y").alias("positive")).toPandas())  # at most 2 * FURTHEST * STEPS + 1 rows
    score = F.lit(1.0) / (1 + F.exp(-F.greatest(F.least(_scores(spark, fitted)(text), F.lit(30.0)), F.lit(-30.0))))
    scored = docs.select(ident, F.coalesce(fold(ident) == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scores(spark: SparkSession, fitted: tuple[np.ndarray, float]) -> Callable[[Column], Column]:
    model = spark.sparkContext.broadcast((fitted[0].astype(np.float32), fitted[1]))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, offset = model.value
        words = WordScores(weights) if len(weights) > 1 else None
        for texts in batches:
            yield pd.Series([offset + (words.of(t) if words is not None else 0.0) for t in texts], dtype=float)

    return scores
