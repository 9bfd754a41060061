"""Quality classifier by co-training of two views: the words of a text, and its page metadata.

The metadata are the source, the language and the declared length; nothing of it is taken from the text. Each view is fitted on labelled documents; over some rounds it labels a pool of others and hands those it is most confident of to
the other view. Both views are calibrated on labelled documents that neither was fitted on, and combined there.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lightsieve.llm.textmodel import Sparse, WordScores, bounded_sample, fit_linear, fold, sigmoid, sparse_features, sparse_rows

MOST_LABELLED = 2000
MOST_POOL = 1500
ROUNDS = 3
LENGTH_STEPS = 40  # two for each doubling
STEP_WEIGHT = 20
STEPS = 4  # bins a unit of a view's score, in which calibration counts its rows
FURTHEST = 40  # scores beyond are counted there


class OneKindOfLabel(ValueError):
    """Nothing tells documents apart."""

    def __init__(self):
        super().__init__("labels of both kinds are needed among the fitted rows and among those of fold 1")


_LETTERS_AND_SPACE = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum() or chr(c).isspace())
_CAPITALS = bytes(range(65, 91))
META_SIZE = 3 + LENGTH_STEPS + 64 + 16


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """The page's declared length, its log and step, and source and language by hash. The text has no part in it."""
    x = np.zeros(META_SIZE, np.float32)
    x[0] = 1.0
    if n_chars is None or np.isnan(n_chars):
        x[1] = 1.0
    else:
        declared = max(n_chars, 0)
        x[2] = np.log1p(declared) / 10
        x[3 + min(LENGTH_STEPS - 1, int(2 * np.log2(declared + 1)))] = 0.5
    x[3 + LENGTH_STEPS + zlib.crc32(f"s{source}".encode()) % 64] = 0.5
    x[67 + LENGTH_STEPS + zlib.crc32(f"l{lang}".encode()) % 16] = 0.5
    return x


def content(text: str) -> str:
    """The text with words of its own for how it repeats and looks: shares of words equal to the one before, of different words, of marks and of capitals."""
    words = text.split()
    if not words:
        return text
    n = len(words)
    doubled, different = sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n
    raw = text.encode()
    marks, capitals = len(raw.translate(None, _LETTERS_AND_SPACE)) / len(raw), (len(raw) - len(raw.translate(None, _CAPITALS))) / len(raw)
    steps = (f"\x01m{min(20, round(marks * 100))}", f"\x01c{min(20, round(capitals * 40))}", f"\x01d{min(9, round(doubled * 40))}", f"\x01v{round(different * 10)}l{int(np.log2(n))}", f"\x01v{round(different * 10)}", f"\x01w{min(20, round(len(text) / n))}")
    return f"{text} {' '.join(steps * STEP_WEIGHT)}"


def fit_meta(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by full gradient steps with momentum."""
    w, move = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        g = x.T @ (weight * (sigmoid(x @ w) - y)) / weight.sum() + decay * w
        move = 0.9 * move - rate * g
        w += move
    return w


def fit_words(rows, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    return fit_linear(rows, lambda s: weight * (sigmoid(s) - y) / weight.sum(), steps=80)


def co_train(rows: Sparse, meta: np.ndarray, y: np.ndarray, labelled: np.ndarray, rounds: int = ROUNDS, share: float = 0.1):
    """((word weights, offset), metadata weights). y counts where ``labelled``; all other rows are the pool."""
    truth = [np.where(labelled, y, 0.0), np.where(labelled, y, 0.0)]  # what each view learns from
    weight = [labelled.astype(float), labelled.astype(float)]
    positive = y[labelled].mean()
    words = metadata = None
    for round_no in range(rounds + 1):
        words = fit_words(rows, truth[0], weight[0])
        metadata = fit_meta(meta, truth[1], weight[1])
        if round_no == rounds:
            break
        scores = [rows.dot(words[0]) + words[1], meta @ metadata]
        for view in (0, 1):
            other = 1 - view
            free = np.flatnonzero(weight[other] == 0)
            take = int(share * len(free))
            order = free[np.argsort(scores[view][free], kind="stable")]
            low, high = order[: round(take * (1 - positive))], order[len(order) - round(take * positive) :]
            # only what the view itself is confident of goes over, at half the weight of a real label
            low, high = low[scores[view][low] < -1], high[scores[view][high] > 1]
            truth[other][low], truth[other][high] = 0.0, 1.0
            weight[other][low] = weight[other][high] = 0.5
    return words, metadata


def calibrate(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Platt scaling: (a, b) so that sigmoid(a * score + b) is a probability. n: how many rows each entry stands for."""
    x = np.stack([score, np.ones(len(score))], axis=1)
    scale = max(1.0, float(np.sqrt(np.average((np.abs(score) - np.average(np.abs(score), weights=n)) ** 2, weights=n))))
    a, b = fit_meta(x / [scale, 1.0], y, n, decay=1e-4)
    return float(a / scale), float(b)


@F.pandas_udf(BinaryType())
def _meta_column(lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
    return pd.Series([meta_features(*r).tobytes() for r in zip(_plain(lang), _plain(source), n_chars)], dtype=object)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", most_labelled: int = MOST_LABELLED, most_pool: int = MOST_POOL, row_col: str | None = None, one_kind: str = "raise") -> DataFrame:
    """(id_col, held_out, text_score, meta_score, score, keep), one row for each input row.

    Scores are probabilities of label 1; keep is score >= 0.5. The fit sees at most most_labelled labelled documents of
    folds 2 and up and most_pool others. Labels of fold 0 are held out, all those of fold 1 serve calibration alone.
    Null and empty texts are scored by their metadata and the words' offset, long ones whole; null metadata are values
    of their own. Without any label everything scores 1; labels of one kind alone, in the fitted folds or in fold 1,
    raise a ValueError, or with one_kind="keep" count as none. Null ids are never learned from; rows that repeat an id are scored one by one. An empty table
    gives no rows; other columns are ignored, whatever their names. With ``row_col`` the whole input row is given out,
    too, as a struct of that name.
    """
    spark = docs.sparkSession
    text, meta = F.coalesce(F.col(text_col), F.lit("")), (F.col(lang_col), F.col(source_col), F.col(chars_col).cast("double"))
    ident = F.col("id")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(ident.isNotNull() & F.col("label").isNotNull() & (fold(ident) != 0)).groupBy("id").agg(F.max("label").cast("double").alias("y"))
    picked = bounded_sample(known.filter(fold(ident) > 1), "id", most_labelled, "labelled")
    pool = bounded_sample(docs.select(F.col(id_col).alias("id")).filter(ident.isNotNull() & (fold(ident) != 0)).join(known, "id", "left_anti").distinct(), "id", most_pool, "pool")
    chosen = F.broadcast(picked.unionByName(pool.withColumn("y", F.lit(None).cast("double"))))  # bounded by the two limits
    learn = docs.select(F.col(id_col).alias("id"), text.alias("text"), meta[0].alias("lang"), meta[1].alias("source"), meta[2].alias("n_chars"))
    places = ("text", "lang", "source", "n_chars")
    # of rows that share a chosen id one is learned from, so what is fitted is bounded whatever ids repeat
    rows = learn.join(chosen, "id").select("id", "y", F.xxhash64(*places).alias("h"), sparse_features(F.col("text"), False, content).alias("words"), _meta_column(*map(F.col, places[1:])).alias("meta"))
    rows = rows.groupBy("id").agg(F.min(F.struct("h", "y", "words", "meta")).alias("r")).select("r.y", "r.words.place", "r.words.value", "r.meta")
    aside = learn.filter(fold(ident) == 1).join(known.filter(fold(ident) == 1), "id")
    raw = None
    try:
        fitted = _fit(rows.toPandas())  # features alone; the texts stay on the executors
        if fitted is None and not aside.isEmpty():
            raise OneKindOfLabel
        if fitted is not None:
            raw = _views(spark, fitted)
            bin_of = lambda view: F.floor(F.greatest(F.least(F.col(view), F.lit(FURTHEST)), F.lit(-FURTHEST)) * STEPS)
            bins = aside.select("y", raw(*map(F.col, places)).alias("v")).select("y", "v.*").groupBy("y", bin_of("words"), bin_of("meta"))
            # at most 2 * (2 * FURTHEST * STEPS + 1) ** 2 rows, of which scores fill few
            fitted = _calibrated(fitted, bins.agg(F.count("*").alias("n"), F.avg("words").alias("words"), F.avg("meta").alias("meta")).select("y", "n", "words", "meta").toPandas())
    except OneKindOfLabel:
        if one_kind != "keep":
            raise
        fitted = raw = None

    def probability(logit: Column) -> Column:
        return F.lit(1.0) / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))

    def scores(view: str) -> Column:
        if fitted is None:
            return F.struct(*(F.lit(1.0).alias(c) for c in ("text_score", "meta_score", "score")))
        logits = [F.lit(a) * F.col(f"{view}.{c}") + F.lit(b) for (a, b), c in zip(fitted["scale"], ("words", "meta"))]
        both = [float(x) for x in fitted["both"]]
        return F.struct(probability(logits[0]).alias("text_score"), probability(logits[1]).alias("meta_score"), probability(logits[0] * both[0] + logits[1] * both[1] + both[2]).alias("score"))

    whole = [F.struct("*").alias(row_col)] if row_col else []
    scored = docs.select(F.col(id_col), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), (raw(text, *meta) if raw else F.lit(None)).alias("v"), *whole)
    scored = scored.select(id_col, "held_out", scores("v").alias("s"), *([row_col] if row_col else []))
    return scored.select(id_col, "held_out", "s.*", *([row_col] if row_col else [])).withColumn("keep", F.col("score") >= 0.5)


def _views(spark: SparkSession, fitted: dict) -> Callable[..., Column]:
    """The raw scores of both views for (text, lang, source, n_chars)."""
    model = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf("struct<words:double,meta:double>")
    def views(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        fitted = model.value
        words = WordScores(fitted["words"], form=False)
        for texts, langs, sources, chars in batches:
            w = [fitted["offset"] + words.of(content(t)) for t in texts]
            m = [float(meta_features(*r) @ fitted["meta"]) for r in zip(_plain(langs), _plain(sources), chars)]
            yield pd.DataFrame({"words": w, "meta": m}, dtype=float)

    return views


def _plain(values: pd.Series) -> list:
    return [None if v is None or v != v else v for v in values]


def _fit(rows: pd.DataFrame) -> dict | None:
    """Both views' weights; None without any label."""
    y = rows["y"].to_numpy(float)
    labelled = ~np.isnan(y)
    if not labelled.any():
        return None
    if len(set(y[labelled])) < 2:
        raise OneKindOfLabel
    meta = np.stack([np.frombuffer(m, np.float32) for m in rows["meta"]])
    (weights, offset), metadata = co_train(sparse_rows(rows["place"].tolist(), rows["value"].tolist()), meta, y, labelled)
    return {"words": weights.astype(np.float32), "offset": offset, "meta": metadata}


def _calibrated(fitted: dict, bins: pd.DataFrame) -> dict:
    """The model with what makes probabilities of its views, alone and together. bins: (y, n, words, meta), n rows with mean scores."""
    y, n = bins["y"].to_numpy(float), bins["n"].to_numpy(float)
    if len(set(y)) < 2:
        raise OneKindOfLabel
    views = [bins[c].to_numpy(float) for c in ("words", "meta")]
    scale = [calibrate(v, y, n) for v in views]
    logits = np.stack([*(a * v + b for (a, b), v in zip(scale, views)), np.ones(len(y))], axis=1)
    return fitted | {"scale": scale, "both": fit_meta(np.clip(logits, -8, 8), y, n, rate=0.05)}
