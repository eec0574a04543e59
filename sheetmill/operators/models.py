"""Pluggable predictors over crops: any callable from a batch of features to class scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import relabel_by_rank

BATCH = 256


def linear_scorer(weights: Sequence[float], bias: float) -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in for a trained network: logistic in the features; scores of (blank, filled)."""

    def score(x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(x @ np.asarray(weights) + bias)))
        return np.stack([1 - p, p], axis=1)

    return score


def score_batches(features: Sequence[str], make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = BATCH) -> Column:
    """Class scores as an array; the model is made once a worker and fed fixed batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(*columns: pd.Series) -> pd.Series:
        if not hasattr(run_state, "model"):
            run_state.model = make()
        x = np.stack([c.to_numpy(float) for c in columns], axis=1)
        parts = [run_state.model(x[a : a + batch]) for a in range(0, len(x), batch)]
        return pd.Series(list(np.concatenate(parts))) if parts else pd.Series([], dtype=object)

    class run_state:  # noqa: N801
        pass

    return run(*[F.col(c) for c in features])


def prediction(scores: Column, classes: Sequence[str], filled_threshold: float = 0.5) -> dict[str, Column]:
    """Label and confidence: by the threshold where blank and filled are classes, else the best class."""
    if not 0 <= filled_threshold <= 1:
        raise ValueError("filled_threshold lies in [0, 1]")
    best = F.array_position(scores, F.array_max(scores))
    names = F.array(*[F.lit(c) for c in classes])
    out = {"argmax_label": F.element_at(names, best.cast("int")), "argmax_confidence": F.round(F.array_max(scores), 6)}
    at = lambda c: F.element_at(scores, classes.index(c) + 1) if c in classes else F.lit(None).cast("double")
    filled, blank = at("filled"), at("blank")
    if {"blank", "filled"} <= set(classes):
        is_filled = filled >= filled_threshold
        out |= {"pred_label": F.when(is_filled, "filled").otherwise("blank"), "pred_confidence": F.round(F.when(is_filled, filled).otherwise(blank), 6)}
    else:
        out |= {"pred_label": out["argmax_label"], "pred_confidence": out["argmax_confidence"]}
    return out | {"filled_probability": F.round(filled, 6), "blank_probability": F.round(blank, 6), "filled_threshold": F.lit(float(filled_threshold))}


def classify_bubbles(bubbles: DataFrame, features: Sequence[str], make, *, filled_threshold: float = 0.90, margin_threshold: float = 0.10, batch: int = BATCH) -> DataFrame:
    """Bubbles labelled by a model's rounded probabilities, ranked within their item."""
    scored = bubbles.withColumn("_scores", score_batches(features, make, batch))
    found = prediction(F.col("_scores"), ["blank", "filled"], filled_threshold)
    columns = {
        "filled_probability": found["filled_probability"],
        "blank_probability": found["blank_probability"],
        "model_label": found["pred_label"],
        "model_confidence": found["pred_confidence"],
        "prelabel_source": F.lit("bubble_classifier_group"),
    }
    labelled = scored.withColumns(columns).drop("_scores")
    return relabel_by_rank(labelled, score="filled_probability", filled_threshold=filled_threshold, margin_threshold=margin_threshold)


def predict_rows(rows: DataFrame, features: Sequence[str], make, classes: Sequence[str] = ("blank", "filled"), *, filled_threshold: float = 0.5, batch: int = BATCH) -> DataFrame:
    """Each row of a manifest with the prediction for it, whose columns replace those of the same name."""
    scored = rows.withColumn("_scores", score_batches(features, make, batch))
    return scored.withColumns(prediction(F.col("_scores"), classes, filled_threshold)).drop("_scores")
