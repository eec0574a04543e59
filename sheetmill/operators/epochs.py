"""Training epochs of a classifier's last layer: softmax regression by AdamW, each step one aggregate.

Gradients, losses and hits are sums of built-in expressions over the rows, added up map-side, so that one row a
step comes to the driver and nothing grows with the rows but the scan.  Meant for some tens of features: there
is a sum for each class and feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import computed_once
from .pictures import draw


@dataclass
class AdamW:
    """Adam with decoupled weight decay."""

    decay: float = 0.01
    fast: float = 0.9
    slow: float = 0.999
    room: float = 1e-8
    steps: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def moved(self, x: np.ndarray, slope: np.ndarray, rate: float) -> np.ndarray:
        self.steps += 1
        self.mean = self.fast * self.mean + (1 - self.fast) * slope
        self.square = self.slow * self.square + (1 - self.slow) * slope * slope
        mean, square = self.mean / (1 - self.fast**self.steps), self.square / (1 - self.slow**self.steps)
        return x * (1 - rate * self.decay) - rate * mean / (np.sqrt(square) + self.room)


def cosine_rate(epoch: int, epochs: int, rate: float, least: float) -> float:
    """The rate of an epoch (the first is 1): half a cosine from ``rate`` down towards ``least``."""
    return least + (rate - least) * (1 + math.cos(math.pi * (epoch - 1) / epochs)) / 2


def _plus(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


def step_sums(rows: DataFrame, weights: np.ndarray, features: Sequence[str], classes: Sequence[str], target: str, weight: str) -> dict:
    """``slope`` (classes x (features + 1), the intercept last), ``loss``, ``weight``, ``right`` and ``n`` at ``weights``,
    all but the last two weighted sums.  A tie goes to the class named first."""
    inputs = [F.col(f) for f in features] + [F.lit(1.0)]
    logits = [_plus([F.lit(float(w)) * x for w, x in zip(line, inputs, strict=True)]) for line in weights]
    rows = rows.select(target, weight, *features, *[z.alias(f"_z{k}") for k, z in enumerate(logits)])
    top = F.greatest(*[F.col(f"_z{k}") for k in range(len(classes))])
    rows = rows.withColumn("_top", top)
    rows = rows.withColumn("_all", _plus([F.exp(F.col(f"_z{k}") - F.col("_top")) for k in range(len(classes))]))
    own = F.coalesce(*[F.when(F.col(target) == c, F.col(f"_z{k}")) for k, c in enumerate(classes)])
    best = F.coalesce(*[F.when(F.col(f"_z{k}") == F.col("_top"), F.lit(c)) for k, c in enumerate(classes)])
    off = [F.col(weight) * (F.exp(F.col(f"_z{k}") - F.col("_top")) / F.col("_all") - F.when(F.col(target) == c, 1.0).otherwise(0.0)) for k, c in enumerate(classes)]
    slopes = [F.sum(o * x) for o in off for x in inputs]
    loss = F.sum(F.col(weight) * (F.log("_all") + F.col("_top") - own))
    got = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(slopes)], loss.alias("loss"), F.sum(weight).alias("weight"), F.sum((best == F.col(target)).cast("long")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    return {"slope": np.array([got[i] or 0.0 for i in range(len(slopes))]).reshape(weights.shape), "loss": got["loss"] or 0.0, "weight": got["weight"] or 0.0, "right": got["right"] or 0, "n": got["n"]}


@dataclass
class Trained:
    """The weights of the best epoch (classes x (features + 1), the intercept last), and a row an epoch."""

    features: list[str]
    classes: list[str]
    weights: np.ndarray
    epoch: int
    history: list[dict] = field(default_factory=list)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """For ``models.score_batches``: class scores of a batch of features."""
        weights = self.weights

        def score(x: np.ndarray) -> np.ndarray:
            z = x @ weights[:, :-1].T + weights[:, -1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            return z / z.sum(axis=1, keepdims=True)

        return score


def train(
    rows: DataFrame, features: Sequence[str], classes: Sequence[str], *, target: str = "gt_label", weight: str = "weight", split: str = "split", key: str = "image_id",
    epochs: int = 20, steps: int = 1, rate: float = 1e-3, least_rate: float = 0.0, decay: float = 0.01, seed: int = 20260619,
) -> Trained:
    """Fits on the rows of split ``train`` and judges each epoch on ``val``: the earliest epoch of the highest accuracy
    there (or on ``train``, if there is no ``val``) gives the weights.

    Rows without a class of ``classes``, a positive weight or a finite number in each feature teach nothing.  An epoch
    deals its rows to ``steps`` batches by a hash of seed, epoch and key, whatever the partitions.  A row's weight is its
    sampling weight: losses and slopes are weighted means.  The rows' numbers are written once to the shared folder and
    read again in each step, so a lost executor costs one step's tasks.  Without rows of split ``train``: an error."""
    whole = [F.col(f).cast("double").alias(f) for f in features]
    good = F.col(target).isin(*classes) & (F.col(weight) > 0)
    for f in features:
        good = good & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < float("inf"))
    kept = rows.where(good & F.col(split).isin("train", "val"))
    stored = computed_once(kept.select(F.col(key).cast("string").alias("_key"), target, F.col(weight).cast("double").alias(weight), split, *whole))
    taught, judged = stored.where(F.col(split) == "train"), stored.where(F.col(split) == "val")
    sums = lambda part, at: step_sums(part, at, features, classes, target, weight)
    mean = lambda got, name, of: round(got[name] / got[of], 9) if got[of] else None
    x = np.zeros((len(classes), len(features) + 1))
    optimizer, history, best = AdamW(decay), [], None
    for epoch in range(1, epochs + 1):
        now, seen = cosine_rate(epoch, epochs, rate, least_rate), {"loss": 0.0, "weight": 0.0, "right": 0, "n": 0}
        place = F.floor(draw(F.lit(f"{seed}:{epoch}"), F.col("_key")) * steps)
        for step in range(steps):
            got = sums(taught.where(place == step) if steps > 1 else taught, x)
            if not got["n"]:
                continue
            seen = {name: seen[name] + got[name] for name in seen}
            x = optimizer.moved(x, got["slope"] / got["weight"], now)
        if not seen["n"]:
            raise ValueError("there are no rows to train on")
        held = sums(judged, x)
        row = {"epoch": epoch, "rate": now, "train_loss": mean(seen, "loss", "weight"), "train_accuracy": mean(seen, "right", "n"), "val_loss": mean(held, "loss", "weight"), "val_accuracy": mean(held, "right", "n")}
        history.append(row)
        score = row["train_accuracy"] if row["val_accuracy"] is None else row["val_accuracy"]
        if best is None or score > best[0]:
            best = (score, epoch, x)
    return Trained([*features], [*classes], best[2], best[1], history)
