"""Logistic models of many targets and folds, fitted together.

One pass over the rows gives losses and gradients of all models at once: a batch of rows is multiplied by one matrix whose
columns are the models, an unknown label or a row of the model's own fold counts nothing, and the sums of tasks are added
by feature. Every model has its own L-BFGS steps on the driver; a pass moves each to its next trial point. So the number of
passes is that of the slowest model, not the sum over targets and folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from screenspark.operators.prep import doubles, fit_moments
from screenspark.session import materialise

#: Passes over the rows at most, and steps that are remembered.
PASSES, MEMORY = 300, 10


@dataclass(frozen=True)
class ManyLogistic:
    """Per model: target, the fold it leaves out (NULL: none), coefficients and intercept; and the passes of the fit."""

    models: list[tuple[str, int | None]]
    coefficients: np.ndarray
    intercepts: np.ndarray
    passes: int

    def of(self, target: str, fold: int | None = None) -> tuple[np.ndarray, float]:
        k = self.models.index((target, fold))
        return self.coefficients[k], float(self.intercepts[k])

    def score(self, df: DataFrame, features: str, id_column: str, fold: str | None = None) -> DataFrame:
        """``(id, target, probability)``; with ``fold``, by the models that left the row's fold out."""
        targets = list(dict.fromkeys(t for t, _ in self.models))
        place = {m: k for k, m in enumerate(self.models)}
        weights, intercepts = self.coefficients, self.intercepts

        @pandas_udf("array<double>")
        def chances(x: pd.Series, f: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            every = 1 / (1 + np.exp(-(np.stack(x.to_list()) @ weights.T + intercepts)))
            own = [[place.get((t, None if pd.isna(k) else int(k)), place[t, None]) for t in targets] for k in f]
            return pd.Series(list(np.take_along_axis(every, np.array(own), axis=1)))

        left_out = F.col(fold).cast("int") if fold else F.lit(None).cast("int")
        rows = df.where(F.col(features).isNotNull()).select(id_column, chances(doubles(features), left_out).alias("_p"))
        names = F.array(*[F.lit(t) for t in targets])
        return rows.select(id_column, F.inline(F.arrays_zip(names.alias("target"), F.col("_p").alias("probability"))))


class _Steps:
    """L-BFGS with halved steps for one model."""

    def __init__(self, width: int) -> None:
        self.at, self.trial = np.zeros(width), np.zeros(width)
        self.loss, self.gradient = np.inf, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.length, self.done = np.zeros(width), 1.0, False

    def told(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        """Loss and gradient at the trial point."""
        if self.done:
            return
        if self.gradient is not None:
            slope = float(self.gradient @ self.direction)
            if loss > self.loss + 1e-4 * self.length * slope and self.length > 1e-10:
                self.length /= 2
                self.trial = self.at + self.length * self.direction
                return
            step, change = self.trial - self.at, gradient - self.gradient
            if step @ change > 1e-12 * (change @ change):
                self.pairs = [*self.pairs, (step, change)][-MEMORY:]
        self.at, self.loss, self.gradient = self.trial, loss, gradient
        self.done = np.abs(gradient).max() <= tolerance or self.length <= 1e-10
        d, kept = -gradient, []
        for step, change in reversed(self.pairs):
            a = (step @ d) / (step @ change)
            d = d - a * change
            kept.append(a)
        if self.pairs:
            step, change = self.pairs[-1]
            d = d * (step @ change) / (change @ change)
        for (step, change), a in zip(self.pairs, reversed(kept)):
            d = d + (a - (change @ d) / (step @ change)) * step
        self.direction = d
        self.length = 1.0 if self.pairs else 1.0 / max(1.0, np.abs(gradient).sum())
        self.trial = self.at + self.length * d


def fit_many(
    df: DataFrame, features: str, targets: Sequence[str], fold: str | None = None, inverse_penalty: float = 1.0, tolerance: float = 1e-6
) -> ManyLogistic:
    """A model per target (a column of 0, 1 and NULL) over its known rows, and one more per target and fold without that fold.

    Classes have balanced weights n / (2 n_c). Minimised is the weighted log-loss plus |w|^2 / (2 inverse_penalty), intercepts
    free, until no part of a gradient is above ``tolerance`` times the rows. Rows without features are left out; a row without a fold is in
    all training parts. A model whose rows are of one class is an error.
    """
    known = df.where(F.col(features).isNotNull())
    labels = F.array(*[F.coalesce(F.col(t).cast("int"), F.lit(-1)) for t in targets])
    of_fold = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    rows = materialise(known.select(doubles(features).alias("x"), labels.alias("y"), of_fold.alias("f")))
    counted = rows.groupBy("f").agg(*[F.count_if(F.get("y", F.lit(k)) == c).alias(f"n{k}_{c}") for k in range(len(targets)) for c in (0, 1)]).collect()
    folds = sorted(r["f"] for r in counted if r["f"] >= 0)
    models = [(t, f) for t in targets for f in [None, *folds]]
    sizes = np.array([[sum(r[f"n{targets.index(t)}_{c}"] for r in counted if r["f"] != f) for c in (0, 1)] for t, f in models], float)
    if (sizes == 0).any():
        raise ValueError(f"one class only: {[m for m, s in zip(models, sizes) if not s.all()]}")
    weight = sizes.sum(axis=1, keepdims=True) / (2 * sizes)
    which = np.array([targets.index(t) for t, _ in models])
    left_out = np.array([-2 if f is None else f for _, f in models])
    moments = fit_moments(rows, "x")
    mean, scale = np.array(moments.mean), np.array(moments.scale)
    width = len(mean)

    def sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses, and gradients (models x (width + 1)), without the penalty."""

        def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, some = np.zeros((width + 2, len(points))), False
            for frame in frames:
                if not len(frame):
                    continue
                some = True
                x = (np.stack(frame["x"].to_list()) - mean) / scale
                label = np.stack(frame["y"].to_list())[:, which]
                counts = np.where(label == 1, weight[:, 1], weight[:, 0]) * (label >= 0) * (frame["f"].to_numpy()[:, None] != left_out)
                margin = x @ points[:, :width].T + points[:, width]
                off = counts * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - (label == 1))
                total[:width] += x.T @ off
                total[width] += off.sum(axis=0)
                total[width + 1] += (counts * (np.logaddexp(0, margin) - (label == 1) * margin)).sum(axis=0)
            if some:
                yield pd.DataFrame({"place": np.arange(width + 2), "v": list(total)})

        parts = rows.mapInPandas(of_frames, "place int, v array<double>").groupBy("place").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        out = np.zeros((width + 2, len(points)))
        for r in parts.select("place", vector_to_array("v").alias("v")).collect():  # (width + 2) x models numbers
            out[r["place"]] = r["v"]
        return out[width + 1], out[: width + 1].T

    steps = [_Steps(width + 1) for _ in models]
    penalty = np.append(1 / (inverse_penalty * scale**2), 0.0)
    passes = 0
    while passes < PASSES and not all(s.done for s in steps):
        trial = np.array([s.trial for s in steps])
        losses, gradients = sums(trial)
        passes += 1
        for k, s in enumerate(steps):
            s.told(losses[k] + 0.5 * float(penalty @ trial[k] ** 2), gradients[k] + penalty * trial[k], tolerance * sizes[k].sum())
    points = np.array([s.at for s in steps])
    coefficients = points[:, :width] / scale
    return ManyLogistic(models, coefficients, points[:, width] - coefficients @ mean, passes)
