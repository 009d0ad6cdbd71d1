"""Class weights, imputation, variance filter and scaling of feature arrays.

Each fit is one aggregate whose result, a few numbers per feature, becomes literals of the transform; no join with
statistics and no pass over wide columns. Feature matrices stay one ``ARRAY<DOUBLE>`` column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.scalars import finite_or_null
from screenspark.operators.joins import join_small
from screenspark.operators.ranking import exact_quantiles


def class_weights(labels: DataFrame, by: Sequence[str] = ("target",), label: str = "label") -> DataFrame:
    """Balanced weight n / (classes x class size) per group and class; 1 where there is only one class."""
    counts = labels.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)  # a few class rows per group
    classes = F.count(F.lit(1)).over(group)
    balanced = F.sum("_n").over(group) / (classes * F.col("_n"))
    return counts.select(
        *by, label, F.when(classes == 1, F.lit(1.0)).otherwise(balanced).alias("weight")
    )


def with_weights(labels: DataFrame, by: Sequence[str] = ("target",), label: str = "label") -> DataFrame:
    """Label rows with their class weight. Two rows per target on the small side."""
    return join_small(labels, class_weights(labels, by, label), [*by, label])


def doubles(features: str) -> Column:
    return F.col(features).cast("array<double>")


def numbers(values: Sequence[float]) -> Column:
    """An array of these numbers. It is one expression, as every column object costs several calls to the JVM."""
    return F.expr(f"array({', '.join(f'{v!r}D' if math.isfinite(v) else f'double({str(v)!r})' for v in map(float, values))})")


def long_features(df: DataFrame, keep: Sequence[str], features: str) -> DataFrame:
    """``(keep..., idx, value)`` with NaN and infinities as NULL."""
    return df.select(*keep, F.posexplode(doubles(features)).alias("idx", "_raw")).select(
        *keep, "idx", finite_or_null("_raw").alias("value")
    )


def width_of(df: DataFrame, features: str) -> int:
    first = df.select(F.size(features).alias("n")).first()
    return first["n"] if first else 0


def fit_medians(df: DataFrame, features: str) -> list[float]:
    """Exact median of the finite values of every feature; 0 where there are none."""
    medians = exact_quantiles(long_features(df, [], features), ["idx"], "value", {"median": 0.5})
    found = {r["idx"]: r["median"] for r in medians.collect()}
    return [found.get(i, 0.0) for i in range(width_of(df, features))]


def fill_missing(df: DataFrame, features: str, fill: Sequence[float]) -> DataFrame:
    """Missing and infinite cells take the fitted value of their feature."""
    filled = F.zip_with(doubles(features), numbers(fill), lambda x, m: F.coalesce(finite_or_null(x), m))
    return df.withColumn(features, filled)


@dataclass(frozen=True)
class Moments:
    count: int
    mean: list[float]
    variance: list[float]  # population

    @property
    def scale(self) -> list[float]:
        """Population deviation; 1 for a constant feature."""
        return [math.sqrt(v) if v > 0 else 1.0 for v in self.variance]


def _moments_row(df: DataFrame, features: str, by: Sequence[str]) -> DataFrame:
    vectors = df.where(F.col(features).isNotNull()).select(*by, array_to_vector(doubles(features)).alias("_v"))
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("_s")
    out = vectors.groupBy(*by).agg(summary) if by else vectors.agg(summary)
    n = F.col("_s.count")
    # The summarizer divides by n - 1.
    population = F.transform(vector_to_array(F.col("_s.variance")), lambda v: v * (n - 1) / n)
    return out.select(*by, n.alias("n"), vector_to_array(F.col("_s.mean")).alias("mean"), population.alias("variance"))


def fit_moments(df: DataFrame, features: str) -> Moments:
    row = _moments_row(df, features, []).first()
    return Moments(row["n"], list(row["mean"]), list(row["variance"]))


def fit_fold_moments(df: DataFrame, features: str, fold: str) -> dict[int, Moments]:
    """Moments of the training side (all other folds) of every fold, from one pass.

    Folds are summarised once; each training side is the merge of the other folds' counts, means and variances.
    """
    rows = {r[fold]: r for r in _moments_row(df, features, [fold]).collect()}
    merged = {}
    for left_out in rows:
        parts = [r for f, r in rows.items() if f != left_out]
        n = sum(r["n"] for r in parts)
        means, variances = [], []
        for i in range(len(rows[left_out]["mean"])):
            mean = sum(r["n"] * r["mean"][i] for r in parts) / n
            spread = sum(r["n"] * (r["variance"][i] + (r["mean"][i] - mean) ** 2) for r in parts) / n
            means.append(mean)
            variances.append(spread)
        merged[left_out] = Moments(n, means, variances)
    return merged


def standardise(df: DataFrame, features: str, moments: Moments) -> DataFrame:
    """Subtract the mean, divide by the population deviation."""
    centred = F.zip_with(doubles(features), numbers(moments.mean), lambda x, m: x - m)
    return df.withColumn(features, F.zip_with(centred, numbers(moments.scale), lambda x, s: x / s))


def standardise_by_fold(df: DataFrame, features: str, fold: str, moments: dict[int, Moments]) -> DataFrame:
    """Scale every row with the training statistics of the fold it is tested in."""
    folds = sorted(moments)
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)).cast("int")
    means = F.element_at(F.array(*[numbers(moments[f].mean) for f in folds]), place)
    scales = F.element_at(F.array(*[numbers(moments[f].scale) for f in folds]), place)
    centred = F.zip_with(doubles(features), means, lambda x, m: x - m)
    return df.withColumn(features, F.zip_with(centred, scales, lambda x, s: x / s))


def variable_features(moments: Moments, threshold: float = 0.01) -> list[int]:
    """Places of the features whose population variance exceeds the threshold."""
    return [i for i, v in enumerate(moments.variance) if v > threshold]


def pick_features(df: DataFrame, features: str, places: Sequence[int]) -> DataFrame:
    """Keep the features at the given places, in that order. Names are picked by the same places."""
    wanted = F.expr(f"cast(array({', '.join(map(str, places))}) AS array<int>)")
    values = doubles(features)
    return df.withColumn(features, F.transform(wanted, lambda i: F.get(values, i)))


@dataclass(frozen=True)
class RobustScale:
    centre: list[float]
    scale: list[float]


def fit_robust(df: DataFrame, features: str) -> RobustScale:
    """Median and distance between the quartiles of every feature; a zero distance counts as 1."""
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = exact_quantiles(long_features(df, [], features), ["idx"], "value", wanted)
    rows = {r["idx"]: r for r in quartiles.collect()}
    width = width_of(df, features)
    centre = [rows[i]["median"] if i in rows else 0.0 for i in range(width)]
    spread = [rows[i]["q3"] - rows[i]["q1"] if i in rows else 0.0 for i in range(width)]
    return RobustScale(centre, [s if s > 0 else 1.0 for s in spread])


def robust_scale(df: DataFrame, features: str, fitted: RobustScale) -> DataFrame:
    centred = F.zip_with(doubles(features), numbers(fitted.centre), lambda x, m: x - m)
    return df.withColumn(features, F.zip_with(centred, numbers(fitted.scale), lambda x, s: x / s))
