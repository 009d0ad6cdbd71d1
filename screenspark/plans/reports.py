"""Comparison, summary and prediction reports over long result tables.

``results`` is the fold table ``(target, model, fold, metric, value)``; ``summary`` its mean and deviation per
``(target, model, metric)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.scalars import confidence, decision_class, mean_spread_text
from screenspark.operators.metrics import METRICS
from screenspark.operators.predictions import by_target, entity_profile


def wide_summary(summary: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    """One row per target and model with ``<metric>_mean`` and ``<metric>_std`` columns."""
    return (
        summary.groupBy(*by)
        .pivot("metric", list(METRICS))
        .agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    )


def model_comparison(summary: DataFrame, order: bool = True) -> DataFrame:
    """``mean ± std`` texts per target and model, best mean ROC-AUC first."""
    wide = wide_summary(summary)
    shown = ("roc_auc", "pr_auc", "f1", "precision", "recall", "balanced_accuracy")
    out = wide.select(
        "target",
        "model",
        *[mean_spread_text(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in shown],
        "roc_auc_mean",
        "pr_auc_mean",
    )
    return out.orderBy("target", F.col("roc_auc_mean").desc_nulls_last(), "model") if order else out


def best_models(summary: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The model with the best mean of the metric per target; equal means go to the first name."""
    ranked = summary.where((F.col("metric") == metric) & F.col("mean").isNotNull())
    best = ranked.groupBy("target").agg(
        F.min_by("model", F.struct((-F.col("mean")).alias("m"), F.col("model"))).alias("model")
    )
    return best


def target_overview(summary: DataFrame, order: bool = True) -> DataFrame:
    """Best model of every target with its metrics as text and number."""
    wide = wide_summary(summary).join(best_models(summary), ["target", "model"], "left_semi")
    out = wide.select(
        "target",
        F.col("model").alias("best_model"),
        *[mean_spread_text(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in ("roc_auc", "pr_auc", "f1")],
        "roc_auc_mean",
        "pr_auc_mean",
    )
    return out.orderBy(F.col("roc_auc_mean").desc_nulls_last(), "target") if order else out


def average_of_best(summary: DataFrame) -> DataFrame:
    """Average of the best mean ROC-AUC over targets."""
    return target_overview(summary, order=False).agg(
        F.count(F.lit(1)).alias("n_targets"), F.avg("roc_auc_mean").alias("average_roc_auc")
    )


def performance(summary: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """All mean metrics of the best model per target. A target without results simply has no row."""
    wide = wide_summary(summary).join(best_models(summary), ["target", "model"], "left_semi")
    if targets is not None:
        wide = wide.where(F.col("target").isin(*targets))
    names = ("roc_auc", "pr_auc", "f1", "precision", "recall", "balanced_accuracy")
    return wide.select(
        "target", F.col("model").alias("best_model"), *[F.col(f"{m}_mean").alias(m) for m in names]
    )


def metric_over_targets(summary: DataFrame, by: str = "model") -> DataFrame:
    """Mean and sample deviation of each metric over targets (or over models, by target)."""
    return summary.groupBy(by, "metric").agg(
        F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"), F.count("mean").alias("n")
    )


def evaluation_report(metrics: DataFrame, k: int = 3) -> DataFrame:
    """Overall mean ± deviation, the k best and k worst targets, and the full table, as one long table.

    One row per target is all this sees, so the two global ranks are over a handful of rows.
    """
    overall = metrics.agg(
        *[F.avg(m).alias(f"{m}_mean") for m in ("roc_auc", "pr_auc", "f1")],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in ("roc_auc", "pr_auc", "f1")],
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("overall").alias("section"),
                        F.lit(m).alias("target"),
                        F.lit(0).alias("place"),
                        F.col(f"{m}_mean").alias("roc_auc"),
                        F.col(f"{m}_std").alias("pr_auc"),
                        mean_spread_text(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias("text"),
                    )
                    for m in ("roc_auc", "pr_auc", "f1")
                ]
            )
        )
    )

    def line(names: Sequence[str]) -> list:
        return [x for n in names for x in (F.lit(f"{n}="), F.format_string("%.3f", F.col(n)), F.lit(" "))][:-1]

    def ranked(section: str, best: bool) -> DataFrame:
        first = F.col("roc_auc").desc_nulls_last() if best else F.col("roc_auc").asc_nulls_last()
        place = F.row_number().over(Window.orderBy(first, "target"))
        return (
            metrics.withColumn("place", place)
            .where(F.col("place") <= k)
            .select(
                F.lit(section).alias("section"),
                "target",
                "place",
                "roc_auc",
                "pr_auc",
                F.concat(*line(["roc_auc", "pr_auc"])).alias("text"),
            )
        )

    full = metrics.select(
        F.lit("table").alias("section"),
        "target",
        F.lit(0).alias("place"),
        "roc_auc",
        "pr_auc",
        F.concat(*line(["roc_auc", "pr_auc", "f1", "balanced_accuracy"])).alias("text"),
    )
    return (
        overall.unionByName(ranked("best", True)).unionByName(ranked("worst", False)).unionByName(full)
    )


def prediction_report(predictions: DataFrame, id_column: str, order: bool = True) -> DataFrame:
    """Decision, class text and confidence per entity and target, most probable first."""
    out = predictions.select(
        id_column,
        "target",
        "probability",
        "prediction",
        decision_class("prediction").alias("toxicity_class"),
        confidence("probability").alias("confidence"),
    )
    return out.orderBy(F.col("probability").desc(), id_column, "target") if order else out


def export_rows(summary: DataFrame, feature_counts: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """One JSON text per target: best model, its mean metrics, number of selected features, training time."""
    overview = performance(summary).join(feature_counts, "target", "left")
    if seconds is not None:
        overview = overview.join(seconds, "target", "left")
    else:
        overview = overview.withColumn("training_time", F.lit(None).cast("double"))
    metrics = [F.col(m) for m in ("roc_auc", "pr_auc", "f1", "precision", "recall", "balanced_accuracy")]
    document = F.struct(
        F.col("target").alias("target_name"),
        F.col("best_model").alias("best_model_name"),
        F.struct(*metrics).alias("performance_metrics"),
        F.col("n_features").alias("selected_features_count"),
        F.col("training_time"),
    )
    return overview.select("target", F.to_json(document).alias("document"))


def profile_report(wide: DataFrame, id_column: str, targets: Sequence[str], k: int = 3) -> DataFrame:
    """Class counts, overall class, status and the k most probable targets per entity, all within the row."""
    ordered = F.array_sort(
        F.transform(by_target(targets), lambda e: F.struct((-e["p"]).alias("p"), e["target"].alias("target")))
    )
    tops = F.array_join(F.transform(F.slice(ordered, 1, k), lambda e: e["target"]), ", ")
    profile = entity_profile(wide.withColumn("top_targets", tops), id_column, targets, ["top_targets"])
    return profile.select(id_column, "n_toxic", "n_moderate", "n_low", "overall", "status", "top_targets")
