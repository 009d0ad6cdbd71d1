"""Exact classification metrics of many (target, model, fold) groups in one job.

Rows are first collapsed to one row per group and distinct score, map-side. Running counts along the score then come
from bucket totals, so a group of any size is ranked in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.functions.scalars import DECISION_LIMIT, ratio, ratio_or_zero
from screenspark.operators.ranking import running_sums, value_buckets


def _score_counts(scored: DataFrame, by: Sequence[str], label: str, probability: str) -> DataFrame:
    """Positives and negatives per distinct score, with running and total counts."""
    known = scored.where(F.col(label).isNotNull() & F.col(probability).isNotNull()).select(
        *by, F.col(label).alias("_label"), F.col(probability).cast("double").alias("score")
    )
    collapsed = known.groupBy(*by, "score").agg(
        F.count_if(F.col("_label") == 1).alias("pos"), F.count_if(F.col("_label") != 1).alias("neg")
    )
    bucketed = value_buckets(collapsed, "score", bounds_from=known)
    return running_sums(bucketed, by, [F.col("score")], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})


def _hits_above() -> tuple[Column, Column]:
    """True and false positives when everything at or above the score counts as positive."""
    return (
        F.col("pos_upto_all") - F.col("pos_upto") + F.col("pos"),
        F.col("neg_upto_all") - F.col("neg_upto") + F.col("neg"),
    )


def confusion_metrics() -> dict[str, Column]:
    """Rates from the columns tp, fp, fn, tn; a zero divisor gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall = ratio_or_zero(tp, tp + fn)
    specificity = ratio_or_zero(tn, tn + fp)
    return {
        "accuracy": ratio_or_zero(tp + tn, tp + fp + fn + tn),
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": recall,
        "f1": ratio_or_zero(tp * 2, tp * 2 + fp + fn),
        "sensitivity": recall,
        "specificity": specificity,
        "balanced_accuracy": (recall + specificity) / 2,
        "n": tp + fp + fn + tn,
        "n_positive": tp + fn,
        "n_negative": tn + fp,
    }


METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall", "accuracy", "balanced_accuracy")


def evaluate(
    scored: DataFrame,
    by: Sequence[str],
    label: str = "label",
    probability: str = "probability",
    limit: float = DECISION_LIMIT,
) -> DataFrame:
    """ROC-AUC (ties count half), average precision, confusion counts and rates per group.

    The areas are NULL where a group has one class only.
    """
    counts = _score_counts(scored, by, label, probability)
    tp_above, fp_above = _hits_above()
    called = F.col("score") > F.lit(limit)
    # Products of counts pass the range of whole numbers in groups of some billion rows.
    pos = F.col("pos").cast("double")
    pairs = pos * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2)
    steps = pos * tp_above / (tp_above + fp_above)
    summed = counts.groupBy(*by).agg(
        F.sum(pairs).alias("_pairs"),
        F.sum(steps).alias("_steps"),
        F.max("pos_upto_all").alias("_p"),
        F.max("neg_upto_all").alias("_n"),
        F.coalesce(F.sum(F.when(called, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(called, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~called, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~called, F.col("neg"))), F.lit(0)).alias("tn"),
    )
    one_class = (F.col("_p") == 0) | (F.col("_n") == 0)
    return summed.select(
        *by,
        ratio(F.col("_pairs"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.when(~one_class, ratio(F.col("_steps"), F.col("_p"))).alias("pr_auc"),
        "tp",
        "fp",
        "fn",
        "tn",
        *[c.alias(name) for name, c in confusion_metrics().items()],
    )


def curve_points(
    scored: DataFrame, by: Sequence[str], label: str = "label", probability: str = "probability"
) -> DataFrame:
    """One ROC and precision-recall point per group and distinct score, taking scores at or above it as positive."""
    counts = _score_counts(scored, by, label, probability)
    tp_above, fp_above = _hits_above()
    return counts.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(fp_above, F.col("neg_upto_all")).alias("fpr"),
        ratio(tp_above, F.col("pos_upto_all")).alias("tpr"),
        ratio(tp_above, tp_above + fp_above).alias("precision"),
        ratio(tp_above, F.col("pos_upto_all")).alias("recall"),
    )


def metric_rows(metrics: DataFrame, by: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """``(by..., metric, value)``."""
    wide = metrics.select(*by, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(list(by), list(names), "metric", "value")


def fold_summary(rows: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return rows.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_folds")
    )
