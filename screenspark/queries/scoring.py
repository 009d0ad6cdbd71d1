"""Metrics, curves, fold tables and comparison reports over scored labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.functions.draws import draw32
from screenspark.operators import metrics as M
from screenspark.plans import reports as R
from screenspark.queries.fixtures import MODELS, PREDICTIONS, SCORED, predictions, scored, table
from screenspark.queries.profiling import rounded
from screenspark.queries.registry import query


def metrics_sql(source: str, keys: str, pick: str = "*") -> str:
    """The metrics of ``evaluate`` by plain windows; ``keys`` is a column list."""
    return f"""sc AS (SELECT {keys}, probability AS s, count(*) FILTER (label = 1) AS pos,
        count(*) FILTER (label <> 1) AS neg FROM {source} GROUP BY {keys}, probability),
      ru AS (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY s) - neg AS below,
        sum(pos) OVER (PARTITION BY {keys} ORDER BY s DESC) AS ta, sum(neg) OVER (PARTITION BY {keys} ORDER BY s DESC) AS fa
        FROM sc),
      su AS (SELECT {keys}, sum(pos * (below + neg / 2.0::DOUBLE)) AS pairs, sum(pos * ta / (ta + fa)::DOUBLE) AS steps,
        sum(pos) AS p, sum(neg) AS n, coalesce(sum(pos) FILTER (s > 0.5), 0)::BIGINT AS tp,
        coalesce(sum(neg) FILTER (s > 0.5), 0)::BIGINT AS fp, coalesce(sum(pos) FILTER (s <= 0.5), 0)::BIGINT AS fn,
        coalesce(sum(neg) FILTER (s <= 0.5), 0)::BIGINT AS tn FROM ru GROUP BY {keys}),
      ev AS (SELECT {keys}, pairs / nullif(p * n, 0) AS roc_auc, CASE WHEN p > 0 AND n > 0 THEN steps / p END AS pr_auc,
        tp, fp, fn, tn, (tp + tn) / (p + n)::DOUBLE AS accuracy,
        coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
        coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS sensitivity,
        coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity,
        (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2 AS balanced_accuracy,
        (p + n)::BIGINT AS n, p::BIGINT AS n_positive, (tn + fp)::BIGINT AS n_negative FROM su)"""


RATES = ("roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1", "sensitivity", "specificity", "balanced_accuracy")


def _round_list(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "evaluate_targets",
    f"WITH {SCORED}, {metrics_sql('scored', 'target, model')} SELECT target, model, {_round_list(RATES)}, "
    "tp, fp, fn, tn, n, n_positive, n_negative FROM ev",
)
def evaluate_targets(spark, sf_dir):
    return rounded(M.evaluate(scored(spark, sf_dir), ["target", "model"]), *RATES)


@query(
    "evaluate_large_table",
    f"""WITH sl AS (SELECT l_returnflag AS target, (l_linestatus = 'F')::INT AS label, l_extendedprice / 105000.0::DOUBLE AS probability
          FROM lineitem), {metrics_sql('sl', 'target')}
        SELECT target, {_round_list(RATES)}, tp, fp, fn, tn, n, n_positive, n_negative FROM ev""",
)
def evaluate_large_table(spark, sf_dir):
    """A third of all rows in each target and nearly every score distinct."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("target"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        (F.col("l_extendedprice") / 105000.0).alias("probability"),
    )
    return rounded(M.evaluate(lines, ["target"]), *RATES)


@query(
    "curve_points",
    f"""WITH {SCORED}, {metrics_sql('scored', 'target, model')}
        SELECT target, model, s AS threshold, round(fa / nullif(sum(neg) OVER w, 0)::DOUBLE, 6) AS fpr,
          round(ta / nullif(sum(pos) OVER w, 0)::DOUBLE, 6) AS tpr, round(ta / (ta + fa)::DOUBLE, 6) AS precision,
          round(ta / nullif(sum(pos) OVER w, 0)::DOUBLE, 6) AS recall
        FROM ru WINDOW w AS (PARTITION BY target, model)""",
)
def curve_points(spark, sf_dir):
    return rounded(M.curve_points(scored(spark, sf_dir), ["target", "model"]), "fpr", "tpr", "precision", "recall")


def with_folds(spark, sf_dir):
    fold = F.pmod(draw32("fold", "target", "doc_id"), F.lit(5)).cast("int")
    return scored(spark, sf_dir).withColumn("fold", fold)


FOLDED = f"""{SCORED}, folded AS (SELECT *, (('0x' || substr(md5('fold:' || target || ':' || doc_id), 1, 8))::BIGINT % 5)::INT
  AS fold FROM scored), {metrics_sql('folded', 'target, model, fold')},
  fr AS ({' UNION ALL '.join(f"SELECT target, model, fold, '{m}' AS metric, {m}::DOUBLE AS value FROM ev" for m in M.METRICS)}),
  fs AS (SELECT target, model, metric, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n_folds
    FROM fr GROUP BY target, model, metric),
  pv AS (SELECT target, model, {', '.join(f"max(mean) FILTER (metric = '{m}') AS {m}_mean, max(std) FILTER (metric = '{m}') AS {m}_std" for m in M.METRICS)}
    FROM fs GROUP BY target, model),
  bm AS (SELECT target, model FROM pv WHERE roc_auc_mean IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY roc_auc_mean DESC, model) = 1)"""


def fold_rows(spark, sf_dir):
    keys = ["target", "model", "fold"]
    return M.metric_rows(M.evaluate(with_folds(spark, sf_dir), keys), keys)


def summary(spark, sf_dir):
    return M.fold_summary(fold_rows(spark, sf_dir))


def _text(metric: str) -> str:
    return f"printf('%.3f ± %.3f', {metric}_mean, {metric}_std) AS {metric}"


@query("fold_metrics", f"WITH {FOLDED} SELECT target, model, fold, metric, round(value, 9) AS value FROM fr")
def fold_metrics(spark, sf_dir):
    return rounded(fold_rows(spark, sf_dir), "value", digits=9)


@query(
    "fold_summary",
    f"WITH {FOLDED} SELECT target, model, metric, round(mean, 6) AS mean, round(std, 6) AS std, n_folds FROM fs",
)
def fold_summary(spark, sf_dir):
    return rounded(summary(spark, sf_dir), "mean", "std")


@query(
    "model_comparison",
    f"""WITH {FOLDED} SELECT target, model,
          {', '.join(_text(m) for m in ('roc_auc', 'pr_auc', 'f1', 'precision', 'recall', 'balanced_accuracy'))},
          round(roc_auc_mean, 6) AS roc_auc_mean, round(pr_auc_mean, 6) AS pr_auc_mean FROM pv""",
)
def model_comparison(spark, sf_dir):
    return rounded(R.model_comparison(summary(spark, sf_dir)), "roc_auc_mean", "pr_auc_mean")


@query("best_models", f"WITH {FOLDED} SELECT target, model FROM bm")
def best_models(spark, sf_dir):
    return R.best_models(summary(spark, sf_dir))


@query(
    "target_overview",
    f"""WITH {FOLDED} SELECT target, model AS best_model, {', '.join(_text(m) for m in ('roc_auc', 'pr_auc', 'f1'))},
          round(roc_auc_mean, 6) AS roc_auc_mean, round(pr_auc_mean, 6) AS pr_auc_mean FROM pv JOIN bm USING (target, model)""",
)
def target_overview(spark, sf_dir):
    return rounded(R.target_overview(summary(spark, sf_dir)), "roc_auc_mean", "pr_auc_mean")


@query(
    "average_of_best",
    f"WITH {FOLDED} SELECT count(*) AS n_targets, round(avg(roc_auc_mean), 6) AS average_roc_auc FROM pv JOIN bm USING (target, model)",
)
def average_of_best(spark, sf_dir):
    return rounded(R.average_of_best(summary(spark, sf_dir)), "average_roc_auc")


_PERFORMANCE = ("roc_auc", "pr_auc", "f1", "precision", "recall", "balanced_accuracy")


@query(
    "performance_by_target",
    f"""WITH {FOLDED} SELECT target, model AS best_model,
          {', '.join(f'round({m}_mean, 6) AS {m}' for m in _PERFORMANCE)} FROM pv JOIN bm USING (target, model)""",
)
def performance_by_target(spark, sf_dir):
    return rounded(R.performance(summary(spark, sf_dir), ["quality", "toxic", "absent"]), *_PERFORMANCE)


@query(
    "metric_over_targets",
    f"""WITH {FOLDED} SELECT model, metric, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std, count(mean) AS n
        FROM fs GROUP BY model, metric""",
)
def metric_over_targets(spark, sf_dir):
    return rounded(R.metric_over_targets(summary(spark, sf_dir)), "mean", "std")


@query(
    "auc_over_models",
    f"""WITH {FOLDED} SELECT target, metric, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std, count(mean) AS n
        FROM fs WHERE metric = 'roc_auc' GROUP BY target, metric""",
)
def auc_over_models(spark, sf_dir):
    rows = summary(spark, sf_dir).where(F.col("metric") == "roc_auc")
    return rounded(R.metric_over_targets(rows, "target"), "mean", "std")


def _line(names) -> str:
    return " || ' ' || ".join(f"printf('{n}=%.3f', {n})" for n in names)


@query(
    "evaluation_report",
    f"""WITH {SCORED}, {metrics_sql('scored', 'target, model')}, e2 AS (SELECT target || '/' || model AS target,
          roc_auc, pr_auc, f1, balanced_accuracy FROM ev), rep AS ("""
    + " UNION ALL ".join(
        f"""SELECT 'overall' AS section, '{m}' AS target, 0 AS place, avg({m}) AS roc_auc, stddev_samp({m}) AS pr_auc,
              printf('%.3f ± %.3f', avg({m}), stddev_samp({m})) AS text FROM e2"""
        for m in ("roc_auc", "pr_auc", "f1")
    )
    + "".join(
        f""" UNION ALL (SELECT '{s}', target, row_number() OVER (ORDER BY roc_auc {d}, target)::INT AS place, roc_auc, pr_auc,
              {_line(('roc_auc', 'pr_auc'))} FROM e2 QUALIFY place <= 3)"""
        for s, d in (("best", "DESC"), ("worst", "ASC"))
    )
    + f""" UNION ALL SELECT 'table', target, 0, roc_auc, pr_auc, {_line(('roc_auc', 'pr_auc', 'f1', 'balanced_accuracy'))} FROM e2)
        SELECT section, target, place, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, text FROM rep""",
)
def evaluation_report(spark, sf_dir):
    metrics = M.evaluate(scored(spark, sf_dir), ["target", "model"])
    metrics = metrics.withColumn("target", F.concat_ws("/", "target", "model"))
    return rounded(R.evaluation_report(metrics), "roc_auc", "pr_auc")


@query(
    "prediction_report",
    f"""WITH {PREDICTIONS} SELECT doc_id, target, probability, (probability > 0.5)::INT AS prediction,
          CASE WHEN probability > 0.5 THEN 'Toxic' ELSE 'Non-toxic' END AS toxicity_class,
          round(abs(probability - 0.5) * 2, 6) AS confidence FROM predictions""",
)
def prediction_report(spark, sf_dir):
    from screenspark.functions.scalars import decision

    decided = predictions(spark, sf_dir).withColumn("prediction", decision("probability"))
    return rounded(R.prediction_report(decided, "doc_id"), "confidence")


@query(
    "export_documents",
    f"""WITH {FOLDED}, fc AS (SELECT target, count(DISTINCT model)::BIGINT AS n_features FROM fs GROUP BY target)
        SELECT target, model AS best_model_name, round(roc_auc_mean, 6) AS roc_auc, n_features AS selected_features_count
        FROM pv JOIN bm USING (target, model) JOIN fc USING (target)""",
)
def export_documents(spark, sf_dir):
    """The exported JSON texts, read back field by field."""
    rows = summary(spark, sf_dir)
    counts = rows.groupBy("target").agg(F.countDistinct("model").alias("n_features"))
    schema = (
        "target_name string, best_model_name string, performance_metrics struct<roc_auc:double>, "
        "selected_features_count bigint"
    )
    parsed = R.export_rows(rows, counts).select(F.from_json("document", schema).alias("d"))
    return parsed.select(
        F.col("d.target_name").alias("target"),
        "d.best_model_name",
        F.round("d.performance_metrics.roc_auc", 6).alias("roc_auc"),
        "d.selected_features_count",
    )


@query(
    "ensemble_probabilities",
    f"""WITH {SCORED} SELECT doc_id, target, round(avg(probability), 6) AS average, max(probability) AS highest,
          min(probability) AS lowest FROM scored GROUP BY doc_id, target""",
)
def ensemble_probabilities(spark, sf_dir):
    from screenspark.operators.predictions import ensemble

    wide = scored(spark, sf_dir).groupBy("doc_id", "target").pivot("model", list(MODELS)).agg(F.first("probability"))
    return rounded(
        wide.select(
            "doc_id",
            "target",
            ensemble(MODELS, "average").alias("average"),
            ensemble(MODELS, "max").alias("highest"),
            ensemble(MODELS, "min").alias("lowest"),
        ),
        "average",
    )
