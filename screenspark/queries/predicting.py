"""Prediction tables, summaries and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.functions import scalars as S
from screenspark.operators import predictions as P
from screenspark.queries.fixtures import (
    PREDICTIONS,
    TARGETS,
    known_labels,
    predictions,
    score,
    score_sql,
    table,
    wide_probabilities,
)
from screenspark.queries.profiling import rounded
from screenspark.queries.registry import query

CLASS_SQL = "CASE WHEN probability < 0.3 THEN 'Non-toxic' WHEN probability < 0.7 THEN 'Moderate' ELSE 'Toxic' END"
CLASSED = f"""{PREDICTIONS}, classed AS (SELECT *, (probability > 0.5)::INT AS prediction, {CLASS_SQL} AS class
  FROM predictions)"""
_COUNTS = """count(*) FILTER (class = 'Non-toxic') AS n_low, count(*) FILTER (class = 'Moderate') AS n_moderate,
  count(*) FILTER (class = 'Toxic') AS n_toxic"""


@query("classified_predictions", f"WITH {CLASSED} SELECT * FROM classed")
def classified_predictions(spark, sf_dir):
    return P.classified(predictions(spark, sf_dir))


@query(
    "wide_predictions",
    f"WITH {CLASSED} SELECT doc_id, "
    + ", ".join(
        f"""max(probability) FILTER (target = '{t}') AS {t}_probability,
          max(prediction) FILTER (target = '{t}') AS {t}_prediction, max(class) FILTER (target = '{t}') AS {t}_toxicity"""
        for t in TARGETS
    )
    + " FROM classed GROUP BY doc_id",
)
def wide_predictions(spark, sf_dir):
    return P.widen(predictions(spark, sf_dir), "doc_id", TARGETS)


@query(
    "probability_matrix",
    f"WITH {PREDICTIONS} SELECT doc_id, "
    + ", ".join(f"max(probability) FILTER (target = '{t}') AS {t}" for t in TARGETS)
    + " FROM predictions GROUP BY doc_id",
)
def probability_matrix(spark, sf_dir):
    return P.probability_matrix(predictions(spark, sf_dir), "doc_id", TARGETS)


@query("long_predictions", f"WITH {CLASSED} SELECT doc_id, target, probability, prediction FROM classed")
def long_predictions(spark, sf_dir):
    return P.lengthen(P.widen(predictions(spark, sf_dir), "doc_id", TARGETS), ["doc_id"])


@query(
    "summary_by_target",
    f"""WITH {CLASSED} SELECT target, round(avg(probability), 6) AS average_probability, max(probability) AS max_probability,
          min(probability) AS min_probability, {_COUNTS},
          CASE target WHEN 'toxic' THEN 'harmful text' ELSE '' END AS description FROM classed GROUP BY target""",
)
def summary_by_target(spark, sf_dir):
    return rounded(P.summary_by_target(predictions(spark, sf_dir), {"toxic": "harmful text"}), "average_probability")


@query("class_counts", f"WITH {CLASSED} SELECT target, class, count(*) AS n FROM classed GROUP BY target, class")
def class_counts(spark, sf_dir):
    return P.class_counts(predictions(spark, sf_dir))


@query(
    "pass_fail",
    f"""WITH {CLASSED} SELECT target, count(*) FILTER (prediction = 0) AS n_passed, count(*) FILTER (prediction = 1) AS n_failed,
          round(avg(probability), 6) AS mean, round(stddev_samp(probability), 6) AS std, min(probability) AS min,
          max(probability) AS max, round(count(*) FILTER (prediction = 0) * 100.0::DOUBLE / count(*), 6) AS passed_pct,
          round(count(*) FILTER (prediction = 1) * 100.0::DOUBLE / count(*), 6) AS failed_pct,
          round(median(probability), 6) AS median FROM classed GROUP BY target""",
)
def pass_fail(spark, sf_dir):
    return rounded(
        P.pass_fail(predictions(spark, sf_dir)), "mean", "std", "passed_pct", "failed_pct", "median"
    )


@query(
    "positives_by_target",
    f"""WITH {CLASSED} SELECT target, count(*) FILTER (prediction = 1) AS n_positive, count(*) AS n,
          round(avg(probability), 6) AS average_probability,
          round(count(*) FILTER (prediction = 1) * 100.0::DOUBLE / count(*), 6) AS positive_pct FROM classed GROUP BY target""",
)
def positives_by_target(spark, sf_dir):
    return rounded(P.positives_by_target(predictions(spark, sf_dir)), "average_probability", "positive_pct")


_PROFILE = f"""{CLASSED}, pc AS (SELECT doc_id, {_COUNTS}, count(*) FILTER (prediction = 0) AS n_passed,
    count(*) FILTER (prediction = 1) AS n_failed, avg(probability) AS average_probability FROM classed GROUP BY doc_id),
  profile AS (SELECT *, CASE WHEN n_toxic > 0 THEN 'Toxic' WHEN n_moderate > 0 THEN 'Moderate' ELSE 'Non-toxic' END AS overall,
    CASE WHEN n_failed = 0 THEN 'ALL PASS' WHEN n_passed = 0 THEN 'ALL FAIL'
      ELSE n_passed || '/' || (n_passed + n_failed) || ' PASS' END AS status,
    CASE WHEN n_toxic > 0 THEN 'Toxic: ' || n_toxic || ', Moderate: ' || n_moderate
      WHEN n_moderate > 0 THEN 'Moderate: ' || n_moderate ELSE 'Non-toxic' END AS summary FROM pc)"""


@query(
    "entity_profile",
    f"WITH {_PROFILE} SELECT * REPLACE (round(average_probability, 6) AS average_probability) FROM profile",
)
def entity_profile(spark, sf_dir):
    return rounded(P.entity_profile(wide_probabilities(spark, sf_dir), "doc_id", TARGETS), "average_probability")


@query(
    "overall_class_counts",
    f"WITH {_PROFILE} SELECT overall, count(*) AS n_entities FROM profile GROUP BY overall",
)
def overall_class_counts(spark, sf_dir):
    return P.overall_counts(wide_probabilities(spark, sf_dir), "doc_id", TARGETS)


@query(
    "screening_totals",
    f"""WITH {_PROFILE} SELECT count(*) AS n_entities, max(n_passed + n_failed) AS n_targets,
          count(*) FILTER (n_toxic > 0) AS n_toxic_entities, count(*) FILTER (n_toxic = 0) AS n_safe_entities,
          round(sum(n_toxic) / max(n_passed + n_failed)::DOUBLE, 6) AS mean_toxic_per_target FROM profile""",
)
def screening_totals(spark, sf_dir):
    return rounded(P.screening_totals(wide_probabilities(spark, sf_dir), "doc_id", TARGETS), "mean_toxic_per_target")


def _ranked(where: str, k: int) -> str:
    return f"""WITH {CLASSED} SELECT doc_id, target, probability, row_number() OVER (PARTITION BY target
      ORDER BY probability DESC, doc_id)::INT AS place FROM classed {where} QUALIFY place <= {k}"""


@query("top_entities_by_target", _ranked("", 10))
def top_entities_by_target(spark, sf_dir):
    return P.top_entities_by_target(predictions(spark, sf_dir), "doc_id", 10)


@query("top_positive_entities_by_target", _ranked("WHERE prediction = 1", 5))
def top_positive_entities_by_target(spark, sf_dir):
    return P.top_entities_by_target(predictions(spark, sf_dir), "doc_id", 5, positives_only=True)


@query(
    "top_entities",
    f"""WITH {PREDICTIONS} SELECT doc_id, round(avg(probability), 6) AS average_probability FROM predictions GROUP BY doc_id
        ORDER BY avg(probability) DESC, doc_id LIMIT 30""",
)
def top_entities(spark, sf_dir):
    return rounded(P.top_entities(wide_probabilities(spark, sf_dir), "doc_id", TARGETS, 30), "average_probability")


@query(
    "top_targets_by_entity",
    f"""WITH {PREDICTIONS} SELECT doc_id, target, probability, row_number() OVER (PARTITION BY doc_id
          ORDER BY probability DESC, target)::INT AS place FROM predictions QUALIFY place <= 3""",
)
def top_targets_by_entity(spark, sf_dir):
    return P.top_targets(wide_probabilities(spark, sf_dir), "doc_id", TARGETS, 3)


@query(
    "targets_by_positive_rate",
    """SELECT target, round(rate, 6) AS positive_ratio FROM (SELECT 'quality' AS target, avg(quality) AS rate FROM labels
         UNION ALL SELECT 'toxic', avg(toxic) FROM labels) ORDER BY rate DESC, target LIMIT 6""",
)
def targets_by_positive_rate(spark, sf_dir):
    from screenspark.operators.profile import target_summary

    summary = target_summary(known_labels(spark, sf_dir)).select("target", "positive_ratio")
    return rounded(summary.orderBy(F.col("positive_ratio").desc(), "target").limit(6), "positive_ratio")


@query(
    "first_rows_for_display",
    """SELECT rn::INT AS place, CASE WHEN rn > 19 THEN '...' ELSE p_partkey::VARCHAR END AS p_partkey,
         CASE WHEN rn > 19 THEN '...' ELSE p_name END AS p_name
       FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 20""",
)
def first_rows_for_display(spark, sf_dir):
    return P.first_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"])


@query(
    "shortened_texts",
    "SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS text FROM conversations",
)
def shortened_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.shorten("text").alias("text"))


@query(
    "profile_report",
    f"""WITH {_PROFILE}, r AS (SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, target) AS place
          FROM predictions), t AS (SELECT doc_id, string_agg(target, ', ' ORDER BY place) AS top_targets FROM r WHERE place <= 3
          GROUP BY doc_id)
        SELECT doc_id, n_toxic, n_moderate, n_low, overall, status, top_targets FROM profile JOIN t USING (doc_id)""",
)
def profile_report(spark, sf_dir):
    from screenspark.plans.reports import profile_report as report

    return report(wide_probabilities(spark, sf_dir), "doc_id", TARGETS)


@query(
    "missing_features_as_zero",
    f"""WITH f AS (SELECT doc_id, {score_sql('a', 'doc_id')} AS a, {score_sql('b', 'doc_id')} AS b FROM documents)
        SELECT doc_id, b AS f1, 0.0::DOUBLE AS f2, a AS f3, 1 AS n_missing FROM f""",
)
def missing_features_as_zero(spark, sf_dir):
    from screenspark.operators.select import features_by_name

    documents = table(spark, sf_dir, "documents")
    matrix = documents.select("doc_id", F.array(score("a", "doc_id"), score("b", "doc_id")).alias("f"))
    out = features_by_name(matrix, "f", ["a", "b"], ["b", "absent", "a"])
    return out.select("doc_id", *[F.get("f", F.lit(i)).alias(f"f{i + 1}") for i in range(3)], "n_missing")
