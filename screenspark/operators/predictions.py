"""Prediction tables: wide and long form, summaries per target and per entity, top lists.

The long form is ``(id, target, probability)``; the wide form has ``<target>_probability``, ``<target>_prediction``
and ``<target>_toxicity`` columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions import scalars as S
from screenspark.operators.ranking import exact_quantiles

PROBABILITY, PREDICTION, CLASS = "_probability", "_prediction", "_toxicity"


def ensemble(columns: Sequence[str], method: str = "average") -> Column:
    """Average, largest or smallest of several models' probabilities."""
    values = [F.col(c) for c in columns]
    if method == "average":
        return sum(values[1:], values[0]) / len(values)
    if method in ("max", "min"):
        if len(values) == 1:
            return values[0]
        return F.greatest(*values) if method == "max" else F.least(*values)
    raise ValueError(f"unknown ensemble method {method!r}")


def classified(predictions: DataFrame, probability: str = "probability") -> DataFrame:
    """Add the decision and the class of each probability."""
    return predictions.withColumn("prediction", S.decision(probability)).withColumn("class", S.class_of(probability))


def widen(predictions: DataFrame, id_column: str, targets: Sequence[str]) -> DataFrame:
    """One row per entity with probability, decision and class of every target. Target names are given, so no scan."""
    wide = predictions.groupBy(id_column).pivot("target", list(targets)).agg(F.first("probability"))
    added = {}
    for t in targets:
        added[f"{t}{PROBABILITY}"] = F.col(f"`{t}`")
        added[f"{t}{PREDICTION}"] = S.decision(f"`{t}`")
        added[f"{t}{CLASS}"] = S.class_of(f"`{t}`")
    return wide.select(id_column, *[c.alias(n) for n, c in added.items()])


def probability_matrix(predictions: DataFrame, id_column: str, targets: Sequence[str]) -> DataFrame:
    """Entity by target probabilities, the table behind a heat map."""
    return predictions.groupBy(id_column).pivot("target", list(targets)).agg(F.first("probability"))


def report_columns(df: DataFrame, id_columns: Sequence[str], targets: Sequence[str]) -> list[str]:
    """Report order: ids, then the three columns of each target; only those that exist."""
    wanted = [*id_columns, *[f"{t}{s}" for t in targets for s in (PROBABILITY, PREDICTION, CLASS)]]
    return [c for c in wanted if c in df.columns]


def target_names(df: DataFrame) -> list[str]:
    """Targets of a wide prediction table, found by column suffix."""
    return [c[: -len(PREDICTION)] for c in df.columns if c.endswith(PREDICTION)]


def lengthen(wide: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Wide prediction table to ``(ids..., target, probability, prediction)``."""
    found = target_names(wide)
    if not found:
        raise ValueError("no column ends in " + PREDICTION)
    entries = [
        F.struct(
            F.lit(t).alias("target"),
            F.col(f"`{t}{PROBABILITY}`").cast("double").alias("probability"),
            F.col(f"`{t}{PREDICTION}`").cast("int").alias("prediction"),
        )
        for t in found
    ]
    return wide.select(*id_columns, F.inline(F.array(*entries)))


def _classes() -> list[Column]:
    return [
        F.count_if(F.col("class") == name).alias(alias)
        for name, alias in ((S.CLASS_LOW, "n_low"), (S.CLASS_MID, "n_moderate"), (S.CLASS_HIGH, "n_toxic"))
    ]


def summary_by_target(predictions: DataFrame, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """Mean, largest and smallest probability and class counts per target, with its description."""
    return (
        classified(predictions)
        .groupBy("target")
        .agg(
            F.avg("probability").alias("average_probability"),
            F.max("probability").alias("max_probability"),
            F.min("probability").alias("min_probability"),
            *_classes(),
        )
        .withColumn("description", S.described("target", descriptions or {}))
    )


def class_counts(predictions: DataFrame) -> DataFrame:
    return classified(predictions).groupBy("target", "class").agg(F.count(F.lit(1)).alias("n"))


def pass_fail(predictions: DataFrame) -> DataFrame:
    """Passed and failed counts and shares, and the probability's mean, median, deviation and range per target."""
    basic = (
        classified(predictions)
        .groupBy("target")
        .agg(
            F.count_if(F.col("prediction") == 0).alias("n_passed"),
            F.count_if(F.col("prediction") == 1).alias("n_failed"),
            F.avg("probability").alias("mean"),
            F.stddev_samp("probability").alias("std"),
            F.min("probability").alias("min"),
            F.max("probability").alias("max"),
        )
    )
    total = F.col("n_passed") + F.col("n_failed")
    median = exact_quantiles(predictions, ["target"], "probability", {"median": 0.5}).drop("n")
    return (
        basic.withColumn("passed_pct", S.ratio(F.col("n_passed"), total) * 100)
        .withColumn("failed_pct", S.ratio(F.col("n_failed"), total) * 100)
        .join(median, "target", "left")
    )


def positives_by_target(predictions: DataFrame) -> DataFrame:
    return (
        classified(predictions)
        .groupBy("target")
        .agg(
            F.count_if(F.col("prediction") == 1).alias("n_positive"),
            F.count(F.lit(1)).alias("n"),
            F.avg("probability").alias("average_probability"),
        )
        .withColumn("positive_pct", S.ratio(F.col("n_positive"), F.col("n")) * 100)
    )


def by_target(targets: Sequence[str]) -> Column:
    """The known probabilities of a row as ``array<struct<p, target>>``."""
    entries = F.array(*[F.struct(F.col(f"`{t}`").alias("p"), F.lit(t).alias("target")) for t in targets])
    return F.filter(entries, lambda e: e["p"].isNotNull())


def mean_probability(targets: Sequence[str]) -> Column:
    known = by_target(targets)
    return S.ratio(F.aggregate(known, F.lit(0.0), lambda a, e: a + e["p"]), F.size(known))


def entity_profile(
    wide: DataFrame, id_column: str, targets: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Class counts, overall class, pass status and mean probability per entity.

    Takes one probability column per target, as models leave it, so every entity is settled within its row and nothing
    is shuffled.
    """
    known = F.col("_known")

    def count(test) -> Column:
        return F.size(F.filter(known, test)).cast("bigint")

    counted = wide.select(
        id_column, *keep, by_target(targets).alias("_known"), mean_probability(targets).alias("average_probability")
    ).select(
        id_column,
        *keep,
        count(lambda e: e["p"] < S.LOW_LIMIT).alias("n_low"),
        count(lambda e: (e["p"] >= S.LOW_LIMIT) & (e["p"] < S.HIGH_LIMIT)).alias("n_moderate"),
        count(lambda e: e["p"] >= S.HIGH_LIMIT).alias("n_toxic"),
        count(lambda e: e["p"] <= S.DECISION_LIMIT).alias("n_passed"),
        count(lambda e: e["p"] > S.DECISION_LIMIT).alias("n_failed"),
        "average_probability",
    )
    summary = (
        F.when(
            F.col("n_toxic") > 0, F.format_string("Toxic: %d, Moderate: %d", F.col("n_toxic"), F.col("n_moderate"))
        )
        .when(F.col("n_moderate") > 0, F.format_string("Moderate: %d", F.col("n_moderate")))
        .otherwise(F.lit(S.CLASS_LOW))
    )
    return (
        counted.withColumn("overall", S.overall_class(F.col("n_toxic"), F.col("n_moderate")))
        .withColumn("status", S.pass_status(F.col("n_passed"), F.col("n_failed")))
        .withColumn("summary", summary)
    )


def overall_counts(wide: DataFrame, id_column: str, targets: Sequence[str]) -> DataFrame:
    """Entities per overall class."""
    return entity_profile(wide, id_column, targets).groupBy("overall").agg(F.count(F.lit(1)).alias("n_entities"))


def screening_totals(wide: DataFrame, id_column: str, targets: Sequence[str]) -> DataFrame:
    """Entities, targets, entities with and without a toxic target, and the mean toxic count per target."""
    per_entity = entity_profile(wide, id_column, targets)
    totals = per_entity.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(F.col("n_toxic") > 0).alias("n_toxic_entities"),
        F.count_if(F.col("n_toxic") == 0).alias("n_safe_entities"),
        F.sum("n_toxic").alias("_toxic"),
    ).withColumn("n_targets", F.lit(len(targets)).cast("bigint"))
    return totals.select(
        "n_entities",
        "n_targets",
        "n_toxic_entities",
        "n_safe_entities",
        S.ratio(F.col("_toxic"), F.col("n_targets")).alias("mean_toxic_per_target"),
    )


def top_entities_by_target(
    predictions: DataFrame, id_column: str, k: int, positives_only: bool = False
) -> DataFrame:
    """The k most probable entities of each target.

    Each task passes on k rows per target and share, so no target is sorted whole.
    """
    rows = predictions.where(F.col("probability") > S.DECISION_LIMIT) if positives_only else predictions
    return top_rows(rows.where(F.col("probability").isNotNull()), ["target"], "probability", id_column, k)


def top_rows(df: DataFrame, by: Sequence[str], value: str, id_column: str, k: int) -> DataFrame:
    """``(by..., place, id, value)`` of the k largest values per group, equal values in id order.

    Two rounds: first the k best of each of many hash shares of the group, then the k best of those.
    """
    shares = 64
    share = F.pmod(F.xxhash64(id_column), F.lit(shares))
    order = [F.col(value).desc(), F.col(id_column)]
    narrow = df.select(*by, id_column, value).withColumn("_share", share)
    first = narrow.withColumn("place", F.row_number().over(Window.partitionBy(*by, "_share").orderBy(*order)))
    best = first.where(F.col("place") <= k).drop("place", "_share")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
        F.col("place") <= k
    )


def top_entities(wide: DataFrame, id_column: str, targets: Sequence[str], k: int) -> DataFrame:
    """The k entities with the highest mean probability over targets; k rows per task reach the last step."""
    means = wide.select(id_column, mean_probability(targets).alias("average_probability"))
    return means.orderBy(F.col("average_probability").desc_nulls_last(), id_column).limit(k)


def top_targets(wide: DataFrame, id_column: str, targets: Sequence[str], k: int = 3) -> DataFrame:
    """The k most probable targets of every entity, equal ones by name; sorted within the row."""
    turned = F.transform(by_target(targets), lambda e: F.struct((-e["p"]).alias("p"), e["target"].alias("target")))
    ordered = F.array_sort(turned)
    rows = wide.select(id_column, F.posexplode(F.slice(ordered, 1, k)).alias("place", "e"))
    return rows.select(
        id_column,
        F.col("e.target").alias("target"),
        (-F.col("e.p")).alias("probability"),
        (F.col("place") + 1).alias("place"),
    )


def first_rows(df: DataFrame, order: Sequence[str], k: int = 19) -> DataFrame:
    """The first k rows for display and, if there are more, one row of dots. Text columns only."""
    head = df.orderBy(*order).limit(k + 1)
    place = F.row_number().over(Window.orderBy(*order))  # at most k + 1 rows
    numbered = head.withColumn("place", place)
    dots = [F.when(F.col("place") > k, F.lit("...")).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns]
    return numbered.select("place", *dots)
