"""Label, property and data-quality profiles.

All of them are one aggregate over the long form: partial sums per task, then a shuffle of a few rows per target.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.draws import hash_key
from screenspark.functions.scalars import Rule, ratio, ratio_or_zero, rules_met
from screenspark.operators.clean import long_labels, long_numbers
from screenspark.operators.joins import join_small
from screenspark.operators.ranking import exact_quantiles


def is_pos() -> Column:
    return F.col("label") == 1


def is_neg() -> Column:
    return F.col("label") == 0


def _count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def target_statistics(labels: DataFrame) -> DataFrame:
    """Counts, active share and imbalance per target. Imbalance is NULL where there is no active row."""
    return (
        labels.where(F.col("label").isNotNull())
        .groupBy("target")
        .agg(
            F.count("label").alias("total_samples"),
            F.count_if(is_pos()).alias("active_samples"),
            F.count_if(is_neg()).alias("inactive_samples"),
        )
        .withColumn("active_ratio", ratio(F.col("active_samples"), F.col("total_samples")))
        .withColumn("imbalance_ratio", ratio(F.col("inactive_samples"), F.col("active_samples")))
    )


def target_summary(labels: DataFrame) -> DataFrame:
    """A row for every target, also for one without any known label (whose ratio is NULL)."""
    return (
        labels.groupBy("target")
        .agg(
            F.count("label").alias("total_samples"),
            F.count_if(F.coalesce(is_pos(), F.lit(False))).alias("positive_samples"),
            F.count_if(F.coalesce(is_neg(), F.lit(False))).alias("negative_samples"),
        )
        .withColumn("positive_ratio", ratio(F.col("positive_samples"), F.col("total_samples")))
    )


# A target is called balanced between these active shares, both included.
BALANCED_FROM, BALANCED_TO = 0.2, 0.8


def target_analysis(labels: DataFrame) -> DataFrame:
    """Statistics plus completeness (known of all rows) and the balance tag; needs the rows with NULL labels too."""
    return (
        labels.groupBy("target")
        .agg(
            F.count("label").alias("total_compounds"),
            _count_if(is_pos()).alias("active_compounds"),
            _count_if(is_neg()).alias("inactive_compounds"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .where(F.col("total_compounds") > 0)
        .withColumn("activity_ratio", ratio(F.col("active_compounds"), F.col("total_compounds")))
        .withColumn("class_imbalance_ratio", ratio(F.col("inactive_compounds"), F.col("active_compounds")))
        .withColumn("data_completeness", ratio(F.col("total_compounds"), F.col("n_rows")))
        .withColumn("balanced", F.col("activity_ratio").between(BALANCED_FROM, BALANCED_TO))
        .drop("n_rows")
    )


def coverage(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Known count and share of all rows per column."""
    return (
        long_labels(df, [], targets, known_only=False)
        .groupBy("target")
        .agg(F.count("label").alias("n_known"), F.count(F.lit(1)).alias("n_rows"))
        .select("target", "n_known", (F.col("n_known") * 100.0 / F.col("n_rows")).alias("coverage_pct"))
    )


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage of the columns that have any; one pass over the table."""
    names = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    return (
        counted.unpivot(["_n"], names, "column_name", "n_missing")
        .where(F.col("n_missing") > 0)
        .select("column_name", "n_missing", (F.col("n_missing") * 100.0 / F.col("_n")).alias("missing_pct"))
    )


def missing_label_cells(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Number of unknown label cells over all targets."""
    return df.agg(sum((F.count_if(F.col(t).isNull()) for t in targets), F.lit(0)).alias("missing_cells"))


def property_summary(df: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Mean, median, smallest and largest value per property."""
    long = long_numbers(df, [], properties)
    basic = long.groupBy("property").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    median = exact_quantiles(long, ["property"], "value", {"median": 0.5}).drop("n")
    return basic.join(median, "property", "left").select("property", "mean", "median", "min", "max")


def labelled_numbers(labels: DataFrame, table: DataFrame, id_column: str, properties: Sequence[str]) -> DataFrame:
    """``(target, label, property, value)`` by an equi-join on the entity key."""
    known = labels.where(F.col("label").isNotNull())
    return long_numbers(
        known.join(table.select(id_column, *properties), id_column), ["target", "label"], properties
    )


def class_differences(labels: DataFrame, table: DataFrame, id_column: str, properties: Sequence[str]) -> DataFrame:
    """Active and inactive means per target and property; only targets that have both classes."""
    long = labelled_numbers(labels, table, id_column, properties)
    return (
        long.groupBy("target", "property")
        .agg(
            F.avg(F.when(is_pos(), F.col("value"))).alias("active_mean"),
            F.avg(F.when(is_neg(), F.col("value"))).alias("inactive_mean"),
            F.count_if(is_pos()).alias("_pos"),
            F.count_if(is_neg()).alias("_neg"),
        )
        .where((F.col("_pos") > 0) & (F.col("_neg") > 0))
        .withColumn("difference", F.col("active_mean") - F.col("inactive_mean"))
        .withColumn("pct_difference", ratio_or_zero(F.col("difference"), F.col("inactive_mean")) * 100)
        .drop("_pos", "_neg")
    )


def rule_flags(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One flag per rule, the number of rules met, and the three usual summary flags."""
    flagged = df.withColumns({f"{r.name}_ok": r.holds() for r in rules}).withColumn("rules_met", rules_met(rules))
    n = len(rules)
    return flagged.withColumns(
        {
            "all_rules": F.col("rules_met") == n,
            "all_but_one": F.col("rules_met") >= n - 1,
            "all_but_two": F.col("rules_met") >= n - 2,
        }
    )


def rule_compliance(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows and percentage meeting each rule and each summary flag."""
    n = len(rules)
    met = rules_met(rules)
    tests = {r.name: r.holds() for r in rules}
    tests |= {"all_rules": met == n, "all_but_one": met >= n - 1, "all_but_two": met >= n - 2}
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    return counted.unpivot(["_n"], list(tests), "rule", "n_compliant").select(
        "rule", "n_compliant", (ratio_or_zero(F.col("n_compliant"), F.col("_n")) * 100).alias("compliant_pct")
    )


def rule_compliance_by_class(
    labels: DataFrame, table: DataFrame, id_column: str, rules: Sequence[Rule]
) -> DataFrame:
    """Compliance per target, class and rule, with the all-rules row; only targets that have both classes."""
    columns = list(dict.fromkeys(r.column for r in rules))
    joined = labels.where(F.col("label").isNotNull()).join(table.select(id_column, *columns), id_column)
    tests = {r.name: r.holds() for r in rules} | {"all_rules": rules_met(rules) == len(rules)}
    counted = joined.groupBy("target", "label").agg(
        F.count(F.lit(1)).alias("n_class"), *[F.count_if(t).alias(k) for k, t in tests.items()]
    )
    # Two rows per target are left: whether both classes are there needs no second join.
    of_target = Window.partitionBy("target")
    positives, negatives = F.sum(F.when(is_pos(), F.col("n_class"))), F.sum(F.when(is_neg(), F.col("n_class")))
    counted = counted.withColumns({"_pos": positives.over(of_target), "_neg": negatives.over(of_target)})
    counted = counted.where((F.col("_pos") > 0) & (F.col("_neg") > 0)).drop("_pos", "_neg")
    return (
        counted.unpivot(["target", "label", "n_class"], list(tests), "rule", "n_compliant")
        .withColumn("compliant_pct", ratio(F.col("n_compliant"), F.col("n_class")) * 100)
    )


def positives_per_entity(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Add the number of positive labels of each row."""
    total = F.lit(0)
    for t in targets:
        total = total + F.coalesce(F.col(t).cast("int"), F.lit(0))
    return df.withColumn("n_positive", total)


def histogram(df: DataFrame, value: str, bins: int, strata: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each stratum, the last bin closed on the right.

    Every bin is listed, empty ones with 0, for each ``by`` class seen. ``density`` sums to 1 over bin widths.
    """
    known = df.where(F.col(value).isNotNull()).select(*strata, *by, F.col(value).cast("double").alias("_v"))
    # A single value gets the unit range around it.
    lowest, highest = F.min("_v"), F.max("_v")
    flat = F.when(lowest == highest, F.lit(0.5)).otherwise(F.lit(0.0))
    limits = [(lowest - flat).alias("_lo"), (highest + flat).alias("_hi")]
    if strata:
        ranges = known.groupBy(*strata).agg(*limits)
        ranged = join_small(known, ranges, strata)
    else:
        row = known.agg(*limits).first()
        ranged = known.withColumns({"_lo": F.lit(row["_lo"]), "_hi": F.lit(row["_hi"])})
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    keys = [*strata, *by, "_lo", "_hi"]
    counts = ranged.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # A few rows per stratum from here on.
    found = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    classes = counts.groupBy(*keys).agg(F.sum("n").alias("_total"), found.alias("_found"))
    listed = classes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce(F.try_element_at("_found", F.col("bin")), F.lit(0).cast("bigint"))
    return listed.select(
        *strata,
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_from"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_to"),
        n.alias("n"),
        (n / (F.col("_total") * width)).alias("density"),
    )


# Fixed value: whisker reach in quartile ranges.
WHISKER = 1.5


def box_table(df: DataFrame, strata: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends and the number of points beyond them, per stratum."""
    quartiles = exact_quantiles(df, strata, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    joined = join_small(df.where(F.col(value).isNotNull()).select(*strata, value), quartiles, strata)
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*strata).agg(
        F.max("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outside"),
    )


def correlation_pairs(df: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Strict lower triangle of the correlation matrix of a few named columns, over rows where both are known.

    One aggregate, no shuffle beyond one row per task. A constant column gives NULL.
    """
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in properties])
    pairs = [(b, a) for a, b in combinations(properties, 2)]
    sums = []
    for i, (row, column) in enumerate(pairs):
        x, y = F.col(row), F.col(column)
        spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        sums.append(F.try_divide(F.covar_pop(x, y), spread).alias(f"c{i}"))
    wide = clean.agg(*sums)
    listed = F.array(
        *[
            F.struct(F.lit(row).alias("row"), F.lit(column).alias("column"), F.col(f"c{i}").alias("corr"))
            for i, (row, column) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(listed))


def matrix_statistics(df: DataFrame, features: str) -> DataFrame:
    """Rows, columns, share of zeros and number of missing cells of a feature matrix."""
    zeros = F.size(F.filter(F.col(features), lambda v: v == 0))
    missing = F.size(F.filter(F.col(features), lambda v: v.isNull() | F.isnan(v)))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size(features)).alias("n_columns"),
        F.try_divide(F.sum(zeros).cast("double"), F.sum(F.size(features)).cast("double")).alias("sparsity"),
        F.sum(missing).alias("n_missing"),
    )


def scatter_pairs(
    left: DataFrame, right: DataFrame, id_column: str, columns: Sequence[str], sample: int | None = None
) -> DataFrame:
    """The rows behind a scatter plot: equi-join on the entity; optionally a repeatable sample of exact size."""
    joined = left.join(right, id_column).select(id_column, *columns)
    if sample is None:
        return joined
    return joined.orderBy(hash_key("scatter", id_column), id_column).limit(sample)


def exploration_report(
    df: DataFrame, targets: Sequence[str], properties: Sequence[str], rules: Sequence[Rule], valid: Column
) -> DataFrame:
    """``(section, key, value)``: totals, property means, rule percentages, positive percentages, missing cells."""
    n = F.count(F.lit(1))
    entries: dict[tuple[str, str], Column] = {
        ("overview", "n_entities"): n,
        ("overview", "n_targets"): F.lit(len(targets)),
        ("quality", "n_valid"): F.count_if(F.coalesce(valid, F.lit(False))),
        ("quality", "missing_label_cells"): sum((F.count_if(F.col(t).isNull()) for t in targets), F.lit(0)),
    }
    entries |= {("property_mean", p): F.avg(F.col(p).cast("double")) for p in properties}
    entries |= {("rule_pct", r.name): ratio_or_zero(F.count_if(r.holds()), n) * 100 for r in rules}
    entries[("rule_pct", "all_rules")] = ratio_or_zero(F.count_if(rules_met(rules) == len(rules)), n) * 100
    entries |= {("positive_pct", t): F.avg(F.col(t).cast("double")) * 100 for t in targets}
    wide = df.agg(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(entries.values())])
    listed = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.col(f"v{i}").alias("value"))
            for i, (s, k) in enumerate(entries)
        ]
    )
    return wide.select(F.inline(listed)).where(F.col("value").isNotNull())
