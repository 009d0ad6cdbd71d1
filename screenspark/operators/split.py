"""Train/test splits and folds as columns of the entity table: no copies of the data, one ranking per split.

All shuffles follow a hash of seed and id, so a split is the same on every run. Fold contents differ from those of a
library with another random generator; sizes, strata and disjointness are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenspark.operators.joins import join_keyed, join_small, null_safe
from screenspark.operators.ranking import row_numbers, shuffled_numbers
from screenspark.session import materialise

TRAIN, VALID, TEST = "train", "val", "test"


def merge_small_strata(df: DataFrame, stratum: str, smallest: int = 2, pooled: int = -1) -> DataFrame:
    """Strata with fewer rows than ``smallest`` share one stratum. The list of strata is small by nature."""
    small = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < smallest)
    marked = join_small(df, small.select(stratum, F.lit(True).alias("_small")), [stratum], "left")
    return marked.withColumn(
        stratum, F.when(F.col("_small"), F.lit(pooled)).otherwise(F.col(stratum))
    ).drop("_small")


def _shares(sizes: DataFrame, by: Sequence[str], stratum: str, wanted: Column, pool: str, out: str) -> DataFrame:
    """Hand ``wanted`` rows to the strata in proportion to ``pool``; the largest fractions get the leftover rows."""
    within = Window.partitionBy(*by)
    exact = F.col(pool) * wanted / F.sum(pool).over(within)
    shared = sizes.withColumn("_floor", F.floor(exact)).withColumn("_fraction", exact - F.floor(exact))
    leftover = (wanted - F.sum("_floor").over(within)).cast("bigint")
    ranked = F.row_number().over(within.orderBy(F.col("_fraction").desc(), F.col(stratum)))
    return shared.withColumn(
        out, F.col("_floor") + F.when(ranked <= leftover, F.lit(1)).otherwise(F.lit(0))
    ).drop("_floor", "_fraction")


def _ceil(value: Column) -> Column:
    # 0.2 * 35 is a hair above 7 in floating point; do not let that add a row.
    return F.ceil(F.round(value, 9))


def stratified_holdout(
    df: DataFrame,
    id_column: str,
    stratum: str,
    by: Sequence[str] = (),
    test_size: float = 0.2,
    val_size: float = 0.0,
    seed: int = 42,
    folds: int = 0,
) -> DataFrame:
    """Add ``part``: test, val or train, with exact counts per stratum in each ``by`` group.

    The validation part takes ``val_size / (1 - test_size)`` of what the test part leaves, rounded up. With ``folds``
    the training rows also get a stratified ``fold``, numbered over the training part only.
    """
    strata = [*by, stratum]
    numbered = shuffled_numbers(df, id_column, seed, strata, out="_rn").drop("_rn_all")
    within = Window.partitionBy(*by)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_total", F.sum("_n").over(within))
    sizes = _shares(sizes, by, stratum, _ceil(F.col("_total") * test_size), "_n", "_test")
    sizes = sizes.withColumn("_rest", F.col("_n") - F.col("_test"))
    if val_size:
        rest = F.sum("_rest").over(within)
        sizes = sizes.withColumn("_want_val", _ceil(rest * (val_size / (1 - test_size))))
        sizes = _shares(sizes, by, stratum, F.col("_want_val"), "_rest", "_val")
    else:
        sizes = sizes.withColumn("_val", F.lit(0))
    sizes = sizes.withColumn("_train", F.col("_n") - F.col("_test") - F.col("_val"))
    earlier = within.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_train_before", F.coalesce(F.sum("_train").over(earlier), F.lit(0)))
    joined = join_small(numbered, sizes.select(*strata, "_test", "_val", "_train_before"), strata)
    used = F.col("_test") + F.col("_val")
    part = F.when(F.col("_rn") <= F.col("_test"), TEST).when(F.col("_rn") <= used, VALID).otherwise(TRAIN)
    out = joined.withColumn("part", part)
    if folds:
        place = F.col("_train_before") + F.col("_rn") - used - 1
        out = out.withColumn("fold", F.when(F.col("part") == TRAIN, F.pmod(place, F.lit(folds)).cast("int")))
    return out.drop("_rn", "_test", "_val", "_train_before")


def _places(df: DataFrame, id_column: str, label: str, by: Sequence[str], seed: int | str) -> DataFrame:
    """0, 1, 2 ... over each ``by`` group, one label after the other and shuffled within it."""
    numbered = shuffled_numbers(df, id_column, seed, by, out="_rn", first=label)
    return numbered.withColumn("_place", F.col("_rn") - 1).drop("_rn", "_rn_all")


def stratified_folds(
    df: DataFrame,
    id_column: str,
    label: str,
    by: Sequence[str] = (),
    n_splits: int = 5,
    n_repeats: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Add ``fold``; fold sizes differ by at most one, also within each label. With repeats also ``repeat``."""
    if n_repeats > 1:
        df = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
        by = [*by, "repeat"]
    placed = _places(df, id_column, label, by, seed)
    return placed.withColumn("fold", F.pmod("_place", F.lit(n_splits)).cast("int")).drop("_place")


def nested_folds(
    df: DataFrame,
    id_column: str,
    label: str,
    by: Sequence[str] = (),
    outer_splits: int = 5,
    inner_splits: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One row per entity and outer fold: its ``role`` there and, for training rows, the ``inner_fold``.

    The place within an outer training set is the overall place less the test rows before it, so one ranking serves
    all outer and inner folds.
    """
    placed = _places(df, id_column, label, by, seed).withColumn(
        "outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer_splits - 1)))
    )
    tested = F.pmod("_place", F.lit(outer_splits)) == F.col("outer_fold")
    tests_before = F.floor((F.col("_place") + F.lit(outer_splits - 1) - F.col("outer_fold")) / outer_splits)
    inner = F.pmod(F.col("_place") - tests_before, F.lit(inner_splits)).cast("int")
    return (
        placed.withColumn("role", F.when(tested, TEST).otherwise(TRAIN))
        .withColumn("inner_fold", F.when(~tested, inner))
        .drop("_place")
    )


def _deal(counts: Sequence[tuple[int, int]], n_splits: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Deal groups, largest first, each to the lightest fold so far.

    Input is the number of groups per size. Output per size: (first place, folds in turn) runs. Once the lightest
    folds lie less than one group apart they are served in turn until the next heavier fold comes into reach, so whole
    rounds are dealt at once and the work grows with the number of distinct sizes, not of groups.
    """
    weights = [0] * n_splits
    plan = []
    for size, n_groups in sorted(counts, reverse=True):
        runs: list[tuple[int, list[int]]] = []
        place = 0
        while place < n_groups:
            lowest = min(weights)
            turn = sorted((w, f) for f, w in enumerate(weights) if w < lowest + size)
            waiting = [w for w in weights if w >= lowest + size]
            rounds = (n_groups - place) // len(turn)
            if waiting:
                rounds = min(rounds, (min(waiting) - turn[-1][0]) // size - 1)
            folds = [f for _, f in turn]
            if rounds >= 1:
                step = rounds * len(folds)
            else:
                rounds, step, folds = 1, 1, folds[:1]
            runs.append((place, folds))
            for f in folds:
                weights[f] += rounds * size
            place += step
        plan.append((size, runs))
    return plan


def group_folds(df: DataFrame, group: str, n_splits: int = 5, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Add ``fold`` so that no group is in two folds; the largest groups go first, each to the lightest fold.

    With ``by``, such as the target of known labels, each of its values has folds of its own. Rows without a group are
    one group. Only the histograms of group sizes reach the driver: n rows have at most sqrt(2 n) different sizes.
    """
    by = list(by)
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_size"))
    counted = sizes.groupBy(*by, "_size").agg(F.count(F.lit(1)).alias("n")).collect()
    histograms: dict[tuple, list[tuple[int, int]]] = {}
    for r in counted:
        histograms.setdefault(tuple(r[c] for c in by), []).append((r["_size"], r["n"]))
    if min((sum(n for _, n in h) for h in histograms.values()), default=0) < n_splits:
        raise ValueError(f"{n_splits} folds need at least that many groups")
    run = T.StructType([T.StructField("start", T.LongType()), T.StructField("folds", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("_size", T.LongType()), T.StructField("_runs", T.ArrayType(run))])
    dealt = [(*key, size, runs) for key, h in histograms.items() for size, runs in _deal(h, n_splits)]
    plan = df.sparkSession.createDataFrame(dealt, schema)
    numbered = shuffled_numbers(sizes, group, seed, [*by, "_size"], out="_rn").drop("_rn_all")
    placed = null_safe(numbered, F.broadcast(plan), [*by, "_size"])  # as many rows as the histograms
    place = F.col("_rn") - 1
    mine = F.element_at(F.filter("_runs", lambda r: r["start"] <= place), -1)
    turn = F.pmod(place - mine["start"], F.size(mine["folds"]).cast("bigint")).cast("int")
    folds = materialise(placed.select(*by, group, "_size", F.get(mine["folds"], turn).alias("fold")))
    total = sum(size * n for h in histograms.values() for size, n in h)
    return join_keyed(df, folds, [*by, group], "_size", total).drop("_size")


def group_fold_report(df: DataFrame, group: str, n_splits: int = 5) -> DataFrame:
    """Per fold: rows and distinct groups on the test and on the training side."""
    per_group = df.groupBy("fold", group).agg(F.count(F.lit(1)).alias("_n"))
    per_fold = per_group.groupBy("fold").agg(
        F.sum("_n").alias("n_test"), F.count(F.lit(1)).alias("n_test_groups")
    )
    everything = Window.partitionBy()  # one row per fold
    return per_fold.select(
        "fold",
        "n_test",
        "n_test_groups",
        (F.sum("n_test").over(everything) - F.col("n_test")).alias("n_train"),
        (F.sum("n_test_groups").over(everything) - F.col("n_test_groups")).alias("n_train_groups"),
    )


def time_folds(df: DataFrame, time: str, id_column: str, n_splits: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Expanding-window folds along time: equal test blocks at the end, training on everything before each.

    Adds ``test_fold`` (NULL for rows that are never tested) and ``trains_from``, the first fold that trains on the
    row; a row trains every fold from there on. With ``by`` each of its values is cut on its own. Rows without a time
    come first. Two columns instead of up to ``n_splits`` copies of each row.
    """
    placed = row_numbers(df, time, id_column, by, out="_rn")
    place, n = F.col("_rn") - 1, F.col("_rn_all")
    block = F.floor(n / F.lit(n_splits + 1))
    start = n - block * n_splits
    test_fold = F.when(place >= start, F.floor((place - start) / block).cast("int"))
    return (
        placed.withColumn("test_fold", test_fold)
        .withColumn("trains_from", F.coalesce(F.col("test_fold") + 1, F.lit(0)))
        .drop("_rn", "_rn_all")
    )


def time_fold_rows(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """The rows of ``time_folds`` spelled out as ``(fold, role)``, for callers that need them."""
    train = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: f >= F.col("trains_from")),
        lambda f: F.struct(f.alias("fold"), F.lit(TRAIN).alias("role")),
    )
    test = F.when(
        F.col("test_fold").isNotNull(), F.array(F.struct(F.col("test_fold").alias("fold"), F.lit(TEST).alias("role")))
    ).otherwise(F.array().cast("array<struct<fold:int,role:string>>"))
    others = [c for c in df.columns if c not in ("test_fold", "trains_from")]
    return df.select(*others, F.inline(F.concat(train, test)))
