"""Feature selection: correlation filter, binned mutual information, ANOVA F, forest importance, and their chain."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.common import _java2py
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from screenspark.operators.jvm_fit import fit_in_jvm
from screenspark.operators.prep import _moments_row, doubles, numbers, pick_features

#: Columns of a tile of the correlation matrix, and pairs of tiles whose sums a task holds (2 MB each).
TILE, TILE_PAIRS = 512, 64
#: Rows from which on those of a forest are dealt out evenly, and rows of a partition at most, about.
SPREAD_ROWS, PARTITION_ROWS = 100_000, 1_000_000
#: Sums that all tasks together send, about (16 GB).
SENT_NUMBERS = 4 << 30

# Defaults of the selection chain and of the F filter.
CORRELATION_LIMIT = 0.90
UNIVARIATE_K = 500
MODEL_TOP_N = 150
F_TOP_K = 1000
IMPORTANCE_TREES = 100


def row_slices(df: DataFrame, features: str, width: int, group: Column | None = None) -> DataFrame:
    """``(v)``: the feature arrays cut into slices of TILE numbers, slice by slice and row by row, so that a batch of rows is
    bounded however wide the features are. With ``group``, ``(g, v)``."""
    starts = F.sequence(F.lit(1), F.lit(width), F.lit(TILE))
    slices = F.transform(starts, lambda s: F.slice(F.col("_x"), s, F.lit(TILE)))
    g = [] if group is None else [group.cast("int").alias("g")]
    known = df.where(F.col(features).isNotNull()).select(*g, doubles(features).alias("_x"))
    return known.select(*(["g"] if g else []), F.explode(slices).alias("v"))


def _tile_products(pairs: list[tuple[int, int]], mean: dict[int, np.ndarray], scale: dict[int, np.ndarray]):
    """Sums of products of standardised columns, over the rows of every group in a task, for some pairs of column tiles."""
    width = len(next(iter(mean.values())))
    tile, tiles = min(TILE, width), -(-width // TILE)

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        slices, groups = [], np.zeros(0, int)
        for frame in frames:
            slices += list(frame["v"])
            groups = np.concatenate([groups, frame["g"]])
            whole = len(slices) // tiles * tiles
            if not whole:
                continue
            flat = np.concatenate(slices[:whole]).astype(np.float64).reshape(-1, width)  # missing numbers become NaN
            own = groups[:whole:tiles]
            slices, groups = slices[whole:], groups[whole:]
            for g in np.unique(own).tolist():
                rows = ((flat if len(mean) == 1 else flat[own == g]) - mean[g]) / scale[g]
                of_group = sums.setdefault(g, {pair: np.zeros((tile, tile)) for pair in pairs})
                for i, j in pairs:
                    part = rows[:, i * tile : (i + 1) * tile].T @ rows[:, j * tile : (j + 1) * tile]
                    of_group[i, j][: part.shape[0], : part.shape[1]] += part
        for g, of_group in sums.items():
            for (i, j), total in of_group.items():
                for start in range(0, tile, 64):
                    rows = np.arange(start, min(start + 64, tile))
                    yield pd.DataFrame({"g": g, "i": i, "j": j, "r": rows, "v": list(total[rows])})

    return of_frames


def correlation_rows(df: DataFrame, features: str, tile_pairs: int = TILE_PAIRS, by: str | None = None) -> DataFrame:
    """``(column, first, correlations)``: the Pearson correlations of a feature with TILE features from place ``first`` on.

    Every pair of features is there with the earlier one as ``column`` (further ones of the same tile are repeated). The
    columns are cut into tiles; a task adds the products of at most ``tile_pairs`` pairs of tiles over its rows, and the sums
    of tasks are added by key, so neither a task nor the driver ever holds the matrix. Features with a missing or
    infinite number have NaN with all others, constant ones 0. ``by``, a column of a few whole numbers, gives the correlations
    within each group, as ``(by, column, first, correlations)``, from the same passes.
    """
    grouped = df.where(F.col(by).isNotNull()) if by else df
    moments = {(r[by] if by else 0): r for r in _moments_row(grouped, features, [by] if by else []).collect()}
    width = len(next(iter(moments.values()))["mean"])
    mean = {g: np.array(r["mean"]) for g, r in moments.items()}
    scale = {g: np.sqrt(np.array(r["variance"])) for g, r in moments.items()}
    for deviations in scale.values():
        deviations[deviations == 0] = np.inf  # a constant has no correlation
    tiles = -(-width // TILE)
    pairs = [(i, j) for i in range(tiles) for j in range(i, tiles)]
    # Every task sends its sums, so wide features are added up in fewer tasks.
    slices = row_slices(grouped, features, width, F.col(by) if by else F.lit(0))
    slices = slices.coalesce(max(8, SENT_NUMBERS // (width**2 * len(moments))))
    at_once = max(1, tile_pairs // len(moments))
    parts = None
    for start in range(0, len(pairs), at_once):
        products = _tile_products(pairs[start : start + at_once], mean, scale)
        part = slices.mapInPandas(products, "g int, i int, j int, r int, v array<double>")
        parts = part if parts is None else parts.unionByName(part)
    sums = F.transform("v", lambda x: F.coalesce(x, F.lit(float("nan"))))  # Arrow took undefined ones as missing
    added = parts.groupBy("g", "i", "j", "r").agg(Summarizer.sum(array_to_vector(sums)).alias("v"))
    n = F.element_at(F.create_map(*[F.lit(v) for g, r in moments.items() for v in (int(g), float(r["n"]))]), F.col("g"))
    return added.select(
        *([F.col("g").alias(by)] if by else []),
        (F.col("i") * TILE + F.col("r")).alias("column"),
        (F.col("j") * TILE).alias("first"),
        F.transform(vector_to_array("v"), lambda s: s / n).alias("correlations"),
    ).where(F.col("column") < width)


def _later_correlated(rows: DataFrame, limit: float, by: Sequence[str]) -> DataFrame:
    """``(by..., later)``: the places above the limit with an earlier one."""
    flat = rows.select(*by, "column", F.posexplode("correlations").alias("k", "c"), "first")
    later = F.col("first") + F.col("k")
    above = flat.where((later > F.col("column")) & ~F.isnan("c") & (F.abs("c") > limit))
    return above.select(*by, later.alias("later")).distinct()


def correlated_features(df: DataFrame, features: str, limit: float = CORRELATION_LIMIT) -> list[int]:
    """Places whose absolute correlation with any earlier feature exceeds the limit.

    An earlier feature counts even if it is dropped itself. An undefined correlation drops nothing.
    """
    above = _later_correlated(correlation_rows(df, features), limit, [])
    return sorted(r["later"] for r in above.collect())  # one number per feature at most


def correlated_features_by(df: DataFrame, features: str, by: str, limit: float = CORRELATION_LIMIT) -> dict[int, list[int]]:
    """``correlated_features`` within each group of ``by``, a column of a few whole numbers; groups that drop nothing are left out."""
    found: dict[int, list[int]] = {}
    for r in _later_correlated(correlation_rows(df, features, by=by), limit, [by]).collect():  # one number per group and feature at most
        found.setdefault(r[by], []).append(r["later"])
    return {g: sorted(places) for g, places in found.items()}


def mutual_information(df: DataFrame, features: str, label: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """``(idx, mutual_information)`` in nats between the equal-width bin of each feature and the label.

    Bin limits are literals; the table is counted to (feature, bin, label) before it moves. ``by``, a column of a few whole
    numbers, gives the information within each group, as ``(by, idx, mutual_information)``.
    """
    group = [by] if by else []
    known = F.col(label).isNotNull() & F.col(features).isNotNull()
    vectors = df.where(known & F.col(by).isNotNull() if by else known)
    limits = vectors.select(*group, array_to_vector(doubles(features)).alias("v")).groupBy(*group).agg(
        Summarizer.metrics("min", "max").summary(F.col("v")).alias("s")
    )
    rows = limits.select(*group, vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi")).collect()
    widths = [[(hi - lo) / bins if hi > lo else 1.0 for lo, hi in zip(r["lo"], r["hi"])] for r in rows]

    def own(values: Sequence[Sequence[float]]) -> Column:
        """The number of the row's group and feature."""
        if not by:
            return F.get(numbers(values[0]), F.col("idx"))
        of_groups = F.create_map(*[c for r, v in zip(rows, values) for c in (F.lit(r[by]), numbers(v))])
        return F.get(F.element_at(of_groups, F.col(by)), F.col("idx"))

    if not rows:  # no group has a row
        return vectors.select(*group, F.lit(0).alias("idx"), F.lit(0.0).alias("mutual_information"))
    place = (F.col("_v") - own([r["lo"] for r in rows])) / own(widths)
    counts = (
        vectors.select(*group, F.col(label).alias("_y"), F.posexplode(doubles(features)).alias("idx", "_v"))
        .select(*group, "idx", "_y", F.least(F.floor(place), F.lit(bins - 1)).cast("int").alias("_bin"))
        .groupBy(*group, "idx", "_bin", "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # At most bins x labels rows per feature from here on.
    per_feature = Window.partitionBy(*group, "idx")
    n = F.sum("_n").over(per_feature)
    n_bin = F.sum("_n").over(Window.partitionBy(*group, "idx", "_bin"))
    n_label = F.sum("_n").over(Window.partitionBy(*group, "idx", "_y"))
    part = F.col("_n") / n * F.log(F.col("_n") * n / (n_bin * n_label))
    return counts.withColumn("_part", part).groupBy(*group, "idx").agg(F.sum("_part").alias("mutual_information"))


def anova_f(df: DataFrame, features: str, label: str) -> DataFrame:
    """``(idx, f_value)``: spread between class means over spread within classes.

    Infinite for a feature that is constant within every class but not overall, NULL for a constant one.
    """
    known = df.where(F.col(label).isNotNull())
    moments = _moments_row(known, features, [label])
    long = moments.select(
        F.col("n").cast("double").alias("n"),
        F.posexplode(F.arrays_zip("mean", "variance")).alias("idx", "m"),
    ).select("idx", "n", F.col("m.mean").alias("mean"), F.col("m.variance").alias("variance"))
    # One row per class and feature.
    per_feature = Window.partitionBy("idx")
    overall = F.sum(F.col("n") * F.col("mean")).over(per_feature) / F.sum("n").over(per_feature)
    sums = (
        long.withColumn("_overall", overall)
        .groupBy("idx")
        .agg(
            F.sum(F.col("n") * (F.col("mean") - F.col("_overall")) * (F.col("mean") - F.col("_overall"))).alias("b"),
            F.sum(F.col("n") * F.col("variance")).alias("w"),
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("k"),
        )
    )
    between = F.try_divide(F.col("b"), (F.col("k") - 1).cast("double"))
    within = F.try_divide(F.col("w"), F.col("n") - F.col("k"))
    perfect = (F.col("b") > 0) & (F.col("w") == 0)
    f_value = F.when(perfect, F.lit(float("inf"))).otherwise(F.try_divide(between, within))
    return sums.select("idx", f_value.alias("f_value"))


def top_features(scores: DataFrame, value: str, k: int) -> DataFrame:
    """The k features of highest score, the first place winning ties."""
    return scores.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), "idx").limit(k)


def f_selection_size(width: int) -> int:
    return min(F_TOP_K, width // 2)


def with_classes(table: DataFrame, label: str, largest: float | None) -> DataFrame:
    """The table, told how many classes its label column has, by its largest label; a classifier needs no pass to find out."""
    if largest is None or not 0 <= largest < 100 or largest != int(largest):
        return table  # left to the classifier to complain
    return table.withMetadata(label, {"ml_attr": {"type": "nominal", "num_vals": int(largest) + 1}})


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """The rows of a table in even partitions, one per core at least; a table below SPREAD_ROWS rows as it is.

    Files may have a single large row group, whose rows one task would pass for every level of every tree. Within partitions
    rows are sorted, so that draws by place are the same in every run. ``n`` is the number of rows if it is known.
    """
    n = df.count() if n is None else n
    if n < SPREAD_ROWS:
        return df
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PARTITION_ROWS))
    return df.repartition(parts).sortWithinPartitions(*df.columns)


def label_facts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, largest)``: known labels and the largest one."""
    known = df.where(F.col(label).isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(label).cast("double")).alias("largest"))


def forest_importance(
    df: DataFrame, features: str, label: str, trees: int = IMPORTANCE_TREES, seed: int = 42, facts: Row | None = None
) -> list[float]:
    """Importance of each feature in a random forest. ``facts`` is the row of ``label_facts``, if it is known."""
    rows = df.where(F.col(label).isNotNull()).select(doubles(features).alias("_x"), F.col(label).cast("double").alias("_y"))
    facts = facts or label_facts(df, label).first()
    vectors = spread(rows, facts["n"]).select(array_to_vector("_x").alias("_v"), "_y")
    forest = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=10, seed=seed)
    fitted = fit_in_jvm(forest, with_classes(vectors, "_y", facts["largest"]))
    return _java2py(df.sparkSession.sparkContext, fitted.java_model.featureImportances()).toArray().tolist()


@dataclass(frozen=True)
class SelectionSettings:
    correlation_limit: float = CORRELATION_LIMIT
    univariate_k: int = UNIVARIATE_K
    model_top_n: int = MODEL_TOP_N
    importance_trees: int = IMPORTANCE_TREES
    seed: int = 42


@dataclass(frozen=True)
class Selection:
    """Chosen places and names, and what each step kept and removed."""

    places: list[int]
    names: list[str]
    history: list[tuple[str, str, bool, float | None]] = field(default_factory=list)

    def transform(self, df: DataFrame, features: str) -> DataFrame:
        return pick_features(df, features, self.places)

    def history_table(self, df: DataFrame) -> DataFrame:
        schema = "step string, feature string, kept boolean, score double"
        return df.sparkSession.createDataFrame(self.history, schema)


def _univariate(
    names: Sequence[str], dropped: Sequence[int], scores: Mapping[int, float], settings: SelectionSettings
) -> tuple[list[int], list[tuple[str, str, bool, float | None]]]:
    """Places left after the first two steps, and the history of these steps. ``scores`` are by place."""
    history: list[tuple[str, str, bool, float | None]] = [("correlation", n, i not in set(dropped), None) for i, n in enumerate(names)]
    best = sorted(scores, key=lambda i: (-scores[i], i))[: settings.univariate_k]
    history += [("univariate", names[i], i in set(best), scores[i]) for i in sorted(scores)]
    return sorted(best), history


def _by_forest(
    df: DataFrame,
    features: str,
    label: str,
    names: Sequence[str],
    places: Sequence[int],
    history: Sequence,
    settings: SelectionSettings,
    facts: Row | None = None,
) -> Selection:
    """The last step, over the places that the others left."""
    kept = pick_features(df, features, places)
    importance = forest_importance(kept, features, label, settings.importance_trees, settings.seed, facts)
    order = sorted(range(len(places)), key=lambda i: (-importance[i], i))[: settings.model_top_n]
    last = [("model", names[p], i in set(order), importance[i]) for i, p in enumerate(places)]
    chosen = [places[i] for i in order]
    return Selection(chosen, [names[p] for p in chosen], [*history, *last])


def fit_selection(
    df: DataFrame, features: str, label: str, names: Sequence[str], settings: SelectionSettings = SelectionSettings()
) -> Selection:
    """Correlation filter, then the best by mutual information, then the best by forest importance."""
    dropped = correlated_features(df, features, settings.correlation_limit)
    places = [i for i in range(len(names)) if i not in set(dropped)]
    kept = pick_features(df, features, places)
    scores = {places[r["idx"]]: r["mutual_information"] for r in mutual_information(kept, features, label).collect()}
    places, history = _univariate(names, dropped, scores, settings)
    return _by_forest(df, features, label, names, places, history, settings)


def fit_selections(
    df: DataFrame,
    features: str,
    label: str,
    names: Sequence[str],
    fold: str,
    left_out: Sequence[int | None],
    settings: SelectionSettings = SelectionSettings(),
    run_all: Callable = lambda run, items: [run(i) for i in items],
) -> dict[int | None, Selection]:
    """``fit_selection`` for the training side of several folds: the rows of all folds but the one ``left_out`` (None: of all).

    The correlations of all sides come from the same passes, and so does their mutual information; only the forests are fitted
    side by side, by ``run_all(function, items)``.
    """
    sides = [F.lit(True) if f is None else F.col(fold) != f for f in left_out]
    of_row = F.array_compact(F.array(*[F.when(inside, F.lit(k)) for k, inside in enumerate(sides)]))
    sided = df.select(features, label, F.explode(of_row).alias("_side"))
    dropped = correlated_features_by(sided, features, "_side", settings.correlation_limit)
    kept = [set(range(len(names))) - set(dropped.get(k, [])) for k in range(len(sides))]
    some = sorted(set().union(*kept))  # kept by a side at least
    information = mutual_information(pick_features(sided, features, some), features, label, by="_side")
    scores: list[dict[int, float]] = [{} for _ in sides]
    for r in information.collect():
        if (place := some[r["idx"]]) in kept[r["_side"]]:
            scores[r["_side"]][place] = r["mutual_information"]
    facts = {r["_side"]: r for r in label_facts(sided, label, ["_side"]).collect()}
    first = [_univariate(names, dropped.get(k, []), scores[k], settings) for k in range(len(sides))]

    def last(k: int) -> Selection:
        return _by_forest(df.where(sides[k]), features, label, names, *first[k], settings, facts[k])

    return dict(zip(left_out, run_all(last, list(range(len(sides))))))


def features_by_name(df: DataFrame, features: str, names: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Features in the wanted order; a name the table lacks becomes 0 and is counted in ``n_missing``."""
    place = {n: i for i, n in enumerate(names)}
    values = doubles(features)
    picked = [F.get(values, F.lit(place[n])) if n in place else F.lit(0.0) for n in wanted]
    missing = sum(n not in place for n in wanted)
    return df.withColumn(features, F.array(*picked)).withColumn("n_missing", F.lit(missing))
