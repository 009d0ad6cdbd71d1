import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.operators import blocks
from screenspark.operators import prep as E
from screenspark.operators import select as S


def matrix(spark, data, extra=None):
    rows = [(i, [None if v is None else float(v) for v in r], *(extra[i] if extra else ())) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "id int, x array<double>" + (", y int" if extra else ""))


def values(df):
    return [r["x"] for r in df.orderBy("id").collect()]


def test_imputation(spark):
    inf, nan = math.inf, math.nan
    df = matrix(spark, [(1, inf, None), (3, 2, nan), (None, 4, None), (8, -inf, inf)])
    medians = E.fit_medians(df, "x")
    assert medians == [3.0, 3.0, 0.0]
    assert values(E.fill_missing(df, "x", medians)) == [[1, 3, 0], [3, 2, 0], [3, 4, 0], [8, 3, 0]]


def test_scaling_uses_the_population_deviation(spark):
    data = np.array([[1.0, 5, 7], [2, 5, 9], [6, 5, 2]])
    df = matrix(spark, data)
    moments = E.fit_moments(df, "x")
    assert moments.variance == pytest.approx(list(data.var(axis=0)))
    got = np.array(values(E.standardise(df, "x", moments)))
    spread = np.where(data.std(axis=0) > 0, data.std(axis=0), 1)
    assert got == pytest.approx((data - data.mean(axis=0)) / spread)
    assert E.variable_features(moments, 0.01) == [0, 2]
    assert values(E.pick_features(df, "x", [2, 0]))[0] == [7, 1]
    robust = np.array(values(E.robust_scale(df, "x", E.fit_robust(df, "x"))))
    q = np.quantile(data, [0.25, 0.5, 0.75], axis=0)
    assert robust == pytest.approx((data - q[1]) / np.where(q[2] > q[0], q[2] - q[0], 1))


def test_fold_moments_leave_their_fold_out(spark):
    draw = np.random.default_rng(0)
    data = draw.normal(1000, 3, (60, 4))
    df = matrix(spark, data).withColumn("fold", F.pmod("id", F.lit(3)))
    for f, m in E.fit_fold_moments(df, "x", "fold").items():
        train = data[[i for i in range(60) if i % 3 != f]]
        assert m.count == 40 and m.mean == pytest.approx(list(train.mean(axis=0)))
        assert m.variance == pytest.approx(list(train.var(axis=0)))


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("a", 0), ("b", 1), ("a", None)], "target string, label int")
    got = {(r["target"], r["label"]): r["weight"] for r in E.class_weights(df).collect()}
    assert got == {("a", 1): 2.0, ("a", 0): pytest.approx(4 / 6), ("b", 1): 1.0}
    assert E.with_weights(df).count() == 5


def test_correlation_filter_counts_dropped_columns(spark):
    draw = np.random.default_rng(1)
    a = draw.normal(size=200)
    b = a + draw.normal(scale=0.3, size=200)
    c = b + draw.normal(scale=0.3, size=200)
    data = np.stack([a, b, c, -a, np.full(200, 2.0), draw.normal(size=200)], axis=1) + 1e6
    corr = np.corrcoef(data[:, [0, 1, 2]].T)
    limit = (max(corr[0, 2], 0) + min(corr[0, 1], corr[1, 2])) / 2
    # c is close to b only; b is dropped because of a, and still drops c
    assert corr[0, 2] < limit < corr[1, 2]
    assert S.correlated_features(matrix(spark, data), "x", limit) == [1, 2, 3]


@pytest.mark.parametrize("tile, pairs", [(3, 64), (3, 2), (512, 64)])
def test_correlations_in_tiles(spark, monkeypatch, tile, pairs):
    monkeypatch.setattr(S, "TILE", tile)
    draw = np.random.default_rng(8)
    data = draw.normal(5, 2, (90, 10)) @ draw.normal(size=(10, 10))
    data[:, 4] = 7.0
    expected = np.corrcoef(np.delete(data, 4, axis=1).T)
    expected = np.insert(np.insert(expected, 4, 0, axis=0), 4, 0, axis=1)
    got = np.full((10, 10), np.nan)
    for r in S.correlation_rows(matrix(spark, data).repartition(4), "x", pairs).collect():
        width = min(tile, 10 - r["first"])
        got[r["column"], r["first"] : r["first"] + width] = r["correlations"][:width]
    upper = np.triu_indices(10, 1)
    assert got[upper] == pytest.approx(expected[upper], abs=1e-9)
    assert S.correlated_features(matrix(spark, data), "x", 0.3) == [j for j in range(10) if (np.abs(expected[:j, j]) > 0.3).any()]


def test_wide_features_are_filtered(spark):
    wide = spark.range(12).coalesce(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(11_999)), lambda k: F.pmod(F.xxhash64("id", k % 11_000), F.lit(1000)).cast("double")).alias("x"))
    draws = np.array([r["x"] for r in wide.select(F.slice("x", 1, 300).alias("x")).collect()])
    found = S.correlated_features(wide, "x", 0.999999)
    assert found == list(range(11_000, 12_000)) and (np.triu(np.corrcoef(draws.T), 1) < 0.9999).all()


def test_missing_numbers_drop_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, float("nan"), 2.0]), (2, [2.0, 2.0, 3.0, 4.0]), (3, [3.0, 3.5, 4.0, 6.0]), (4, None)], "id int, x array<double>")
    assert S.correlated_features(df, "x", 0.9) == [1, 3]


def test_mutual_information_and_f(spark):
    data = [(i % 2, (i // 2) % 2, 1, i % 2 + (i % 5) / 100) for i in range(40)]
    df = matrix(spark, data, [(i % 2,) for i in range(40)])
    mi = {r["idx"]: r["mutual_information"] for r in S.mutual_information(df, "x", "y").collect()}
    assert mi[0] == pytest.approx(math.log(2)) and mi[3] == pytest.approx(math.log(2))
    assert mi[1] == pytest.approx(0, abs=1e-12) and mi[2] == pytest.approx(0, abs=1e-12)
    f = {r["idx"]: r["f_value"] for r in S.anova_f(df, "x", "y").collect()}
    assert f[0] == math.inf and f[2] is None and f[1] == pytest.approx(0) and f[3] > 1000
    assert [r["idx"] for r in S.top_features(S.anova_f(df, "x", "y"), "f_value", 2).collect()] == [0, 3]


def test_selection_chain(spark):
    draw = np.random.default_rng(2)
    y = draw.integers(0, 2, 300)
    signal = y + draw.normal(scale=0.3, size=300)
    data = np.stack([signal, signal * 2 + 1, *draw.normal(size=(5, 300))], axis=1)
    df = matrix(spark, data, [(int(v),) for v in y])
    names = ["signal", "copy", "n1", "n2", "n3", "n4", "n5"]
    got = S.fit_selection(df, "x", "y", names, S.SelectionSettings(univariate_k=4, model_top_n=2, importance_trees=10))
    assert got.names[0] == "signal" and len(got.names) == 2 and "copy" not in got.names
    steps = {}
    for step, name, kept, _ in got.history:
        steps.setdefault(step, {})[name] = kept
    assert not steps["correlation"]["copy"] and sum(steps["univariate"].values()) == 4
    assert got.transform(df, "x").first()["x"][0] == pytest.approx(data[0, 0])
    assert got.history_table(df).count() == len(got.history)


def test_features_by_name(spark):
    df = matrix(spark, [(1, 2)])
    row = S.features_by_name(df, "x", ["a", "b"], ["b", "gone", "a"]).first()
    assert row["x"] == [2, 0, 1] and row["n_missing"] == 1


def test_blocks_side_by_side(spark):
    data = [(1, [0, 3], [1], 2.5, None), (2, [], None, float("nan"), 4), (3, [3, 5], [0, 1], 1.0, 0)]
    df = spark.createDataFrame(data, "id int, a array<int>, b array<int>, x double, y int")
    wide = blocks.assemble(df, {"one": ("a", 6), "two": ("b", 2)}, ["x", "y"], "f")
    names = blocks.feature_names(wide, "f")
    assert names == [*[f"one_{k}" for k in range(6)], "two_0", "two_1", "x", "y"] and wide.columns == [*df.columns, "f"]
    rows = np.array([r["f"].toArray() for r in wide.orderBy("id").collect()])
    assert rows.tolist() == [[1, 0, 0, 1, 0, 0, 0, 1, 2.5, 0], [0] * 9 + [4], [0, 0, 0, 1, 0, 1, 1, 1, 1, 0]]
    n, nonzeros, mean, variance = blocks.block_moments(wide, "f")
    assert n == 3 and nonzeros.tolist() == (rows != 0).sum(axis=0).tolist()
    assert mean == pytest.approx(rows.mean(axis=0)) and variance == pytest.approx(rows.var(axis=0))
    kept = blocks.variable_block(wide, "f", "v", 0.3)
    assert blocks.feature_names(kept, "v") == ["x", "y"]
    some = blocks.named_block(wide, "f", ["y", "one_3"], "v")
    assert blocks.feature_names(some, "v") == ["y", "one_3"] and [r["v"].toArray().tolist() for r in some.orderBy("id").collect()] == [[0, 1], [4, 0], [0, 1]]
    with pytest.raises(ValueError):
        blocks.variable_block(wide, "f", "v", 100.0)


def test_rows_of_a_forest_are_dealt_out_evenly(spark, monkeypatch):
    rows = spark.range(200).selectExpr("array(cast(id % 9 as double)) AS _x", "cast(id % 2 as double) AS _y").coalesce(1)
    assert S.spread(rows).rdd.getNumPartitions() == 1
    monkeypatch.setattr(S, "SPREAD_ROWS", 100)
    sizes = S.spread(rows).rdd.glom().map(len).collect()
    assert sum(sizes) == 200 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 2 * 200 / len(sizes)


def test_numbers_are_exact(spark):
    values = [0.0, -0.0, 1e-5, -1.5, 5e-324, 1e300, 0.1 + 0.2, float("inf"), float("-inf"), float("nan")]
    got = spark.range(1).select(E.numbers(values).alias("v")).first()["v"]
    assert [repr(v) for v in got] == [repr(v) for v in values]


def test_wide_correlations_within_groups(spark, monkeypatch):
    """Slices of rows of different groups come mixed; every row is added to its own group."""
    monkeypatch.setattr(S, "TILE", 3)
    draw = np.random.default_rng(4)
    data = draw.normal(size=(60, 7))
    data[::2, 5] = data[::2, 1] * 3 + 1
    data[1::2, 6] = 2.0
    df = spark.createDataFrame([(i % 2, [float(v) for v in x]) for i, x in enumerate(data)], "side int, x array<double>").coalesce(2)
    assert S.correlated_features_by(df, "x", "side") == {0: [5]}
    for g in (0, 1):
        rows = S.correlation_rows(df, "x", 2, "side").where(F.col("side") == g).collect()
        found = {(r["column"], r["first"] + k): c for r in rows for k, c in enumerate(r["correlations"])}
        part = data[g::2, :6] if g else data[g::2]
        matrix_of = np.corrcoef(part.T)
        for i in range(len(matrix_of)):
            for j in range(i, len(matrix_of)):
                assert found[i, j] == pytest.approx(matrix_of[i, j], abs=1e-9)
