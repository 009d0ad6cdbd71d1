import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from screenspark.operators import split as X


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(523).select(
        "id",
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("target"),
        (F.col("id") % 7 == 0).cast("int").alias("label"),
    )


def test_folds_are_stratified_and_balanced(labels):
    folds = X.stratified_folds(labels, "id", "label", ["target"])
    assert folds.count() == 523
    for keys in (["target"], ["target", "label"]):
        for r in folds.groupBy(*keys, "fold").count().groupBy(*keys).agg(F.max("count") - F.min("count")).collect():
            assert r[-1] <= 1


def test_repeats_differ(labels):
    folds = X.stratified_folds(labels, "id", "label", ["target"], n_repeats=2)
    one, two = (rows(folds.where(F.col("repeat") == i), "id", "fold") for i in (0, 1))
    assert len(one) == len(two) == 523 and one != two


def test_nested_folds_partition_each_training_side(labels):
    nested = X.nested_folds(labels, "id", "label", ["target"])
    assert nested.count() == 5 * 523
    assert nested.where("role = 'test'").groupBy("id").count().where("count <> 1").count() == 0
    assert nested.where("role = 'train' and inner_fold is null").count() == 0
    sizes = nested.where("role = 'train'").groupBy("target", "outer_fold", "label", "inner_fold").count()
    spread = sizes.groupBy("target", "outer_fold", "label").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.where("d > 1").count() == 0


def test_holdout_counts_are_exact(labels):
    out = X.stratified_holdout(labels, "id", "label", ["target"], 0.2, 0.2, folds=3)
    sizes = {(r["target"], r["part"]): r["count"] for r in out.groupBy("target", "part").count().collect()}
    # 262 and 261 rows: a fifth rounded up for the test part, then a quarter of the rest rounded up
    assert sizes["a", "test"] == 53 and sizes["a", "val"] == 53 and sizes["a", "train"] == 156
    assert out.where("part <> 'train' and fold is not null").count() == 0
    spread = out.where("part = 'train'").groupBy("target", "label", "fold").count()
    spread = spread.groupBy("target", "label").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.where("d > 1").count() == 0


def test_exact_fifth_is_not_rounded_up(spark):
    df = spark.range(35).select("id", F.lit(1).alias("label"))
    out = X.stratified_holdout(df, "id", "label")
    assert out.where("part = 'test'").count() == 7


def test_small_strata_are_pooled(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 5), (4, 9)], "id int, n int")
    merged = {r["id"]: r["n"] for r in X.merge_small_strata(df, "n").collect()}
    assert merged == {1: 0, 2: 0, 3: -1, 4: -1}


def greedy(counts, k):
    weights, folds = [0] * k, []
    for size, n in sorted(counts, reverse=True):
        for _ in range(n):
            f = weights.index(min(weights))
            weights[f] += size
            folds.append((size, f))
    return folds


def spelled_out(plan, counts):
    sizes, out = dict(counts), []
    for size, runs in plan:
        starts = [s for s, _ in runs] + [sizes[size]]
        for (start, folds), after in zip(runs, starts[1:]):
            out += [(size, folds[i % len(folds)]) for i in range(after - start)]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_dealing_equals_the_plain_greedy_rule(seed):
    draw = random.Random(seed)
    counts = [(s, draw.randint(1, 300)) for s in draw.sample(range(1, 60), draw.randint(1, 6))]
    if seed % 3 == 0:
        counts.append((draw.randint(500, 5000), 1))
    k = draw.randint(2, 6)
    plan = X._deal(counts, k)
    assert spelled_out(plan, counts) == greedy(counts, k)


def test_dealing_takes_whole_rounds():
    plan = X._deal([(1, 10_000_000), (3_000_000, 1)], 5)
    assert sum(len(runs) for _, runs in plan) < 60


def test_group_folds_with_a_hot_group(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, "hot").otherwise((F.col("id") % 37).cast("string")).alias("g")
    )
    folds = X.group_folds(df, "g", 5)
    assert folds.count() == 3000
    assert folds.select("g", "fold").distinct().groupBy("g").count().where("count > 1").count() == 0
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes[-1] == 1000 and sizes[0] > 400
    report = X.group_fold_report(folds, "g").collect()
    assert all(r["n_test"] + r["n_train"] == 3000 and r["n_test_groups"] + r["n_train_groups"] == 38 for r in report)
    with pytest.raises(ValueError):
        X.group_folds(df.withColumn("g", F.lit("x")), "g", 2)


def test_tiny_groups(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate("AAAAABBBBCCCDDE")], "id int, g string")
    sizes = sorted(r["count"] for r in X.group_folds(df, "g", 3).groupBy("fold").count().collect())
    assert sizes == [5, 5, 5]


@pytest.mark.parametrize("n,k", [(23, 5), (12, 3)])
def test_time_folds(spark, n, k):
    df = spark.range(n).select("id", (F.lit(1000) - F.col("id")).alias("t"))
    folds = X.time_folds(df, "t", "id", k)
    spelled = X.time_fold_rows(folds, k)
    block = n // (k + 1)
    order = sorted(range(n), key=lambda i: 1000 - i)
    for f in range(k):
        start = n - block * (k - f)
        mine = spelled.where(F.col("fold") == f)
        assert {r["id"] for r in mine.where("role = 'test'").collect()} == set(order[start : start + block])
        assert {r["id"] for r in mine.where("role = 'train'").collect()} == set(order[:start])
