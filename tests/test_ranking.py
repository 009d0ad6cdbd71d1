import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from screenspark.operators import ranking as R
from screenspark.operators.joins import join_keyed, join_small


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, and one of two strata holds most rows."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(50.0)).otherwise((F.col("id") * 7919 % 1000) / 10.0)
    return spark.range(6000).select("id", hot.alias("v"), (F.col("id") % 10 == 0).cast("int").alias("s"))


def test_row_numbers_equal_the_plain_window(skewed):
    got = R.row_numbers(skewed, "v", "id", ["s"], buckets=64)
    plain = F.row_number().over(Window.partitionBy("s").orderBy("v", "id"))
    assert got.withColumn("p", plain).where("p <> rn").count() == 0
    assert rows(got.select("s", "rn_all").distinct()) == [(0, 5400), (1, 600)]


def test_hot_value_is_cut_by_the_tie_column(skewed):
    sizes = R.value_buckets(skewed, "v", "id", 64).groupBy(R.B1, R.B2).count()
    assert sizes.agg(F.max("count")).first()[0] < 6000 / 10
    without = R.value_buckets(skewed, "v", None, 64).groupBy(R.B1, R.B2).count()
    assert without.agg(F.max("count")).first()[0] >= 2000


def test_time_and_date_order(spark):
    df = spark.range(500).select(
        "id", F.timestamp_seconds(F.lit(1700000000) + (F.col("id") * 37) % 500 * 4000).cast("timestamp_ntz").alias("t")
    )
    plain = F.row_number().over(Window.orderBy("t", "id"))
    assert R.row_numbers(df, "t", "id").withColumn("p", plain).where("p <> rn").count() == 0
    with pytest.raises(TypeError):
        R.row_numbers(df.withColumn("x", F.lit("a")), "x", "id")


def test_shuffled_numbers_are_a_permutation_and_repeat(skewed):
    got = R.shuffled_numbers(skewed, "id", 1, ["s"])
    counts = got.groupBy("s").agg(F.count_distinct("rn").alias("n"), F.min("rn"), F.max("rn"))
    assert rows(counts) == [(0, 5400, 1, 5400), (1, 600, 1, 600)]
    again = R.shuffled_numbers(skewed.repartition(3), "id", 1, ["s"])
    assert rows(got, "id", "rn") == rows(again, "id", "rn")
    other = R.shuffled_numbers(skewed, "id", 2, ["s"])
    assert rows(got, "id", "rn") != rows(other, "id", "rn")


def test_no_single_task_window_over_rows(skewed):
    plan = R.shuffled_numbers(skewed, "id", 1, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles_interpolate(spark, skewed, p):
    got = {r["s"]: r["q"] for r in R.exact_quantiles(skewed, ["s"], "v", {"q": p}, 64).collect()}
    local = skewed.toPandas()
    for s in (0, 1):
        assert got[s] == pytest.approx(np.quantile(local[local.s == s].v, p))


def test_tiny_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "v double")
    row = R.exact_quantiles(df, [], "v", {"q1": 0.25, "m": 0.5}).first()
    assert (row["n"], row["q1"], row["m"]) == (4, 1.75, 3.0)


def test_scan_numbers_are_contiguous(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    got = R.scan_numbers(spark.read.parquet(str(tmp_path / "t")))
    row = got.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first()
    assert tuple(row) == (1000, 1, 1000)


def test_joins_keep_every_row(spark, skewed, monkeypatch):
    keyed = skewed.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    plain = skewed.join(keyed, "v")
    assert rows(join_keyed(skewed, keyed, ["v"], "n", 6000), "id", "first") == rows(plain, "id", "first")
    assert rows(join_small(skewed, keyed, ["v"]), "id", "first") == rows(plain, "id", "first")
    monkeypatch.setattr("screenspark.operators.joins.SMALL_ROWS", 3)
    assert rows(join_small(skewed, keyed, ["v"]), "id", "first") == rows(plain, "id", "first")
