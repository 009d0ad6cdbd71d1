import pytest
from conftest import rows
from pyspark.sql import functions as F

from screenspark.functions import scalars as S
from screenspark.functions.draws import draw32, draw_unit


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_lenient_cast_takes_numbers_only(spark):
    values = ["1", " 2.5 ", "-1e3", "1d", "0x1", "maybe", "", None, "NaN", ".5", "5."]
    assert one(spark, values, S.lenient_double) == [1.0, 2.5, -1000.0] + [None] * 6 + [0.5, 5.0]


def test_label_words(spark):
    values = ["Active", "0", "yes", "maybe", "", None, "FALSE", "1", "no", "true"]
    assert one(spark, values, S.label_flag) == [1, 0, 1, None, None, None, 0, 1, 0, 1]


def test_first_present_keeps_a_present_empty_value(spark):
    df = spark.sql("select map('Activity_T', '', 'T2', 'x') as m")
    names = ["T", "Activity_T", "T2"]
    assert df.select(S.first_present("m", names).alias("v")).first()["v"] == ""
    assert df.select(S.first_present("m", ["a", "b"]).alias("v")).first()["v"] is None


def test_class_limits_are_half_open(spark):
    got = one(spark, [0.0, 0.3, 0.69, 0.7, 1.0, None], S.class_of, "double")
    assert got == ["Non-toxic", "Moderate", "Moderate", "Toxic", "Toxic", None]
    assert one(spark, [0.5, 0.51], S.decision, "double") == [0, 1]
    assert one(spark, [0.0, 0.5, 0.75], S.confidence, "double") == [1.0, 0.0, 0.5]


def test_status_texts(spark):
    df = spark.createDataFrame([(2, 0), (0, 2), (1, 2)], "p int, f int")
    got = {r["s"] for r in df.select(S.pass_status(F.col("p"), F.col("f")).alias("s")).collect()}
    assert got == {"ALL PASS", "ALL FAIL", "1/3 PASS"}


def test_finite_and_ratios(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.5, None]
    assert one(spark, values, S.finite_or_null, "double") == [None, None, None, 1.5, None]
    assert one(spark, [0.0, 4.0], lambda v: S.ratio(F.lit(2), v), "double") == [None, 0.5]
    assert one(spark, [0.0, 4.0], lambda v: S.guarded_ratio(F.lit(2.0), v), "double") == [2.0, 0.5]


def test_names_and_texts(spark):
    assert one(spark, ["NR-AhR"], S.plain_name) == ["nr_ahr"]
    assert one(spark, ["a" * 51, "b" * 50], S.shorten) == ["a" * 50 + "...", "b" * 50]
    assert one(spark, [0.5], lambda v: S.mean_spread_text(v, F.lit(0.0314)), "double") == ["0.500 ± 0.031"]


def test_structure_text_check(spark):
    values = ["CC(=O)O", "CC(", "", None, "a b", "C[N+](C)C"]
    assert one(spark, values, S.balanced_brackets) == [True, False, False, False, False, True]


def test_rules(spark):
    df = spark.createDataFrame([(500.0, 5.1, 5, None)], "molecular_weight double, logp double, hbd int, hba int")
    assert df.select(S.rules_met(S.RULE_OF_FIVE).alias("n")).first()["n"] == 2
    with pytest.raises(ValueError):
        S.Rule("x", "logp", "~", 1).holds()


def test_draws_repeat_and_spread(spark):
    df = spark.range(4000).select("id", draw32(7, "id").alias("d"), draw_unit(7, "id").alias("u"))
    assert rows(df) == rows(df)
    row = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.02
