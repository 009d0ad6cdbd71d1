import pytest
from conftest import rows
from pyspark.sql import functions as F

from screenspark.functions.scalars import Rule
from screenspark.operators import clean as C
from screenspark.operators import groups as G
from screenspark.operators import profile as P

TARGETS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def labels(spark):
    """b is never known, c has no positive row, row 8 has no label at all."""
    data = [
        (1, 1, None, 0, 1),
        (2, 1, None, 0, 1),
        (3, 0, None, 0, None),
        (4, 0, None, None, 1),
        (5, 0, None, 0, 0),
        (6, None, None, 0, 0),
        (7, 1, None, None, None),
        (8, None, None, None, None),
    ]
    return spark.createDataFrame(data, "id int, a int, b int, c int, d int")


def test_filters(labels):
    assert C.any_known(labels, TARGETS).count() == 7
    assert C.missing_labels(labels, ["a", "c", "d"], "drop").count() == 3
    assert C.missing_labels(labels, TARGETS, "impute").where("b = 0").count() == 8
    with pytest.raises(ValueError):
        C.missing_labels(labels, TARGETS, "guess")


def test_long_labels_and_eligibility(labels):
    long = C.long_labels(labels, ["id"], TARGETS)
    assert long.count() == 16
    assert rows(C.eligible_targets(long, 5, 2), "target") == [("a",), ("d",)]


def test_statistics(labels):
    long = C.long_labels(labels, ["id"], TARGETS, known_only=False)
    stats = {r["target"]: r for r in P.target_statistics(long).collect()}
    assert set(stats) == {"a", "c", "d"}
    assert stats["a"]["active_ratio"] == 0.5 and stats["a"]["imbalance_ratio"] == 1.0
    assert stats["c"]["imbalance_ratio"] is None
    analysis = {r["target"]: r for r in P.target_analysis(long).collect()}
    assert analysis["a"]["data_completeness"] == 0.75 and analysis["a"]["balanced"]
    assert not analysis["c"]["balanced"]
    summary = {r["target"]: r for r in P.target_summary(long).collect()}
    assert summary["b"]["total_samples"] == 0 and summary["b"]["positive_ratio"] is None


def test_missing_values(labels):
    got = {r["column_name"]: r["n_missing"] for r in P.missing_values(labels).collect()}
    assert got == {"a": 2, "b": 8, "c": 3, "d": 3}
    assert P.missing_label_cells(labels, TARGETS).first()[0] == 16


def test_fixed_schema_and_text(spark):
    df = spark.createDataFrame([(1, " x "), (2, ""), (3, None), (4, "nan")], "id int, t string")
    got = C.fixed_schema(df, {"t": "string", "id": "bigint", "gone": "double"})
    assert got.dtypes == [("t", "string"), ("id", "bigint"), ("gone", "double")]
    assert rows(C.with_text(df, "t", ("", "nan"), trim=True)) == [(1, "x")]
    assert C.with_text(df, "t").count() == 2


def test_class_differences_need_both_classes(spark, labels):
    table = labels.select("id", (F.col("id") * 10.0).alias("v"), F.lit(0.0).alias("z"))
    long = C.long_labels(labels, ["id"], TARGETS)
    got = {(r["target"], r["property"]): r for r in P.class_differences(long, table, "id", ["v", "z"]).collect()}
    assert set(got) == {(t, p) for t in "ad" for p in "vz"}
    assert got["a", "v"]["active_mean"] == pytest.approx(100 / 3)
    assert got["a", "z"]["pct_difference"] == 0


def test_rule_compliance(spark, labels):
    table = labels.select("id", F.col("id").alias("v"))
    rules = [Rule("low", "v", "<=", 4), Rule("odd", "v", ">", 2)]
    got = {r["rule"]: r["n_compliant"] for r in P.rule_compliance(table, rules).collect()}
    assert got == {"low": 4, "odd": 6, "all_rules": 2, "all_but_one": 8, "all_but_two": 8}
    long = C.long_labels(labels, ["id"], TARGETS)
    by_class = P.rule_compliance_by_class(long, table, "id", rules)
    assert {r["target"] for r in by_class.collect()} == {"a", "d"}


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 9.0, 10.0)], "v double")
    assert rows(P.histogram(df, "v", 5), "bin", "n") == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 2)]
    total = sum(r["density"] * (r["bin_to"] - r["bin_from"]) for r in P.histogram(df, "v", 5).collect())
    assert total == pytest.approx(1)
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r["n"] for r in P.histogram(flat, "v", 4).collect()) == 2


def test_box_table(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)], "g string, v double")
    row = P.box_table(df, ["g"], "v").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["n_outside"]) == (1.0, 4.0, 1)


def test_correlation_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "a double, b double, k double")
    got = {(r["row"], r["column"]): r["corr"] for r in P.correlation_pairs(df, ["a", "b", "k"]).collect()}
    assert got["b", "a"] == pytest.approx(0.9979, abs=1e-3)
    assert got["k", "a"] is None and got["k", "b"] is None


def test_groups(spark, labels):
    groups = labels.select("id", F.when(F.col("id") <= 6, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    row = G.group_diversity(groups, "g").first()
    assert (row["n_entities"], row["n_groups"]) == (8, 3)
    long = C.long_labels(labels, ["id"], TARGETS)
    got = {r["target"]: r for r in G.groups_by_activity(long, groups, "id", "g").collect()}
    assert set(got) == {"a", "d"}
    a = got["a"]
    assert (a["active_groups"], a["inactive_groups"], a["shared_groups"], a["active_only_groups"]) == (2, 1, 1, 1)


def test_matrix_statistics(spark):
    df = spark.createDataFrame([([0.0, 1.0, None],), ([0.0, float("nan"), 2.0],)], "x array<double>")
    row = P.matrix_statistics(df, "x").first()
    assert (row["n_rows"], row["n_columns"], row["n_missing"]) == (2, 3, 2)
    assert row["sparsity"] == pytest.approx(2 / 6)
