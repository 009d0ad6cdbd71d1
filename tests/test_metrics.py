import pytest
from pyspark.sql import functions as F

from screenspark.operators import metrics as M
from screenspark.plans import reports as R


def scored(spark, groups):
    data = [(g, y, p) for g, pairs in groups.items() for y, p in pairs]
    return spark.createDataFrame(data, "target string, label int, probability double")


def test_by_hand(spark):
    groups = {
        "hand": [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)],
        "tied": [(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)],
        "one": [(1, 0.2), (1, 0.9), (None, 0.5)],
    }
    got = {r["target"]: r for r in M.evaluate(scored(spark, groups), ["target"]).collect()}
    assert got["hand"]["roc_auc"] == 0.75 and got["hand"]["pr_auc"] == pytest.approx(0.8333, abs=1e-4)
    assert (got["hand"]["tp"], got["hand"]["fp"], got["hand"]["fn"], got["hand"]["tn"]) == (1, 0, 1, 2)
    assert got["hand"]["f1"] == pytest.approx(2 / 3) and got["hand"]["balanced_accuracy"] == 0.75
    assert got["tied"]["roc_auc"] == 0.5 and got["tied"]["precision"] == 0 and got["tied"]["f1"] == 0
    assert got["one"]["roc_auc"] is None and got["one"]["pr_auc"] is None and got["one"]["n"] == 2


def test_against_brute_force_with_ties(spark):
    pairs = [((i * 7) % 3 == 0, (i * 37 % 23) / 23) for i in range(200)]
    df = scored(spark, {"t": [(int(y), p) for y, p in pairs]})
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    row = M.evaluate(df, ["target"]).first()
    assert row["roc_auc"] == pytest.approx(auc)
    points = M.curve_points(df, ["target"]).orderBy(F.col("threshold").desc()).collect()
    assert len(points) == 23 and points[-1]["tpr"] == 1 and points[-1]["fpr"] == 1
    steps, last = 0.0, 0.0
    for r in points:
        steps, last = steps + (r["recall"] - last) * r["precision"], r["recall"]
    assert row["pr_auc"] == pytest.approx(steps)


def test_hot_score_and_partitions_do_not_matter(spark):
    hot = F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 31 % 997) / 997)
    df = spark.range(20000).select(
        F.lit("t").alias("target"), (F.col("id") % 5 == 0).cast("int").alias("label"), hot.alias("probability")
    )
    one = M.evaluate(df.coalesce(1), ["target"]).first().asDict()
    many = M.evaluate(df.repartition(16), ["target"]).first().asDict()
    assert one == pytest.approx(many)


def summary_of(spark, values):
    data = [(t, m, f, "roc_auc", v) for t, m, f, v in values]
    full = spark.createDataFrame(data, "target string, model string, fold int, metric string, value double")
    others = [full.withColumn("metric", F.lit(m)) for m in M.METRICS[1:]]
    for o in others:
        full = full.unionByName(o)
    return M.fold_summary(full)


def test_reports(spark):
    summary = summary_of(
        spark, [("x", "b", 0, 0.6), ("x", "b", 1, 0.8), ("x", "a", 0, 0.7), ("x", "a", 1, 0.7), ("y", "a", 0, 0.9)]
    )
    row = summary.where("target = 'x' and model = 'b' and metric = 'f1'").first()
    assert row["mean"] == pytest.approx(0.7) and row["std"] == pytest.approx(0.1)
    best = {r["target"]: r["model"] for r in R.best_models(summary).collect()}
    assert best == {"x": "a", "y": "a"}
    overview = R.target_overview(summary).collect()
    assert [r["target"] for r in overview] == ["y", "x"] and overview[1]["roc_auc"] == "0.700 ± 0.000"
    assert R.average_of_best(summary).first()["average_roc_auc"] == pytest.approx(0.8)
    assert R.performance(summary, ["y", "gone"]).count() == 1


def test_evaluation_report_sections(spark):
    data = [(f"t{i}", i / 10, i / 20, 0.5, 0.5) for i in range(1, 6)]
    metrics = spark.createDataFrame(
        data, "target string, roc_auc double, pr_auc double, f1 double, balanced_accuracy double"
    )
    got = R.evaluation_report(metrics).collect()
    assert [r["target"] for r in got if r["section"] == "best"] == ["t5", "t4", "t3"]
    assert [r["target"] for r in got if r["section"] == "worst"] == ["t1", "t2", "t3"]
    assert sum(r["section"] == "table" for r in got) == 5
    assert next(r["text"] for r in got if r["section"] == "overall" and r["target"] == "roc_auc") == "0.300 ± 0.158"
