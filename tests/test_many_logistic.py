import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from screenspark.operators import many_logistic as L
from screenspark.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 4)) * [1, 10, 0.1, 1] + [0, 50, 0, 3]
    data = []
    for i in range(200):
        labels = [int(x[i, 0] + draw.normal() > 0), int(x[i, 1] / 10 - 5 + draw.normal() > 0.8), int(draw.random() < 0.3)]
        labels[2] = None if i % 7 == 0 else labels[2]
        data.append((i, [float(v) for v in x[i]], *labels, i % 3))
    return spark.createDataFrame(data, "id int, x array<double>, a int, b int, c int, fold int").repartition(4)


def single(rows, target):
    """MLlib's fit of one target."""
    known = rows.where(F.col(target).isNotNull())
    n = {r[target]: r["count"] for r in known.groupBy(target).count().collect()}
    total = sum(n.values())
    weight = F.when(F.col(target) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0]))
    table = known.select(array_to_vector("x").alias("features"), F.col(target).cast("double").alias("label"), weight.alias("w"))
    fit = LogisticRegression(weightCol="w", regParam=1 / total, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(table)
    return fit.coefficients.toArray(), fit.intercept


def test_all_models_equal_single_fits(rows):
    many = L.fit_many(rows, "x", ["a", "b", "c"], "fold")
    assert many.models == [(t, f) for t in "abc" for f in (None, 0, 1, 2)]
    for target, fold in [("a", None), ("a", 1), ("b", None), ("b", 2), ("c", 0)]:
        expected = single(rows.where(F.col("fold") != fold) if fold is not None else rows, target)
        found = many.of(target, fold)
        assert found[0] == pytest.approx(expected[0], abs=1e-4) and found[1] == pytest.approx(expected[1], abs=1e-3)
    one = L.fit_many(rows, "x", ["a"])
    assert one.of("a")[0] == pytest.approx(many.of("a")[0], abs=1e-4)
    assert many.passes <= one.passes + 30  # twelve models, not twelve times the passes


def test_scores_leave_their_fold_out(rows):
    many = L.fit_many(rows, "x", ["a", "b"], "fold")
    local = {r["id"]: r for r in rows.collect()}
    found = {(r["id"], r["target"]): r["probability"] for r in many.score(rows, "x", "id", "fold").collect()}
    assert len(found) == 400
    for (i, t), p in found.items():
        w, b = many.of(t, local[i]["fold"])
        assert p == pytest.approx(1 / (1 + np.exp(-(np.dot(local[i]["x"], w) + b))))
    everywhere = many.score(rows.withColumn("fold", F.lit(None).cast("int")), "x", "id", "fold").where("id = 3 and target = 'a'").first()
    assert everywhere["probability"] == pytest.approx(many.score(rows, "x", "id").where("id = 3 and target = 'a'").first()["probability"])


def test_one_class_is_refused(rows):
    with pytest.raises(ValueError):
        L.fit_many(rows.withColumn("a", F.lit(1)), "x", ["a"])


def test_scores_equal_the_single_model_path(rows):
    many = L.fit_many(rows, "x", ["a", "b"])
    fitted = M.train_targets(rows, "x", ["a", "b"], M.LOGISTIC, M.ModelSettings())
    one, other = ({(r["id"], r["target"]): r["probability"] for r in d.collect()} for d in (many.score(rows, "x", "id"), M.score_targets(fitted, rows, "x", "id")))
    assert set(one) == set(other) and all(one[k] == pytest.approx(other[k], abs=1e-3) for k in one)
