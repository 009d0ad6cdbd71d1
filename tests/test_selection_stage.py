import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from screenspark.operators import select as S
from screenspark.operators.blocks import feature_names
from screenspark.operators.selection_stage import FeatureSelection

NAMES = ["signal", "copy", "n1", "n2", "weak"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    y = draw.integers(0, 2, 240)
    signal = y + draw.normal(scale=0.3, size=240)
    data = np.stack([signal, 2 * signal + 1, *draw.normal(size=(2, 240)), y + draw.normal(scale=2, size=240)], axis=1)
    schema = "id int, y int, " + ", ".join(f"{n} double" for n in NAMES)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, data[i])) for i in range(240)] + [(900, None, 0.0, 1.0, 0.0, 0.0, 0.0)], schema)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def test_stage_selects_what_the_chain_selects_and_survives_saving(rows, tmp_path):
    stage = FeatureSelection(labelCol="y", univariateK=3, modelTopN=2, importanceTrees=10)
    known = rows.where("y is not null").select("y", vector_to_array("features").alias("x"))
    expected = S.fit_selection(known, "x", "y", NAMES, S.SelectionSettings(univariate_k=3, model_top_n=2, importance_trees=10))
    model = Pipeline(stages=[stage, LogisticRegression(featuresCol="selected", labelCol="y")]).fit(rows.where("y is not null"))
    assert model.stages[0].getOrDefault("names") == expected.names and expected.names[0] == "signal" and "copy" not in expected.names
    assert model.stages[0].history == expected.history
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.stages[0].getOrDefault("names") == expected.names
    scored, again = (m.transform(rows).select("id", "selected", "prediction").orderBy("id") for m in (model, loaded))
    assert scored.collect() == again.collect() and scored.count() == 241
    assert feature_names(loaded.transform(rows), "selected") == expected.names


def test_selection_within_folds(rows):
    stage = FeatureSelection(labelCol="y", univariateK=3, importanceTrees=5)
    grid = ParamGridBuilder().addGrid(stage.modelTopN, [1, 2]).build()
    folds = rows.where("y is not null").withColumn("fold", F.pmod("id", F.lit(2)))
    search = CrossValidator(
        estimator=Pipeline(stages=[stage, LogisticRegression(featuresCol="selected", labelCol="y")]), estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=2, foldCol="fold",
    )
    found = search.fit(folds)
    assert len(found.avgMetrics) == 2 and min(found.avgMetrics) > 0.9
    assert found.bestModel.stages[0].getOrDefault("names")[0] == "signal"
