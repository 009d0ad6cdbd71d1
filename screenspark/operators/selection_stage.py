"""The selection chain as a stage of an ML pipeline: fitted with the model behind it, in every fold of a cross-validation.

Features are a vector column whose places have names in the column's metadata, as ``blocks.assemble`` and
``VectorAssembler`` leave it; the selected column keeps the names of the places it holds.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.operators import select as S
from screenspark.operators.blocks import feature_names


class _SelectionParams(HasFeaturesCol, HasLabelCol, HasOutputCol, HasSeed):
    correlationLimit = Param(Params._dummy(), "correlationLimit", "correlation above which the later feature goes", TypeConverters.toFloat)
    univariateK = Param(Params._dummy(), "univariateK", "features kept by mutual information", TypeConverters.toInt)
    modelTopN = Param(Params._dummy(), "modelTopN", "features kept by forest importance", TypeConverters.toInt)
    importanceTrees = Param(Params._dummy(), "importanceTrees", "trees of the forest", TypeConverters.toInt)

    def _set_defaults(self) -> None:
        self._setDefault(
            outputCol="selected", seed=42, correlationLimit=S.CORRELATION_LIMIT, univariateK=S.UNIVARIATE_K,
            modelTopN=S.MODEL_TOP_N, importanceTrees=S.IMPORTANCE_TREES,
        )


class FeatureSelection(Estimator, _SelectionParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the selection chain; rows without a label are left out of the fit, and every row is transformed."""

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", outputCol="selected", seed=42, correlationLimit=S.CORRELATION_LIMIT,
        univariateK=S.UNIVARIATE_K, modelTopN=S.MODEL_TOP_N, importanceTrees=S.IMPORTANCE_TREES,
    ):
        super().__init__()
        self._set_defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeatureSelectionModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        rows = dataset.where(F.col(label).isNotNull()).select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
        settings = S.SelectionSettings(*[self.getOrDefault(p) for p in ("correlationLimit", "univariateK", "modelTopN", "importanceTrees", "seed")])
        chosen = S.fit_selection(rows, "x", "y", feature_names(dataset, features), settings)
        model = FeatureSelectionModel(names=chosen.names)
        model.history = chosen.history
        return self._copyValues(model)


class FeatureSelectionModel(Model, _SelectionParams, DefaultParamsReadable, DefaultParamsWritable):
    """Selected features by name. ``history`` (step, feature, kept, score) is there after a fit, not after loading."""

    names = Param(Params._dummy(), "names", "names of the selected features, best first", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, names=None):
        super().__init__()
        self._set_defaults()
        self.history: list[tuple[str, str, bool, float | None]] = []
        if names is not None:
            self._set(names=names)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        slicer = VectorSlicer(inputCol=self.getFeaturesCol(), outputCol=self.getOutputCol(), names=self.getOrDefault("names"))
        return slicer.transform(dataset)
