"""Fits of many small models with few calls between Python and the JVM.

``fit`` of an estimator makes about 800 such calls, nearly all to copy parameters there and back, and calls of all threads run
one after the other. Where hundreds of models are only scored or asked for one fact, these calls outweigh the fits.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Transformer
from pyspark.ml.common import _py2java
from pyspark.sql import DataFrame


class JvmModel(Transformer):
    """A fitted model that only scores; it is neither saved nor asked for its parameters."""

    def __init__(self, java_model) -> None:
        super().__init__()
        self.java_model = java_model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return DataFrame(self.java_model.transform(dataset._jdf), dataset.sparkSession)


def fit_in_jvm(estimator: Estimator, table: DataFrame) -> JvmModel:
    """Fit an MLlib estimator with the parameters set on it; the others have the same defaults on both sides."""
    java = estimator._java_obj
    for param, value in estimator._paramMap.items():
        java.set(java.getParam(param.name).w(_py2java(table.sparkSession.sparkContext, value)))
    return JvmModel(java.fit(table._jdf))
