"""Feature blocks side by side as sparse vectors: bit sets, counts and plain columns under one list of names.

A text sets a few hundred of some thousand bits. A bit set becomes a sparse vector in the JVM without a look at the bits
that are not set; blocks are laid end to end, with a name for every place kept in the column's metadata. Moments, the
variance filter and the selection by name then work on the non-zeros alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: features whose population variance is not above it are dropped.
LEAST_VARIANCE = 0.01


def with_bit_block(df: DataFrame, bits: str, n_bits: int, out: str) -> DataFrame:
    """Add a bit set as a sparse vector of ones, ``n_bits`` wide; a NULL set has none, bits beyond the width are left out."""
    names = f"{out}_names"
    named = df.withColumn(names, F.transform(F.coalesce(F.col(bits), F.array().cast("array<int>")), lambda b: b.cast("string")))
    model = CountVectorizerModel.from_vocabulary([str(b) for b in range(n_bits)], inputCol=names, outputCol=out)
    return model.setBinary(True).setMinTF(1.0).transform(named).drop(names)


def assemble(df: DataFrame, bit_blocks: Mapping[str, tuple[str, int]], numbers: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the bit blocks (name: column of set bits, width), in order, and then the number columns.

    Missing numbers are 0. Places are named ``<block>_<bit>`` and by the number columns.
    """
    made = df
    for name, (bits, n_bits) in bit_blocks.items():
        made = with_bit_block(made, bits, n_bits, name)
    filled = [f"{c}_filled" for c in numbers]
    for c, f in zip(numbers, filled):
        value = F.col(c).cast("double")
        made = made.withColumn(f, F.when(F.isnan(value) | value.isNull(), 0.0).otherwise(value))
    made = VectorAssembler(inputCols=[*bit_blocks, *filled], outputCol=out).transform(made).drop(*bit_blocks, *filled)
    names = [f"{name}_{b}" for name, (_, n_bits) in bit_blocks.items() for b in range(n_bits)] + list(numbers)
    attributes = {"ml_attr": {"attrs": {"numeric": [{"idx": k, "name": n} for k, n in enumerate(names)]}, "num_attrs": len(names)}}
    return made.withMetadata(out, attributes)


def feature_names(df: DataFrame, features: str) -> list[str]:
    """Names of all places of a vector column, from its metadata."""
    found = [a for kind in df.schema[features].metadata["ml_attr"]["attrs"].values() for a in kind]
    return [a["name"] for a in sorted(found, key=lambda a: a["idx"])]


def block_moments(df: DataFrame, features: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, non-zeros, means, population variances) per place; one pass over the non-zeros, d numbers to the driver."""
    summary = Summarizer.metrics("count", "numNonZeros", "mean", "variance").summary(F.col(features)).alias("s")
    row = df.agg(summary).select(
        "s.count", *[vector_to_array(f"s.{c}").alias(c) for c in ("numNonZeros", "mean", "variance")]
    ).first()
    n = row["count"]
    return n, np.array(row["numNonZeros"]), np.array(row["mean"]), np.array(row["variance"]) * ((n - 1) / n if n else 0)


def variable_block(df: DataFrame, features: str, out: str, least: float = LEAST_VARIANCE) -> DataFrame:
    """Add the features whose population variance is above ``least``, with their names, as a sparse vector."""
    names = feature_names(df, features)
    *_, variance = block_moments(df, features)
    return named_block(df, features, [n for n, v in zip(names, variance) if v > least], out)


def named_block(df: DataFrame, features: str, names: Sequence[str], out: str) -> DataFrame:
    """Add the features of the given names, in that order, as a sparse vector."""
    if not names:
        raise ValueError("no features are left")
    return VectorSlicer(inputCol=features, outputCol=out, names=list(names)).transform(df)
