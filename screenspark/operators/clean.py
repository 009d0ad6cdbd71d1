"""Projection, cleaning and row filters on label tables (wide or long)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.functions.scalars import finite_or_null, label_flag, lenient_double, ratio_or_zero


def fixed_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Exactly the named columns in that order and type; a column the input lacks is NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)).alias(name)
            for name, kind in schema.items()
        ]
    )


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lenient cast of the named columns; text that is no number becomes NULL."""
    return df.withColumns({c: lenient_double(c) for c in columns})


def label_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Label words of the named columns to 1, 0 or NULL."""
    return df.withColumns({c: label_flag(c) for c in columns})


def with_text(df: DataFrame, column: str, empty_words: Sequence[str] = ("",), trim: bool = False) -> DataFrame:
    """Rows whose key text is there; optionally trimmed first, with further words counting as empty."""
    text = F.trim(F.col(column)) if trim else F.col(column)
    return df.withColumn(column, text).where(F.col(column).isNotNull() & ~F.col(column).isin(*empty_words))


def any_known(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(t) for t in targets]).isNotNull())


def missing_labels(df: DataFrame, targets: Sequence[str], strategy: str = "drop") -> DataFrame:
    """``drop`` keeps rows with every target known; ``impute`` takes unknown as 0."""
    if strategy == "drop":
        return df.dropna("any", subset=list(targets))
    if strategy == "impute":
        return df.fillna(0, subset=list(targets))
    raise ValueError(f"unknown strategy {strategy!r}")


def long_labels(df: DataFrame, ids: Sequence[str], targets: Sequence[str], known_only: bool = True) -> DataFrame:
    """``(ids..., target, label)``: one scan serves every target."""
    out = df.select(*ids, *[F.col(t).cast("int").alias(t) for t in targets])
    out = out.unpivot(list(ids), list(targets), "target", "label")
    return out.where(F.col("label").isNotNull()) if known_only else out


def long_numbers(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "property", value: str = "value"
) -> DataFrame:
    """``(ids..., property, value)`` with NaN and infinities as NULL."""
    out = df.select(*ids, *[finite_or_null(c).alias(c) for c in columns])
    return out.unpivot(list(ids), list(columns), name, value)


def eligible_targets(labels: DataFrame, min_known: int = 100, min_positive: int = 10) -> DataFrame:
    """Targets with enough known and positive rows, from the long form."""
    return (
        labels.where(F.col("label").isNotNull())
        .groupBy("target")
        .agg(F.count("label").alias("n_known"), F.count_if(F.col("label") == 1).alias("n_positive"))
        .where((F.col("n_known") >= min_known) & (F.col("n_positive") >= min_positive))
    )


def validity(df: DataFrame, test: Column) -> DataFrame:
    """Share of rows that pass the caller's test."""
    return df.agg(
        F.count_if(F.coalesce(test, F.lit(False))).alias("n_valid"), F.count(F.lit(1)).alias("n_rows")
    ).withColumn("valid_ratio", ratio_or_zero(F.col("n_valid"), F.col("n_rows")))


def labelled_only(features: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """Feature rows whose entity has a label row."""
    return features.join(labels.select(id_column), id_column, "left_semi")


def unfinished(work: DataFrame, done: DataFrame, key: str = "target") -> DataFrame:
    """Work rows without a finished entry."""
    return work.join(done.select(key), key, "left_anti")
