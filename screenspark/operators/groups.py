"""Diversity of a grouping key, overall and by class. Two-level aggregates replace set arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.functions.scalars import ratio


def group_diversity(df: DataFrame, group: str) -> DataFrame:
    """Entities, distinct groups, their ratio and the average group size.

    Sizes are pre-aggregated per group, so a group holding a third of the rows is summed map-side.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.agg(
        F.coalesce(F.sum("_size"), F.lit(0)).alias("n_entities"), F.count(F.lit(1)).alias("n_groups")
    ).select(
        "n_entities",
        "n_groups",
        ratio(F.col("n_groups"), F.col("n_entities")).alias("diversity"),
        ratio(F.col("n_entities"), F.col("n_groups")).alias("avg_group_size"),
    )


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_entities"))


def group_sizes_by_class(labels: DataFrame, groups: DataFrame, id_column: str, group: str) -> DataFrame:
    """Entities per target, group and class."""
    return (
        labels.where(F.col("label").isNotNull())
        .join(groups.where(F.col(group).isNotNull()).select(id_column, group), id_column)
        .groupBy("target", group)
        .agg(F.count_if(F.col("label") == 1).alias("n_active"), F.count_if(F.col("label") == 0).alias("n_inactive"))
    )


def groups_by_activity(labels: DataFrame, groups: DataFrame, id_column: str, group: str) -> DataFrame:
    """Per target: entities and distinct groups of each class, groups seen in one class only, and shared groups.

    Also the entities per distinct group of each class and the active share of the class-wise group counts. Targets
    with one class only are left out.
    """
    has_active, has_inactive = F.col("n_active") > 0, F.col("n_inactive") > 0
    counted = (
        group_sizes_by_class(labels, groups, id_column, group)
        .groupBy("target")
        .agg(
            F.sum("n_active").alias("active_entities"),
            F.sum("n_inactive").alias("inactive_entities"),
            F.count_if(has_active).alias("active_groups"),
            F.count_if(has_inactive).alias("inactive_groups"),
            F.count(F.lit(1)).alias("total_groups"),
            F.count_if(has_active & ~has_inactive).alias("active_only_groups"),
            F.count_if(has_inactive & ~has_active).alias("inactive_only_groups"),
            F.count_if(has_active & has_inactive).alias("shared_groups"),
        )
        .where((F.col("active_entities") > 0) & (F.col("inactive_entities") > 0))
    )
    return counted.withColumns(
        {
            "active_per_group": ratio(F.col("active_entities"), F.col("active_groups")),
            "inactive_per_group": ratio(F.col("inactive_entities"), F.col("inactive_groups")),
            "active_group_share": ratio(F.col("active_groups"), F.col("active_groups") + F.col("inactive_groups")),
        }
    )
