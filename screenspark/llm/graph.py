"""Connected components of a large sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the smallest node that links reach from it.

    ``links`` holds pairs of longs, in any direction, repeated or not; pairs with a NULL or of a node with itself say
    nothing. Alternates the two star steps: every node's larger neighbours are tied to its smallest neighbour, then
    its smaller ones. Groups only ever gather a minimum, which is combined before the shuffle, and each round is
    written to the shared folder, so a lost executor costs one round at most. A chain of n nodes takes about log n
    rounds.
    """
    known = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
    stars = _checked(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        rows, mark = stars
        if mark == before:
            return rows.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                rows.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = _checked(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _checked(rows: DataFrame) -> tuple[DataFrame, tuple]:
    """The rows, written down, and a checksum of them as a set."""
    kept = materialise(rows)
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return kept, tuple(kept.agg(F.count(F.lit(1)), total).first())
