"""Joins of near keys, and joins whose key may hold many rows.

A band join pairs rows whose keys differ by a number within limits. The key axis is cut into blocks as wide as the band:
a row of the left side goes to the one or two blocks that its band touches, one of the right side to its own block, and
equal blocks are joined. Blocks (and keys of a plain join) with many rows are dealt out to tiles: a part of the left rows
meets a part of the right rows, every pair of parts in a group of its own, so no task gets more than a tile of a key.
Pairs are rows of the plan, to be aggregated in the same stage; they are not written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.functions.tokens import N_BITS, packed_shared
from screenspark.operators.joins import join_small
from screenspark.operators.ranking import row_numbers
from screenspark.session import materialise

#: Rows of a key on either side of a tile.
TILE = 1024
# Fixed value: how many following rows a row is compared with.
FOLLOWING = 99


def tile_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, condition: Column | None = None, rows: int = TILE
) -> DataFrame:
    """Inner join on equal keys (NULL equals NULL), where keys with more than ``rows`` rows on a side are cut into tiles.

    Columns are the keys and those of both sides, which must have different names. ``left_id`` and ``right_id`` tell the rows
    of their sides apart, and deal those of a large key out. Both sides are read twice.
    """
    counted = [side.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(n)).where(F.col(n) > 1) for side, n in ((left, "_pl"), (right, "_pr"))]
    none = F.lit(None).cast("int")
    large = counted[0].withColumn("_pr", none).unionByName(counted[1].withColumn("_pl", none))
    large = large.groupBy(*on).agg(F.max("_pl").alias("_pl"), F.max("_pr").alias("_pr"))
    n_left, n_right = F.coalesce("_pl", F.lit(1)), F.coalesce("_pr", F.lit(1))

    def part(name: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(name)), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    a = join_small(left, large, on, "left")
    a = a.withColumn("_tl", part(left_id, n_left)).withColumn("_tr", every(n_right)).drop("_pl", "_pr")
    b = join_small(right, large, on, "left")
    b = b.withColumn("_ul", every(n_left)).withColumn("_ur", part(right_id, n_right)).drop("_pl", "_pr")
    b = b.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in b.columns if c not in on])
    same = (F.col("_tl") == F.col("_ul")) & (F.col("_tr") == F.col("_ur"))
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    joined = a.join(b, same if condition is None else same & condition)
    return joined.drop("_tl", "_tr", "_ul", "_ur", *[f"_on_{c}" for c in on])


def band_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_key: str, right_key: str, low: float, high: float,
    left_id: str, right_id: str, condition: Column | None = None, rows: int = TILE,
) -> DataFrame:
    """Pairs of rows of a group with ``low <= right_key - left_key <= high``, of any width.

    Rows without a key have no pair; NULL is a group. Otherwise as in ``tile_join``.
    """
    if high < low:
        raise ValueError(f"an empty band: {low} to {high}")
    width = (high - low) or 1
    first, last = (F.floor((F.col(left_key) + end) / width) for end in (low, high))
    a = left.where(F.col(left_key).isNotNull()).withColumn("_block", F.explode(F.sequence(first, last)))
    b = right.where(F.col(right_key).isNotNull()).withColumn("_block", F.floor(F.col(right_key) / width))
    within = (F.col(right_key) >= F.col(left_key) + low) & (F.col(right_key) <= F.col(left_key) + high)
    paired = tile_join(a, b, [*by, "_block"], left_id, right_id, within if condition is None else within & condition, rows)
    return paired.drop("_block")


def following_similarity(
    df: DataFrame, by: Sequence[str], id_column: str, packed: str, size: str, following: int = FOLLOWING, n_bits: int = N_BITS, similar: float = 0.8
) -> DataFrame:
    """``(by..., n_pairs, mean, max and min similarity, n_similar)`` of every row with the ``following`` next rows of its group, in
    the order of the id. Pairs of two empty sets do not count; a group without a pair has no row."""
    numbered = materialise(row_numbers(df.select(*by, id_column, packed, size), id_column, size, by, out="_rn"))
    a = numbered.select(*by, F.col("_rn").alias("_a"), F.col(packed).alias("_pa"), F.col(size).alias("_sa"))
    b = numbered.select(*by, F.col("_rn").alias("_b"), F.col(packed).alias("_pb"), F.col(size).alias("_sb"))
    pairs = band_join(a, b, by, "_a", "_b", 1, following, "_a", "_b", rows=max(TILE, 2 * following))
    # The shared bits are counted in a step of their own: written out twice, the code would be too long to be compiled.
    shared = pairs.select(*by, "_sa", "_sb", packed_shared("_pa", "_pb", n_bits).alias("_n"))
    value = F.try_divide(F.col("_n").cast("double"), (F.col("_sa") + F.col("_sb") - F.col("_n")).cast("double"))
    return shared.where("_sa + _sb > 0").groupBy(*by).agg(*similarity_numbers(value, similar))


def similarity_numbers(value: Column, similar: float) -> list[Column]:
    return [
        F.count(value).alias("n_pairs"),
        F.avg(value).alias("mean_similarity"),
        F.max(value).alias("max_similarity"),
        F.min(value).alias("min_similarity"),
        F.count_if(value >= similar).alias("n_similar"),
    ]
