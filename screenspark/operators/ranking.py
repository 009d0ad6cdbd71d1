"""Ranks, running sums and exact quantiles over one huge ordered group.

A plain ``row_number`` over two label values would put half the table into one task. Everything here first cuts the
order into buckets, works inside each bucket in parallel and adds the totals of the buckets before it. The table of
bucket totals has (strata x buckets) rows, whatever the data size.

Buckets must be the same in every part of a plan, so their bounds are literals: hex prefixes of a hash (uniform by
construction) or quantiles fetched once by ``value_buckets``. A value so frequent that it fills buckets by itself
gets a bucket of its own, which is cut again by the tie-break column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenspark.functions.draws import hash_key
from screenspark.operators.joins import join_small

B1, B2 = "_bucket", "_tie_bucket"
MAX_BUCKETS = 16384


def bucket_count(spark: SparkSession) -> int:
    """A few buckets per shuffle task, so that one slow bucket cannot hold the stage."""
    return max(32, min(MAX_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def hash_digits(spark: SparkSession) -> int:
    """Hex digits that cut a hash into a few shares per shuffle task: 256 shares at least."""
    return max(2, math.ceil(math.log(bucket_count(spark), 16)))


def order_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases along the order of the column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # Wall-clock fields of a zoneless time; a zoned one would jump back an hour in autumn.
        day = F.unix_date(F.col(name).cast("date")).cast("double")
        return day * 86400 + F.hour(name) * 3600 + F.minute(name) * 60 + F.second(name)
    raise TypeError(f"column {name} of type {kind.simpleString()} has no numeric order; rank it by hash instead")


#: First-level groups whose sketches are merged before the last merge.
SKETCH_GROUPS = 64


def _splits(df: DataFrame, number: Column, n: int) -> tuple[list[float], list[float], bool]:
    """Interior cut points, the values that hold more than one bucket's share, and whether some rows have no number.

    Every task sketches its rows; SKETCH_GROUPS tasks merge the sketches of the tasks and one merges theirs, each a
    few thousand numbers. The bounds are approximate, what is computed within them is exact.
    """
    known = number.isNotNull() & ~F.isnan(number)
    tagged = df.select(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"), F.when(known, number).alias("x"))
    sketch = F.kll_sketch_agg_double("x", F.lit(min(65535, max(256, 8 * n))))
    first = tagged.groupBy("g").agg(sketch.alias("s"), F.count("x").alias("n"), F.count(F.lit(1)).alias("rows"))
    whole = first.agg(
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("s"))).alias("s"), F.sum("n").alias("n"), F.sum("rows").alias("rows")
    )
    ranks = F.array(*[F.lit(i / n) for i in range(1, n)])
    quantile = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", ranks))
    row = whole.select(quantile.alias("q"), "n", "rows").first()
    quantiles = [float(v) for v in (row["q"] or [])]
    hot = sorted({a for a, b in zip(quantiles, quantiles[1:]) if a == b})
    cuts = set(quantiles) | {math.nextafter(v, math.inf) for v in hot}
    return sorted(c for c in cuts if math.isfinite(c)), hot, (row["rows"] or 0) > (row["n"] or 0)


def _cut(df: DataFrame, number: Column, cuts: Sequence[float], out: str) -> DataFrame:
    """The number's bucket: NULLs below all others, NaN above, as in the sort order."""
    if not cuts:
        return df.withColumn(out, F.when(number.isNull(), -1.0).when(F.isnan(number), 1.0).otherwise(0.0))
    raw = f"{out}_key"
    bucketizer = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=raw, outputCol=out, handleInvalid="keep"
    )
    cut = bucketizer.transform(df.withColumn(raw, number))
    return cut.withColumn(out, F.when(F.col(raw).isNull(), -1.0).otherwise(F.col(out))).drop(raw)


def value_buckets(
    df: DataFrame, key: str, tie: str | None = None, n: int | None = None, bounds_from: DataFrame | None = None
) -> DataFrame:
    """Add bucket columns that follow the order ``(key, tie)`` and hold about equal numbers of rows.

    One aggregate pass over ``key`` runs at once, a second one over ``tie`` only if some value is hot. ``bounds_from``
    is a table with the same key that is cheaper to read, such as the rows that ``df`` was collapsed from.
    """
    n = n or bucket_count(df.sparkSession)
    number = order_number(df, key)
    cuts, hot, unknown = _splits(bounds_from if bounds_from is not None else df, number, n)
    out = _cut(df, number, cuts, B1)
    if (hot or unknown) and tie is not None:
        # Rows without a number are one value too. The buckets are shared out over the hot values.
        is_hot = number.isin(hot) | number.isNull() | F.isnan(number) if hot else number.isNull() | F.isnan(number)
        tie_number = order_number(df, tie)
        tie_cuts, _, _ = _splits(df.where(is_hot), tie_number, max(2, math.ceil(n / (len(hot) + unknown))))
        return _cut(out, F.when(is_hot, tie_number).otherwise(F.lit(-math.inf)), tie_cuts, B2)
    return out.withColumn(B2, F.lit(0.0))


def bucket_offsets(
    bucketed: DataFrame, strata: Sequence[str], sums: Mapping[str, Column], totals: bool = True
) -> DataFrame:
    """Per (stratum, bucket): the sum of every earlier bucket as ``<name>_before`` and the stratum's ``<name>_all``."""
    by = [*strata, B1, B2]
    per_bucket = bucketed.groupBy(*by).agg(*[F.sum(c).alias(f"{n}_in") for n, c in sums.items()])
    stratum = Window.partitionBy(*strata)
    before = stratum.orderBy(B1, B2).rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum(f"{n}_in").over(before), F.lit(0)).alias(f"{n}_before") for n in sums]
    columns += [F.col(f"{n}_in") for n in sums]
    if totals:
        columns += [F.sum(f"{n}_in").over(stratum).alias(f"{n}_all") for n in sums]
    return per_bucket.select(*by, *columns)


def running_sums(
    bucketed: DataFrame, strata: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add, for every name, the running sum up to the row and the stratum total ``<name>_all``.

    ``order`` must be total within a stratum and must agree with the bucket columns. The join back is on the window's
    own partitioning, so only the small offset table moves again.
    """
    # One struct as the key: NULLs within it are equal, in the shuffle as in the join.
    at = F.struct(*strata, B1, B2)
    here = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = bucketed.withColumn("_at", at)
    local = keyed.select("*", *[F.sum(c).over(here).alias(f"{n}_here") for n, c in sums.items()])
    offsets = bucket_offsets(bucketed, strata, sums)
    offsets = offsets.select(at.alias("_at"), *[f"{n}_{x}" for n in sums for x in ("before", "all")])
    joined = local.join(offsets, "_at")
    added = [(F.col(f"{n}_here") + F.col(f"{n}_before")).alias(n) for n in sums]
    added += [F.col(f"{n}_all") for n in sums]
    kept = [c for c in bucketed.columns if c not in (B1, B2)]
    return joined.select(*kept, *added)


def row_numbers(
    df: DataFrame, key: str, tie: str, strata: Sequence[str] = (), out: str = "rn", buckets: int | None = None
) -> DataFrame:
    """1, 2, 3 ... along ``(key, tie)`` within each stratum, plus the stratum size as ``<out>_all``."""
    bucketed = value_buckets(df, key, tie, buckets)
    return running_sums(bucketed, strata, [F.col(key), F.col(tie)], {out: F.lit(1)})


def shuffled_numbers(
    df: DataFrame,
    id_column: str,
    seed: int | str,
    strata: Sequence[str] = (),
    out: str = "rn",
    first: str | None = None,
) -> DataFrame:
    """1, 2, 3 ... in a repeatable shuffled order of distinct ids within each stratum, plus ``<out>_all``.

    Rows can be ordered by the values of ``first`` before the shuffle. A hex prefix of the shuffle key cuts the order
    into equal shares without a look at the data; the shuffle key also covers the strata, so each has its own order.
    """
    keyed = df.withColumn("_shuffle_key", hash_key(seed, *strata, id_column))
    bucketed = keyed.withColumn(B1, F.col(first) if first else F.lit(0)).withColumn(
        B2, F.substring("_shuffle_key", 1, hash_digits(df.sparkSession))
    )
    order = [F.col(c) for c in ([first] if first else [])] + [F.col("_shuffle_key"), F.col(id_column)]
    return running_sums(bucketed, strata, order, {out: F.lit(1)}).drop("_shuffle_key")


def scan_numbers(df: DataFrame, out: str = "rn") -> DataFrame:
    """1, 2, 3 ... in the order of file names and of the rows in each file, without a shuffle of the rows.

    ``df`` is a scan, filtered or not; rows that come from no file are numbered task by task.
    ``monotonically_increasing_id`` carries the scan task in its upper bits and counts rows in its lower 33; the piece
    of a file that a task reads starts at some count. The rows of the pieces before give the offset, in a table with a
    row per piece. Both sides read the same files with the same split sizes.
    """
    tagged = df.withColumns(
        {"_scan": F.monotonically_increasing_id(), "_file": F.input_file_name(), "_start": F.input_file_block_start()}
    ).withColumn("_task", F.shiftright("_scan", 33))
    piece = ["_file", "_start", "_task"]
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*piece)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_scan").alias("_first"))
        .select(*piece, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    numbered = join_small(tagged, offsets, piece).withColumn(out, F.col("_before") + F.col("_scan") - F.col("_first") + 1)
    return numbered.drop(*piece, "_first", "_before", "_scan")


def exact_quantiles(
    df: DataFrame,
    strata: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    buckets: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per stratum; NULL values are left out.

    ``percentile`` keeps all distinct values of a group in one task. Here the first pass only counts rows per bucket;
    the second keeps just the buckets that contain a wanted rank, so the sort sees a small part of the data.
    """
    known = df.where(F.col(value).isNotNull()).select(*strata, value)
    bucketed = value_buckets(known, value, None, buckets)
    offsets = bucket_offsets(bucketed, strata, {"n": F.lit(1)})

    def place(p: float) -> Column:
        return (F.col("n_all") - 1) * F.lit(float(p))

    def wanted_in(first: Column, after: Column) -> Column:
        hit = F.lit(False)
        for p in probabilities.values():
            low, high = F.floor(place(p)), F.ceil(place(p))
            hit = hit | ((low >= first) & (low < after)) | ((high >= first) & (high < after))
        return hit

    # Two buckets per stratum and quantile at most.
    kept = offsets.where(wanted_in(F.col("n_before"), F.col("n_before") + F.col("n_in")))
    by = [*strata, B1, B2]
    facts = ["n_before", "n_all"]
    counted = (
        join_small(bucketed, kept.select(*by, *facts), by)
        .groupBy(*by, *facts, value)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    here = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counted.withColumn("_upto", F.sum("_rows").over(here))
        .withColumn("_after", F.col("n_before") + F.col("_upto"))
        .withColumn("_first", F.col("_after") - F.col("_rows"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_after")), F.col(value).cast("double")))

    picks = []
    for name, p in probabilities.items():
        picks += [at(F.floor(place(p))).alias(f"{name}_lo"), at(F.ceil(place(p))).alias(f"{name}_hi")]
    picked = placed.groupBy(*strata).agg(F.max("n_all").alias("n_all"), *picks)
    results = [
        (
            F.col(f"{name}_lo")
            + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place(p) - F.floor(place(p)))
        ).alias(name)
        for name, p in probabilities.items()
    ]
    return picked.select(*strata, F.col("n_all").alias("n"), *results)
