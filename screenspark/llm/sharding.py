"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash of their key. How many rows of each block go to each shard is drawn first, as one
exact sample of the multivariate hypergeometric law. Then each block is permuted and cut by its drawn counts, the rows are
exchanged, and each shard is permuted again. Everything is a DataFrame expression; draws come from hashes, so a
task that runs again after a lost executor draws the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.llm.common import numbered_columns, unit_draw
from screenspark.session import materialise

#: Rows of the matrix. 100 TB of one-kilobyte documents make 100 million narrow rows a block.
BLOCKS = 1024


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` balls, taken from ``total`` of which ``marked`` are marked, are marked, at quantile u.

    Inversion over a window of 12 standard deviations around the mean, with weights from the ratio of neighbouring
    probabilities; what lies outside is below 1e-30.
    """

    def within(v: Column) -> Column:
        low = F.greatest(F.lit(0), v.draws - (v.total - v.marked))
        high = F.least(v.draws, v.marked)
        share = v.marked / F.greatest(v.total, F.lit(1))
        spread = F.sqrt(
            v.draws * share * (1 - share) * (v.total - v.draws) / F.greatest(v.total - 1, F.lit(1))
        )
        width = F.ceil(12 * spread) + 40
        first = F.greatest(low, F.floor(v.draws * share) - width)
        last = F.least(high, F.floor(v.draws * share) + width)

        def ratio(k: Column) -> Column:
            up = (v.marked - k).cast("double") * (v.draws - k)
            return up / ((k + 1).cast("double") * F.greatest(v.total - v.marked - v.draws + k + 1, F.lit(1)))

        def weighed(ks: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
            whole = F.aggregate(
                ks,
                start,
                lambda a, k: F.struct((a.p * ratio(k)).alias("p"), (a["sum"] + a.p).alias("sum")),
                lambda a: a["sum"],
            )

            def found(goal: Column) -> Column:
                begin = F.struct(
                    F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("k")
                )
                return F.aggregate(
                    ks,
                    begin,
                    lambda a, k: F.struct(
                        (a.p * ratio(k)).alias("p"),
                        (a["sum"] + a.p).alias("sum"),
                        F.coalesce(a.k, F.when(a["sum"] + a.p >= goal, k)).alias("k"),
                    ),
                    lambda a: F.coalesce(a.k, F.element_at(ks, -1)),
                )

            return _let(whole * v.u, found)

        return _let(F.sequence(first, last), weighed)

    given = F.struct(total.alias("total"), marked.alias("marked"), draws.alias("draws"), u.alias("u"))
    return _let(given, within)


def communication_matrix(sizes: DataFrame, n_shards: int, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """Draw, for block sizes (block, n), the rows (block, quotas): quotas[s] rows of the block go to shard s.

    Rows add up to the block sizes and columns to the shard sizes, which differ by one at most. Blocks that are not
    in ``sizes`` are empty. The table has ``blocks`` rows whatever the data size, so one fold draws it: block after
    block takes its rows from what is left of the shards, shard after shard by a hypergeometric draw.
    """
    by_block = F.map_from_entries(F.collect_list(F.struct("block", "n")))
    none = F.lit(0).cast("bigint")
    root = sizes.agg(by_block.alias("m")).select(
        F.transform(
            F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(b.alias("block"), F.coalesce(F.col("m")[b], none).alias("n"))
        ).alias("sizes"),
    )
    total = F.aggregate("sizes", none, lambda a, x: a + x["n"])
    whole = root.withColumn("n", total).select(
        "sizes",
        F.transform(
            F.sequence(F.lit(0), F.lit(n_shards - 1)),
            lambda s: F.floor(F.col("n") * (s + 1) / n_shards) - F.floor(F.col("n") * s / n_shards),
        ).alias("quotas"),
    )

    def of_block(left: Column, size: Column) -> Column:
        """The block's draws from the quotas that are left."""
        start = F.struct(
            F.aggregate(left, none, lambda a, x: a + x).alias("total"),
            size["n"].alias("draws"),
            F.array().cast("array<bigint>").alias("out"),
        )
        numbered = F.transform(left, lambda q, s: F.struct(q.alias("q"), s.alias("s")))

        def of_shard(a: Column, x: Column) -> Column:
            u = unit_draw(F.lit(seed), size["block"], x["s"])
            return _let(
                hypergeometric(a["total"], x["q"], a["draws"], u),
                lambda taken: F.struct(
                    (a["total"] - x["q"]).alias("total"),
                    (a["draws"] - taken).alias("draws"),
                    F.concat(a["out"], F.array(taken)).alias("out"),
                ),
            )

        return F.aggregate(numbered, start, of_shard, lambda a: a["out"])

    start = F.struct(F.col("quotas").alias("left"), F.array().cast("array<struct<block:int,quotas:array<bigint>>>").alias("out"))

    def step(a: Column, size: Column) -> Column:
        return _let(
            of_block(a["left"], size),
            lambda drawn: F.struct(
                F.zip_with(a["left"], drawn, lambda q, d: q - d).alias("left"),
                F.concat(a["out"], F.array(F.struct(size["block"].alias("block"), drawn.alias("quotas")))).alias("out"),
            ),
        )

    return whole.select(F.inline(F.aggregate("sizes", start, step, lambda a: a["out"])))


def shuffle_into_shards(
    rows: DataFrame, keys: Sequence[str], n_shards: int = 8, blocks: int = BLOCKS, seed: int = 0
) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard) in a uniform random order.

    ``keys`` should tell rows apart; NULL keys are values like others, and rows with equal keys share a block and are
    interchangeable. Shard sizes differ by one at most. An empty table gives an empty table; columns of ``rows``
    called shard or slot are replaced.
    """
    inner, key_names = numbered_columns(rows, *keys)
    numbers = [k for k, c in enumerate(rows.columns) if c.lower() not in ("shard", "slot")]
    columns = [f"c{k}" for k in numbers]
    kept = inner.select(*dict.fromkeys([*columns, *key_names]))
    of_key = [F.col(k) for k in key_names]

    def draw(name: str) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(name), *of_key)

    def block() -> Column:
        return F.pmod(draw("block"), F.lit(blocks)).cast("int")

    sizes = kept.select(block().alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    ends = communication_matrix(sizes, n_shards, blocks, seed)
    ends = materialise(ends).select(
        F.col("block").alias("_block"),
        F.transform(
            "quotas", lambda q, s: F.aggregate(F.slice("quotas", F.lit(1), s + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
        ).alias("_ends"),
    )
    local = Window.partitionBy("_block").orderBy("_local", *of_key)
    permuted = (
        kept.withColumn("_block", block())
        .withColumn("_local", draw("local"))
        .withColumn("_place", F.row_number().over(local) - 1)
        .join(F.broadcast(ends), "_block")  # BLOCKS rows of n_shards numbers
        .withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))))
    )
    cells = max(1, blocks // n_shards)
    dealt = permuted.select(*kept.columns, "_shard").withColumn("_second", draw("second"))
    dealt = dealt.withColumn("_cell", F.pmod(F.shiftright("_second", 20), F.lit(cells)).cast("int"))
    before = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("_shard", "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    here = Window.partitionBy("_shard", "_cell").orderBy("_second", *of_key)
    return (
        dealt.withColumn("_place", F.row_number().over(here) - 1)
        .join(F.broadcast(offsets), ["_shard", "_cell"])  # n_shards x cells rows, at most BLOCKS
        .select(
            *columns,
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_before") + F.col("_place")).cast("bigint").alias("slot"),
        )
        .toDF(*[rows.columns[k] for k in numbers], "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Write the rows in shard and slot order, in about ``files`` files, one folder per shard."""
    ordered = sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)


def sharded_documents(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """Place of every document, with the law ``rows``: shard sizes differ by one at most.

    Size is the UTF-8 bytes of the text plus 1; a NULL text has no bytes and the checksum of the empty text.
    """
    narrow = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    placed = shuffle_into_shards(narrow, ["doc_id", "text_crc32", "size"], n_shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
