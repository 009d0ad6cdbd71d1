import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from screenspark.llm import sharding
from screenspark.llm.common import unit_draw


def test_hypergeometric_law(spark):
    total, marked, draws, n = 40, 15, 12, 40_000
    numbers = [F.lit(x).cast("bigint") for x in (total, marked, draws)]
    drawn = spark.range(n).select(sharding.hypergeometric(*numbers, unit_draw(F.col("id"))).alias("k"))
    counts = {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()}
    expected = {k: n * comb(marked, k) * comb(total - marked, draws - k) / comb(total, draws) for k in range(draws + 1)}
    common = [k for k in expected if expected[k] >= 20]
    chi = sum((counts.get(k, 0) - expected[k]) ** 2 / expected[k] for k in common)
    assert chi < 3 * len(common) and set(counts) <= set(expected)


@pytest.mark.parametrize("total, marked, draws, k", [(10, 0, 5, 0), (10, 10, 5, 5), (10, 3, 10, 3), (0, 0, 0, 0), (5, 2, 0, 0)])
def test_certain_draws(spark, total, marked, draws, k):
    numbers = [F.lit(x).cast("bigint") for x in (total, marked, draws)]
    assert spark.range(1).select(sharding.hypergeometric(*numbers, F.lit(0.7))).first()[0] == k


def test_matrix_margins(spark):
    sizes = spark.createDataFrame([(0, 50), (1, 7), (3, 100), (7, 1)], "block int, n bigint")
    rows = {r.block: r.quotas for r in sharding.communication_matrix(sizes, 3, 8, seed=4).collect()}
    assert {b: sum(q) for b, q in rows.items()} == {0: 50, 1: 7, 2: 0, 3: 100, 4: 0, 5: 0, 6: 0, 7: 1}
    assert sorted(sum(q[s] for q in rows.values()) for s in range(3)) == [52, 53, 53]
    again = sharding.communication_matrix(sizes, 3, 8, seed=4).collect()
    assert {r.block: r.quotas for r in again} == rows


def test_documents(spark):
    rows = [(k, f"text {k % 9} é", "x", -1) for k in range(203)]
    rows += [(None, "no id", "y", -1), (None, "no id", "y", -1), (7, None, None, None), (7, "", "z", 3), (8, "a" * 100_000, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, law string, shard int")
    found = sharding.sharded_documents(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _, _ in rows
    )
    by_shard = {s: sorted(r.slot for r in found if r.shard == s) for s in range(8)}
    assert sum(map(len, by_shard.values())) == len(rows)
    assert all(slots == list(range(len(slots))) and len(slots) in (26, 26, 27) for slots in by_shard.values())
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    again = sharding.sharded_documents(df.repartition(5)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again if r.doc_id} == {(r.doc_id, r.shard, r.slot) for r in found if r.doc_id}
    assert sharding.sharded_documents(df.limit(0)).count() == 0


def test_every_shard_is_equally_likely(spark):
    df = spark.range(64)
    shard = Counter()
    for seed in range(12):
        placed = sharding.shuffle_into_shards(df, ["id"], 4, blocks=8, seed=seed).collect()
        assert Counter(r.shard for r in placed) == {0: 16, 1: 16, 2: 16, 3: 16}
        shard.update((r.id < 32, r.shard) for r in placed)
    assert all(50 < shard[True, s] < 142 for s in range(4))


def test_files(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("text"))
    sharding.write_shards(sharding.shuffle_into_shards(df, ["id"], 4, blocks=8), str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
