from itertools import combinations

import pytest
from pyspark.sql import functions as F

from screenspark.functions import tokens as K
from screenspark.operators import bands
from screenspark.operators import bits as B


def tanimoto(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else None


def test_tokens_and_bits(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT sat"), (2, ""), (3, None), (4, "x")], "id int, t string")
    got = df.select("id", K.tokens("t").alias("w")).select(
        "id",
        "w",
        K.gram_bits("w").alias("g"),
        K.gram_bits("w", max_gram=1).alias("g1"),
        K.pair_bits("w").alias("p"),
        K.gram_bits("w", portable=False).alias("fast"),
    )
    rows = {r["id"]: r for r in got.collect()}
    assert rows[1]["w"] == ["the", "cat", "the", "cat", "sat"]
    # the cat sat / the-cat cat-the cat-sat / the-cat-the cat-the-cat the-cat-sat
    assert len(rows[1]["g"]) == 9 and len(rows[1]["g1"]) == 3 and len(rows[1]["fast"]) == 9
    # 10 position pairs, of which (the, cat, 1) occurs twice
    assert len(rows[1]["p"]) == 9
    assert rows[1]["g"] == sorted(rows[1]["g"]) and max(rows[1]["g"]) < 2048
    for i in (2, 3):
        assert rows[i]["g"] == rows[i]["p"] == []
    assert len(rows[4]["g"]) == 1 and rows[4]["p"] == []


def test_keys_counts_and_blocks(spark):
    df = spark.createDataFrame([("a1b22",), (None,)], "t string")
    rows = df.select(
        K.key_bits("t", ["[0-9]", "z"]).alias("k"), *[c.alias(n) for n, c in K.pattern_counts("t", {"d": "[0-9]"}).items()]
    ).collect()
    assert [r["k"] for r in rows] == [[1, 0], [0, 0]] and [r["d"] for r in rows] == [3, 0]
    row = spark.sql("select array(1, null) as a, array(double('nan'), 2.5) as b, array(0, 3) as s")
    assert row.select(K.concat_blocks(["a", "b"]).alias("x")).first()["x"] == [1, 0, 0, 2.5]
    assert row.select(K.dense("s", 4).alias("x")).first()["x"] == [1, 0, 0, 1]


def test_tanimoto(spark):
    df = spark.createDataFrame([([0, 1, 2], [0, 1, 3]), ([], []), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(K.tanimoto("a", "b")).collect()] == [0.5, None, 0.0]


def test_structure_ratios(spark):
    df = spark.sql(
        "select 4 rotatable_bonds, 0 heavy_atoms, 2 rings, 1 aromatic_rings, 1 saturated_rings, 3 heteroatoms, "
        "0 spiro_atoms, 0 bridgehead_atoms, 2 hbd, 5 hba"
    )
    made = K.derived_ratios(K.STRUCTURE_RATIOS, K.STRUCTURE_SUMS)
    row = df.select(*[c.alias(n) for n, c in made.items()]).first()
    assert row["flexibility"] == 4 and row["aromaticity"] == 0.5 and row["hydrogen_bonding"] == 7


@pytest.fixture(scope="module")
def sets(spark):
    """205 rows, so that bands cross block ends; every tenth row has no bit, every third is a copy."""
    data = []
    for i in range(205):
        bits = [] if i % 10 == 9 else sorted({(i * 7 + j * j) % 60 for j in range(8)})
        data.append((i, "g", int(i % 4 == 0), [1, 2, 3] if i % 3 == 0 else bits))
    return spark.createDataFrame(data, "id long, g string, y int, bits array<int>")


def expect(rows, pairs):
    found = [(i, j, t) for i, j in pairs if (t := tanimoto(rows[i], rows[j])) is not None and t >= 0.8]
    partners = {x for i, j, _ in found for x in (i, j)}
    return {
        "n_rows": len(rows),
        "n_with_partner": len(partners),
        "n_similar": len(found),
        "max_similarity": pytest.approx(max(t for _, _, t in found)) if found else None,
    }


def stats(df):
    return {k: v for k, v in df.first().asDict().items() if k != "g"}


@pytest.fixture(scope="module")
def close_sets(spark):
    """Sets of 20 to 30 bits, most of them a few bits away from others, some equal, some empty."""
    import random

    draw = random.Random(4)
    data = []
    for i in range(240):
        base = random.Random(i % 11)
        bits = set(base.sample(range(64), base.randint(20, 30)))
        bits ^= set(draw.sample(range(64), draw.choice([0, 0, 1, 2, 4])))
        data.append((i, "g", draw.choice([0, 1, 1]), sorted(bits) if i % 20 else []))
    return spark.createDataFrame(data, "id long, g string, y int, bits array<int>")


@pytest.mark.parametrize("block", [7, 1024])
@pytest.mark.parametrize("name", ["sets", "close_sets"])
def test_similar_rows_equal_brute_force(request, name, block):
    df = request.getfixturevalue(name)
    local = df.orderBy("id").collect()
    rows = [r["bits"] for r in local]
    every = list(combinations(range(len(rows)), 2))
    assert stats(B.similar_rows(df, ["g"], "bits", 64, block=block)) == expect(rows, every)
    crossing = [(i, j) for i, j in every if local[i]["y"] != local[j]["y"]]
    assert stats(B.similar_rows(df, ["g"], "bits", 64, side="y", block=block)) == expect(rows, crossing)


def test_similar_rows_of_unusual_tables(spark):
    df = spark.createDataFrame([(None, [1, 2]), (None, [1, 2]), ("b", None), ("c", [])], "g string, bits array<int>")
    rows = {r["g"]: tuple(r)[1:] for r in B.similar_rows(df, ["g"], "bits", 8).collect()}
    assert rows == {None: (2, 2, 1, 1.0), "c": (1, 0, 0, None)}
    assert B.similar_rows(df.limit(0), ["g"], "bits", 8).count() == 0


def test_bit_profile(spark):
    df = spark.createDataFrame([("a", [0, 1, 2]), ("a", [0]), ("b", [])], "g string, bits array<int>")
    rows = {r["g"]: r for r in B.bit_profile(df, ["g"], "bits", 8).collect()}
    assert rows["a"]["density"] == 4 / 16 and rows["a"]["used_bits"] == 3 and rows["a"]["bits_per_row"] == 2
    assert rows["b"]["density"] == 0 and rows["b"]["used_bits"] == 0 and rows["b"]["n_rows"] == 1
    freq = {(r["g"], r["bit"]): r["n_rows"] for r in B.bit_frequency(df, ["g"], "bits").collect()}
    assert freq == {("a", 0): 2, ("a", 1): 1, ("a", 2): 1}


def test_packed_sets(spark):
    data = [[], [0], [63], [64], [0, 63, 64, 127, 128], [5, 199], list(range(200))]
    df = B.pack_sets(spark.createDataFrame([(x,) for x in data], "bits array<int>"), ["bits"], "bits", 200, "p")
    assert df.count() == len(data)
    for r in df.collect():
        assert [64 * w + b for w, v in enumerate(r.p) for b in range(64) if v >> b & 1] == r.bits and len(r.p) == 4
    both = df.select(F.col("bits").alias("x"), F.col("p").alias("px")).crossJoin(df.select(F.col("bits").alias("y"), F.col("p").alias("py")))
    both = both.select("x", "y", K.packed_shared("px", "py", 200).alias("n"), K.packed_tanimoto("px", F.size("x"), "py", F.size("y"), 200).alias("t"))
    for r in both.collect():
        assert r.n == len({*r.x} & {*r.y}) and r.t == tanimoto(r.x, r.y)


def numbers(rows, pairs):
    values = [t for i, j in pairs if (t := tanimoto(rows[i], rows[j])) is not None]
    return {
        "n_pairs": len(values),
        "mean_similarity": pytest.approx(sum(values) / len(values)),
        "max_similarity": pytest.approx(max(values)),
        "min_similarity": pytest.approx(min(values)),
        "n_similar": sum(v >= 0.8 for v in values),
    }


@pytest.mark.parametrize("block", [7, 1024])
@pytest.mark.parametrize("name", ["sets", "close_sets"])
def test_all_pairs_equal_brute_force(request, name, block):
    df = request.getfixturevalue(name)
    local = df.orderBy("id").collect()
    rows = [r["bits"] for r in local]
    every = list(combinations(range(len(rows)), 2))
    assert stats(B.pair_similarity(df, ["g"], "bits", 64, block=block)) == numbers(rows, every)
    assert stats(B.pair_similarity(df, [], "bits", 64, block=block)) == numbers(rows, every)
    crossing = [(i, j) for i, j in every if local[i]["y"] != local[j]["y"]]
    assert stats(B.pair_similarity(df, ["g"], "bits", 64, side="y", block=block)) == numbers(rows, crossing)


def test_all_pairs_of_unusual_tables(spark):
    df = spark.createDataFrame([(None, [1, 2]), (None, [1, 2]), ("b", None), ("b", [1]), ("c", []), ("c", []), ("d", [3])], "g string, bits array<int>")
    assert [tuple(r) for r in B.pair_similarity(df, ["g"], "bits", 8).collect()] == [(None, 1, 1.0, 1.0, 1.0, 1)]
    assert B.pair_similarity(df.limit(0), ["g"], "bits", 8).count() == 0
    assert B.pair_similarity(df.limit(0), [], "bits", 8).count() == 0


@pytest.mark.parametrize("following", [1, 7, 99, 500])
def test_following_pairs_equal_brute_force(sets, following):
    rows = [r["bits"] for r in sets.orderBy("id").collect()]
    packed = B.pack_sets(sets.withColumn("n", F.size("bits")), ["g", "id", "n"], "bits", 64, "p")
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if j <= i + following]
    assert stats(bands.following_similarity(packed, ["g"], "id", "p", "n", following, 64)) == numbers(rows, pairs)


@pytest.mark.parametrize("tile", [3, 1024])
@pytest.mark.parametrize("band", [(0, 0), (-2, 5), (1, 1), (0.5, 40.0), (-7, -3)])
def test_band_join_equals_brute_force(spark, band, tile):
    import random

    draw = random.Random(9)
    a = [(draw.choice(["x", "y", None]), i, draw.choice([None, 3, 3, 3, *range(-20, 60)])) for i in range(90)]
    b = [(draw.choice(["x", "y", None]), i, draw.choice([None, 3, 3, *range(-20, 60)])) for i in range(70)]
    left = spark.createDataFrame(a, "g string, i long, k int").repartition(3)
    right = spark.createDataFrame(b, "g string, j long, m int")
    got = sorted((r.i, r.j) for r in bands.band_join(left, right, ["g"], "k", "m", *band, "i", "j", rows=tile).collect())
    expected = [(i, j) for g, i, k in a for h, j, m in b if g == h and k is not None and m is not None and band[0] <= m - k <= band[1]]
    assert got == sorted(expected) and len(expected) > 5


def test_band_join_refuses_an_empty_band(sets):
    with pytest.raises(ValueError):
        bands.band_join(sets, sets, [], "id", "id", 2, 1, "id", "id")


def test_large_sets_meet_by_size(spark):
    import random

    draw, data = random.Random(3), []
    for i in range(60):
        bits = set(random.Random(i % 9).sample(range(2048), draw.choice([30, 200, 240, 600, 900])))
        bits ^= set(draw.sample(range(2048), draw.choice([0, 1, 5, 30])))
        data.append((i, "g", i % 2, sorted(bits)))
    df = spark.createDataFrame(data, "id long, g string, y int, bits array<int>")
    rows = [d[3] for d in data]
    every = list(combinations(range(60), 2))
    assert stats(B.similar_rows(df, ["g"], "bits", 2048)) == expect(rows, every)
    assert stats(B.similar_rows(df, ["g"], "bits", 2048, side="y", block=5)) == expect(rows, [(i, j) for i, j in every if (i - j) % 2])


def test_bits_are_hashed_in_batches(spark, monkeypatch):
    from hashlib import md5

    import pyarrow as pa

    from screenspark.functions import hashing

    texts = ["a b a", None, "", "x" * 60 + " y " + "z" * 54, "w" * 55, "é\u4e2d q " * 40, "one", "k " + "v" * 53]
    rows = [None if t is None else t.split() for t in texts] * 3
    monkeypatch.setattr(hashing, "PIECES", 5)
    monkeypatch.setattr(hashing, "WORDS", 7)

    def grams(starts, own, ends):
        import numpy as np

        for n in range(3):
            i = np.flatnonzero(np.arange(len(own)) + n < ends)
            yield starts[i], starts[i + n + 1] - 1, None, None, b"", own[i]

    def expected(row):
        pieces = {" ".join(row[i : i + n]) for n in (1, 2, 3) for i in range(len(row) - n + 1)}
        return sorted({int(md5(p.encode()).hexdigest()[:8], 16) % 2048 for p in pieces})

    wanted = [None if row is None else expected(row) for row in rows]
    assert hashing.bit_sets(pa.array(rows, pa.list_(pa.string())), 2048, " ", grams).to_pylist() == wanted
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "i int, w array<string>")
    made = df.select("i", K.gram_bits("w").alias("g"), K.pair_bits("w").alias("p")).orderBy("i")
    found = made.collect()
    assert [r["g"] for r in found] == wanted
    for row, r in zip(rows, found):
        pairs = None if row is None else {f"{a}|{b}|{d}" for d in (1, 2, 3, 4) for a, b in zip(row, row[d:])}
        assert r["p"] == (None if row is None else sorted({int(md5(p.encode()).hexdigest()[:8], 16) % 2048 for p in pairs}))
    assert "ArrowEvalPython" in made._jdf.queryExecution().toString()


def test_pairs_across_sides_meet_only_across(spark):
    df = spark.createDataFrame([("a", i, [i % 7, 7 + i % 5, 12 + i], int(i < 4)) for i in range(40)], "g string, id long, bits array<int>, y int")
    met = B.pair_similarity(df, ["g"], "bits", 64, side="y", block=4)._jdf.queryExecution().toString()
    # One branch of the plan deals the rows of either side out.
    assert "Union" in met
    assert B.pair_similarity(df, ["g"], "bits", 64, side="y", block=4).first()["n_pairs"] == 4 * 36


@pytest.mark.parametrize("sided", [False, True])
@pytest.mark.parametrize("kind", ["sparse", "dense", "mixed"])
def test_tiles_of_near_sets_equal_brute_force(monkeypatch, kind, sided):
    """First bits leave some pairs open, or all of them (dense sets); strips and steps of pairs end anywhere."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(B, "STRIP", 16)
    monkeypatch.setattr(B, "PAIRS_AT_ONCE", 5)
    draw = np.random.default_rng(5)
    share = {"sparse": [0.02, 0.1], "dense": [0.9, 0.95], "mixed": [0.05, 0.5, 0.9]}[kind]
    base = [draw.random(2048) < s for s in share for _ in range(3)]
    flags = np.array([base[i % len(base)] ^ (draw.random(2048) < draw.choice([0.001, 0.01, 0.1])) for i in range(70)])
    one, zero = draw.integers(0, 3, 70), draw.integers(1, 3, 70) * int(sided)
    one = one if sided else one + 1
    packed = [np.packbits(f, bitorder="little").tobytes() for f in flags]
    rows = pd.DataFrame({"_node": range(100, 170), "_size": flags.sum(axis=1), "_one": one, "_zero": zero, "_packed": packed})
    for met, first in (((0, 0), np.ones(70, bool)), ((0, 1), draw.random(70) < 0.4)):
        told = B._near_pairs(rows.assign(_i=met[0], _j=met[1], _first=first), 0.8, sided)
        wanted = {}
        for i, j in combinations(range(70), 2):
            value = (flags[i] & flags[j]).sum() / (flags[i] | flags[j]).sum()
            if value < 0.8 or (met[1] and first[i] == first[j]):
                continue
            crossing = not sided or (one[i] and zero[j]) or (zero[i] and one[j])
            for x, y in ((i, j), (j, i)):
                ones, zeros, best = wanted.get(100 + x, (0, 0, 0.0))
                wanted[100 + x] = (ones + one[y], zeros + zero[y], max(best, value if crossing else 0.0))
        wanted = {n: w for n, w in wanted.items() if w[0] + w[1]}
        assert {r["_node"]: (r["_ones"], r["_zeros"], r["_best"]) for r in told.to_dict("records")} == wanted


def test_blocks_of_similar_sizes_meet(spark):
    data = [("g", size, n) for size in range(100, 400) for n in range(4)] + [(None, 50, n) for n in range(100)]
    sets = spark.createDataFrame([(g, size, 1000 * size + n) for g, size, n in data], "g string, _size int, _node long")
    placed, met = B._blocks_of_sizes(sets, ["g"], 0.8, 40)
    blocks = placed.groupBy("_block").count().collect()
    assert placed.count() == 1300 and max(r["count"] for r in blocks) <= 80
    size = {r["_block"]: (r["g"], r["lo"], r["hi"]) for r in placed.groupBy("g", "_block").agg(F.min("_size").alias("lo"), F.max("_size").alias("hi")).collect()}
    pairs = {(r["_i"], r["_j"]) for r in met.collect()}
    for x, (g, lo, hi) in size.items():
        for y, (h, low, high) in size.items():
            near = g == h and max(lo, low) * 0.8 <= min(hi, high)
            assert ((x, y) in pairs or (y, x) in pairs) == near
            assert x == y or not ((x, y) in pairs and (y, x) in pairs)


def _sets_of_all_sizes(draw, n):
    """Distinct sets of 2048 bits, few to almost all, some near each other; an empty, a full one and some about a digit's limit."""
    import numpy as np

    flags = [np.zeros(2048, bool), np.ones(2048, bool), *(np.arange(2048) < k for k in (1, 254, 255, 256, 1023, 1024, 1025, 2047))]
    while len(flags) < n:
        flags.append(draw.random(2048) < draw.choice([0.002, 0.05, 0.3, 0.6, 0.97]))
        flags.append(flags[-1] ^ (draw.random(2048) < 0.01))
    return np.unique(np.array(flags[:n]), axis=0)


def test_three_sets_are_counted_by_one_product():
    import numpy as np

    flags = _sets_of_all_sizes(np.random.default_rng(1), 80)
    flags, packed = flags.astype(np.float32), np.packbits(flags, axis=1, bitorder="little").view("<u8")
    for over in (False, True):
        threes = B._Threes(packed, flags.sum(axis=1), np.ones(len(packed)), np.arange(len(packed)), over)
        # A third of the rows is multiplied; a full set needs runs of three words, which hold 192 bits.
        assert threes.numbers.shape == (-(-len(packed) // 3), 2048) and len(threes.runs) == 11
        shared = np.vstack(threes.shared(flags))[: len(packed)]
        assert (shared == ((1 - flags if over else flags) @ flags.T)).all()


@pytest.mark.parametrize("sided", [False, True])
def test_numbers_of_tiles_equal_brute_force(monkeypatch, sided):
    import numpy as np
    import pandas as pd

    for name, value in (("FIRSTS", 12), ("SECONDS", 9), ("ROWS_AT_ONCE", 3)):
        monkeypatch.setattr(B, name, value)
    draw = np.random.default_rng(6)
    flags = _sets_of_all_sizes(draw, 76)
    n = len(flags)
    one, zero = draw.integers(1, 4, n), draw.integers(1, 3, n)
    packed = [np.packbits(f, bitorder="little").tobytes() for f in flags]
    rows = pd.DataFrame({"_size": flags.sum(axis=1), "_one": one, "_zero": zero, "_packed": packed})
    for met, first in (((0, 0), np.ones(n, bool)), ((0, 1), draw.random(n) < 0.4)):
        if sided:
            first = draw.random(n) < 0.5
        values, weights = [], []
        for i in range(n):
            for j in range(n):
                if (first[i] and not first[j]) if sided or met[1] else i <= j:
                    union = (flags[i] | flags[j]).sum()
                    weight = one[i] * (one[i] - 1) // 2 if i == j else one[i] * (zero[j] if sided else one[j])
                    if union and weight:
                        values.append((flags[i] & flags[j]).sum() / union)
                        weights.append(weight)
        values, weights = np.array(values), np.array(weights)
        found = B._numbers_of_tile(rows.assign(_i=met[0], _j=met[1], _first=first), 0.8, sided)
        assert (found.n, found.near) == (weights.sum(), weights[values >= 0.8].sum()) and found.near > 0
        assert [found.sum, found.most, found.least] == pytest.approx([(values * weights).sum(), values.max(), values.min()], rel=1e-12, abs=1e-15)


def test_a_set_moves_to_few_blocks_of_all_pairs(spark, monkeypatch):
    """A group is cut into 16 blocks unless these are full; before, it was into blocks of 1,024 rows."""
    frame, seen = type(spark.range(1)), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *on: seen.append(self) or deal(self, n, *on))
    monkeypatch.setattr(B, "SECONDS", 4)
    df = spark.range(300).select(F.lit("g").alias("g"), F.array(F.col("id").cast("int")).alias("bits"))
    out = B.pair_similarity(df, ["g"], "bits", 320).first()
    assert (out["n_pairs"], out["mean_similarity"], out["n_similar"]) == (300 * 299 // 2, 0.0, 0)
    dealt = seen[-1]
    assert dealt.count() == 300 * 16 and dealt.select("_i", "_j").distinct().count() == 16 * 17 // 2
