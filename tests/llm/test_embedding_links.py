import numpy as np
import pytest

from screenspark.llm import embedding_links


def brute(rows):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    links = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and sound(v) and sound(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            new = links[front.pop()] - seen
            seen |= new
            front.extend(new)
        out.append((vec_id, len(links[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return sorted(out, key=repr)


def test_large_group_equals_small_steps():
    draw = np.random.default_rng(8)
    unit = draw.standard_normal((1, 24)) + 0.3 * draw.standard_normal((300, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    keys = draw.integers(0, 3, (300, 6))
    rows = np.arange(300)
    one = embedding_links._small_groups(unit, keys, np.full(300, 2), np.zeros(300, int), 0.93)
    other = embedding_links._block_pair(unit, keys, 2, rows, rows, 0.93)
    cosines = unit @ unit.T
    expected = {(i, j) for i in rows for j in rows if i < j and cosines[i, j] >= 0.93 and not (keys[i, :2] == keys[j, :2]).any()}
    assert set(zip(*map(list, one))) == set(zip(*map(list, other))) == expected and len(expected) > 100


@pytest.mark.parametrize("block, small", [(1024, 48), (4, 48), (1024, 1), (4, 1)])
def test_against_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(embedding_links, "BLOCK", block)
    monkeypatch.setattr(embedding_links, "SMALL", small)
    draw = np.random.default_rng(5)
    rows, n = [], 0
    for group in range(12):
        centre = draw.standard_normal(16)
        for spread in (0, 0, 0.1, 0.2, 0.3, 0.35, 0.4):
            rows.append((n, [float(x) for x in centre + spread * draw.standard_normal(16)], group % 3 if group else None))
            n += 1
    same = [0.5] * 16
    rows += [(200 - i, same, 7) for i in range(20)] + [(300, [x * 1e200 for x in same], 7), (301, [x * 1e-300 for x in same], 7)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [], 1)]
    rows += [(405, [1.0, float("inf")], 1), (406, [1.0, 2.0], 9), (407, [1.0, 2.0, 0.0], 9), (None, [2.0, 4.0], 9), (406, [1.0, 2.0], 9)]
    rows += [(408, [-0.0, 1.0], 8), (409, [0.0, 1.0], 8), (None, [5.0, -3.0], 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, node string")
    found = sorted(((r.id, r.n_links, r.component) for r in embedding_links.linked_vectors(df).collect()), key=repr)
    assert found == brute(rows)
    assert embedding_links.vector_components(df.limit(0)).count() == 0
