import itertools
import re

import numpy as np
import pytest
import xxhash

from screenspark.llm import graph, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in near:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["a b c d a b c", "One two", "", None, " \t\n", "É É É é x y z", "x" * 1000, "a b c d\x0be"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    got = spark.sql("select xxhash64('ab cd ef')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"ab cd ef", 42)


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("pass_rows", [4096, 3])
def test_links_against_all_pairs(spark, monkeypatch, bits, pass_rows):
    monkeypatch.setattr(simhash, "PASS_ROWS", pass_rows)
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    prints = set(base.tolist())
    for x in base.tolist()[:20]:
        for _ in range(12):
            x ^= 1 << int(draw.integers(64))
            prints.add(x ^ (1 << int(draw.integers(64))))
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in sorted(prints)]
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= bits]
    expected = roots_of(signed, near)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), bits)
    found = [(r.a, r.b) for r in links.collect()]
    assert roots_of(signed, found) == expected
    listed = {r.node: r.root for r in graph.components(links).collect()}
    assert all(listed.get(n, n) == r for n, r in expected.items())


def test_documents_with_every_kind_of_row(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "x"), (3, text, "x"), (3, text, "x"), (9, None, None), (8, "", "y"), (None, "solo text here", "z"), (7, "other words entirely so", None), (11, text.upper(), "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component string")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.linked_documents(df).collect()), key=repr)
    prints = {t: f"{plain_fingerprint(t):016x}" for t in (text, None, "solo text here", "other words entirely so")}
    assert found == sorted(
        [(5, prints[text], 3), (3, prints[text], 3), (3, prints[text], 3), (11, prints[text], 3), (9, "0" * 16, 8), (8, "0" * 16, 8), (None, prints["solo text here"], None), (7, prints["other words entirely so"], 7)],
        key=repr,
    )
    assert simhash.linked_documents(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, 8: 8, 9: 8}
