import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenspark.llm import runs


def plain_runs(words):
    """(start, length, period) of all runs, by looking at every period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(12, 2 * p):
                found.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def own_runs(texts):
    text, start, end, period = runs.find_runs([np.array(t, np.int64) for t in texts])
    found = [[] for _ in texts]
    for k, s, e, p in zip(text.tolist(), start.tolist(), end.tolist(), period.tolist()):
        found[k].append((s, e - s, p))
    return found


repeated = st.tuples(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 60)).map(
    lambda t: t[0] + [t[1][k % len(t[1])] for k in range(t[2])]
)
any_words = st.one_of(repeated, st.lists(st.integers(0, 1), max_size=80), st.lists(st.integers(0, 20), max_size=80), st.tuples(repeated, repeated).map(lambda t: t[0] + t[1] + t[0]))


@settings(max_examples=300, deadline=None)
@given(st.lists(any_words, min_size=1, max_size=6))
def test_runs_equal_brute_force(texts):
    assert own_runs(texts) == [plain_runs(t) for t in texts]


def test_words_of_the_contract_lengths():
    assert own_runs([[0] * 11, [0] * 12, [0, 1] * 6, [0, 1] * 5 + [0], list(range(6)) * 2, list(range(7)) * 2, []]) == [
        [], [(0, 12, 1)], [(0, 12, 2)], [], [(0, 12, 6)], [(0, 14, 7)], [],
    ]


def test_fibonacci_words_have_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert own_runs([b, b]) == [plain_runs(b)] * 2 and len(plain_runs(b)) > 40


@pytest.mark.parametrize("limit", [1, 50])
def test_questions_in_small_parts(monkeypatch, limit):
    monkeypatch.setattr(runs, "QUESTIONS_AT_ONCE", limit)
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, k, 120).tolist() for k in (1, 2, 3, 9)] + [list(range(40)) * 3, list(range(30)) * 2 + [7] * 30]
    assert own_runs(texts) == [plain_runs(t) for t in texts]


def test_long_repeats():
    draw = np.random.default_rng(6)
    once = draw.integers(0, 5000, 3000).tolist()
    assert own_runs([once * 3, once + [9999] + once, [4] * 20000]) == [[(0, 9000, 3000)], [], [(0, 20000, 1)]]


def test_cover_reaches_every_pair():
    assert all((i + runs._STEP[i, j]) % 13 in runs.COVER and (j + runs._STEP[i, j]) % 13 in runs.COVER for i in range(13) for j in range(13))


@pytest.mark.parametrize("words", [5, 10**6])
def test_table(spark, monkeypatch, words):
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", words)
    line = "this line comes again\n"
    texts = [None, "", "   ", "one", "a a a a a a a a a a a a a", line * 9, "start " + line * 3 + "end", "tab\tnew\x0b\x0c\r x", "nbsp stays \x1cone", "  é " * 20]
    rows = [(k, t) for k in range(40) for t in texts[k % len(texts) :][:1]] + [(7, line * 9), (7, line * 9), (None, line * 5), (None, None), (-3, "x y " * 30)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, runs int, `a.b` int").repartition(3)
    found = runs.document_runs(df)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([plain_row(k, t) for k, t in rows], key=repr)
    assert runs.document_runs(df.limit(0)).collect() == []


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect() if len(r.text or "") < 20_000]
    expected = [plain_row(k, t) for k, t in rows]
    known = {r[0] for r in rows}
    assert sorted((tuple(r) for r in runs.document_runs(df).collect() if r.doc_id in known), key=repr) == sorted(expected, key=repr)
    assert sum(r[1] > 0 for r in expected) > 10


def test_texts_without_repetitions_stay(spark):
    df = spark.createDataFrame([(1, "so it is  said\n" * 4 + "and done"), (2, " plain  words ")], "doc_id bigint, text string")
    found = {r.id: (r.runs, r.collapsed) for r in runs.word_runs(df).collect()}
    assert found[1] == ([(0, 16, 4)], "so it is said and done") and found[2] == ([], "plain words")
