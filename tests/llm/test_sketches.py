import hashlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenspark.llm import sketches
from tests.llm.test_decontaminate import plain_words

FOLDER = "/root/testdata/sf0.001"
TOP = 1 << 63


def chained(words):
    """What Spark's xxhash64 makes of several strings, without the sign bit."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed & (TOP - 1)


def plain_sketch(text, share=sketches.SHARE):
    words = plain_words(text or "")
    if len(words) >= 5:
        hashes = {chained(words[i : i + 5]) for i in range(len(words) - 4)}
    else:
        hashes = {chained([" ".join(words)])} if words else set()
    return sorted(h for h in hashes if h < share * TOP) or sorted(hashes)[:1]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return len(set(a) & set(b)) / min(len(a), len(b))


def plain_rows(rows):
    def tie(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >= TOP else h

    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    known = {t: plain_sketch(t) for _, t in rows}
    out = []
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        own, changed = known[t], plain_sketch(new)
        text = ["".join(f"{h:016x}" for h in s) for s in (own, changed)]
        out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), *text, plain_likeness(own, changed), plain_likeness(own, known[after])))
    return sorted(out, key=repr)


def found_rows(df):
    return sorted(map(tuple, sketches.document_fingerprints(df).collect()), key=repr)


@pytest.fixture(params=[(500, 8), (2, 1)])
def cut(request, monkeypatch):
    monkeypatch.setattr(sketches, "ROWS", request.param[0])
    monkeypatch.setattr(sketches, "SAMPLED", request.param[1])


def test_table(spark, cut):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " ", "One", "one", "a b c d", "a b c d e", "A B c d e f g", long, long, long.upper(), "漢字 かな é🙂 x y z 🙂🙂", "...", "n u\tm\nb e r s"]
    rows = [*enumerate(texts), (3, "again three"), (3, "One"), (3, "One"), (None, "no id"), (None, "no id"), (None, None), (-5, long)]
    rows += [(100, "many copies of one row here")] * 40 + [(101, "after them")]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id bigint, text string, _place int, `a.b` int, sketch int").repartition(5)
    assert found_rows(df) == plain_rows(rows)
    assert found_rows(df.limit(0)) == []
    assert found_rows(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id bigint, text string")) == plain_rows([(7, "a b c d e f g h")])
    same = [(1, "all rows are one and the same")] * 30
    assert found_rows(spark.createDataFrame(same, "doc_id bigint, text string")) == plain_rows(same)


def test_given_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found_rows(df) == plain_rows([(r.doc_id, r.text) for r in df.collect()])


texts = st.lists(st.sampled_from(["a", "b", "c", "d", "é", "Z", "the cat", "sat. on"]), max_size=40).map(" ".join)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=20), st.sampled_from([1 / 2, 1 / 8, 1.0]))
def test_sketches_merge(spark, pairs, share):
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, "a", "sa", share), "b", "sb", share)
    df = df.select("a", "b", "sa", "sb", sketches.merged(F.col("sa"), F.col("sb"), share).alias("m"), sketches.containment(F.col("sa"), F.col("sb")).alias("c"))
    for r in df.collect():
        every = sorted({*plain_sketch(r.a, 1.0), *plain_sketch(r.b, 1.0)})
        assert r.sa == plain_sketch(r.a, share)
        assert r.m == ([h for h in every if h < share * TOP] or every[:1])
        assert r.c == pytest.approx(len({*r.sa} & {*r.sb}) / len(r.sa) if r.sa else 1.0)
    assert df.count() == len(pairs)


def test_unequal_documents(spark):
    long = " ".join(f"word{i} {i % 7}" for i in range(20_000))
    part = " ".join(long.split()[10_000:11_200])
    df = sketches.with_sketch(spark.createDataFrame([(long, part)], "long string, part string"), "long", "l")
    df = sketches.with_sketch(df, "part", "p")
    r = df.select(sketches.containment(F.col("p"), F.col("l")).alias("inside"), sketches.containment(F.col("l"), F.col("p")).alias("back"), sketches.likeness(F.col("l"), F.col("p")).alias("near")).first()
    assert r.inside == r.near == 1.0 and r.back == pytest.approx(1196 / 39_996, rel=0.4)


def test_groups(spark):
    rows = [("x", "a b c d e f g h i j k l m n"), ("x", "o p q r s t u v w x y z"), ("y", "h i j k l m n o p q r s t"), (None, "h i j k l m"), ("z", "")]
    df = sketches.with_sketch(spark.createDataFrame(rows, "source string, text string"), "text", "sketch", 0.75)
    found = {r.group: tuple(r)[1:] for r in sketches.group_containment(df, "source", "sketch", 0.75).collect()}
    sets = {}
    for g, t in rows:
        sets.setdefault(g, set()).update(h for h in plain_sketch(t, 0.75) if h < 0.75 * TOP)
    for g, own in sets.items():
        rest = set().union(*[s for o, s in sets.items() if o != g])
        if own:
            assert found[g] == (len(own), len(rest), len(own & rest), pytest.approx(len(own & rest) / len(own)))
        else:
            assert g not in found
