import itertools
import zlib

import numpy as np
import pytest

from screenspark.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_pairs_by_the_identity():
    draw = np.random.default_rng(2)
    machine = quality.Machine(0.3, draw.normal(size=quality.WIDTH), draw.normal(size=(quality.WIDTH, 3)))
    texts = ["", "one two two three", "ÀÉ 12 !! | x\nx\nx", "漢字 🙂 \ud800"]
    row, place, value = quality.features(texts)
    raw = machine.raw(row, place, value, len(texts))
    for k in range(len(texts)):
        p, x = place[row == k], value[row == k]
        pairs = sum(machine.factors[a] @ machine.factors[b] * u * v for (a, u), (b, v) in itertools.combinations(list(zip(p, x)), 2))
        assert raw[k] == pytest.approx(0.3 + machine.linear[p] @ x + pairs)


def test_features_do_not_depend_on_neighbours():
    texts = ["a b c", "", "many words here " * 50, "a b c"]
    row, place, value = quality.features(texts)
    for k, text in enumerate(texts):
        _, p, v = quality.features([text])
        assert p.tolist() == place[row == k].tolist() and np.allclose(v, value[row == k])


def test_every_kind_of_row(spark):
    rows = [(k, f"fine words number {k} of the text", "x", 9.0) for k in range(60)] + [(k, "BAD!! BAD!! BAD!!", "x", 9.0) for k in range(60, 120)]
    rows += [(200, None, "x", 1.0), (201, "", "y", 1.0), (202, "w" * 200_000, None, None), (None, "fine words of the text", "z", None), (5, "fine words of the text", "z", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality string, score double")
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)] + [(3, 1, 0), (4, None, 0), (None, 1, 0), (7, 5, 0)], "doc_id bigint, quality int, text int")
    found = quality.document_quality(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert all((r.score > 0.5) == (r.doc_id < 60) for r in held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {k for k in range(60)} and not {r.doc_id for r in kept.collect()} & set(range(60, 120))
    assert quality.document_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.document_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_rows_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in quality.document_quality(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    assert np.mean([a == b for a, b in held]) >= 0.9
