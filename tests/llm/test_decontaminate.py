import re

import pytest

from screenspark.llm import decontaminate

LONG = " ".join(f"w{i}" for i in range(30))


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item_id, item in items:
            iw = plain_words(item)
            n = min(10, len(iw))
            if not n:
                continue
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= {str(item_id)} - {"None"}
        out.append((doc_id, len(words), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


DOCS = [
    (1, f"before {LONG} after"),
    (1, f"before {LONG} after"),
    (2, "W3 w4 w5, w6 w7 w8 w9 w10 w11! w12 other w20 w21"),
    (3, "w3 w4 w5 w6 w7 w8 w9 w10 w11 none"),
    (4, None),
    (5, ""),
    (6, "x short item y short item short item"),
    (7, "É accent here É accent here"),
    (8, "a a a a a a a a a a a a a a"),
    (None, f"{LONG} {LONG}"),
    (9, "...!!! "),
    (10, "one"),
    (13, "ONE TWO!! THREE.\n"),
    (11, "é accent"),
    (12, " ".join(["pad"] * 500 + [LONG] + ["pad"] * 500)),
]
ITEMS = [
    (100, LONG),
    (9, LONG),
    (9, LONG),
    (12, "short item"),
    (13, None),
    (14, "--"),
    (15, "É accent"),
    (16, "a a a a a a a a a a a"),
    (None, "one"),
    (17, "w20 w21 w22 w23 w24 w25 w26 w27 w28 w29 extra " + LONG),
]


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    docs = spark.createDataFrame([(*d, "k", [1]) for d in DOCS], "doc_id bigint, text string, item string, spans array<int>")
    items = spark.createDataFrame([(*i, "w") for i in ITEMS], "item_id bigint, text string, w string")
    found = decontaminate.overlaps(docs, items).collect()
    got = sorted(
        ((r.id, len(plain_words(r.text)), sum(s.after - s.first for s in r.spans or []), ",".join(r["items"] or [])) for r in found),
        key=repr,
    )
    assert got == brute(DOCS, ITEMS)
    counted = decontaminate.contamination(docs, items).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit) for r in counted) == sorted((repr(a), b, c) for a, b, c, _ in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}


@pytest.mark.parametrize("separator", [" ", "\n", ":", ".", "'", "-"])
def test_capital_sigma_before_any_separator(spark, separator):
    names = "ΝΙΚΟΛΑΟΣ ΕΛΛΑΔΑΣ ΠΑΥΛΟΣ ΟΔΟΣ ΛΟΓΟΣ ΝΟΜΟΣ ΤΟΠΟΣ ΧΡΟΝΟΣ ΔΡΟΜΟΣ ΠΥΡΓΟΣ".split()
    docs, items = [(1, f"x {separator.join(names)} y")], [(1, " ".join(names)), (2, ":".join(names[:3]))]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = [(r.id, 12, sum(s.after - s.first for s in r.spans or []), ",".join(r["items"] or [])) for r in found.collect()]
    assert got == brute(docs, items) == [(1, 12, 10, "1,2")]
