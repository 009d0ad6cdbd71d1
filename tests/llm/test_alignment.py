import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from screenspark.llm import alignment

FIRST = Tokenizer.from_file(alignment.BYTE_LEVEL)
FIRST.no_truncation()
FIRST.no_padding()
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
ODD = [
    "", " ", "  a  b ", "a b  c\n d", "it's 'll 're x''s", "<|endoftext|>", "a <|endoftext|> b<s> </s>", "tab\t x \t y",
    "é è ñ ß 漢字 かな 🙂🙂 é   x  y", "word" * 30, "a\x1c b \x85 c", "123 4567 8 9.0", "\n\n\n", "x \n y\n z", "low ▁ line", "a▁b",
    "\x00 nul", "é́ ﬁ Ⅷ", "same same", "Ünïcödé", "<0x41> is no byte", "end ",
]


def plain(text):
    """(a ids, b ids, groups, links) of a text, by the definition."""
    raw = (" " + text).encode()
    a, b = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    if not text:
        return None
    own = alignment.aligner(alignment.BYTE_LEVEL, alignment.PIECES)
    spans = []
    for ids, pieces in ((a, own.a.pieces), (b, own.b_bytes)):
        at, out = 0, []
        for k in ids:
            out.append((at, at + len(pieces[k])))
            at += len(pieces[k])
        if b"".join(pieces[k] for k in ids) != raw:
            return None
        spans.append(out)
    x, y = spans
    common = sorted({e for _, e in x} & {e for _, e in y})
    groups, start = [], 0
    for end in common:
        groups.append("|".join(",".join(str(k) for k, (s, e) in zip(ids, own_spans) if s >= start and e <= end) for ids, own_spans in ((a, x), (b, y))))
        start = end
    links = [(p, q) for p, (s, e) in zip(a, x) for q, (t, f) in zip(b, y) if s < f and t < e]
    return a, b, ";".join(groups), Counter(links)


def digests(texts):
    """The rows that the query should give for (id, text) pairs."""
    found = [plain(t or "") for _, t in texts]
    counts = Counter(link for x in found if x for link in x[3])
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for (k, _), x in zip(texts, found):
        if x is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        n_best = sum(n for link, n in links.items() if counts[link] == best[link[0]])
        total = sum(n * counts[link] for link, n in links.items())
        out.append((k, len(a), len(b), groups.count(";") + 1, sum(links.values()), n_best, total, hashlib.sha256(groups.encode()).hexdigest()))
    return out


def own(text):
    total, groups, distinct, pairs, times = alignment.aligner(alignment.BYTE_LEVEL, alignment.PIECES).align([text])
    width = SECOND.get_piece_size()
    return total[0].tolist(), groups[0], {(int(p) // width, int(p) % width): int(n) for p, n in zip(pairs, times)}


def check(text):
    expected, (total, groups, links) = plain(text), own(text)
    if expected is None:
        assert total == [0] * 5 and groups == "" and links == {}
    else:
        assert total[1:] == [len(expected[0]), len(expected[1]), expected[2].count(";") + 1, sum(expected[3].values())]
        assert (groups, links) == (expected[2], dict(expected[3]))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aeinrst'. \n1é漢🙂!?-▁\t", "the", "'s", "  ", " ", " word", "ing", "<|endoftext|>", "ll", "__"]), max_size=60).map("".join))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("part", ["abc", "漢字", "=-", "the cat  sat\n", "🙂"])
def test_long_texts(part):
    check(part * (2 * alignment.LONG // len(part) // len(part.encode())))


def test_long_part_through_the_tree():
    text = "loooong漢" * 3000
    total, groups, _ = own(text)
    assert total[1] == len(FIRST.encode(" " + text, add_special_tokens=False).ids) and total[2] == len(SECOND.encode(text))
    assert groups == own(text)[1] and groups.count(";") + 1 == total[3]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 300), max_size=60), st.sets(st.integers(0, 300), max_size=200))
def test_gallop_finds_places(short, long):
    x, y = np.array(sorted(short), np.int64), np.array(sorted(long), np.int64)
    assert alignment.gallop(x, y).tolist() == np.searchsorted(y, x).tolist()


def test_gallop_of_long_lists():
    draw = np.random.default_rng(2)
    x, y = np.unique(draw.integers(0, 10**7, 40_000)), np.unique(draw.integers(0, 10**7, 300_000))
    assert (alignment.gallop(x, y) == np.searchsorted(y, x)).all()


def test_forgotten_parts_are_learnt_again(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_PARTS", 3)
    for text in ODD + ODD:
        check(text)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_table(spark, monkeypatch, limit):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
    rows = [(k, t) for k, t in enumerate([*ODD, None, "same same", "same same", "the same word, the other word"])] + [(None, "no id"), (3, "a b  c\n d")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, id int, `a.pairs` string").repartition(3)
    found = alignment.document_alignments(df)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(digests(rows), key=repr)
    assert alignment.document_alignments(df.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, alignment.document_alignments(nothing).collect())) == digests([(1, None), (2, "")])


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    short = [(k, t) for k, t in rows if len(t or "") < 1500]
    part = df.join(spark.createDataFrame([(k,) for k, _ in short], "doc_id bigint"), "doc_id")
    assert sorted(map(tuple, alignment.document_alignments(part).collect())) == sorted(digests(short))
    groups = {r.id: (r.groups, r.n_groups) for r in alignment.aligned(df).collect()}
    assert all(n == (g.count(";") + 1 if g else 0) for g, n in groups.values())
