import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from screenspark.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.BYTE_LEVEL)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ODD = [
    "", " ", "  a  b ", "a b  c\n d", "it's 'll 're x''s", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "tab\t x \t y",
    "é è ñ ß 漢字 かな 🙂🙂 é   x  y", "word" * 30, "a\x1c b \x85 c", "123 4567 8 9.0", "\n\n\n", "x \n y\n z",
]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text):
    return np.frombuffer(next(iter(bpe.byte_level(bpe.BYTE_LEVEL).encode([text]))), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert own(text) == ids_of(text)
    assert bpe.byte_level(bpe.BYTE_LEVEL).decode(ids_of(text)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aeinrst'. \n1é漢🙂!?-", "the", "'s", "'re", "  ", "<|endoftext|>", "ll", "__", "''", "\t"]), max_size=60).map("".join))
def test_any_text(text):
    assert own(text) == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aeinrst'.\n1é漢🙂!?-", "the", "'s", "'re", "  ", " ", "'ll", "aaaa", "====", "--"]), min_size=2, max_size=200).map("".join), st.integers(1, 9))
def test_tree_with_tiny_leaves(text, leaf):
    coder = bpe.byte_level(bpe.BYTE_LEVEL)
    before = bpe.LEAF, bpe.FIRST_WINDOW
    bpe.LEAF, bpe.FIRST_WINDOW = leaf, 4
    try:
        assert np.frombuffer(coder.tree(text), "<u4").tolist() == ids_of(text)
    finally:
        bpe.LEAF, bpe.FIRST_WINDOW = before


@pytest.mark.parametrize("part", ["a", "ab", "漢字かな", "=-", "the\n", "🙂", "x1y2", "'s'", "\n\n ", "loooong"])
def test_long_texts_without_spaces(part):
    text = part * (60_000 // len(part))
    assert own(text) == ids_of(text)


def test_bytes_that_are_no_text():
    ids = [LIBRARY.token_to_id(t) for t in ("Ã", "A", "Â")]
    assert bpe.byte_level(bpe.BYTE_LEVEL).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_table(spark, monkeypatch):
    rows = [(k, t, "de") for k, t in enumerate([*ODD, None, "same", "same", "x" * 100_000])] + [(None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = bpe.round_trip(df).collect()
    expected = []
    for k, t, _ in rows:
        ids = ids_of(t or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        expected.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    texts = {r.id: r.text for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert all(texts[k] == (t or "") for k, t, _ in rows)
    assert bpe.round_trip(df.limit(0)).count() == 0
