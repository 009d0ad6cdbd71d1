import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from screenspark.llm import token_files

LIBRARY = Tokenizer.from_file(token_files.WORD_BPE)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ODD = ["", " ", "Hello  World, it's\n\nfine", "É é ́x ΣΑΣ ΑΣ İ", "<|endoftext|> a<|startoftext|>b", "a\x1cb \x85 c　d", "x" * 5000, "漢字 🙂 12 345", "don't 'S 'Re"]


def ids_of(texts):
    coder = token_files.word_bpe(token_files.WORD_BPE)
    return [np.frombuffer(x, coder.kind).tolist() for part in coder.encode(texts) for x in part]


@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300), st.sampled_from([255, 256, 65535, 65536, 2**24 - 1, 2**24]))))
def test_pack_and_unpack(numbers):
    control, data = token_files.pack(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, -(-n.bit_length() // 8)) for n in numbers)
    assert token_files.unpack(control, data, len(numbers)).tolist() == numbers


@given(st.lists(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=9), max_size=9))
def test_pack_many(sequences):
    flat, lengths = np.array([n for s in sequences for n in s], np.uint32), np.array([len(s) for s in sequences], np.int64)
    control, data = token_files.pack_all(flat, lengths)
    assert [(c, d) for c, d in zip(control, data)] == [token_files.pack(np.array(s, np.uint32)) for s in sequences]
    assert token_files.unpack_all(control, data, lengths).tolist() == flat.tolist()


@pytest.mark.parametrize("text", ODD)
def test_words(text):
    own = ids_of([text])[0]
    assert own == LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from([*"aeiJjSΣ'. \n1éÉ漢🙂!́̌İſ½²Ǆ\t", "the", "'s", " ", "<|endoftext|>", "ll"]), max_size=40).map("".join))
def test_any_words(text):
    own = ids_of([text])[0]
    assert own == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [(700_000, 8_000_000), (5, 30)])
def test_many_texts_at_once(monkeypatch, limits):
    monkeypatch.setattr(token_files, "KEPT_PIECES", limits[0])
    monkeypatch.setattr(token_files, "CHARS_AT_ONCE", limits[1])
    texts = [*ODD, "", "the same words the same words", "J̌ ǰ Ǆ ﬁ ½ ² Ⅷ x", *ODD, "", ""]
    assert ids_of(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_file(spark):
    rows = [(50 - 3 * k, t, "x") for k, t in enumerate(ODD)] + [(7, None, None), (None, "no id", "y"), (90, "same", "s"), (90, "same", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part string")
    found = [tuple(r) for r in token_files.through_file(df).collect()]
    expected, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == expected
    assert token_files.through_file(df.limit(0)).count() == 0
