import zlib

import numpy as np
import pytest

from screenspark.llm import language

FOLDER = "/root/testdata/sf0.001"


def plain_phrases(text, sample):
    total = 0
    for start in range(0, len(text), language.STRETCH):
        part, i = text[start : start + language.STRETCH], 0
        while i < len(part):
            j = i
            while j < len(part) and part[i : j + 1] in sample:
                j += 1
            total, i = total + 1, max(j, i + 1)
    return total


def test_phrases_against_substring_search():
    draw = np.random.default_rng(1)
    samples = (("a", "".join(draw.choice(list("abcd "), 300))), ("b", "".join(draw.choice(list("cdefé "), 400))))
    texts = ["", "a", "zzz", "éa", *["".join(draw.choice(list("abcdefé z漢🙂"), n)) for n in (1, 2, 30, 511, 512, 513, 1500)]]
    found = language.CrossParser(samples).phrases(texts)
    assert found.tolist() == [[plain_phrases(t, s) for _, s in samples] for t in texts]


@pytest.mark.parametrize("text, expected", [(None, ""), ("", ""), ("12 ½²!", ""), ("A-b\n C1d", "a b c d"), ("É_é", "é é")])
def test_plain(text, expected):
    assert language.plain(text) == expected


def test_every_kind_of_row(spark):
    rows = [(k, "the cat and the dog " * 3, "en", 0.5) for k in range(30)] + [(k, "der hund und die katze " * 3, "de", 0.5) for k in range(30, 60)]
    rows += [(60, None, "en", 0.1), (61, "", "de", 0.1), (62, "123 !", None, None), (63, "und die katze", None, None), (None, "the dog", "en", None), (63, "und die katze", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    found = {r.doc_id: r for r in language.document_languages(df).collect()}
    assert language.document_languages(df).count() == len(rows)
    assert [found[k].lang_pred for k in (0, 40, 60, 61, 62, 63, None)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items() if k is not None)
    kept = language.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert language.document_languages(df.limit(0)).count() == 0
    unlabelled = language.document_languages(df.selectExpr("doc_id", "text", "string(null) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.document_languages(docs).collect() if r.held_out]
    assert len(held) > 40
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_hot_copies_do_not_starve_their_language(spark):
    words = {"xx": "lorum kepas vidon malet sorin tuvak".split(), "en": "the cat and dog sleep under old trees".split()}
    draw = np.random.default_rng(2)
    rows = [(" ".join(draw.choice(words[lang], 60)), lang) for lang, n in (("xx", 300), ("en", 400)) for _ in range(n)]
    rows += [("vidon malet " * 10, "xx")] * 60_000 + [("Я", "ru"), ("1" * 900 + " д", "ru"), ("12", "no")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    found = dict(language.learn(df))
    assert set(found) == {"xx", "en", "ru"} and len(found["xx"]) == len(found["en"]) == language.SAMPLE_CHARS
    assert sorted(found["ru"].split()) == ["д", "я"]


def test_few_long_texts_give_a_whole_sample(spark):
    df = spark.createDataFrame([("ab cd " * 2000, "a"), ("ef gh " * 4000, "a"), ("12 x " * 9000, "b")], "text string, lang string")
    assert {len(t) for _, t in language.learn(df)} == {language.SAMPLE_CHARS}


def test_short_samples_win_no_foreign_text():
    english = "the cat and the dog sleep under the old trees of the garden " * 40
    parser = language.CrossParser((("en", english), ("xx", "a")))
    names, scores = parser.predict(["the old cat of the garden sleeps", "漢字漢字漢字", "a"])
    assert names[0] == "en" and scores[1] == 0.5 and names[2] == "xx"


def script(first, letters, seed):
    draw = np.random.default_rng(seed)
    return " ".join("".join(chr(first + int(k)) for k in draw.integers(0, letters, 6)) for _ in range(400))


def test_letters_beyond_the_first_plane():
    samples = (("de", script(97, 20, 1)), ("got", script(0x10330, 20, 2)))
    names, scores = language.CrossParser(samples).predict([script(0x10330, 20, 3)[:200], script(97, 20, 4)[:200]])
    assert names == ["got", "de"] and min(scores) > 0.9


def test_rare_letters_are_parsed_like_frequent_ones(monkeypatch):
    samples = (("a", script(0x4E00, 60, 1)), ("b", script(0x4E20, 90, 2)))
    texts = [script(0x4E00, 120, k)[:300] for k in range(5)] + [samples[0][1][50:400], "", "xyz"]
    expected = language.CrossParser(samples).costs(texts)
    for few in (1, 7, 40):
        monkeypatch.setattr(language, "FREQUENT_LETTERS", few)
        assert (language.CrossParser(samples).costs(texts) == expected).all()


def test_many_languages_of_many_letters_fit():
    samples = tuple((f"l{k:02}", script(*((97, 26), (0x400, 60), (0x4E00, 8000))[k % 3], k)) for k in range(60))
    parser = language.CrossParser(samples)
    held = sum(s.table.nbytes + s.keys.nbytes + s.to.nbytes + s.own.nbytes for s in parser.steps) + parser.code.nbytes
    assert held < 500e6
    assert parser.predict([samples[2][1][100:400], samples[1][1][100:400]])[0] == ["l02", "l01"]
