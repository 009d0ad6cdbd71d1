import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from screenspark.llm import bpe, decontaminate, language, quality, simhash
from tests.llm.test_decontaminate import plain_words
from tests.llm.test_simhash import plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [tuple(plain_words(t)) for (t,) in duckdb.sql(f"select text from '{FOLDER}/benchmark.parquet'").fetchall()]
    windows = {w[i : i + 10] for w in bench for i in range(max(1, len(w) - 9))}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], FOLDER).cache())
    texts = [{r.doc_id: r.text for r in step.collect()} for step in steps[:-1]]
    assert all(step.columns == docs.columns for step in steps[:-1])

    samples = language.learn(language.training_rows(docs))
    names, scores = language.CrossParser(samples).predict(list(texts[0].values()))
    assert set(texts[1]) == {k for k, n, s in zip(texts[0], names, scores) if n != "und" and s >= language.MIN_SCORE}

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bad = quality.learn(steps[1], labels).scores(list(texts[1].values())) < quality.REJECTED_BELOW
    assert set(texts[2]) == {k for k, b in zip(texts[1], bad) if not b}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(truth.get(k, 0) for k in set(texts[1]) - set(texts[2])) <= 2

    prints = {k: plain_fingerprint(t) for k, t in texts[2].items()}
    group = {k: k for k in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and group[b] > group[a]:
                    group[b], changed = group[a], True
    assert set(texts[3]) == set(group.values())

    def is_clean(text):
        w = plain_words(text)
        return not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    assert set(texts[4]) == {k for k, t in texts[3].items() if is_clean(t)}
    assert len(texts[4]) < len(texts[3])

    library = Tokenizer.from_file(bpe.BYTE_LEVEL)
    assert {r.doc_id: r.n_tokens for r in steps[5].collect()} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts[4].items()}


def test_run_is_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding_and_decoding",
    ]
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_stages_take_every_kind_of_row(spark):
    long = " ".join(f"word{i} of the story" for i in range(40))
    rows = [(1, long, "en", "a", 3, "k"), (1, long, "en", "a", 3, "k"), (2, long, "en", None, None, "k"), (None, long, "en", "b", 1, "k"), (3, None, None, None, None, None), (4, "", "en", "a", 0, "x"), (None, "no id at all, only a text", "en", "a", 0, "x"), (None, "no id at all, only a text", "en", "a", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __spare string").withColumnRenamed("__spare", "score")
    one = simhash.one_per_group(docs)
    assert one.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=repr) == sorted([(1, long), (3, None), (None, "no id at all, only a text")], key=repr)
    bench = spark.createDataFrame([(1, "of the story word3 of the story word4 of the story")], "item_id bigint, text string")
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        stage(spark, docs, FOLDER).collect()


def test_columns_of_any_name_come_back(spark):
    long = " ".join(f"word{i} of the story" for i in range(40))
    rows = [(k, f"{long} {k % 3}" if k < 6 else long.upper(), "en", "a", 3, "d", 2.5, 3, 4, 5, 6, "j", "T", "S") for k in range(8)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "__score", "__id", "__mark", "__k1", "__k2", "__judged", "judged", "stays"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, c0 string, n_chars bigint, x5 string, x6 double, x7 int, x8 int, x9 int, x10 int, x11 string, x12 string, x13 string").toDF(*names)
    bench = spark.createDataFrame([(1, "no passage of these")], "item_id bigint, text string")
    kept = {r[0]: tuple(r) for r in docs.collect()}
    stages = [*[lambda d, stage=stage: stage(spark, d, FOLDER) for _, stage in corpus_pipeline.STAGES[:-1]], lambda d: decontaminate.clean_documents(d, bench)]
    for stage in stages:
        out = stage(docs)
        assert out.columns == names
        assert all(kept[r[0]] == tuple(r) for r in out.collect())
    assert len(stages[-1](docs).collect()) == 8 and len(simhash.one_per_group(docs).collect()) >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 8
    twins = docs.select("doc_id", "text", "lang").withColumn("other", docs["text"]).toDF("doc_id", "text", "lang", "TEXT")
    assert quality.accepted(twins, spark.read.parquet(f"{FOLDER}/labels.parquet")).columns == twins.columns
    found = language.identified(docs, language.learn(language.training_rows(docs)))
    assert found.columns == [*names, "lang_pred", "score"] and found.count() == 8
