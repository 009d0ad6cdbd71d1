"""Views of the given tables in the shape the operators expect, and the same views as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.functions.draws import draw32
from screenspark.functions.scalars import Rule
from screenspark.operators.clean import long_labels

TARGETS = ("quality", "toxic")
MODELS = ("forest", "linear", "boosted")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its labels, NULL where it has none."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


WIDE = """wide AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long labels with the unknown ones."""
    return long_labels(wide_labels(spark, sf_dir), ["doc_id"], TARGETS, known_only=False)


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_labels(table(spark, sf_dir, "labels"), ["doc_id"], TARGETS)


LONG_ALL = f"""{WIDE}, long AS (
  SELECT doc_id, 'quality' AS target, quality AS label FROM wide
  UNION ALL SELECT doc_id, 'toxic', toxic FROM wide)"""

LONG = """long AS (
  SELECT doc_id, 'quality' AS target, quality AS label FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic IS NOT NULL)"""


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count properties of each whole text."""
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        "source",
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.regexp_count("text", F.lit("[.!?]")).cast("double").alias("n_stops"),
        F.regexp_count("text", F.lit("[0-9]")).cast("double").alias("n_digits"),
    )


PROPS = """props AS (
  SELECT doc_id, source, lang, n_chars::DOUBLE AS n_chars,
    len(string_split(text, ' '))::DOUBLE AS n_words,
    len(regexp_extract_all(text, '[.!?]'))::DOUBLE AS n_stops,
    len(regexp_extract_all(text, '[0-9]'))::DOUBLE AS n_digits
  FROM documents)"""

PROPERTIES = ("n_chars", "n_words", "n_stops", "n_digits")
RULES = (
    Rule("chars", "n_chars", "<=", 500),
    Rule("words", "n_words", "<=", 100),
    Rule("stops", "n_stops", "<=", 5),
    Rule("digits", "n_digits", "<=", 10),
)


def score(salt: str, *keys: str) -> Column:
    """A made-up probability with two decimals, so that many rows tie."""
    return F.pmod(draw32(salt, *keys), F.lit(101)) / F.lit(100.0)


def score_sql(salt: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{salt}'", *[f"{k}" for k in keys]])
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT % 101) / 100.0::DOUBLE)"


def wide_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with a probability column per target, as models leave it."""
    return table(spark, sf_dir, "documents").select("doc_id", *[score(t, "doc_id").alias(t) for t in TARGETS])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, target, probability)`` for every document and target."""
    return wide_probabilities(spark, sf_dir).unpivot(["doc_id"], list(TARGETS), "target", "probability")


PREDICTIONS = f"""predictions AS (
  SELECT doc_id, 'quality' AS target, {score_sql('quality', 'doc_id')} AS probability FROM documents
  UNION ALL SELECT doc_id, 'toxic', {score_sql('toxic', 'doc_id')} FROM documents)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, target, model, label, probability)``: known labels with one score per model."""
    labels = known_labels(spark, sf_dir)
    wide = labels.select("*", *[score(m, "target", "doc_id").alias(m) for m in MODELS])
    return wide.unpivot(["doc_id", "target", "label"], list(MODELS), "model", "probability")


SCORED = f"{LONG}, scored AS (" + " UNION ALL ".join(
    f"SELECT doc_id, target, '{m}' AS model, label, {score_sql(m, 'target', 'doc_id')} AS probability FROM long"
    for m in MODELS
) + ")"
