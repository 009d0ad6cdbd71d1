"""URL filter: a list of allow and block rules, and boosted trees on lexical features for the rest.

The trees see length, depth, digit ratio, entropy, parameter counts and suffix statistics of a url, never its words.
They learn from labelled urls. Where the caller has none, urls are labelled by a short list of words that registered
names of unwanted sites commonly contain (``seed_labels``), so that the trees generalise from listed to unlisted names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import ascii_lower, bounded_sample

#: (verdict, host and path), as production uses them.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words in host names that mark a url as unwanted when no labels are given.
SEED_WORDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "loan", "pills", "porn", "poker", "spam", "viagra", "warez")
#: Labelled urls that the trees are trained on, at most (a hash sample).
TRAINING_ROWS = 20_000
#: Suffixes are counted in this many hash buckets, so their table has a fixed size.
SUFFIX_BUCKETS = 4096
TREES, DEPTH, SEED = 20, 4, 3
BLOCK_AT = 0.5

NUMBERS = (
    "length", "host_length", "path_length", "depth", "dots", "hyphens", "digits", "other", "entropy", "parameters",
    "query_length", "fragment", "top_rate", "top_n", "ending_rate", "ending_n",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to ``?``,
    ``#`` or the end. Both are empty for NULL and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else NULLs. A rule fits its host and all subdomains if the
    path starts with the rule's; of equally long ones, the first in the list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, below = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(told)).otherwise(verdict)
    return rule, verdict


def seed_labels(host: Column, words: Sequence[str] = SEED_WORDS) -> Column:
    """1.0 if a part of the host between dots and hyphens is a listed word, else 0.0; NULL for empty hosts."""
    parts = F.split(host, r"[.\-]")
    return F.when(host != "", F.arrays_overlap(parts, F.array(*map(F.lit, words))).cast("double"))


def _bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(urls: DataFrame) -> DataFrame:
    """Numbers of each url of ``urls`` (url, host, path), and the buckets of its two suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def share_of(pattern: str) -> Column:
        return F.length(F.regexp_replace(url, pattern, "")) / size

    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "dots": (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).cast("double"),
            "hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "digits": share_of("[^0-9]"),
            "other": share_of("[A-Za-z0-9]"),
            "entropy": F.when(url != "", entropy).otherwise(F.lit(0.0)),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "query_length": F.length(query).cast("double"),
            "fragment": F.instr(url, "#").cast("boolean").cast("double"),
            "top_bucket": _bucket(F.substring_index("host", ".", -1)),
            "ending_bucket": _bucket(F.regexp_extract("path", r"(\.[^./]*|/[^/]?)$", 1)),
        }
    )


def _suffix_table(labelled: DataFrame, bucket: str, name: str) -> DataFrame:
    """Smoothed rate of bad urls and logarithmic count per bucket: SUFFIX_BUCKETS rows at most."""
    return labelled.groupBy(F.col(bucket)).agg(
        ((F.sum("label") + 1) / (F.count(F.lit(1)) + 10)).alias(f"{name}_rate"), F.log1p(F.count(F.lit(1))).alias(f"{name}_n")
    )


def _with_suffixes(numbers: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    for table, bucket in zip(tables, ("top_bucket", "ending_bucket")):
        numbers = numbers.join(F.broadcast(table), bucket, "left")  # SUFFIX_BUCKETS rows
    return numbers.fillna({"top_rate": 0.1, "top_n": 0.0, "ending_rate": 0.1, "ending_n": 0.0})


class UrlModel:
    """Suffix statistics of all labelled urls and trees fitted to a bounded sample of them."""

    def __init__(self, tables: Sequence[DataFrame], trees: GBTClassificationModel | None, constant: float) -> None:
        self.tables, self.trees, self.constant = tables, trees, constant

    def scored(self, numbers: DataFrame) -> DataFrame:
        """``numbers`` of ``lexical`` with p_bad."""
        if self.trees is None:
            return numbers.withColumn("p_bad", F.lit(self.constant))
        ready = VectorAssembler(inputCols=list(NUMBERS), outputCol="_features").transform(_with_suffixes(numbers, self.tables))
        scored = self.trees.transform(ready)
        return scored.withColumn("p_bad", vector_to_array("probability")[1])


def learn(labelled: DataFrame) -> UrlModel:
    """Fit to rows (url, label): 1.0 is bad, 0.0 good. Labels of one kind, or none, give a constant."""
    host, path = host_and_path(F.col("url"))
    known = labelled.where("label is not null").select("url", "label", host.alias("host"), path.alias("path")).distinct()
    numbers = lexical(known)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(counts) < 2:
        return UrlModel((), None, float(next(iter(counts), 0.0)))
    tables = (_suffix_table(numbers, "top_bucket", "top"), _suffix_table(numbers, "ending_bucket", "ending"))
    fetched = [numbers.sparkSession.createDataFrame(t.collect(), t.schema) for t in tables]  # SUFFIX_BUCKETS rows each
    sample = _with_suffixes(bounded_sample(numbers, [F.col("url")], TRAINING_ROWS), fetched)
    # Both kinds weigh the same, so that 0.5 separates them however rare bad urls are.
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    ready = VectorAssembler(inputCols=list(NUMBERS), outputCol="_features").transform(sample.withColumn("_weight", weight))
    booster = GBTClassifier(
        featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
    )
    return UrlModel(fetched, booster.fit(ready.select("_features", "label", "_weight")), 0.0)


def judged(
    pages: DataFrame,
    id_column: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, p_bad) of every row of ``pages``.

    A url that a rule fits has the rule's verdict; any other is blocked if the trees find it bad with BLOCK_AT or more.
    ``labelled`` (url, label) trains them; by default the pages' own urls with ``seed_labels``. NULL and malformed
    urls have an empty host and path. Every row is judged, repeated ones too; an empty table gives none.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    if labelled is None:
        labelled = rows.select("url", seed_labels(F.col("host")).alias("label"))
    model = learn(labelled)
    rule, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    scored = model.scored(lexical(rows))
    own = F.when(F.col("p_bad") >= BLOCK_AT, "block").otherwise("allow")
    return scored.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_bad")


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Verdict on the url of every page."""
    return judged(pages).withColumnRenamed("id", "page_id")
