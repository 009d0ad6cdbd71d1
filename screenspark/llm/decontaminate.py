"""Benchmark passages in documents, found by winnowing.

The fingerprints of a word sequence are the smallest hash of its k-grams in every window of w consecutive k-grams. A
passage of w + k - 1 words or more that two sequences share holds a full window of both, so they share its fingerprint:
with k = 5 and w = 6 every shared run of ten words is found. Documents' fingerprints meet the benchmark's in a join;
the hits are laid back on document and item, and each diagonal is extended to the full runs of equal words. Runs of at
least ten words count. Items of one to nine words are below the guarantee: for each such length that occurs, the
documents' n-grams of that length are joined on their own.

Only built-in functions are used. Texts are never shuffled: a document's hits, a few numbers, come back to the scan of
the documents by broadcast if they are measured to be small, else by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import ascii_lower, numbered_columns, sent_if_small
from screenspark.session import materialise

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Words are runs of everything but ASCII control characters, white space and punctuation.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a side is sent to every task. A row holds a few numbers (an item's row its words: tens to
#: thousands of bytes), so this is tens of megabytes; larger sides are joined by key.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered; NULL has none. Full lowering would not do: what a capital sigma becomes depends
    on the characters after it, across the ends of words."""
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(cut, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words (full lowering has the same); only the pieces before the first and after the last separator can be empty."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    empty = (F.get(cut, F.lit(0)) == "").cast("int") + F.when(F.size(cut) > 1, (F.element_at(cut, -1) == "").cast("int")).otherwise(0)
    return (F.size(cut) - empty).cast("bigint")


def gram_hashes(words: Column, n: int) -> Column:
    """Hash of every n-gram, in order."""
    count = F.size(words) - n + 1
    positions = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))


def winnowed(hashes: Column) -> Column:
    """The distinct smallest hashes of all windows; of the whole if there are fewer hashes than a window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - WINDOW + 1, F.lit(1)))
    least = F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _sent(rows: DataFrame, entries: Column | None = None) -> DataFrame:
    return sent_if_small(rows, BROADCAST_ROWS, entries)


def _with_key(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """Two hashes stand for a row's id and text: rows that are equal in both have equal hits."""
    return documents.withColumns({"__k1": F.xxhash64(id_column, text), "__k2": F.xxhash64(F.col(text), F.lit(1), F.col(id_column))})


def _indexed(benchmark: DataFrame, item_column: str, item_text: str) -> DataFrame:
    """(r, item, m, iw): distinct items with words, numbered."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), words_of(F.col(item_text)).alias("iw"))
    items = items.where(F.size("iw") > 0).distinct().withColumn("m", F.size("iw"))
    return materialise(items.withColumn("r", F.monotonically_increasing_id()))


def _keyed_overlaps(docs: DataFrame, benchmark: DataFrame, item_column: str, item_text: str) -> DataFrame:
    """(k1, k2, spans, items) of the documents, as of ``_with_key``, in which a benchmark window occurs."""
    items = _indexed(benchmark, item_column, item_text)
    short = [r["m"] for r in items.where(F.col("m") < SPAN).select("m").distinct().collect()]  # nine at most

    def tagged(hashes: Column, n: int) -> Column:
        return F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))

    lowered = docs.select("__k1", "__k2", words_of(F.col("text")).alias("w"))
    parts = [tagged(winnowed(F.col("g")), GRAM)]
    parts += [tagged(F.array_distinct(gram_hashes(F.col("w"), n)), -n) for n in short]
    prints = lowered.withColumn("g", gram_hashes(F.col("w"), GRAM))
    prints = prints.select("__k1", "__k2", F.inline(F.concat(*parts)))
    long_items = items.where(F.col("m") >= SPAN).select("r", gram_hashes(F.col("iw"), GRAM).alias("g"))
    long_items = long_items.select("r", winnowed(F.col("g")).alias("chosen"), F.posexplode("g").alias("q", "h"))
    of_items = long_items.where(F.array_contains("chosen", F.col("h"))).select(F.lit(GRAM).alias("n"), "h", "r", "q")
    for n in short:
        whole = items.where(F.col("m") == n).select(F.lit(-n).alias("n"), F.get(gram_hashes(F.col("iw"), n), F.lit(0)).alias("h"), "r")
        of_items = of_items.unionByName(whole.withColumn("q", F.lit(0)))
    found = prints.join(_sent(of_items), ["n", "h"])
    hits = found.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("n", "h", "r", "q")).alias("met"))

    # Back to the texts of the documents with a hit: on which diagonals of which items do shared grams lie?
    hit = docs.join(_sent(hits, F.size("met")), ["__k1", "__k2"]).select("__k1", "__k2", "met", "text")
    hit = hit.withColumn("w", words_of(F.col("text")))

    def placed(n: int) -> Column:
        grams = gram_hashes(F.col("w"), abs(n))
        return F.transform(grams, lambda h, p: F.struct(F.lit(n).alias("n"), h.alias("h"), p.alias("p")))

    at = [placed(n) for n in (GRAM, *[-m for m in short])]
    known = F.transform("met", lambda m: m["h"])
    hit = hit.withColumn("at", F.filter(F.concat(*at), lambda g: F.array_contains(known, g["h"])))
    diagonals = F.flatten(
        F.transform(
            "met",
            lambda m: F.transform(
                F.filter("at", lambda g: (g["h"] == m["h"]) & (g["n"] == m["n"])),
                lambda g: F.struct(m["r"].alias("r"), (g["p"] - m["q"]).alias("shift")),
            ),
        )
    )
    laid = hit.select("__k1", "__k2", "w", F.inline(F.array_distinct(diagonals)))
    laid = laid.join(_sent(items.select("r", "item", "m", "iw"), F.size("iw")), "r")

    # Extend: the runs of equal words along the diagonal that are long enough.
    equal = F.transform(F.sequence(F.lit(0), F.col("m")), lambda j: F.coalesce(F.get("w", F.col("shift") + j) == F.get("iw", j), F.lit(False)))
    numbered = F.transform(equal, lambda e, j: F.struct(e.alias("e"), j.alias("j")))
    none = F.array().cast("array<struct<first:int,after:int>>")
    need = F.least(F.col("m"), F.lit(SPAN))

    def extend(a: Column, x: Column) -> Column:
        ended = ~x["e"] & (x["j"] - a["start"] >= need)
        span = F.struct((F.col("shift") + a["start"]).alias("first"), (F.col("shift") + x["j"]).alias("after"))
        return F.struct(
            F.when(x["e"], a["start"]).otherwise(x["j"] + 1).alias("start"),
            F.when(ended, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"),
        )

    runs = F.aggregate(numbered, F.struct(F.lit(0).alias("start"), none.alias("out")), extend, lambda a: a["out"])
    spans = laid.select("__k1", "__k2", "item", F.explode(runs).alias("span"))
    by_document = spans.groupBy("__k1", "__k2").agg(
        F.array_sort(F.collect_set("span")).alias("raw"), F.array_sort(F.collect_set("item")).alias("items")
    )

    def merge(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["after"], x["after"]).alias("after"))
        touches = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["after"] >= x["first"])
        return F.when(touches, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(x)))

    return by_document.select("__k1", "__k2", F.aggregate("raw", none, merge).alias("spans"), "items")


def overlaps(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, text, spans, items) of every row of ``documents``: disjoint [first, after) word spans, in order, that lie in
    occurrences of benchmark windows, and the ids of the items that occur, in order; both NULL if there are none.

    A window is ten consecutive words of an item, or the whole item if it has one to nine. NULL and empty texts have
    no words, items without words no windows. Repeated documents each get their row; repeated items count once per id;
    an item with a NULL id is found but not listed. Empty tables give no hits. Further columns are ignored.
    """
    docs = _with_key(documents.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "id", "text")
    results = _sent(_keyed_overlaps(docs, benchmark, item_column, item_text), F.size("spans") + F.size("items"))
    return docs.join(results, ["__k1", "__k2"], "left").select("id", "text", "spans", "items")


def clean_documents(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``documents`` in which no benchmark window occurs, all columns as they were, whatever their names.

    NULL and empty texts are clean; repeated rows stay or go together, NULL ids like others. Empty tables: no documents,
    or all of them.
    """
    inner, (i, t) = numbered_columns(documents, id_column, text)
    docs = _with_key(inner.select(F.col(i).alias("id"), F.col(t).alias("text")), "id", "text")
    found = _sent(_keyed_overlaps(docs, benchmark, item_column, item_text).select("__k1", "__k2"))
    return _with_key(inner, i, t).join(found, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2").toDF(*documents.columns)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts of words, hit words and found items of every document."""
    found = overlaps(documents, benchmark)
    hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["after"] - s["first"]), F.lit(0)).cast("bigint")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return found.select(
        F.col("id").alias("doc_id"),
        word_count(F.col("text")).alias("n_words"),
        hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: Digests for DuckDB, by comparing every ten-word window.
ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
    FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
placed AS (
  SELECT rid, p, list(word) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)),
hit AS (
  SELECT rid, p, n, item_id FROM (
    SELECT rid, p, n, array_to_string(run[1:n], ' ') AS g FROM placed, lengths WHERE len(run) >= n)
  JOIN win USING (n, g)),
counted AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (rid) LEFT JOIN listed USING (rid)
"""
