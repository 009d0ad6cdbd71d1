"""Token features of whole texts and bit-set similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.functions import tokens as K
from screenspark.operators import bands, blocks
from screenspark.operators import bits as B
from screenspark.queries.fixtures import LONG, PROPS, known_labels, properties, table
from screenspark.queries.profiling import rounded
from screenspark.queries.registry import query
from screenspark.session import materialise

TOK = """tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS t
  FROM documents)"""
GRAMS = f"""{TOK}, pieces AS (
    SELECT doc_id, unnest(t) AS p FROM tok
    UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) FROM tok
    UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]) FROM tok),
  setbits AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(p), 1, 8))::BIGINT % 2048)::INT AS bit FROM pieces),
  fp AS (SELECT d.doc_id, coalesce(b.bits, []) AS bits FROM documents d LEFT JOIN
    (SELECT doc_id, list(bit ORDER BY bit) AS bits FROM setbits GROUP BY doc_id) b USING (doc_id))"""
PACKED = f"""{GRAMS}, fb AS (SELECT d.doc_id, coalesce(b.b, bitstring('0', 2048)) AS b FROM documents d LEFT JOIN
    (SELECT doc_id, bitstring_agg(bit, 0, 2047) AS b FROM setbits GROUP BY doc_id) b USING (doc_id))"""


def fingerprints(spark, sf_dir, *keep, only=None):
    documents = table(spark, sf_dir, "documents").select("doc_id", *keep, "text")
    if only is not None:
        documents = documents.join(only, "doc_id", "left_semi")
    words = documents.select("doc_id", *keep, K.tokens("text").alias("words"))
    return words.select("doc_id", *keep, K.gram_bits("words").alias("bits"))


def _digest(df, column="bits"):
    """The bit set as one text, so that any engine can compare it."""
    return df.select(
        "doc_id", F.size(column).alias("n_bits"), F.md5(F.array_join(column, ",")).alias("digest")
    )


_DIGEST = "SELECT doc_id, len(bits)::INT AS n_bits, md5(array_to_string(bits, ',')) AS digest FROM fp"


@query("token_fingerprints", f"WITH {GRAMS} {_DIGEST}")
def token_fingerprints(spark, sf_dir):
    return _digest(fingerprints(spark, sf_dir))


PATTERNS = {
    "url": "https?://",
    "email": "[a-z0-9.]+@[a-z0-9.]+",
    "year": "(19|20)[0-9][0-9]",
    "capital": "[A-Z]",
    "digit": "[0-9]",
    "bracket": "[(]",
    "comma": ",",
    "break": "[\\n]",
}


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "pattern_key_bits",
    "SELECT doc_id, concat("
    + ", ".join(f"regexp_matches(text, {_sql_text(p)})::INT" for p in PATTERNS.values())
    + ") AS keys FROM documents",
)
def pattern_key_bits(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.array_join(K.key_bits("text", list(PATTERNS.values())), "").alias("keys"))


@query(
    "token_pair_fingerprints",
    f"""WITH {TOK}, pieces AS ("""
    + " UNION ALL ".join(
        f"SELECT doc_id, unnest([t[i] || '|' || t[i + {d}] || '|{d}' for i in range(1, len(t) - {d} + 1)]) AS p FROM tok"
        for d in (1, 2, 3, 4)
    )
    + f"""), setbits AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(p), 1, 8))::BIGINT % 2048)::INT AS bit FROM pieces),
      fp AS (SELECT d.doc_id, coalesce(b.bits, []) AS bits FROM documents d LEFT JOIN
        (SELECT doc_id, list(bit ORDER BY bit) AS bits FROM setbits GROUP BY doc_id) b USING (doc_id)) {_DIGEST}""",
)
def token_pair_fingerprints(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = documents.select("doc_id", K.tokens("text").alias("words"))
    return _digest(words.select("doc_id", K.pair_bits("words").alias("bits")))


@query(
    "pattern_counts",
    "SELECT page_id, "
    + ", ".join(f"len(regexp_extract_all(html, {_sql_text(p)}))::INT AS n_{n}" for n, p in PATTERNS.items())
    + " FROM pages",
)
def pattern_counts(spark, sf_dir):
    counts = K.pattern_counts("html", PATTERNS)
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(f"n_{n}") for n, c in counts.items()])


@query(
    "derived_ratios",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / greatest(1, l_quantity), 9) AS unit_price,
         round(l_discount / greatest(1, l_tax), 9) AS discount_over_tax, round(l_discount + l_tax, 9) AS discount_and_tax
       FROM lineitem""",
)
def derived_ratios(spark, sf_dir):
    added = K.derived_ratios(
        {"unit_price": ("l_extendedprice", "l_quantity"), "discount_over_tax": ("l_discount", "l_tax")},
        {"discount_and_tax": ("l_discount", "l_tax")},
    )
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(n) for n, c in added.items()])


#: The property table of the named ratios, from counts of each text.
_STRUCTURE = {
    "rotatable_bonds": "n_words", "heavy_atoms": "n_chars", "rings": "n_words", "aromatic_rings": "n_stops", "saturated_rings": "n_digits",
    "heteroatoms": "n_digits", "spiro_atoms": "n_stops", "bridgehead_atoms": "n_digits", "hbd": "n_stops", "hba": "n_digits",
}


@query(
    "structure_ratios",
    f"WITH {PROPS} SELECT doc_id, "
    + ", ".join(f"round({_STRUCTURE[a]} / greatest(1, {_STRUCTURE[b]}), 9) AS {n}" for n, (a, b) in K.STRUCTURE_RATIOS.items())
    + ", n_stops + n_digits AS hydrogen_bonding FROM props",
)
def structure_ratios(spark, sf_dir):
    """The seven named ratios and the named sum, over counts of each text."""
    rows = properties(spark, sf_dir).select("doc_id", *[F.col(c).alias(n) for n, c in _STRUCTURE.items()])
    made = K.derived_ratios(K.STRUCTURE_RATIOS, K.STRUCTURE_SUMS)
    return rows.select("doc_id", *[(c if n in K.STRUCTURE_SUMS else F.round(c, 9)).alias(n) for n, c in made.items()])


@query(
    "feature_block_concat",
    """SELECT doc_id, ([n_chars::DOUBLE, coalesce(quality, 0)::DOUBLE, coalesce(toxic, 0)::DOUBLE])[1] AS f1,
         coalesce(quality, 0)::DOUBLE AS f2, coalesce(toxic, 0)::DOUBLE AS f3, 3 AS width
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def feature_block_concat(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    blocks = [F.array("n_chars"), F.array("quality", "toxic")]
    features = joined.select("doc_id", K.concat_blocks(blocks).alias("f"))
    return features.select(
        "doc_id", *[F.get("f", F.lit(i)).alias(f"f{i + 1}") for i in range(3)], F.size("f").alias("width")
    )


@query(
    "bit_profile",
    f"""WITH {GRAMS} SELECT (SELECT count(*) FROM fp) AS n_rows,
          round((SELECT sum(len(bits)) FROM fp) / ((SELECT count(*) FROM fp) * 2048.0::DOUBLE), 9) AS density,
          (SELECT count(DISTINCT bit) FROM setbits) AS used_bits,
          round((SELECT avg(len(bits)) FROM fp), 6) AS bits_per_row""",
)
def bit_profile(spark, sf_dir):
    out = B.bit_profile(fingerprints(spark, sf_dir), [], "bits", K.N_BITS)
    return rounded(rounded(out, "density", digits=9), "bits_per_row")


@query(
    "bit_profile_by_class",
    f"""WITH {GRAMS}, {LONG}, j AS (SELECT target, label, doc_id, bits FROM long JOIN fp USING (doc_id)),
        u AS (SELECT target, label, count(DISTINCT bit) AS used_bits FROM long JOIN setbits USING (doc_id) GROUP BY ALL)
        SELECT target, label, count(*) AS n_rows, round(sum(len(bits)) / (count(*) * 2048.0::DOUBLE), 9) AS density,
          max(used_bits) AS used_bits, round(avg(len(bits)), 6) AS bits_per_row
        FROM j JOIN u USING (target, label) GROUP BY target, label""",
)
def bit_profile_by_class(spark, sf_dir):
    out = B.bit_profile(_labelled_bits(spark, sf_dir), ["target", "label"], "bits", K.N_BITS)
    return rounded(rounded(out, "density", digits=9), "bits_per_row")


@query("bit_frequency", f"WITH {GRAMS} SELECT bit, count(*) AS n_rows FROM setbits GROUP BY bit")
def bit_frequency(spark, sf_dir):
    return B.bit_frequency(fingerprints(spark, sf_dir), [], "bits")


_SIM = "bit_count(a.b & b.b) / nullif(bit_count(a.b | b.b), 0)::DOUBLE"


def _similar_sql(by: str, rows: str, crossing: str = "") -> str:
    """All pairs of the rows (by..., doc_id, label, b), compared one by one."""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    return f"""{rows}, p AS (
      SELECT {", ".join(f"a.{c.strip()}" for c in by.split(","))}, a.doc_id AS x, b.doc_id AS y, {_SIM} AS s
      FROM n a JOIN n b ON {on} AND a.doc_id < b.doc_id {crossing} WHERE {_SIM} >= 0.8),
    c AS (SELECT {by}, count(*) AS n_similar, round(max(s), 9) AS max_similarity FROM p GROUP BY {by}),
    w AS (SELECT {by}, count(DISTINCT z) AS n_with_partner FROM (
      SELECT {by}, x AS z FROM p UNION ALL SELECT {by}, y FROM p) GROUP BY {by})
    SELECT {by}, n_rows, coalesce(n_with_partner, 0) AS n_with_partner, coalesce(n_similar, 0) AS n_similar, max_similarity
    FROM (SELECT {by}, count(*) AS n_rows FROM n GROUP BY {by}) LEFT JOIN c USING ({by}) LEFT JOIN w USING ({by})"""


@query(
    "similar_texts_by_language",
    _similar_sql("lang", f"WITH {PACKED}, n AS (SELECT f.doc_id, f.b, lang, 0 AS label FROM fb f JOIN documents USING (doc_id))"),
)
def similar_texts_by_language(spark, sf_dir):
    """All pairs of similar texts of each language."""
    return rounded(B.similar_rows(fingerprints(spark, sf_dir, "lang"), ["lang"], "bits", K.N_BITS), "max_similarity", digits=9)


def _labelled_bits(spark, sf_dir):
    """Bit sets of the texts with a label; the others are dropped before their texts are hashed."""
    labels = known_labels(spark, sf_dir)
    return labels.join(fingerprints(spark, sf_dir, only=labels.select("doc_id").distinct()), "doc_id")


@query(
    "similar_texts_by_class",
    _similar_sql("target, label", f"WITH {PACKED}, {LONG}, n AS (SELECT target, label, doc_id, b FROM long JOIN fb USING (doc_id))"),
)
def similar_texts_by_class(spark, sf_dir):
    """All pairs of similar texts of each class."""
    out = B.similar_rows(_labelled_bits(spark, sf_dir), ["target", "label"], "bits", K.N_BITS)
    return rounded(out, "max_similarity", digits=9)


@query(
    "similar_texts_across_classes",
    _similar_sql("target", f"WITH {PACKED}, {LONG}, n AS (SELECT target, label, doc_id, b FROM long JOIN fb USING (doc_id))", "AND a.label <> b.label"),
)
def similar_texts_across_classes(spark, sf_dir):
    """All pairs of similar texts with different labels."""
    out = B.similar_rows(_labelled_bits(spark, sf_dir), ["target"], "bits", K.N_BITS, side="label")
    return rounded(out, "max_similarity", digits=9)


def _pairs_sql(by: str, rows: str, on: str) -> str:
    """Similarity of all pairs of the rows (by..., doc_id, label, b) that ``on`` tells of."""
    keys = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    return f"""{rows}, p AS (SELECT {", ".join(f"a.{c.strip()}" for c in by.split(","))}, {_SIM} AS s FROM n a JOIN n b ON {keys} AND {on})
    SELECT {by}, count(s) AS n_pairs, round(avg(s), 9) AS mean_similarity, round(max(s), 9) AS max_similarity,
      round(min(s), 9) AS min_similarity, count(*) FILTER (s >= 0.8) AS n_similar
    FROM p WHERE s IS NOT NULL GROUP BY {by}"""


_NUMBERS = ("mean_similarity", "max_similarity", "min_similarity")


@query(
    "pair_similarity_by_language",
    _pairs_sql("lang", f"WITH {PACKED}, n AS (SELECT f.doc_id, f.b, lang FROM fb f JOIN documents USING (doc_id))", "a.doc_id < b.doc_id"),
)
def pair_similarity_by_language(spark, sf_dir):
    """Mean, largest and smallest similarity over all pairs of texts of each language."""
    return rounded(B.pair_similarity(fingerprints(spark, sf_dir, "lang"), ["lang"], "bits", K.N_BITS), *_NUMBERS, digits=9)


@query(
    "pair_similarity_by_class",
    _pairs_sql("target, label", f"WITH {PACKED}, {LONG}, n AS (SELECT target, label, doc_id, b FROM long JOIN fb USING (doc_id))", "a.doc_id < b.doc_id"),
)
def pair_similarity_by_class(spark, sf_dir):
    """The same over all pairs of texts of each class."""
    return rounded(B.pair_similarity(_labelled_bits(spark, sf_dir), ["target", "label"], "bits", K.N_BITS), *_NUMBERS, digits=9)


@query(
    "pair_similarity_across_classes",
    _pairs_sql("target", f"WITH {PACKED}, {LONG}, n AS (SELECT target, label, doc_id, b FROM long JOIN fb USING (doc_id))", "a.label = 1 AND b.label = 0"),
)
def pair_similarity_across_classes(spark, sf_dir):
    """The same over all pairs of texts with different labels."""
    return rounded(B.pair_similarity(_labelled_bits(spark, sf_dir), ["target"], "bits", K.N_BITS, side="label"), *_NUMBERS, digits=9)


@query(
    "following_pairs_by_class",
    _pairs_sql(
        "target, label",
        f"""WITH {PACKED}, {LONG}, n AS (SELECT target, label, doc_id, b, row_number() OVER (PARTITION BY target, label ORDER BY doc_id) AS rn
          FROM long JOIN fb USING (doc_id))""",
        "b.rn BETWEEN a.rn + 1 AND a.rn + 99",
    ),
)
def following_pairs_by_class(spark, sf_dir):
    """The same over the pairs of each text with the 99 next ones of its class."""
    rows = _labelled_bits(spark, sf_dir).withColumn("size", F.size("bits"))
    rows = B.pack_sets(rows, ["target", "label", "doc_id", "size"], "bits", K.N_BITS)
    return rounded(bands.following_similarity(rows, ["target", "label"], "doc_id", "packed", "size"), *_NUMBERS, digits=9)


@query(
    "orders_soon_after",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders)
       SELECT a.o_orderkey, count(*) AS n_later, round(sum(b.o_totalprice), 2) AS later_price, min(b.day - a.day)::INT AS days_to_next
       FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.day BETWEEN a.day + 1 AND a.day + 90 GROUP BY a.o_orderkey""",
)
def orders_soon_after(spark, sf_dir):
    """Orders of the same customer in the 90 days after an order."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("day"))
    b = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("later"), "o_totalprice", day.alias("later_day"))
    pairs = bands.band_join(a, b, ["o_custkey"], "day", "later_day", 1, 90, "o_orderkey", "later")
    return pairs.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n_later"), F.round(F.sum("o_totalprice"), 2).alias("later_price"), F.min(F.col("later_day") - F.col("day")).alias("days_to_next")
    )


_PAIR_BITS = " UNION ALL ".join(
    f"SELECT doc_id, unnest([t[i] || '|' || t[i + {d}] || '|{d}' for i in range(1, len(t) - {d} + 1)]) AS p FROM tok" for d in (1, 2, 3, 4)
)


@query(
    "assembled_blocks",
    f"""WITH {GRAMS}, pairpieces AS ({_PAIR_BITS}),
      pairbits AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(p), 1, 8))::BIGINT % 2048)::INT AS bit FROM pairpieces),
      every AS (SELECT doc_id, 'gram_' || bit AS feature, 1.0::DOUBLE AS v FROM setbits
        UNION ALL SELECT doc_id, 'pair_' || bit, 1.0 FROM pairbits
        UNION ALL SELECT doc_id, 'n_chars', n_chars::DOUBLE FROM documents
        UNION ALL SELECT l.doc_id, 'quality', quality::DOUBLE FROM labels l JOIN documents USING (doc_id)),
      names AS (SELECT 'gram_' || i AS feature FROM range(2048) r(i) UNION ALL SELECT 'pair_' || i FROM range(2048) r(i)
        UNION ALL SELECT unnest(['n_chars', 'quality'])),
      sums AS (SELECT feature, count(*) FILTER (v <> 0) AS n, sum(v) AS s, sum(v * v) AS q FROM every GROUP BY feature),
      total AS (SELECT count(*) AS n_rows FROM documents)
    SELECT feature, n_nonzero, CASE WHEN v > 1 THEN round(v, 2) ELSE round(v, 9) END AS variance, v > 0.01 AS kept FROM (
      SELECT feature, coalesce(n, 0) AS n_nonzero, coalesce(q, 0) / n_rows - (coalesce(s, 0) / n_rows) ** 2 AS v
      FROM names LEFT JOIN sums USING (feature), total)""",
)
def assembled_blocks(spark, sf_dir):
    """Two hashed bit blocks and two columns side by side, under their names: non-zeros, variance, and what the filter keeps."""
    words = table(spark, sf_dir, "documents").select("doc_id", "n_chars", K.tokens("text").alias("words"))
    bits = words.select("doc_id", "n_chars", K.gram_bits("words").alias("grams"), K.pair_bits("words").alias("pairs"))
    rows = bits.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    wide = materialise(blocks.assemble(rows, {"gram": ("grams", K.N_BITS), "pair": ("pairs", K.N_BITS)}, ["n_chars", "quality"], "f").select("doc_id", "f"))
    names = blocks.feature_names(wide, "f")
    _, nonzeros, _, variance = blocks.block_moments(wide, "f")
    kept = set(blocks.feature_names(blocks.variable_block(wide, "f", "v"), "v"))
    found = [(n, int(c), round(float(v), 2 if v > 1 else 9) + 0.0, n in kept) for n, c, v in zip(names, nonzeros, variance)]
    return spark.createDataFrame(found, "feature string, n_nonzero long, variance double, kept boolean")


@query(
    "property_against_bits",
    f"""WITH {GRAMS} SELECT doc_id, len(string_split(text, ' '))::DOUBLE AS n_words, len(bits)::INT AS n_bits
        FROM documents JOIN fp USING (doc_id)""",
)
def property_against_bits(spark, sf_dir):
    from screenspark.operators.profile import scatter_pairs

    sizes = fingerprints(spark, sf_dir).select("doc_id", F.size("bits").alias("n_bits"))
    return scatter_pairs(properties(spark, sf_dir), sizes, "doc_id", ["n_words", "n_bits"])
