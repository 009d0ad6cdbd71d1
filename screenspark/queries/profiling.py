"""Label, property, rule, group and data-quality profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import groups as G
from screenspark.operators import profile as P
from screenspark.operators.joins import join_small
from screenspark.queries.fixtures import (
    LONG,
    LONG_ALL,
    PROPERTIES,
    PROPS,
    RULES,
    TARGETS,
    WIDE,
    all_labels,
    known_labels,
    properties,
    table,
    wide_labels,
)
from screenspark.queries.registry import query
from screenspark.session import materialise


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


COUNTS = "count(label) AS {total}, count(*) FILTER (label = 1) AS {pos}, count(*) FILTER (label = 0) AS {neg}"


@query(
    "target_statistics",
    f"""WITH {LONG_ALL}, c AS (SELECT target,
          {COUNTS.format(total='total_samples', pos='active_samples', neg='inactive_samples')}
          FROM long GROUP BY target HAVING count(label) > 0)
        SELECT *, round(active_samples / total_samples::DOUBLE, 6) AS active_ratio,
          round(inactive_samples / nullif(active_samples, 0)::DOUBLE, 6) AS imbalance_ratio FROM c""",
)
def target_statistics(spark, sf_dir):
    return rounded(P.target_statistics(all_labels(spark, sf_dir)), "active_ratio", "imbalance_ratio")


@query(
    "target_summary",
    f"""WITH {LONG_ALL} SELECT target,
          {COUNTS.format(total='total_samples', pos='positive_samples', neg='negative_samples')},
          round(avg(label), 6) AS positive_ratio FROM long GROUP BY target""",
)
def target_summary(spark, sf_dir):
    return rounded(P.target_summary(all_labels(spark, sf_dir)), "positive_ratio")


@query(
    "target_analysis",
    f"""WITH {LONG_ALL} SELECT target,
          {COUNTS.format(total='total_compounds', pos='active_compounds', neg='inactive_compounds')},
          round(avg(label), 6) AS activity_ratio,
          round(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 6) AS class_imbalance_ratio,
          round(count(label) / count(*)::DOUBLE, 6) AS data_completeness,
          avg(label) BETWEEN 0.2 AND 0.8 AS balanced
        FROM long GROUP BY target HAVING count(label) > 0""",
)
def target_analysis(spark, sf_dir):
    return rounded(
        P.target_analysis(all_labels(spark, sf_dir)), "activity_ratio", "class_imbalance_ratio", "data_completeness"
    )


@query(
    "label_coverage",
    f"""WITH {LONG_ALL} SELECT target, count(label) AS n_known, round(count(label) * 100.0::DOUBLE / count(*), 6) AS coverage_pct
        FROM long GROUP BY target""",
)
def label_coverage(spark, sf_dir):
    return rounded(P.coverage(wide_labels(spark, sf_dir), TARGETS), "coverage_pct")


@query(
    "missing_values",
    f"""WITH {WIDE}, m AS (
          SELECT 'quality' AS column_name, count(*) FILTER (quality IS NULL) AS n_missing, count(*) AS n FROM wide
          UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), count(*) FROM wide
          UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), count(*) FROM wide
          UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), count(*) FROM wide)
        SELECT column_name, n_missing, round(n_missing * 100.0::DOUBLE / n, 6) AS missing_pct FROM m WHERE n_missing > 0""",
)
def missing_values(spark, sf_dir):
    return rounded(P.missing_values(wide_labels(spark, sf_dir)), "missing_pct")


@query(
    "missing_label_cells",
    f"WITH {LONG_ALL} SELECT count(*) - count(label) AS missing_cells FROM long",
)
def missing_label_cells(spark, sf_dir):
    return P.missing_label_cells(wide_labels(spark, sf_dir), TARGETS)


_LONG_PROPS = "plong AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{p}' AS property, {p} AS value FROM props" for p in PROPERTIES
) + ")"


@query(
    "property_summary",
    f"""WITH {PROPS}, {_LONG_PROPS} SELECT property, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
          min(value) AS min, max(value) AS max FROM plong GROUP BY property""",
)
def property_summary(spark, sf_dir):
    return rounded(P.property_summary(materialise(properties(spark, sf_dir)), PROPERTIES), "mean", "median")


@query(
    "price_summary",
    """SELECT 'l_extendedprice' AS property, round(avg(l_extendedprice), 4) AS mean,
         round(median(l_extendedprice), 4) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max
       FROM lineitem""",
)
def price_summary(spark, sf_dir):
    return rounded(
        P.property_summary(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]), "mean", "median", digits=4
    )


@query(
    "class_differences",
    f"""WITH {LONG}, {PROPS}, {_LONG_PROPS}, m AS (
          SELECT target, property, avg(value) FILTER (label = 1) AS a, avg(value) FILTER (label = 0) AS i
          FROM long JOIN plong USING (doc_id) GROUP BY target, property
          HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0)
        SELECT target, property, round(a, 4) AS active_mean, round(i, 4) AS inactive_mean, round(a - i, 4) AS difference,
          round(CASE WHEN i = 0 THEN 0 ELSE (a - i) / i * 100 END, 4) AS pct_difference FROM m""",
)
def class_differences(spark, sf_dir):
    out = P.class_differences(known_labels(spark, sf_dir), properties(spark, sf_dir), "doc_id", PROPERTIES)
    return rounded(out, "active_mean", "inactive_mean", "difference", "pct_difference", digits=4)


_MET = "(n_chars <= 500)::INT + (n_words <= 100)::INT + (n_stops <= 5)::INT + (n_digits <= 10)::INT"
_RULE_ROWS = (
    ("chars", "n_chars <= 500"),
    ("words", "n_words <= 100"),
    ("stops", "n_stops <= 5"),
    ("digits", "n_digits <= 10"),
    ("all_rules", f"{_MET} = 4"),
)


@query(
    "rule_flags",
    f"""WITH {PROPS} SELECT doc_id, n_chars <= 500 AS chars_ok, n_words <= 100 AS words_ok, n_stops <= 5 AS stops_ok,
          n_digits <= 10 AS digits_ok, {_MET} AS rules_met, {_MET} = 4 AS all_rules, {_MET} >= 3 AS all_but_one,
          {_MET} >= 2 AS all_but_two FROM props""",
)
def rule_flags(spark, sf_dir):
    return P.rule_flags(properties(spark, sf_dir), RULES).drop("source", "lang", *PROPERTIES)


@query(
    "rule_compliance",
    f"WITH {PROPS} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS rule, count(*) FILTER ({test}) AS n_compliant,
              round(count(*) FILTER ({test}) * 100.0::DOUBLE / count(*), 6) AS compliant_pct FROM props"""
        for name, test in [*_RULE_ROWS, ("all_but_one", f"{_MET} >= 3"), ("all_but_two", f"{_MET} >= 2")]
    ),
)
def rule_compliance(spark, sf_dir):
    return rounded(P.rule_compliance(properties(spark, sf_dir), RULES), "compliant_pct")


@query(
    "rule_compliance_by_class",
    f"WITH {LONG}, {PROPS}, j AS (SELECT * FROM long JOIN props USING (doc_id)) "
    + " UNION ALL ".join(
        f"""SELECT target, label, count(*) AS n_class, '{name}' AS rule, count(*) FILTER ({test}) AS n_compliant,
              round(count(*) FILTER ({test}) * 100.0::DOUBLE / count(*), 6) AS compliant_pct
            FROM j WHERE target IN (SELECT target FROM j GROUP BY target HAVING count(DISTINCT label) = 2)
            GROUP BY target, label"""
        for name, test in _RULE_ROWS
    ),
)
def rule_compliance_by_class(spark, sf_dir):
    out = P.rule_compliance_by_class(known_labels(spark, sf_dir), properties(spark, sf_dir), "doc_id", RULES)
    return rounded(out, "compliant_pct")


@query(
    "group_diversity",
    """SELECT count(*) AS n_entities, count(DISTINCT source || lang) AS n_groups,
         round(count(DISTINCT source || lang) / count(*)::DOUBLE, 6) AS diversity,
         round(count(*) / count(DISTINCT source || lang)::DOUBLE, 6) AS avg_group_size FROM documents""",
)
def group_diversity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.concat("source", "lang").alias("grp"))
    return rounded(G.group_diversity(documents, "grp"), "diversity", "avg_group_size")


@query("group_sizes", "SELECT source, count(*) AS n_entities FROM documents GROUP BY source")
def group_sizes(spark, sf_dir):
    return G.group_sizes(table(spark, sf_dir, "documents"), "source")


@query(
    "group_sizes_by_class",
    f"""WITH {LONG} SELECT target, source, count(*) FILTER (label = 1) AS n_active, count(*) FILTER (label = 0) AS n_inactive
        FROM long JOIN documents USING (doc_id) GROUP BY target, source""",
)
def group_sizes_by_class(spark, sf_dir):
    return G.group_sizes_by_class(known_labels(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "source")


@query(
    "groups_by_activity",
    f"""WITH {LONG}, j AS (SELECT target, label, source || lang AS g FROM long JOIN documents USING (doc_id)),
        per AS (SELECT target, g, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS i FROM j GROUP BY ALL),
        c AS (SELECT target, sum(a)::BIGINT AS active_entities, sum(i)::BIGINT AS inactive_entities,
          count(*) FILTER (a > 0) AS active_groups, count(*) FILTER (i > 0) AS inactive_groups, count(*) AS total_groups,
          count(*) FILTER (a > 0 AND i = 0) AS active_only_groups, count(*) FILTER (i > 0 AND a = 0) AS inactive_only_groups,
          count(*) FILTER (a > 0 AND i > 0) AS shared_groups FROM per GROUP BY target HAVING sum(a) > 0 AND sum(i) > 0)
        SELECT *, round(active_entities / active_groups::DOUBLE, 6) AS active_per_group,
          round(inactive_entities / inactive_groups::DOUBLE, 6) AS inactive_per_group,
          round(active_groups / (active_groups + inactive_groups)::DOUBLE, 6) AS active_group_share FROM c""",
)
def groups_by_activity(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", "lang").alias("grp"))
    out = G.groups_by_activity(known_labels(spark, sf_dir), groups, "doc_id", "grp")
    return rounded(out, "active_per_group", "inactive_per_group", "active_group_share")


@query(
    "group_property_differences",
    f"""WITH {LONG}, gp AS (SELECT source, avg(n_chars) AS group_chars, count(*)::DOUBLE AS group_size
          FROM documents GROUP BY source),
        j AS (SELECT target, label, gp.* FROM long JOIN documents USING (doc_id) JOIN gp USING (source)),
        k AS (SELECT target, label, 'group_chars' AS property, group_chars AS value FROM j
          UNION ALL SELECT target, label, 'group_size', group_size FROM j),
        m AS (SELECT target, property, avg(value) FILTER (label = 1) AS a, avg(value) FILTER (label = 0) AS i
          FROM k GROUP BY target, property)
        SELECT target, property, round(a, 4) AS active_mean, round(i, 4) AS inactive_mean, round(a - i, 4) AS difference,
          round((a - i) / i * 100, 4) AS pct_difference FROM m WHERE a IS NOT NULL AND i IS NOT NULL""",
)
def group_property_differences(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    per_group = documents.groupBy("source").agg(
        F.avg("n_chars").alias("group_chars"), F.count(F.lit(1)).cast("double").alias("group_size")
    )
    entities = join_small(documents, per_group, ["source"])
    out = P.class_differences(known_labels(spark, sf_dir), entities, "doc_id", ["group_chars", "group_size"])
    return rounded(out, "active_mean", "inactive_mean", "difference", "pct_difference", digits=4)


def _histogram_sql(source: str, value: str, bins: int, strata: str, by: str) -> str:
    keys = ", ".join(k for k in (strata, by) if k)
    on = f"USING ({strata})" if strata else "ON true"
    group = f"GROUP BY {strata}" if strata else ""
    lead = f"{strata}, " if strata else ""
    return f"""v AS (SELECT {keys}, {value}::DOUBLE AS v FROM {source} WHERE {value} IS NOT NULL),
      r AS (SELECT {lead} min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS w FROM v {group}),
      b AS (SELECT {keys}, least(floor((v - lo) / w), {bins - 1})::INT AS bin FROM v JOIN r {on}),
      c AS (SELECT {keys}, bin, count(*) AS n FROM b GROUP BY ALL),
      t AS (SELECT {keys}, sum(n) AS total FROM c GROUP BY ALL),
      grid AS (SELECT t.*, lo, w, bin::INT AS bin FROM t JOIN r {on}, range({bins}) x(bin))
      SELECT {keys}, bin, round(lo + bin * w, 4) AS bin_from, round(lo + (bin + 1) * w, 4) AS bin_to,
        coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (total * w), 9) AS density
      FROM grid LEFT JOIN c USING ({keys}, bin)"""


@query(
    "property_histogram_by_class",
    f"""WITH {LONG}, {PROPS}, {_LONG_PROPS}, j AS (SELECT property, target || '=' || label AS class, value
          FROM long JOIN plong USING (doc_id)), """
    + _histogram_sql("j", "value", 20, "property", "class"),
)
def property_histogram_by_class(spark, sf_dir):
    long = P.labelled_numbers(known_labels(spark, sf_dir), materialise(properties(spark, sf_dir)), "doc_id", PROPERTIES)
    long = long.withColumn("class", F.concat_ws("=", "target", "label"))
    out = rounded(P.histogram(long, "value", 20, ["property"], ["class"]), "bin_from", "bin_to", digits=4)
    return rounded(out, "density", digits=9)


@query(
    "price_histogram",
    "WITH " + _histogram_sql("lineitem", "l_extendedprice", 30, "", "l_returnflag"),
)
def price_histogram(spark, sf_dir):
    out = P.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30, [], ["l_returnflag"])
    return rounded(rounded(out, "bin_from", "bin_to", digits=4), "density", digits=9)


_BOX = """q AS (SELECT {keys}, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median,
    quantile_cont(value, 0.75) AS q3 FROM j GROUP BY {keys})
  SELECT {keys}, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
    min(value) FILTER (value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
    max(value) FILTER (value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
    count(*) FILTER (NOT value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS n_outside
  FROM j JOIN q USING ({keys}) GROUP BY {keys}, n, q1, median, q3"""


@query(
    "box_table_by_class",
    f"""WITH {LONG}, {PROPS}, {_LONG_PROPS}, j AS (SELECT target, label, property, value
          FROM long JOIN plong USING (doc_id)), """
    + _BOX.format(keys="target, label, property"),
)
def box_table_by_class(spark, sf_dir):
    long = P.labelled_numbers(known_labels(spark, sf_dir), materialise(properties(spark, sf_dir)), "doc_id", PROPERTIES)
    return rounded(P.box_table(long, ["target", "label", "property"], "value"), "q1", "median", "q3", digits=4)


@query(
    "price_box_table",
    "WITH j AS (SELECT l_returnflag, l_extendedprice AS value FROM lineitem), " + _BOX.format(keys="l_returnflag"),
)
def price_box_table(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    return rounded(P.box_table(prices, ["l_returnflag"], "value"), "q1", "median", "q3", digits=4)


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "property_correlations",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{b}' AS "row", '{a}' AS "column", round(corr({b}, {a}), 6) AS corr FROM lineitem"""
        for i, a in enumerate(_NUMERIC)
        for b in _NUMERIC[i + 1 :]
    )
    + ")",
)
def property_correlations(spark, sf_dir):
    return rounded(P.correlation_pairs(table(spark, sf_dir, "lineitem"), _NUMERIC), "corr")


@query(
    "matrix_statistics",
    """SELECT count(*) AS n_rows, max(len(embedding))::INT AS n_columns,
         round(sum(len(list_filter(embedding, lambda x: x = 0)))::DOUBLE / sum(len(embedding)), 9) AS sparsity,
         sum(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))))::BIGINT AS n_missing FROM embeddings""",
)
def matrix_statistics(spark, sf_dir):
    return rounded(P.matrix_statistics(table(spark, sf_dir, "embeddings"), "embedding"), "sparsity", digits=9)


@query(
    "scatter_pairs",
    f"WITH {PROPS} SELECT doc_id, n_words, quality FROM props JOIN labels USING (doc_id)",
)
def scatter_pairs(spark, sf_dir):
    return P.scatter_pairs(properties(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", ["n_words", "quality"])


@query(
    "property_against_cluster",
    f"WITH {PROPS} SELECT doc_id, n_words, (n_chars::BIGINT % 7)::INT AS cluster FROM props",
)
def property_against_cluster(spark, sf_dir):
    """A property against the cluster of each text."""
    clusters = table(spark, sf_dir, "documents").select("doc_id", F.pmod("n_chars", F.lit(7)).cast("int").alias("cluster"))
    return P.scatter_pairs(properties(spark, sf_dir), clusters, "doc_id", ["n_words", "cluster"])


@query(
    "group_properties",
    f"""WITH {PROPS} SELECT source, round(avg(n_chars), 6) AS mean_chars, max(n_stops) AS most_stops
        FROM props GROUP BY source""",
)
def group_properties(spark, sf_dir):
    """Size against structure of each group: two numbers of a group that stand in different tables."""
    rows = properties(spark, sf_dir)
    sizes = rows.groupBy("source").agg(F.avg("n_chars").alias("mean_chars"))
    stops = rows.groupBy("source").agg(F.max("n_stops").alias("most_stops"))
    return rounded(P.scatter_pairs(sizes, stops, "source", ["mean_chars", "most_stops"]), "mean_chars")


_REPORT = [
    ("overview", "n_entities", "count(*)"),
    ("overview", "n_targets", "max(2)"),
    ("quality", "n_valid", "count(*) FILTER (n_words > 1)"),
    ("quality", "missing_label_cells", "2 * count(*) - count(quality) - count(toxic)"),
    *[("property_mean", p, f"avg({p})") for p in PROPERTIES],
    *[("rule_pct", n, f"count(*) FILTER ({t}) * 100.0::DOUBLE / count(*)") for n, t in _RULE_ROWS],
    *[("positive_pct", t, f"avg({t}) * 100") for t in TARGETS],
]


@query(
    "exploration_report",
    f"WITH {PROPS}, w AS (SELECT props.*, quality, toxic FROM props LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS section, '{k}' AS key, round(({e})::DOUBLE, 4) AS value FROM w" for s, k, e in _REPORT
    ),
)
def exploration_report(spark, sf_dir):
    wide = properties(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = P.exploration_report(wide, TARGETS, PROPERTIES, RULES, F.col("n_words") > 1)
    return rounded(out, "value", digits=4)
