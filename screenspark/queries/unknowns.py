"""Keys, strata, groups and times that are NULL in some rows: no row may vanish. And folds for each target."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import metrics as M
from screenspark.operators import profile as P
from screenspark.operators import split as X
from screenspark.operators.ranking import row_numbers
from screenspark.queries.fixtures import LONG, known_labels, table
from screenspark.queries.profiling import rounded
from screenspark.queries.registry import query


def _lines(spark, sf_dir):
    """Order lines; a third of the flags and one quantity are unknown."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        F.nullif("l_returnflag", F.lit("A")).alias("flag"),
        F.nullif("l_quantity", F.lit(10.0)).alias("quantity"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        (F.col("l_extendedprice") / 105000.0).alias("probability"),
    )


LINES = """lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS line, nullif(l_returnflag, 'A') AS flag, nullif(l_quantity, 10) AS quantity,
    (l_linestatus = 'F')::INT AS label, l_extendedprice / 105000.0::DOUBLE AS probability
  FROM lineitem)"""


@query(
    "row_numbers_of_unknown_keys",
    f"""WITH {LINES} SELECT line, row_number() OVER (PARTITION BY flag ORDER BY quantity NULLS FIRST, line) AS rn,
          count(*) OVER (PARTITION BY flag) AS rn_all FROM lines""",
)
def row_numbers_of_unknown_keys(spark, sf_dir):
    return row_numbers(_lines(spark, sf_dir).select("line", "flag", "quantity"), "quantity", "line", ["flag"]).select("line", "rn", "rn_all")


@query(
    "box_table_of_unknown_strata",
    f"""WITH {LINES}, j AS (SELECT flag, quantity AS v FROM lines WHERE quantity IS NOT NULL),
        q AS (SELECT flag, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3
          FROM j GROUP BY flag)
        SELECT j.flag, n, q1, median, q3,
          min(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
          max(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
          count(*) FILTER (NOT v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS n_outside
        FROM j JOIN q ON j.flag IS NOT DISTINCT FROM q.flag GROUP BY j.flag, n, q1, median, q3""",
)
def box_table_of_unknown_strata(spark, sf_dir):
    return P.box_table(_lines(spark, sf_dir), ["flag"], "quantity")


@query(
    "histogram_of_unknown_strata",
    f"""WITH {LINES}, j AS (SELECT flag, quantity AS v, min(quantity) OVER (PARTITION BY flag) AS lo,
          max(quantity) OVER (PARTITION BY flag) AS hi FROM lines WHERE quantity IS NOT NULL)
        SELECT flag, least(floor((v - lo) / ((hi - lo) / 7)), 6)::INT AS bin, count(*) AS n FROM j GROUP BY ALL""",
)
def histogram_of_unknown_strata(spark, sf_dir):
    bins = P.histogram(_lines(spark, sf_dir), "quantity", 7, ["flag"])
    return bins.where("n > 0").select("flag", "bin", "n")


@query(
    "evaluate_unknown_group",
    f"""WITH {LINES}, c AS (SELECT flag, probability, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
          FROM lines GROUP BY ALL),
        r AS (SELECT *, sum(neg) OVER (PARTITION BY flag ORDER BY probability) AS upto FROM c)
        SELECT flag, round(sum(pos * (upto - neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0), 9) AS roc_auc,
          sum(pos + neg)::BIGINT AS n FROM r GROUP BY flag""",
)
def evaluate_unknown_group(spark, sf_dir):
    return rounded(M.evaluate(_lines(spark, sf_dir), ["flag"]).select("flag", "roc_auc", "n"), "roc_auc", digits=9)


@query(
    "holdout_of_unknown_strata",
    """WITH d AS (SELECT nullif(lang, 'en') AS lang, count(*) AS n FROM documents GROUP BY 1),
         t AS (SELECT sum(n) AS total, ceil(round(sum(n) * 0.2::DOUBLE, 9)) AS tests FROM d)
       SELECT lang, n, tests::BIGINT AS n_test_of_all, (total - tests)::BIGINT AS n_train_of_all FROM d, t""",
)
def holdout_of_unknown_strata(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    split = X.stratified_holdout(documents, "doc_id", "lang")
    parts = split.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    return parts.groupBy("lang").agg(
        F.sum("n").alias("n"), F.lit(totals["test"]).cast("bigint").alias("n_test_of_all"), F.lit(totals["train"]).cast("bigint").alias("n_train_of_all")
    )


def _folds_of_groups(folds, *by):
    """Rows and folds of every group."""
    return folds.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("n_folds"))


@query(
    "group_folds_of_unknown_groups",
    "SELECT nullif(source, 'src0') AS grp, count(*) AS n, 1::BIGINT AS n_folds FROM documents GROUP BY 1",
)
def group_folds_of_unknown_groups(spark, sf_dir):
    """Rows without a group are one group, here the largest."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.nullif("source", F.lit("src0")).alias("grp"))
    return _folds_of_groups(X.group_folds(documents, "grp"))


@query(
    "group_folds_by_target",
    f"""WITH {LONG} SELECT target, nullif(source, 'src0') AS grp, count(*) AS n, 1::BIGINT AS n_folds
        FROM long JOIN documents USING (doc_id) GROUP BY ALL""",
)
def group_folds_by_target(spark, sf_dir):
    """Folds over the rows whose label is known, for each target on its own."""
    groups = table(spark, sf_dir, "documents").select("doc_id", F.nullif("source", F.lit("src0")).alias("grp"))
    labelled = known_labels(spark, sf_dir).join(groups, "doc_id").select("target", "doc_id", "grp")
    return _folds_of_groups(X.group_folds(labelled, "grp", by=["target"]), "target")


@query(
    "time_folds_by_type",
    """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events),
         p AS (SELECT event_id, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n
           FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id)),
         f AS (SELECT event_id, CASE WHEN place >= n - (n // 6) * 5 THEN ((place - (n - (n // 6) * 5)) // (n // 6))::INT END
           AS test_fold FROM p)
       SELECT event_id, test_fold, coalesce(test_fold + 1, 0)::INT AS trains_from FROM f""",
)
def time_folds_by_type(spark, sf_dir):
    """Each type of event has folds of its own; events without a time come first."""
    time = F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", time)
    return X.time_folds(events, "ts", "event_id", by=["event_type"]).drop("ts", "event_type")
