"""Splits, folds, class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import prep
from screenspark.operators import split as X
from screenspark.operators.profile import positives_per_entity
from screenspark.operators.ranking import row_numbers
from screenspark.queries.fixtures import LONG, TARGETS, WIDE, known_labels, table, wide_labels
from screenspark.queries.registry import query

# Sizes and cut points per target; the largest fractions get the rows left over.
_HOLDOUT = f"""WITH {LONG},
  r AS (SELECT *, row_number() OVER (PARTITION BY target, label
          ORDER BY md5('42:' || target || ':' || label || ':' || doc_id)) AS rn FROM long),
  s AS (SELECT target, label, count(*) AS n FROM long GROUP BY ALL),
  t1 AS (SELECT *, sum(n) OVER w AS total, ceil(round(sum(n) OVER w * 0.2::DOUBLE, 9)) AS want FROM s
          WINDOW w AS (PARTITION BY target)),
  t2 AS (SELECT *, n * want / total AS ex, floor(n * want / total) AS fl FROM t1),
  t3 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ex - fl DESC, label) AS rk,
          want - sum(fl) OVER (PARTITION BY target) AS left_over FROM t2),
  t4 AS (SELECT target, label, n, fl + (rk <= left_over)::INT AS n_test FROM t3),
  v1 AS (SELECT *, n - n_test AS rest, ceil(round(sum(n - n_test) OVER (PARTITION BY target) * 0.25::DOUBLE, 9)) AS want,
          sum(n - n_test) OVER (PARTITION BY target) AS total FROM t4),
  v2 AS (SELECT *, rest * want / total AS ex, floor(rest * want / total) AS fl FROM v1),
  v3 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ex - fl DESC, label) AS rk,
          want - sum(fl) OVER (PARTITION BY target) AS left_over FROM v2),
  v4 AS (SELECT target, label, n_test, fl + (rk <= left_over)::INT AS n_val FROM v3)
"""


@query(
    "train_val_test_split",
    _HOLDOUT
    + """SELECT doc_id, r.target, r.label, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val'
           ELSE 'train' END AS part FROM r JOIN v4 ON r.target = v4.target AND r.label = v4.label""",
)
def train_val_test_split(spark, sf_dir):
    return X.stratified_holdout(known_labels(spark, sf_dir), "doc_id", "label", ["target"], 0.2, 0.2)


@query(
    "split_by_positive_count",
    f"""WITH {WIDE}, c AS (SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) AS n FROM wide),
      small AS (SELECT n FROM c GROUP BY n HAVING count(*) < 2),
      m AS (SELECT doc_id, CASE WHEN n IN (SELECT n FROM small) THEN -1 ELSE n END AS n_positive FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY n_positive ORDER BY md5('42:' || n_positive || ':' || doc_id)) AS rn FROM m),
      s AS (SELECT n_positive, count(*) AS n FROM m GROUP BY ALL),
      e AS (SELECT *, n * ceil(round(sum(n) OVER () * 0.2::DOUBLE, 9)) / sum(n) OVER () AS ex,
              ceil(round(sum(n) OVER () * 0.2::DOUBLE, 9)) AS want FROM s),
      k AS (SELECT n_positive, floor(ex) + (row_number() OVER (ORDER BY ex - floor(ex) DESC, n_positive)
              <= want - sum(floor(ex)) OVER ())::INT AS n_test FROM e)
      SELECT doc_id, n_positive::INT AS n_positive, CASE WHEN rn <= n_test THEN 'test' ELSE 'train' END AS part
      FROM r JOIN k USING (n_positive)""",
)
def split_by_positive_count(spark, sf_dir):
    counted = positives_per_entity(wide_labels(spark, sf_dir), TARGETS).select("doc_id", "n_positive")
    return X.stratified_holdout(X.merge_small_strata(counted, "n_positive"), "doc_id", "n_positive")


@query(
    "holdout_with_folds",
    _HOLDOUT
    + """, h AS (SELECT r.*, n_test FROM r JOIN t4 ON r.target = t4.target AND r.label = t4.label)
        SELECT doc_id, target, label, 'test' AS part, NULL::INT AS fold FROM h WHERE rn <= n_test
        UNION ALL SELECT doc_id, target, label, 'train',
          ((row_number() OVER (PARTITION BY target ORDER BY label, rn) - 1) % 5)::INT FROM h WHERE rn > n_test""",
)
def holdout_with_folds(spark, sf_dir):
    return X.stratified_holdout(known_labels(spark, sf_dir), "doc_id", "label", ["target"], 0.2, folds=5)


@query(
    "stratified_folds",
    f"""WITH {LONG} SELECT doc_id, target, label, ((row_number() OVER (PARTITION BY target
          ORDER BY label, md5('42:' || target || ':' || doc_id)) - 1) % 5)::INT AS fold FROM long""",
)
def stratified_folds(spark, sf_dir):
    return X.stratified_folds(known_labels(spark, sf_dir), "doc_id", "label", ["target"])


@query(
    "repeated_stratified_folds",
    f"""WITH {LONG} SELECT doc_id, target, label, "repeat"::INT AS "repeat", ((row_number() OVER (PARTITION BY target, "repeat"
          ORDER BY label, md5('42:' || target || ':' || "repeat" || ':' || doc_id)) - 1) % 5)::INT AS fold
        FROM long, range(3) r("repeat")""",
)
def repeated_stratified_folds(spark, sf_dir):
    return X.stratified_folds(known_labels(spark, sf_dir), "doc_id", "label", ["target"], n_repeats=3)


@query(
    "nested_folds",
    f"""WITH {LONG}, p AS (SELECT *, row_number() OVER (PARTITION BY target
          ORDER BY label, md5('42:' || target || ':' || doc_id)) - 1 AS place FROM long),
        o AS (SELECT p.*, i AS outer_fold, place % 5 = i AS tested FROM p, range(5) r(i))
        SELECT doc_id, target, label, outer_fold::INT AS outer_fold, 'test' AS role, NULL::INT AS inner_fold FROM o WHERE tested
        UNION ALL SELECT doc_id, target, label, outer_fold::INT, 'train',
          ((row_number() OVER (PARTITION BY target, outer_fold ORDER BY place) - 1) % 3)::INT FROM o WHERE NOT tested""",
)
def nested_folds(spark, sf_dir):
    return X.nested_folds(known_labels(spark, sf_dir), "doc_id", "label", ["target"])


_GROUP_FOLDS = """WITH RECURSIVE d AS (SELECT doc_id, source || ':' || lang AS grp FROM documents),
  g AS (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC,
          md5('42:' || count(*) || ':' || grp)) AS rn FROM d GROUP BY grp),
  deal AS (
    SELECT 0::BIGINT AS rn, ''::VARCHAR AS grp, -1::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS w
    UNION ALL
    SELECT g.rn, g.grp, list_position(deal.w, list_min(deal.w)) - 1,
      [deal.w[i] + CASE WHEN i = list_position(deal.w, list_min(deal.w)) THEN g.n ELSE 0 END for i in range(1, 6)]
    FROM deal JOIN g ON g.rn = deal.rn + 1),
  f AS (SELECT d.doc_id, d.grp, deal.fold::INT AS fold FROM d JOIN deal USING (grp))
"""


def _grouped(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    grouped = documents.select("doc_id", F.concat_ws(":", "source", "lang").alias("grp"))
    return X.group_folds(grouped, "grp")


@query("group_folds", _GROUP_FOLDS + "SELECT doc_id, grp, fold FROM f")
def group_folds(spark, sf_dir):
    return _grouped(spark, sf_dir)


@query(
    "group_fold_report",
    _GROUP_FOLDS
    + """, c AS (SELECT fold, count(*) AS n_test, count(DISTINCT grp) AS n_test_groups FROM f GROUP BY fold)
       SELECT *, (sum(n_test) OVER () - n_test)::BIGINT AS n_train,
         (sum(n_test_groups) OVER () - n_test_groups)::BIGINT AS n_train_groups FROM c""",
)
def group_fold_report(spark, sf_dir):
    return X.group_fold_report(_grouped(spark, sf_dir), "grp")


_TIME = """WITH p AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, count(*) OVER () AS n FROM events),
  b AS (SELECT *, n // 6 AS block, n - (n // 6) * 5 AS start FROM p),
  f AS (SELECT event_id, ts, CASE WHEN place >= start THEN ((place - start) // block)::INT END AS test_fold FROM b)
"""


@query(
    "time_folds",
    _TIME + "SELECT event_id, test_fold, coalesce(test_fold + 1, 0)::INT AS trains_from FROM f",
)
def time_folds(spark, sf_dir):
    return X.time_folds(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").drop("ts")


@query(
    "time_fold_sizes",
    _TIME
    + """SELECT i::INT AS fold, 'train' AS role, count(*) AS n FROM f, range(5) r(i)
           WHERE coalesce(test_fold + 1, 0) <= i GROUP BY i
         UNION ALL SELECT test_fold, 'test', count(*) FROM f WHERE test_fold IS NOT NULL GROUP BY test_fold""",
)
def time_fold_sizes(spark, sf_dir):
    folds = time_folds(spark, sf_dir)
    return X.time_fold_rows(folds).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "global_row_numbers",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag
         ORDER BY l_quantity, l_orderkey * 10 + l_linenumber) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS rn_all
       FROM lineitem""",
)
def global_row_numbers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_quantity",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
    )
    return row_numbers(lines, "l_quantity", "line", ["l_returnflag"]).drop("l_returnflag", "l_quantity", "line")


@query(
    "class_weights",
    f"""WITH {LONG}, c AS (SELECT target, label, count(*) AS n FROM long GROUP BY ALL),
        k AS (SELECT target, sum(n) AS total, count(*) AS classes FROM c GROUP BY target)
        SELECT target, label, round(CASE WHEN classes = 1 THEN 1 ELSE total / (classes * n)::DOUBLE END, 9) AS weight
        FROM c JOIN k USING (target)""",
)
def class_weights(spark, sf_dir):
    weights = prep.class_weights(known_labels(spark, sf_dir), ["target"])
    return weights.withColumn("weight", F.round("weight", 9))
