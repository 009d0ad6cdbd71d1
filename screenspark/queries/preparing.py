"""Imputation, scaling, selection and oversampling on feature matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import oversample as O
from screenspark.operators import prep as E
from screenspark.operators import select as S
from screenspark.queries.fixtures import table
from screenspark.queries.profiling import rounded
from screenspark.queries.registry import query

WIDTH = 64


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", E.doubles("embedding").alias("x"), "label")


def cells(df, *keep, digits=6):
    """One row per entity and feature."""
    return df.select(*keep, F.posexplode("x").alias("idx", "value")).withColumn("value", F.round("value", digits))


LONG_X = f"""lx AS (SELECT vec_id, label, i::INT AS idx, embedding[i + 1]::DOUBLE AS v FROM embeddings, range({WIDTH}) r(i))"""


def holes(spark, sf_dir):
    """Order lines as a matrix with missing and infinite cells made from the data."""
    quantity = F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_quantity"))
    price = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(quantity, price, F.lit(None).cast("double"), "l_tax").alias("x")
    )


@query(
    "median_imputation",
    """WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS q,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice END AS p, l_tax FROM lineitem),
       m AS (SELECT median(q) AS mq, median(p) AS mp FROM h)
       SELECT l_orderkey, l_linenumber, round(coalesce(q, mq), 4) AS quantity, round(coalesce(p, mp), 4) AS price,
         0.0::DOUBLE AS nothing, l_tax AS tax FROM h, m""",
)
def median_imputation(spark, sf_dir):
    rows = holes(spark, sf_dir)
    filled = E.fill_missing(rows, "x", E.fit_medians(rows, "x"))
    names = ("quantity", "price", "nothing", "tax")
    wide = filled.select("l_orderkey", "l_linenumber", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rounded(wide, "quantity", "price", digits=4)


_LINES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "variance_filter",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(var_pop({c}), 2) AS variance, var_pop({c}) > 0.01 AS kept FROM lineitem"
        for c in _LINES
    )
    + ")",
)
def variance_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.array(*_LINES).alias("x"))
    moments = E.fit_moments(lines, "x")
    kept = set(E.variable_features(moments))
    rows = [(n, round(moments.variance[i], 2), i in kept) for i, n in enumerate(_LINES)]
    return spark.createDataFrame(rows, "feature string, variance double, kept boolean")


@query(
    "standardised_features",
    f"""WITH {LONG_X}, s AS (SELECT idx, avg(v) AS m, stddev_pop(v) AS s FROM lx GROUP BY idx)
        SELECT vec_id, idx, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM lx JOIN s USING (idx)""",
)
def standardised_features(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cells(E.standardise(rows, "x", E.fit_moments(rows, "x")), "vec_id")


@query(
    "fold_standardised_features",
    f"""WITH {LONG_X}, f AS (SELECT *, (vec_id % 5)::INT AS fold FROM lx),
        c AS (SELECT fold, idx, count(*) AS n, sum(v) AS t, sum(v * v) AS q FROM f GROUP BY fold, idx),
        o AS (SELECT fold, idx, sum(n) OVER w - n AS n, sum(t) OVER w - t AS t, sum(q) OVER w - q AS q FROM c
          WINDOW w AS (PARTITION BY idx)),
        s AS (SELECT fold, idx, t / n AS m, sqrt(greatest(q / n - (t / n) * (t / n), 0)) AS s FROM o)
        SELECT vec_id, fold, idx, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM f JOIN s USING (fold, idx)""",
)
def fold_standardised_features(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("fold", F.pmod("vec_id", F.lit(5)).cast("int"))
    moments = E.fit_fold_moments(rows, "x", "fold")
    return cells(E.standardise_by_fold(rows, "x", "fold", moments), "vec_id", "fold")


@query(
    "robust_scaled_features",
    f"""WITH {LONG_X}, s AS (SELECT idx, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM lx GROUP BY idx)
        SELECT vec_id, idx, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM lx JOIN s USING (idx)""",
)
def robust_scaled_features(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return cells(E.robust_scale(rows, "x", E.fit_robust(rows, "x")), "vec_id")


def derived_lines(spark, sf_dir):
    """Columns of order lines, some of them nearly functions of earlier ones."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.array(
            F.col("l_quantity"),
            price,
            price * (1 - discount),
            price * (1 - discount) * (1 + F.col("l_tax")),
            discount,
            F.col("l_quantity") * 2 + 1,
            F.lit(3.0),
        ).alias("x"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        F.col("l_returnflag").alias("flag"),
    )


_DERIVED = """SELECT l_quantity AS f0, l_extendedprice AS f1, l_extendedprice * (1 - l_discount) AS f2,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS f3, l_discount AS f4, l_quantity * 2 + 1 AS f5, 3.0::DOUBLE AS f6,
  (l_linestatus = 'F')::INT AS label, l_returnflag AS flag FROM lineitem"""


@query(
    "correlation_filter",
    f"WITH d AS ({_DERIVED}) SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT {j} AS idx, "
        + (" OR ".join(f"coalesce(abs(corr(f{i}, f{j})) > 0.9, false)" for i in range(j)) or "max(false)")
        + " AS dropped FROM d"
        for j in range(6)
    )
    + " UNION ALL SELECT 6, false)",
)
def correlation_filter(spark, sf_dir):
    dropped = set(S.correlated_features(derived_lines(spark, sf_dir), "x"))
    return spark.createDataFrame([(i, i in dropped) for i in range(7)], "idx int, dropped boolean")


@query(
    "mutual_information",
    f"""WITH d AS ({_DERIVED}), l AS ({' UNION ALL '.join(f'SELECT {i} AS idx, f{i} AS v, flag FROM d' for i in range(7))}),
        r AS (SELECT idx, min(v) AS lo, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 10 ELSE 1 END AS w FROM l GROUP BY idx),
        b AS (SELECT idx, least(floor((v - lo) / w), 9)::INT AS bin, flag, count(*) AS n FROM l JOIN r USING (idx) GROUP BY ALL),
        t AS (SELECT idx, n, sum(n) OVER (PARTITION BY idx) AS total, sum(n) OVER (PARTITION BY idx, bin) AS nb,
          sum(n) OVER (PARTITION BY idx, flag) AS nf FROM b)
        SELECT idx, round(sum(n / total::DOUBLE * ln(n * total / (nb * nf)::DOUBLE)) + 0.0, 9) AS mutual_information FROM t GROUP BY idx""",
)
def mutual_information(spark, sf_dir):
    return rounded(
        S.mutual_information(derived_lines(spark, sf_dir), "x", "flag"), "mutual_information", digits=9
    )


@query(
    "anova_f",
    f"""WITH {LONG_X}, c AS (SELECT idx, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM lx GROUP BY idx, label),
        o AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS g FROM c WINDOW w AS (PARTITION BY idx))
        SELECT idx, round((sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 6) AS f_value
        FROM o GROUP BY idx""",
)
def anova_f(spark, sf_dir):
    return rounded(S.anova_f(vectors(spark, sf_dir), "x", "label"), "f_value")


@query(
    "top_features_by_f",
    f"""WITH {LONG_X}, c AS (SELECT idx, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM lx GROUP BY idx, label),
        o AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS g FROM c WINDOW w AS (PARTITION BY idx)),
        f AS (SELECT idx, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM o GROUP BY idx)
        SELECT idx, round(f, 6) AS f_value FROM f ORDER BY f DESC, idx LIMIT 32""",
)
def top_features_by_f(spark, sf_dir):
    scores = S.anova_f(vectors(spark, sf_dir), "x", "label")
    return rounded(S.top_features(scores, "f_value", S.f_selection_size(WIDTH)), "f_value")


@query(
    "nearest_rows_in_class",
    """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
       d AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, list_distance(a.e, b.e) AS dist
         FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id)
       SELECT label, vec_id, row_number() OVER w::INT AS place, neighbour, round(dist, 6) AS distance FROM d
       WINDOW w AS (PARTITION BY label, vec_id ORDER BY dist, neighbour) QUALIFY place <= 5""",
)
def nearest_rows_in_class(spark, sf_dir):
    return rounded(O.nearest_rows(vectors(spark, sf_dir), "vec_id", "x", ["label"]), "distance")


@query(
    "nearest_orders_by_status",
    """WITH x AS (SELECT o_orderkey, o_orderstatus, o_totalprice / 1000 AS p,
         date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS t FROM orders),
       d AS (SELECT a.o_orderstatus, a.o_orderkey,
           min({'d': sqrt((a.p - b.p) * (a.p - b.p) + (a.t - b.t) * (a.t - b.t)), 'n': b.o_orderkey}, 5) AS near
         FROM x a JOIN x b ON a.o_orderstatus = b.o_orderstatus AND a.o_orderkey <> b.o_orderkey GROUP BY ALL)
       SELECT o_orderstatus, o_orderkey, place::INT AS place, near[place].n AS neighbour, round(near[place].d, 6) AS distance
       FROM (SELECT *, unnest(range(1, len(near) + 1)) AS place FROM d)""",
)
def nearest_orders_by_status(spark, sf_dir):
    """Groups of many blocks: price and day of the orders of each status."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.array(F.col("o_totalprice") / 1000, day).alias("x"))
    return rounded(O.nearest_rows(orders, "o_orderkey", "x", ["o_orderstatus"]), "distance")


@query(
    "synthetic_minority_rows",
    """WITH x AS (SELECT vec_id, (label = 0)::INT AS y, embedding::DOUBLE[] AS e FROM embeddings),
       s AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM x),
       b AS (SELECT vec_id, e, row_number() OVER (ORDER BY md5('42:' || vec_id)) - 1 AS no FROM x WHERE y = 1),
       d AS (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id
           ORDER BY list_distance(a.e, b.e), b.vec_id) AS place
         FROM x a JOIN x b ON a.y = 1 AND b.y = 1 AND a.vec_id <> b.vec_id QUALIFY place <= 5),
       r AS (SELECT unnest(range(n0 - n1)) AS seq, n1 FROM s),
       w AS (SELECT seq, ('0x' || substr(md5('42:base:' || seq), 1, 15))::BIGINT % n1 AS no,
         ('0x' || substr(md5('42:neighbour:' || seq), 1, 15))::BIGINT % 5 + 1 AS place,
         ('0x' || substr(md5('42:gap:' || seq), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS gap FROM r)
       SELECT seq, 1 AS y, b.vec_id AS base, d.neighbour, round(gap, 9) AS gap,
         round(b.e[1] + gap * (t.e[1] - b.e[1]), 6) AS first_value, round(b.e[64] + gap * (t.e[64] - b.e[64]), 6) AS last_value
       FROM w JOIN b USING (no) JOIN d ON d.vec_id = b.vec_id AND d.place = w.place JOIN x t ON t.vec_id = d.neighbour""",
)
def synthetic_minority_rows(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("y", (F.col("label") == 0).cast("int"))
    made = O.synthetic_rows(rows, "vec_id", "x", "y")
    return made.select(
        "seq",
        "y",
        "base",
        "neighbour",
        F.round("gap", 9).alias("gap"),
        F.round(F.get("x", F.lit(0)), 6).alias("first_value"),
        F.round(F.get("x", F.lit(63)), 6).alias("last_value"),
    )


@query(
    "oversampled_class_sizes",
    """WITH s AS (SELECT (label = 0)::INT AS y, count(*) AS n FROM embeddings GROUP BY 1)
       SELECT y, false AS synthetic, n FROM s
       UNION ALL SELECT y, true, (SELECT max(n) FROM s) - n FROM s WHERE n < (SELECT max(n) FROM s)""",
)
def oversampled_class_sizes(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("y", (F.col("label") == 0).cast("int"))
    return O.oversample(rows, "vec_id", "x", "y").groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))
