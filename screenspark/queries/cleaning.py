"""Projection, cleaning, filter and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.functions import scalars as S
from screenspark.operators import clean as C
from screenspark.queries.fixtures import (
    LONG_ALL,
    TARGETS,
    WIDE,
    all_labels,
    known_labels,
    table,
    wide_labels,
)
from screenspark.queries.registry import query


@query(
    "fixed_schema_projection",
    """SELECT p_partkey::BIGINT AS p_partkey, p_name, p_retailprice::DOUBLE AS p_retailprice,
         NULL::DOUBLE AS logp FROM part""",
)
def fixed_schema_projection(spark, sf_dir):
    schema = {"p_partkey": "bigint", "p_name": "string", "p_retailprice": "double", "logp": "double"}
    return C.fixed_schema(table(spark, sf_dir, "part"), schema)


@query(
    "lenient_numeric_cast",
    r"""SELECT event_id, TRY_CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS DOUBLE) AS k,
          TRY_CAST(event_type AS DOUBLE) AS event_type FROM events""",
)
def lenient_numeric_cast(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", r'"k": ?([0-9]+)', 1).alias("k"), "event_type"
    )
    return C.numeric_columns(events, ["k", "event_type"])


@query(
    "label_words",
    """WITH words AS (
         SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'FALSE' ELSE 'unsure' END AS word
         FROM orders)
       SELECT o_orderkey, CASE WHEN lower(word) IN ('1', 'active', 'true', 'yes') THEN 1
         WHEN lower(word) IN ('0', 'inactive', 'false', 'no') THEN 0 END AS word FROM words""",
)
def label_words(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", "Active").when(F.col("o_orderstatus") == "O", "FALSE")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", word.otherwise("unsure").alias("word"))
    return C.label_columns(orders, ["word"])


@query(
    "rows_with_text",
    "SELECT conv_id, turn, trim(role) AS role FROM conversations WHERE role IS NOT NULL AND trim(role) NOT IN ('', 'nan')",
)
def rows_with_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return C.with_text(turns, "role", ("", "nan"), trim=True)


@query(
    "rows_with_any_label",
    f"WITH {WIDE} SELECT doc_id, quality, toxic FROM wide WHERE quality IS NOT NULL OR toxic IS NOT NULL",
)
def rows_with_any_label(spark, sf_dir):
    return C.any_known(wide_labels(spark, sf_dir).select("doc_id", *TARGETS), TARGETS)


@query(
    "rows_with_all_labels",
    f"WITH {WIDE} SELECT doc_id, quality, toxic FROM wide WHERE quality IS NOT NULL AND toxic IS NOT NULL",
)
def rows_with_all_labels(spark, sf_dir):
    return C.missing_labels(wide_labels(spark, sf_dir).select("doc_id", *TARGETS), TARGETS, "drop")


@query(
    "unknown_labels_as_zero",
    f"WITH {WIDE} SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM wide",
)
def unknown_labels_as_zero(spark, sf_dir):
    return C.missing_labels(wide_labels(spark, sf_dir).select("doc_id", *TARGETS), TARGETS, "impute")


@query(
    "known_labels_long",
    f"WITH {LONG_ALL} SELECT doc_id, target, label FROM long WHERE label IS NOT NULL",
)
def known_labels_long(spark, sf_dir):
    return C.long_labels(wide_labels(spark, sf_dir), ["doc_id"], TARGETS)


@query(
    "eligible_targets",
    f"""WITH {LONG_ALL} SELECT target, count(label) AS n_known, count(*) FILTER (label = 1) AS n_positive
        FROM long GROUP BY target HAVING count(label) >= 100 AND count(*) FILTER (label = 1) >= 10""",
)
def eligible_targets(spark, sf_dir):
    return C.eligible_targets(all_labels(spark, sf_dir))


@query(
    "structure_text_validity",
    r"""WITH t AS (SELECT coalesce(url <> '' AND regexp_matches(url, '^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+$')
          AND len(url) - len(replace(url, '(', '')) = len(url) - len(replace(url, ')', ''))
          AND len(url) - len(replace(url, '[', '')) = len(url) - len(replace(url, ']', '')), false) AS ok FROM pages)
        SELECT count(*) FILTER (ok) AS n_valid, count(*) AS n_rows, count(*) FILTER (ok) / count(*)::DOUBLE AS valid_ratio
        FROM t""",
)
def structure_text_validity(spark, sf_dir):
    return C.validity(table(spark, sf_dir, "pages"), S.balanced_brackets("url"))


@query(
    "finite_values",
    """SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN NULL ELSE round(v, 9) END AS v FROM (
         SELECT event_id, CASE WHEN event_type = 'click' THEN 'inf'::DOUBLE WHEN event_type = 'view' THEN 'nan'::DOUBLE
           ELSE value END AS v FROM events)""",
)
def finite_values(spark, sf_dir):
    value = (
        F.when(F.col("event_type") == "click", F.lit(float("inf")))
        .when(F.col("event_type") == "view", F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    return table(spark, sf_dir, "events").select("event_id", F.round(S.finite_or_null(value), 9).alias("v"))


@query(
    "plain_names",
    "SELECT DISTINCT replace(lower(p_type || '-' || p_brand), '-', '_') AS name FROM part",
)
def plain_names(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .select(S.plain_name(F.concat_ws("-", "p_type", "p_brand")).alias("name"))
        .distinct()
    )


@query(
    "labelled_feature_rows",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def labelled_feature_rows(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return C.labelled_only(documents, table(spark, sf_dir, "labels"), "doc_id")


@query(
    "unfinished_work",
    """SELECT p_partkey, p_brand FROM part
       WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40)""",
)
def unfinished_work(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)
    )
    work = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return C.unfinished(work, done.select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query(
    "positives_per_entity",
    f"WITH {WIDE} SELECT doc_id, (coalesce(quality, 0) + coalesce(toxic, 0))::INT AS n_positive FROM wide",
)
def positives_per_entity(spark, sf_dir):
    from screenspark.operators.profile import positives_per_entity as counted

    return counted(wide_labels(spark, sf_dir), TARGETS).select("doc_id", "n_positive")


@query(
    "label_group_join",
    f"""WITH {LONG_ALL} SELECT l.doc_id, l.target, l.label, d.source, d.lang FROM long l JOIN documents d USING (doc_id)
        WHERE l.label IS NOT NULL""",
)
def label_group_join(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return known_labels(spark, sf_dir).join(documents, "doc_id")
