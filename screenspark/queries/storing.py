"""Sources and sinks: the given tables are written to the shared folder and read back by the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenspark.operators import metrics as M
from screenspark.operators import predictions as P
from screenspark.operators import split as X
from screenspark.operators.clean import unfinished
from screenspark.operators.ranking import scan_numbers
from screenspark.queries.fixtures import TARGETS, known_labels, predictions, table
from screenspark.queries.predicting import CLASSED
from screenspark.queries.registry import query
from screenspark.queries.scoring import FOLDED, fold_rows
from screenspark.queries.splitting import LONG
from screenspark.session import scratch_path
from screenspark.sources import readers, writers


@query(
    "csv_scan",
    "SELECT p_partkey::VARCHAR AS compound_id, p_name AS smiles, p_brand FROM part",
)
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "parts")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand"), F.col("p_partkey").alias("compound_id"), F.col("p_name").alias("Canonical_SMILES")
    )
    writers.write_csv(parts, path)
    return readers.read_entity_csv(spark, path)


@query(
    "csv_scan_default_ids",
    """SELECT 'compound_' || rn AS compound_id, l_orderkey, l_linenumber FROM (
         SELECT l_orderkey, l_linenumber, row_number() OVER () AS rn FROM lineitem)""",
)
def csv_scan_default_ids(spark, sf_dir):
    """Every row of a folder of files without ids gets the next number in file order, whatever task reads it."""
    path = scratch_path(spark, "lines")
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select(F.col("l_shipdate").cast("string").alias("smiles"), "l_orderkey", "l_linenumber")
    writers.write_csv(lines, path)
    numbered = readers.read_entity_csv(spark, path)
    return numbered.select("compound_id", F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"))


@query("scan_row_numbers", "SELECT event_id, row_number() OVER () AS rn FROM events")
def scan_row_numbers(spark, sf_dir):
    return scan_numbers(table(spark, sf_dir, "events").select("event_id"), "rn")


@query(
    "required_column_scan",
    "SELECT conv_id::VARCHAR AS conv_id, trim(role) AS Smiles FROM conversations WHERE trim(role) NOT IN ('', 'nan')",
)
def required_column_scan(spark, sf_dir):
    path = scratch_path(spark, "turns")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit(" "), "role").alias("Smiles"))
    turns.write.option("header", True).option("sep", ";").csv(path)
    return readers.read_required_csv(spark, path, "Smiles")


def _write_records(spark, sf_dir) -> str:
    """Labels as property records, one target under its plain name and one under another name form."""
    path = scratch_path(spark, "records")
    labels = table(spark, sf_dir, "labels")
    record = F.format_string(
        "entity %d\n  block\nM  END\n> <doc_id>\n%d\n\n>  <quality>\n%s\n\n> <Activity_toxic>\n%d\n\n$$$$",
        F.col("doc_id"),
        F.col("doc_id"),
        F.when(F.col("quality") == 1, "Active").otherwise("inactive"),
        F.col("toxic"),
    )
    labels.select(record.alias("value")).write.text(path)
    return path


@query(
    "record_scan",
    """SELECT 'doc_id' AS name, doc_id::VARCHAR AS value FROM labels
       UNION ALL SELECT 'quality', CASE WHEN quality = 1 THEN 'Active' ELSE 'inactive' END FROM labels
       UNION ALL SELECT 'Activity_toxic', toxic::VARCHAR FROM labels""",
)
def record_scan(spark, sf_dir):
    records = readers.read_records(spark, _write_records(spark, sf_dir))
    return records.select(F.explode("props").alias("name", "value"))


@query("record_labels", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def record_labels(spark, sf_dir):
    records = readers.read_records(spark, _write_records(spark, sf_dir))
    return readers.record_labels(records, TARGETS).groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_matrix_round_trip",
    """SELECT vec_id AS entity_id, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings""",
)
def feature_matrix_round_trip(spark, sf_dir):
    path = scratch_path(spark, "features")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )
    writers.write_features(rows, path, "entity_id", "features")
    stored = readers.read_entities(spark, path + "/*.parquet")
    return stored.select(
        "entity_id", F.size("features").alias("width"), F.round(F.get("features", F.lit(0)), 6).alias("first_value")
    )


@query(
    "prediction_csv_round_trip",
    f"WITH {CLASSED} SELECT doc_id::VARCHAR AS doc_id, target, probability, prediction FROM classed",
)
def prediction_csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "report")
    wide = P.widen(predictions(spark, sf_dir), "doc_id", TARGETS).withColumn("other", F.lit(1))
    writers.write_prediction_csv(wide, path, ["doc_id", "smiles"], TARGETS)
    return readers.read_predictions(spark, path, ["doc_id"])


@query(
    "split_round_trip",
    f"""WITH {LONG} SELECT doc_id, target, label, ((row_number() OVER (PARTITION BY target
          ORDER BY label, md5('42:' || target || ':' || doc_id)) - 1) % 5)::INT AS fold FROM long""",
)
def split_round_trip(spark, sf_dir):
    path = scratch_path(spark, "splits")
    writers.write_splits(X.stratified_folds(known_labels(spark, sf_dir), "doc_id", "label", ["target"]), path)
    return spark.read.parquet(path)


@query(
    "result_round_trip",
    f"WITH {FOLDED} SELECT target, model, metric, round(mean, 6) AS mean, round(std, 6) AS std, n_folds FROM fs",
)
def result_round_trip(spark, sf_dir):
    """Written twice: the second write replaces the first."""
    path = scratch_path(spark, "results")
    rows = fold_rows(spark, sf_dir)
    writers.write_by_target(rows, path)
    writers.write_by_target(rows, path)
    summary = M.fold_summary(readers.read_results(spark, path))
    return summary.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("available_targets", f"WITH {LONG} SELECT DISTINCT target FROM long")
def available_targets(spark, sf_dir):
    path = scratch_path(spark, "results")
    writers.write_by_target(fold_rows(spark, sf_dir), path)
    return readers.available_targets(readers.read_results(spark, path))


@query(
    "resumed_work",
    """SELECT DISTINCT s_nationkey::VARCHAR AS target FROM supplier
       WHERE s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9700)""",
)
def resumed_work(spark, sf_dir):
    """Nations with a rich supplier are marked as finished; the others are left to do."""
    path = scratch_path(spark, "progress")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("target"), "s_acctbal")
    nothing = writers.read_progress(spark, path, "r1")
    work = unfinished(suppliers.select("target").distinct(), nothing)
    done = [r["target"] for r in suppliers.where(F.col("s_acctbal") > 9700).select("target").distinct().collect()]
    writers.write_progress(spark, path, "r1", done)
    writers.write_progress(spark, path, "r1", done)
    return unfinished(work, writers.read_progress(spark, path, "r1"))


@query(
    "json_export_round_trip",
    f"WITH {FOLDED} SELECT target, model AS best_model FROM bm",
)
def json_export_round_trip(spark, sf_dir):
    from screenspark.plans.reports import export_rows

    path = scratch_path(spark, "export")
    summary = M.fold_summary(fold_rows(spark, sf_dir))
    counts = summary.groupBy("target").agg(F.countDistinct("model").alias("n_features"))
    writers.write_json_documents(export_rows(summary, counts), path)
    documents = spark.read.schema("value string, target string").text(path)
    return documents.select("target", F.get_json_object("value", "$.best_model_name").alias("best_model"))


@query(
    "streamed_classes",
    f"WITH {CLASSED} SELECT doc_id, target, probability, prediction, class FROM classed",
)
def streamed_classes(spark, sf_dir):
    """The row-wise operators on files read as a stream."""
    from screenspark.streaming.rowwise import stream_predictions, write_available

    source, sink = scratch_path(spark, "incoming"), scratch_path(spark, "classed")
    predictions(spark, sf_dir).write.parquet(source)
    stream = stream_predictions(spark, source, "doc_id bigint, target string, probability double")
    write_available(stream, sink, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(sink)
