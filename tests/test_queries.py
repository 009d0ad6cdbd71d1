"""A selection of the registered queries against DuckDB on the smallest tables; tools/check_queries.py runs them all."""

import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "lenient_numeric_cast",
    "target_analysis",
    "property_summary",
    "rule_compliance_by_class",
    "groups_by_activity",
    "property_histogram_by_class",
    "train_val_test_split",
    "nested_folds",
    "group_folds",
    "time_folds",
    "evaluate_targets",
    "model_comparison",
    "fold_standardised_features",
    "synthetic_minority_rows",
    "token_fingerprints",
    "similar_texts_across_classes",
    "entity_profile",
    "record_scan",
    "top_cluster_by_target",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_no_query_joins_without_a_key(spark):
    for name in ("groups_by_activity", "box_table_by_class", "group_folds", "similar_texts_by_language", "nearest_rows_in_class"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
