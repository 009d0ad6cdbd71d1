import glob
import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import rows_of

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]


def test_all_are_registered():
    assert sorted({n.split("_")[0] for n in NAMES}) == sorted([*[f"op{k}" for k in range(1, 14)], "pipeline"])


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_native_operators_run_no_python(spark):
    for name in ("op1_sharding", "op7_benchmark_decontamination", "op13_document_fingerprints"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_the_rest_of_the_library_stands_alone():
    for path in glob.glob(f"{ROOT}/screenspark/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read()
    code = "import sys; sys.modules['screenspark.llm'] = None; sys.modules['corpus_pipeline'] = None\nfrom screenspark.queries import load_all; load_all()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
