import pytest
from conftest import rows

from screenspark.operators import predictions as P
from screenspark.sources import readers, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_entity_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'name,Canonical_SMILES,w\nx,"C,C",1\ny,"a ""q"" b",2\n')
    got = readers.read_entities(spark, path)
    assert got.columns == ["compound_id", "smiles", "name", "w"]
    assert rows(got, "compound_id", "smiles") == [("compound_1", "C,C"), ("compound_2", 'a "q" b')]
    path = put(tmp_path / "b.csv", "compound_id,smiles\nm7,CC\n")
    assert rows(readers.read_entities(spark, path)) == [("m7", "CC")]
    with pytest.raises(ValueError):
        readers.read_entities(spark, put(tmp_path / "c.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError):
        readers.read_entities(spark, "x.xyz")


def test_required_column(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id;Smiles\n1; CC \n2;\n3;nan\n4;N\n")
    assert rows(readers.read_required_csv(spark, path, "Smiles")) == [("1", "CC"), ("4", "N")]
    with pytest.raises(ValueError):
        readers.read_required_csv(spark, path, "smiles")


RECORDS = """first
  block
M  END
> <T>
1

>  <Activity_U>
inactive

$$$$
second
> <PANEL_T_active> (2)
Active

> <NOTE>
two
lines

> <U>
unsure

> <Activity_U>
1

$$$$
third
> <NOTE>
a

> <NOTE>
b

$$$$
"""


def test_records(spark, tmp_path):
    records = readers.read_entities(spark, put(tmp_path / "r.sdf", RECORDS))
    got = {r["record_id"]: r["props"] for r in records.collect()}
    assert got[1] == {"T": "1", "Activity_U": "inactive"}
    assert got[2]["NOTE"] == "two\nlines" and got[2]["PANEL_T_active"] == "Active"
    assert got[3] == {"NOTE": "b"}
    labels = readers.record_labels(records, ["T", "U"])
    assert {r["record_id"]: (r["T"], r["U"]) for r in labels.collect()} == {1: (1, 0), 2: (1, None), 3: (None, None)}


def test_windows_line_ends(spark, tmp_path):
    path = tmp_path / "r.sdf"
    path.write_bytes(RECORDS.replace("\n", "\r\n").encode())
    assert {len(r["props"]) for r in readers.read_records(spark, str(path)).collect()} == {2, 4, 1}


def test_prediction_csv_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "NR-A", 0.8), (2, "NR-A", 0.2)], "id int, target string, probability double")
    wide = P.widen(df, "id", ["NR-A"]).selectExpr("'x' as other", "*")
    assert P.report_columns(wide, ["id", "smiles"], ["NR-A", "SR-B"]) == [
        "id",
        "NR-A_probability",
        "NR-A_prediction",
        "NR-A_toxicity",
    ]
    writers.write_prediction_csv(wide, str(tmp_path / "p"), ["id"], ["NR-A"])
    back = readers.read_predictions(spark, str(tmp_path / "p"), ["id"])
    assert rows(back) == [("1", "NR-A", 0.8, 1), ("2", "NR-A", 0.2, 0)]
    with pytest.raises(ValueError):
        P.lengthen(df, ["id"])


def test_progress_is_kept_per_target(spark, tmp_path):
    path = str(tmp_path / "progress")
    assert writers.read_progress(spark, path).count() == 0
    writers.write_progress(spark, path, "r", ["a", "NR-B/x"])
    writers.write_progress(spark, path, "r", ["a"])
    assert rows(writers.read_progress(spark, path, "r"), "target") == [("NR-B/x",), ("a",)]
    assert writers.read_progress(spark, path, "other").count() == 0
    writers.write_progress(spark, path, "other", ["a"])
    assert rows(writers.read_progress(spark, path), "run_id", "target") == [("other", "a"), ("r", "NR-B/x"), ("r", "a")]


def test_partitions_are_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "target string, v int")
    writers.write_by_target(df, path)
    writers.write_by_target(df.where("target = 'a'"), path)
    assert rows(spark.read.parquet(path), "target", "v") == [("a", 1), ("b", 2)]


def test_entity_reports(spark):
    wide = spark.createDataFrame([(1, 0.9, 0.1, None), (2, 0.2, 0.4, 0.5), (3, 0.1, 0.2, 0.0)], "id int, a double, b double, c double")
    targets = ["a", "b", "c"]
    got = {r["id"]: r for r in P.entity_profile(wide, "id", targets).collect()}
    assert got[1]["overall"] == "Toxic" and got[1]["status"] == "1/2 PASS" and got[1]["average_probability"] == 0.5
    assert got[1]["summary"] == "Toxic: 1, Moderate: 0"
    assert got[2]["overall"] == "Moderate" and got[2]["status"] == "ALL PASS" and got[2]["summary"] == "Moderate: 2"
    assert got[3]["summary"] == "Non-toxic"
    tops = [(r["place"], r["target"]) for r in P.top_targets(wide.where("id = 1"), "id", targets, 3).orderBy("place").collect()]
    assert tops == [(1, "a"), (2, "b")]
    assert [r["id"] for r in P.top_entities(wide, "id", targets, 2).collect()] == [1, 2]


def test_top_rows_under_skew(spark):
    from pyspark.sql import functions as F

    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"), F.lit(0.5).alias("p"))
    got = P.top_rows(df, ["g"], "p", "id", 3)
    assert rows(got, "g", "place", "id") == [("x", 1, 0), ("x", 2, 3), ("x", 3, 6), ("y", 1, 1), ("y", 2, 2), ("y", 3, 4)]


def test_display_head(spark):
    got = P.first_rows(spark.range(100), ["id"], 3).orderBy("place").collect()
    assert [r["id"] for r in got] == ["0", "1", "2", "..."]
    assert P.first_rows(spark.range(3), ["id"], 3).count() == 3
