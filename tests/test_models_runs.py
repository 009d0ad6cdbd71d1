import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.operators import cluster as C
from screenspark.operators import models as M
from screenspark.operators.clean import long_labels
from screenspark.operators.metrics import evaluate
from screenspark.operators.select import SelectionSettings
from screenspark.operators.split import stratified_folds
from screenspark.plans import screening as R
from screenspark.plans.presets import ASSAY_SETTINGS
from screenspark.sources import readers, writers
from screenspark.streaming.rowwise import stream_predictions, write_available

QUICK = M.ModelSettings(trees=5, depth=3, linear_iterations=10, rounds=5, network_iterations=30, calibration_folds=2)


@pytest.fixture(scope="module")
def separable(spark):
    draw = np.random.default_rng(5)
    data = []
    for i in range(240):
        y = int(i % 3 == 0)
        x = [float(v) for v in draw.normal(size=4)]
        x[0] += 6 * y
        data.append((i, x, y, y if i % 2 else None, 1))
    return spark.createDataFrame(data, "id long, x array<double>, y int, half int, one int").repartition(4).persist()


@pytest.mark.parametrize("kind", [M.FOREST, M.LOGISTIC, M.SVM, M.BOOSTED, M.BOOSTED_SAMPLED, M.NETWORK])
def test_every_model_separates(separable, kind):
    fitted = M.train_targets(separable, "x", ["y"], kind, QUICK)
    scored = M.score_targets(fitted, separable, "x", "id")
    out_of_range = scored.where((F.col("probability") < 0) | (F.col("probability") > 1))
    assert scored.count() == 240 and out_of_range.count() == 0
    joined = scored.join(separable.select("id", F.col("y").alias("label")), "id")
    assert evaluate(joined, ["target"]).first()["roc_auc"] > 0.95


def test_voting_averages_the_kinds(separable):
    by_kind = {k: M.train_targets(separable, "x", ["y"], k, QUICK) for k in (M.FOREST, M.LOGISTIC)}
    voted = {r["id"]: r["probability"] for r in M.score_voting(by_kind, separable, "x", "id").collect()}
    single = [M.score_targets(fitted, separable, "x", "id") for fitted in by_kind.values()]
    means = single[0].unionByName(single[1]).groupBy("id").agg(F.avg("probability").alias("p"))
    assert voted == pytest.approx({r["id"]: r["p"] for r in means.collect()})


def test_targets_with_few_rows_are_skipped(separable):
    assert set(M.train_targets(separable, "x", ["y", "half"], M.LOGISTIC, QUICK, smallest=200)) == {"y"}


def test_balanced_weights(separable):
    assert M.balanced_weights(separable, "y") == {0: 0.75, 1: 1.5}
    assert M.balanced_weights(separable, "one") == {}


def test_cross_validation_leaves_out_a_failing_model(separable):
    folds = stratified_folds(separable, "id", "y", n_splits=3)
    got = M.cross_validate(folds, "x", "y", "fold", [M.FOREST, "unknown"], QUICK)
    assert list(got.failed) == ["unknown"]
    rows = got.rows.collect()
    assert len(rows) == 3 * 7 and {r["model"] for r in rows} == {M.FOREST}
    assert min(r["value"] for r in rows if r["metric"] == "roc_auc") > 0.95
    with pytest.raises(RuntimeError):
        M.cross_validate(folds, "x", "y", "fold", ["unknown"], QUICK)


def test_grid_search(separable):
    folds = stratified_folds(separable, "id", "y", n_splits=2)
    got = M.grid_search(folds, "x", "y", "fold", grid={"maxDepth": [1, 3], "numTrees": [5]}, settings=QUICK)
    assert len(got.table) == 2 and got.score == max(s for _, s in got.table) and got.best["numTrees"] == 5


def test_rows_of_large_tables_are_dealt_out_for_the_fits(separable, monkeypatch):
    """Neither the one task of a single row group nor every shuffle partition passes the rows once per step of a fit."""
    from screenspark.operators import select as S

    monkeypatch.setattr(S, "SPREAD_ROWS", 200)
    cores, seen = separable.sparkSession.sparkContext.defaultParallelism, []
    single = separable.coalesce(1)
    monkeypatch.setattr(M, "fit_model", lambda kind, table, settings: seen.append((table.rdd.getNumPartitions(), table.count())))
    M.train_targets(single, "x", ["y", "half"], M.NETWORK, QUICK)
    assert sorted(seen) == [(cores, 120), (cores, 240)]
    seen.clear()

    class Search:
        def __init__(self, **settings):
            self.points = settings["estimatorParamMaps"]

        def fit(self, table):
            seen.append((table.rdd.getNumPartitions(), table.count()))
            self.avgMetrics = [0.5] * len(self.points)
            return self

    monkeypatch.setattr(M, "CrossValidator", Search)
    folds = separable.withColumn("fold", F.col("id") % 2).repartition(5 * cores)
    assert M.grid_search(folds, "x", "y", "fold", grid={"maxDepth": [1]}, settings=QUICK).score == 0.5
    assert seen == [(cores, 240)]


def test_principal_axes_equal_the_covariance_matrix(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as x")
    data = np.array([r["x"] for r in df.collect()])
    values, vectors = np.linalg.eigh(np.cov(data.T, bias=True))
    axes, found = C.principal_axes(df, "x", 3)
    assert found == pytest.approx(values[::-1][:3], rel=1e-9)
    assert np.abs(np.array(axes) @ vectors[:, ::-1][:, :3]) == pytest.approx(np.eye(3), abs=1e-5)
    plain, projection = C.project(df, "x", 2)
    monkeypatch.setattr(C, "WIDE", 10)
    wide, again = C.project(df, "x", 2)
    assert again.explained == pytest.approx(projection.explained, abs=1e-6)
    a, b = (np.array([r["coordinates"] for r in d.orderBy("vec_id").collect()]) for d in (plain, wide))
    assert np.abs(b - b.mean(axis=0)) == pytest.approx(np.abs(a - a.mean(axis=0)), abs=1e-4)


def test_wide_features_are_projected(spark):
    draw = np.random.default_rng(3)
    data = draw.normal(size=(40, 3)) @ draw.normal(size=(3, 4500)) * 5 + draw.normal(size=(40, 4500))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "id int, x array<double>").coalesce(2)
    projected, projection = C.project(df, "x", 3)
    singular = np.linalg.svd(data - data.mean(axis=0), compute_uv=False) ** 2
    assert projection.explained == pytest.approx((singular / singular.sum())[:3], rel=1e-6)
    found = np.array([r["coordinates"] for r in projected.orderBy("id").collect()])
    assert (found**2).sum(axis=0) == pytest.approx(singular[:3], rel=1e-6)


def plain_silhouettes(x, c):
    out = []
    for i in range(len(x)):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        own = [far[j] for j in range(len(x)) if c[j] == c[i] and j != i]
        rest = [np.mean([far[j] for j in range(len(x)) if c[j] == k]) for k in set(c) if k != c[i]]
        a, b = np.mean(own) if own else 0, min(rest)
        out.append((b - a) / max(a, b) if own and max(a, b) > 0 else 0.0)
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_silhouettes_equal_brute_force(spark, block):
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(size=(30, 3)), draw.normal(4, 1, (25, 3)), [[9.0, 9.0, 9.0]], np.ones((4, 3))])
    c = ["a"] * 30 + ["b"] * 25 + ["alone"] + ["same"] * 4
    df = spark.createDataFrame([(i, c[i], [float(v) for v in x[i]]) for i in range(60)] + [(99, None, [0.0, 0.0, 0.0]), (98, "a", None)], "id long, c string, x array<double>")
    found = {r["id"]: (r["c"], r["silhouette"]) for r in C.silhouettes(df, "id", "x", "c", block).collect()}
    expected = plain_silhouettes(x, c)
    assert len(found) == 60 and all(found[i][0] == c[i] and found[i][1] == pytest.approx(expected[i], abs=1e-6) for i in range(60))
    one = C.silhouettes(df.where("c = 'a'"), "id", "x", "c", block).collect()
    assert len(one) == 30 and all(r["silhouette"] is None for r in one)
    assert C.silhouettes(df.limit(0), "id", "x", "c").count() == 0


def test_euclidean_choice_of_clusters(spark):
    draw = np.random.default_rng(7)
    data = [(int(i), [float(v) for v in (i % 3) * 20 + draw.normal(size=2)]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, x array<double>")
    chosen = C.choose_clusters(df, "x", [2, 3, 4], starts=2, id_column="id")
    labels = {r["id"]: r["cluster"] for r in C.assign_clusters(df, "x", chosen).collect()}
    assert chosen.k == 3 and dict(chosen.scores)[3] == pytest.approx(np.mean(plain_silhouettes(np.array([x for _, x in data]), [labels[i] for i in range(60)])), abs=1e-6)


def test_clusters(spark):
    draw = np.random.default_rng(6)
    data = [(i, [float(v) for v in draw.normal(10 * (i % 3), 0.5, 5)]) for i in range(150)]
    df = spark.createDataFrame(data, "id long, x array<double>")
    projected, projection = C.project(df, "x")
    assert projection.explained[0] > 0.9
    means = projected.agg(*[F.avg(F.get("coordinates", F.lit(i))) for i in range(2)]).first()
    assert list(means) == pytest.approx([0, 0], abs=1e-6)
    chosen = C.choose_clusters(projected, "coordinates", [2, 3, 4], starts=2)
    assert chosen.k == 3
    assigned = C.assign_clusters(projected, "coordinates", chosen)
    assert sorted(r["cluster_size"] for r in C.cluster_sizes(assigned).collect()) == [50, 50, 50]
    assert C.choose_clusters(projected, "coordinates", []).k == 1
    assert C.cluster_grid(10_000) == [5, 10, 15, 20, 25] and C.cluster_grid(450) == [] and C.class_cluster_grid(9) == []
    assert C.class_cluster_grid(35) == [2, 3]


def settings(**changes):
    base = R.ScreeningSettings(
        cv_folds=2,
        min_known=50,
        models=(M.FOREST, M.LOGISTIC),
        selection=SelectionSettings(univariate_k=3, model_top_n=2, importance_trees=5),
        model=QUICK,
    )
    return R.replace(base, **changes)


NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def inputs(separable):
    features = separable.select(F.col("id").alias("entity_id"), F.col("x").alias("features"))
    labels = long_labels(separable.withColumnRenamed("id", "entity_id"), ["entity_id"], ["y", "half", "one"])
    return features, labels


def test_run_resume_and_scoring(spark, inputs, tmp_path):
    features, labels = inputs
    folder = str(tmp_path / "run")
    first = R.run_screening(features, labels, NAMES, folder, settings(models=(M.FOREST,)), ["y"])
    assert first.finished == ["y"] and not first.failed
    changed = settings(models=(M.FOREST,), scale=True, oversample=True, select_in_folds=False)
    second = R.run_screening(features, labels, NAMES, folder, changed, ["y", "half"])
    assert second.finished == ["half"]
    assert {r["target"] for r in second.overview.collect()} == {"y", "half"}
    results = readers.read_results(spark, f"{folder}/results")
    assert results.count() == 2 * 2 * 7
    scored = R.score_run(features, NAMES, folder)
    assert scored.count() == 480 and scored.where("probability is null").count() == 0
    fewer = R.score_run(features.withColumn("features", F.slice("features", 2, 3)), NAMES[1:], folder)
    assert fewer.count() == 480
    export = {r["target"]: r["document"] for r in R.export_run(spark, folder).collect()}
    assert '"selected_features_count":2' in export["y"]
    info = {r["target"]: json.loads(r["document"]) for r in R.model_info(spark, folder).collect()}
    assert len(info["half"]["model_comparison"]) == 1 and info["half"]["training_config"]["cv_folds"] == 2
    assert info["y"]["performance"]["roc_auc"] > 0.95 and len(info["y"]["selected_features"]) == 2
    assert writers.read_progress(spark, f"{folder}/progress").count() == 2


def test_a_failing_target_does_not_stop_the_others(inputs, tmp_path):
    features, labels = inputs
    bad = settings(models=(M.FOREST,), select_in_folds=False, overrides={"half": {"models": ("unknown",)}})
    report = R.run_screening(features, labels, NAMES, str(tmp_path / "run"), bad, ["y", "half"])
    assert report.finished == ["y"] and list(report.failed) == ["half"]


def test_settings_of_a_target():
    base = settings(overrides={"t": {"univariate_k": 9, "trees": 77, "cv_folds": 4}} | {"p": ASSAY_SETTINGS["NR-AR"]})
    own = base.for_target("t")
    assert own.model.trees == 77 and own.selection.importance_trees == 5
    preset = base.for_target("p")
    assert (preset.model.trees, preset.model.depth, preset.selection.correlation_limit) == (150, 12, 0.85)
    assert own.selection.univariate_k == 9 and own.cv_folds == 4 and base.for_target("u").cv_folds == 2


def test_stream_gives_the_batch_result(spark, tmp_path):
    schema = "id long, target string, probability double"
    batch = spark.range(100).selectExpr("id", "'t' as target", "id / 100.0D as probability")
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch.write.parquet(source)
    write_available(stream_predictions(spark, source, schema), sink, state).awaitTermination()
    batch.selectExpr("id + 100 as id", "target", "probability").write.mode("append").parquet(source)
    write_available(stream_predictions(spark, source, schema), sink, state).awaitTermination()
    counts = {r["class"]: r["count"] for r in spark.read.parquet(sink).groupBy("class").count().collect()}
    assert counts == {"Non-toxic": 60, "Moderate": 80, "Toxic": 60}


def test_targets_run_side_by_side(inputs, tmp_path, monkeypatch):
    import threading

    features, labels = inputs
    both = threading.Barrier(2, timeout=60)
    plain = R.run_target

    def met(spark, table, names, target, folders, base):
        both.wait()
        plain(spark, table, names, target, folders, base)

    monkeypatch.setattr(R, "run_target", met)
    report = R.run_screening(features, labels, NAMES, str(tmp_path / "run"), settings(models=(M.FOREST,)), ["y", "half"])
    assert report.finished == ["half", "y"] and not report.failed


def test_silhouettes_move_rows_a_bounded_number_of_times(spark, monkeypatch):
    draw = np.random.default_rng(8)
    x, c = draw.normal(size=(70, 2)), [int(v) for v in draw.integers(0, 3, 70)]
    df = spark.createDataFrame([(i, c[i], [float(v) for v in x[i]]) for i in range(70)], "id long, c int, x array<double>")
    monkeypatch.setattr(C, "BLOCKS", 3)
    monkeypatch.setattr(C, "AT_ONCE", 50)
    found = {r["id"]: r["silhouette"] for r in C.silhouettes(df, "id", "x", "c", 4).collect()}
    assert [found[i] for i in range(70)] == pytest.approx(plain_silhouettes(x, c), abs=1e-6)


def test_a_failed_model_is_no_result(separable, inputs, tmp_path):
    """The best of the models that are left is not the best model: the target fails, and has no results."""
    folds = stratified_folds(separable, "id", "y", n_splits=2)
    with pytest.raises(RuntimeError, match="unknown"):
        M.cross_validate(folds, "x", "y", "fold", [M.FOREST, "unknown"], QUICK).whole()
    features, labels = inputs
    bad = settings(models=(M.FOREST,), select_in_folds=False, overrides={"half": {"models": (M.FOREST, "unknown")}})
    report = R.run_screening(features, labels, NAMES, str(tmp_path / "run"), bad, ["y", "half"])
    assert report.finished == ["y"] and "unknown" in report.failed["half"]


def test_a_failed_target_is_no_result(spark, inputs, tmp_path):
    """The overview of a run with failed targets is an error; results of theirs from earlier runs are not taken for new ones."""
    features, labels = inputs
    folder = str(tmp_path / "run")
    good = settings(models=(M.FOREST,), select_in_folds=False, resume=False)
    assert R.run_screening(features, labels, NAMES, folder, good, ["half"]).overview.count() == 1
    bad = R.replace(good, overrides={"half": {"models": ("unknown",)}})
    report = R.run_screening(features, labels, NAMES, folder, bad, ["y", "half"])
    with pytest.raises(RuntimeError, match="half"):
        report.overview
    assert [r["target"] for r in report.summary.collect()] == ["y"]
    listed = spark.read.option("header", True).csv(f"{folder}/failures").collect()
    assert [r["target"] for r in listed] == ["half"] and "unknown" in listed[0]["reason"]


@pytest.mark.parametrize("name", ["screening_overview", "model_descriptions", "stored_run_scores"])
def test_queries_of_runs_end_with_failed_targets(spark, monkeypatch, name):
    from screenspark.queries import modelling as Q

    own = spark.createDataFrame([(1, [0.5], 1, 0)], "vec_id long, x array<double>, is_0 int, is_1 int")
    monkeypatch.setattr(Q, "labelled_vectors", lambda spark, sf_dir: own)
    monkeypatch.setattr(Q, "CLASSES", (0, 1))
    monkeypatch.setattr(R, "run_screening", lambda *a, **b: R.RunReport(spark.range(1), ["is_1"], {"is_0": "lost"}))
    with pytest.raises(RuntimeError, match="is_0"):
        getattr(Q, name)(spark, "unread")


def test_selections_of_all_folds_come_from_the_same_passes(separable, monkeypatch):
    from screenspark.operators import select as S

    wide = F.concat("x", F.array(F.get("x", F.lit(1)) * 2 + 1, F.lit(3.0)))  # a copy and a constant
    folds = stratified_folds(separable.withColumn("x", wide), "id", "y", n_splits=3)
    names = ["a", "b", "c", "d", "b2", "one"]
    own = SelectionSettings(univariate_k=3, model_top_n=2, importance_trees=5)
    expected = {f: S.fit_selection(folds if f is None else folds.where(F.col("fold") != f), "x", "y", names, own) for f in (None, 0, 1, 2)}
    asked = []
    plain = S.correlation_rows
    monkeypatch.setattr(S, "correlation_rows", lambda *a, **b: asked.append(a) or plain(*a, **b))
    found = S.fit_selections(folds, "x", "y", names, "fold", [None, 0, 1, 2], own)
    assert len(asked) == 1 and list(found) == [None, 0, 1, 2]
    for f, chosen in found.items():
        assert chosen.names == expected[f].names and chosen.places == expected[f].places
        assert [h[:3] for h in chosen.history] == [h[:3] for h in expected[f].history]
        assert [h[3] for h in chosen.history if h[3] is not None] == pytest.approx([h[3] for h in expected[f].history if h[3] is not None])


def test_one_count_of_labels_serves_all_folds(separable):
    folds = stratified_folds(separable, "id", "y", n_splits=2).persist()
    found = [
        {(r["model"], r["fold"], r["metric"]): r["value"] for r in M.cross_validate(folds, "x", "y", "fold", settings=QUICK, **how).rows.collect()}
        for how in ({}, {"prepare": lambda t, f: t}, {"prepare": lambda t, f: t, "same_rows": True, "held": True})
    ]
    assert len(found[0]) == 3 * 2 * 7 and found[0] == pytest.approx(found[1], abs=1e-6) and found[0] == pytest.approx(found[2], abs=1e-6)


def test_lean_fits_equal_plain_ones(separable):
    table = M.training_table(separable, "x", "y", ["id"], {0: 0.75, 1: 1.5})
    for kind in (M.FOREST, M.LOGISTIC, M.BOOSTED):
        plain, lean = (M.fit_model(kind, table, QUICK, only_scores=o) for o in (False, True))
        p, q = ({r["id"]: r["probability"] for r in M.add_probability(m, table).collect()} for m in (plain, lean))
        assert len(p) == 240 and p == pytest.approx(q)


def test_a_run_gives_the_same_results_again(spark, inputs, tmp_path):
    """Forests draw by place, and the places of the rows of a small table are those of their ids."""
    features, labels = inputs
    noise = features.withColumn("features", F.transform(F.slice("features", 2, 3), lambda v: v))
    runs = []
    for k, parts in enumerate((2, 5)):
        folder = str(tmp_path / f"run{k}")
        R.run_screening(noise.repartition(parts), labels, NAMES[1:], folder, settings(models=(M.FOREST,), select_in_folds=False), ["y"])
        runs.append({(r["fold"], r["metric"]): r["value"] for r in readers.read_results(spark, f"{folder}/results").collect()})
    assert len(runs[0]) == 14 and runs[0] == runs[1]


def test_clusterings_of_a_grid_share_the_distances(spark, monkeypatch):
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.normal(size=(40, 2)), draw.normal(5, 1, (30, 2))])
    c = [[0] * 40 + [1] * 30, [int(v) for v in draw.integers(2, 6, 70)], [7] * 70]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], c[0][i], c[1][i], c[2][i]) for i in range(70)], "id long, x array<double>, a int, b int, one int")
    found = {(r["of"], r["id"]): (r["cluster"], r["silhouette"]) for r in C.silhouettes_of_all(df, "id", "x", ["a", "b", "one"], 20).collect()}
    assert len(found) == 210 and all(found[2, i] == (7, None) for i in range(70))
    for k in (0, 1):
        expected = plain_silhouettes(x, c[k])
        assert all(found[k, i][0] == c[k][i] and found[k, i][1] == pytest.approx(expected[i], abs=1e-6) for i in range(70))
    asked = []
    plain = C._distance_sums
    monkeypatch.setattr(C, "_distance_sums", lambda *a: asked.append(a) or plain(*a))
    C.choose_clusters(df, "x", [2, 3, 4], starts=1, id_column="id")
    assert len(asked) == 1
