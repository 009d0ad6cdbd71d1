"""Models, searches, clusters and whole runs. Their numbers have no SQL twin; what must hold of them has."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from screenspark.operators import cluster as C
from screenspark.operators import models as M
from screenspark.operators import select as S
from screenspark.operators.clean import long_labels
from screenspark.operators.many_logistic import fit_many
from screenspark.operators.metrics import evaluate
from screenspark.operators.selection_stage import FeatureSelection
from screenspark.operators.split import stratified_folds
from screenspark.plans import screening as R
from screenspark.queries.fixtures import LONG, known_labels, table
from screenspark.queries.preparing import WIDTH, derived_lines, vectors
from screenspark.queries.profiling import rounded
from screenspark.queries.registry import query
from screenspark.session import materialise, scratch_path

CLASSES = tuple(range(10))
#: Forests and logistic models of the queries run with the default settings. The other kinds and whole runs take
#: minutes a target with theirs, so their queries set fewer trees, rounds and steps.
FULL = M.ModelSettings()
QUICK = M.ModelSettings(
    trees=20,
    depth=6,
    linear_iterations=20,
    rounds=10,
    boosted_depth=4,
    network_iterations=50,
    calibration_folds=3,
)
NAMES = [f"x{i}" for i in range(WIDTH)]


def labelled_vectors(spark, sf_dir):
    """Vectors with one 0/1 target per class number."""
    rows = vectors(spark, sf_dir)
    return rows.select("vec_id", "x", *[(F.col("label") == c).cast("int").alias(f"is_{c}") for c in CLASSES])


def _scores(spark, sf_dir, kind, settings=QUICK):
    rows = labelled_vectors(spark, sf_dir)
    targets = [f"is_{c}" for c in CLASSES]
    fitted = M.train_targets(rows, "x", targets, kind, settings)
    return rounded(M.score_targets(fitted, rows, "x", "vec_id"), "probability")


@query("forest_scores")
def forest_scores(spark, sf_dir):
    return _scores(spark, sf_dir, M.FOREST, FULL)


@query("logistic_scores")
def logistic_scores(spark, sf_dir):
    return _scores(spark, sf_dir, M.LOGISTIC, FULL)


@query("folded_logistic_scores")
def folded_logistic_scores(spark, sf_dir):
    """Ten classes and five folds in one fit; every row is scored by the models that left its fold out."""
    rows = labelled_vectors(spark, sf_dir).withColumn("fold", F.pmod(F.col("vec_id"), F.lit(5)).cast("int"))
    many = fit_many(rows, "x", [f"is_{c}" for c in CLASSES], "fold")
    return rounded(many.score(rows, "x", "vec_id", "fold"), "probability")


@query("calibrated_svm_scores")
def calibrated_svm_scores(spark, sf_dir):
    return _scores(spark, sf_dir, M.SVM)


@query("boosted_scores")
def boosted_scores(spark, sf_dir):
    return _scores(spark, sf_dir, M.BOOSTED)


@query("sampled_boosted_scores")
def sampled_boosted_scores(spark, sf_dir):
    return _scores(spark, sf_dir, M.BOOSTED_SAMPLED)


@query("network_scores")
def network_scores(spark, sf_dir):
    return _scores(spark, sf_dir, M.NETWORK)


@query("voting_scores")
def voting_scores(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir)
    targets = [f"is_{c}" for c in CLASSES]
    by_kind = {kind: M.train_targets(rows, "x", targets, kind, QUICK) for kind in (M.FOREST, M.BOOSTED)}
    return rounded(M.score_voting(by_kind, rows, "x", "vec_id"), "probability")


@query(
    "model_score_checks",
    """WITH t AS (SELECT unnest(range(10)) AS c), m AS (SELECT unnest(['forest', 'logistic']) AS model)
       SELECT model, 'is_' || c AS target, count(*) AS n_rows, true AS within_bounds, true AS tells_classes_apart
       FROM t, m, embeddings GROUP BY model, c""",
)
def model_score_checks(spark, sf_dir):
    """Every row has a probability from every model; on the rows they were trained on, models tell classes apart."""
    rows = labelled_vectors(spark, sf_dir)
    targets = [f"is_{c}" for c in CLASSES]
    truth = long_labels(rows, ["vec_id"], targets)
    told = []
    for name, kind in (("forest", M.FOREST), ("logistic", M.LOGISTIC)):
        scores = M.score_targets(M.train_targets(rows, "x", targets, kind, QUICK), rows, "x", "vec_id")
        told.append(scores.join(truth, ["vec_id", "target"]).withColumn("model", F.lit(name)))
    scored = materialise(told[0].unionByName(told[1]))
    bounds = scored.groupBy("model", "target").agg(
        F.count(F.lit(1)).alias("n_rows"), F.every((F.col("probability") >= 0) & (F.col("probability") <= 1)).alias("within_bounds")
    )
    areas = evaluate(scored, ["model", "target"]).select("model", "target", (F.col("roc_auc") > 0.6).alias("tells_classes_apart"))
    return bounds.join(areas, ["model", "target"])


@query(
    "voting_equals_mean",
    """SELECT 'is_' || c AS target, count(*) AS n_rows, count(*) AS n_equal
       FROM embeddings, (SELECT unnest(range(2)) AS c) GROUP BY c""",
)
def voting_equals_mean(spark, sf_dir):
    """The vote of models is the average of their probabilities."""
    rows = labelled_vectors(spark, sf_dir).drop(*[f"is_{c}" for c in CLASSES[2:]])
    by_kind = {kind: M.train_targets(rows, "x", ["is_0", "is_1"], kind, QUICK) for kind in (M.FOREST, M.LOGISTIC)}
    voted = M.score_voting(by_kind, rows, "x", "vec_id").select("vec_id", "target", F.col("probability").alias("voted"))
    parts = [M.score_targets(fitted, rows, "x", "vec_id").select("vec_id", "target", "probability") for fitted in by_kind.values()]
    mean = parts[0].unionByName(parts[1]).groupBy("vec_id", "target").agg(F.avg("probability").alias("mean"))
    both = voted.join(mean, ["vec_id", "target"])
    equal = F.abs(F.col("voted") - F.col("mean")) < 1e-9
    return both.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(equal).alias("n_equal"))


@query(
    "projection_checks",
    """SELECT count(*) AS n_rows, true AS centred, true AS uncorrelated, true AS first_is_wider FROM embeddings""",
)
def projection_checks(spark, sf_dir):
    """Principal coordinates have mean zero, no correlation, and falling variance."""
    projected, _ = C.project(vectors(spark, sf_dir), "x")
    flat = projected.select(F.get("coordinates", F.lit(0)).alias("a"), F.get("coordinates", F.lit(1)).alias("b"))
    return flat.agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.abs(F.avg("a")) < 1e-6) & (F.abs(F.avg("b")) < 1e-6)).alias("centred"),
        (F.abs(F.corr("a", "b")) < 1e-6).alias("uncorrelated"),
        (F.var_pop("a") >= F.var_pop("b")).alias("first_is_wider"),
    )


@query(
    "cluster_checks",
    """SELECT count(*) AS n_rows, true AS every_row_has_one, true AS scores_within_bounds FROM embeddings""",
)
def cluster_checks(spark, sf_dir):
    """Every row gets a cluster below the chosen number, and silhouettes lie between -1 and 1."""
    projected, chosen = clustered(spark, sf_dir)
    fair = all(-1 <= s <= 1 for _, s in chosen.scores) and chosen.k in dict(chosen.scores)
    return C.assign_clusters(projected, "coordinates", chosen).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.every((F.col("cluster") >= 0) & (F.col("cluster") < chosen.k)).alias("every_row_has_one"),
        F.lit(fair).alias("scores_within_bounds"),
    )


@query("cross_validated_models")
def cross_validated_models(spark, sf_dir):
    rows = stratified_folds(labelled_vectors(spark, sf_dir), "vec_id", "is_0", n_splits=3)
    return rounded(M.cross_validate(rows, "x", "is_0", "fold", settings=QUICK).whole(), "value")


@query("grid_search")
def grid_search(spark, sf_dir):
    rows = stratified_folds(labelled_vectors(spark, sf_dir), "vec_id", "is_0", n_splits=3)
    grid = {"numTrees": [5, 10], "maxDepth": [3, 5]}
    found = M.grid_search(rows, "x", "is_0", "fold", grid=grid, settings=QUICK)
    table_rows = [(p["numTrees"], p["maxDepth"], round(s, 6), p == found.best) for p, s in found.table]
    return spark.createDataFrame(table_rows, "trees int, depth int, roc_auc double, best boolean")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir)
    importance = S.forest_importance(rows, "x", "is_0")
    return rounded(M.importance_rows(rows, importance, NAMES, 20), "importance")


@query("selection_history")
def selection_history(spark, sf_dir):
    lines = derived_lines(spark, sf_dir)
    names = ["quantity", "price", "net", "gross", "discount", "twice", "constant"]
    chosen = S.fit_selection(lines, "x", "label", names, S.SelectionSettings(univariate_k=3, model_top_n=2))
    return rounded(chosen.history_table(lines), "score")


@query("selected_in_pipeline")
def selected_in_pipeline(spark, sf_dir):
    """The selection chain as the first stage of a fitted, saved and reloaded pipeline: places and names that it keeps, and the rows scored."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), price.alias("price"), (price * (1 - discount)).alias("net"), discount.alias("discount"),
        F.col("l_tax").alias("tax"), (F.col("l_linestatus") == "F").cast("int").alias("label"),
    )
    names = ["quantity", "price", "net", "discount", "tax"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(lines)
    stage = FeatureSelection(univariateK=3, modelTopN=2, importanceTrees=20)
    path = scratch_path(spark, "selection-pipeline")
    Pipeline(stages=[stage, LogisticRegression(featuresCol="selected", maxIter=20)]).fit(rows).write().save(path)
    model = PipelineModel.load(path)
    n = model.transform(rows).where(F.col("prediction").isNotNull()).count()
    kept = model.stages[0].getOrDefault("names")
    return spark.createDataFrame([(k, name, n) for k, name in enumerate(kept)], "place int, feature string, n_scored long")


@query("principal_coordinates")
def principal_coordinates(spark, sf_dir):
    projected, _ = C.project(vectors(spark, sf_dir), "x")
    return projected.select(
        "vec_id",
        F.round(F.get("coordinates", F.lit(0)), 6).alias("first"),
        F.round(F.get("coordinates", F.lit(1)), 6).alias("second"),
    )


@query(
    "principal_variances",
    f"""WITH lx AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range({WIDTH}) r(i)),
        c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM lx)
        SELECT i::INT AS idx, round(avg(v * v), 6) AS variance FROM c GROUP BY i""",
)
def principal_variances(spark, sf_dir):
    """Variance of every feature, put together again from all principal axes: their squares weighted by the variances along them."""
    axes, variances = C.principal_axes(vectors(spark, sf_dir), "x", WIDTH)
    total = (np.array(axes) ** 2 * np.array(variances)[:, None]).sum(axis=0)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(total)], "idx int, variance double")


#: Cluster numbers that are tried: those of a table of 2,500 rows and more.
GRID = C.cluster_grid(2_500)


def clustered(spark, sf_dir):
    projected, _ = C.project(vectors(spark, sf_dir), "x")
    projected = materialise(projected.select("vec_id", "coordinates", "label"))
    return projected, C.choose_clusters(projected, "coordinates", GRID, starts=3)


@query(
    "silhouette_of_labels",
    """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
       d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)) / count(*) AS far
         FROM x a JOIN x b ON a.vec_id <> b.vec_id GROUP BY ALL),
       m AS (SELECT vec_id, own, max(far) FILTER (WHERE other = own) AS a, min(far) FILTER (WHERE other <> own) AS b FROM d GROUP BY ALL)
       SELECT vec_id, own AS label, round(CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM m""",
)
def silhouette_of_labels(spark, sf_dir):
    """Plain Euclidean silhouette of every vector within its label."""
    return rounded(C.silhouettes(vectors(spark, sf_dir), "vec_id", "x", "label"), "silhouette", digits=5)


@query("class_cluster_choice")
def class_cluster_choice(spark, sf_dir):
    """Cluster numbers 2 to 10 within label 0 and outside it, by the Euclidean silhouette."""
    projected = materialise(C.project(vectors(spark, sf_dir), "x")[0].select("vec_id", "coordinates", (F.col("label") == 0).cast("int").alias("is_0")))
    rows = []
    for label in (0, 1):
        part = projected.where(F.col("is_0") == label)
        chosen = C.choose_clusters(part, "coordinates", C.class_cluster_grid(part.count()), starts=1, id_column="vec_id")
        rows += [(label, k, round(s, 6), k == chosen.k) for k, s in chosen.scores]
    return spark.createDataFrame(rows, "is_0 int, k int, silhouette double, chosen boolean")


@query("cluster_choice")
def cluster_choice(spark, sf_dir):
    _, chosen = clustered(spark, sf_dir)
    rows = [(k, round(s, 6), k == chosen.k) for k, s in chosen.scores]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


@query("targets_by_found_cluster")
def targets_by_found_cluster(spark, sf_dir):
    projected, chosen = clustered(spark, sf_dir)
    entities = C.assign_clusters(projected, "coordinates", chosen)
    labels = entities.select("vec_id", *[(F.col("label") == c).cast("int").alias(f"is_{c}") for c in CLASSES])
    long = long_labels(labels, ["vec_id"], [f"is_{c}" for c in CLASSES])
    return rounded(C.targets_by_cluster(entities, long, "vec_id"), "positive_ratio")


def given_clusters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.pmod("n_chars", F.lit(7)).cast("int").alias("cluster"))


@query(
    "cluster_sizes",
    """SELECT (n_chars % 7)::INT AS cluster, count(*) AS cluster_size,
         round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS cluster_pct FROM documents GROUP BY 1""",
)
def cluster_sizes(spark, sf_dir):
    return rounded(C.cluster_sizes(given_clusters(spark, sf_dir)), "cluster_pct")


_BY_CLUSTER = f"""WITH {LONG}, c AS (SELECT doc_id, (n_chars % 7)::INT AS cluster FROM documents),
  s AS (SELECT cluster, count(*) AS cluster_size FROM c GROUP BY cluster),
  t AS (SELECT cluster, target, count(*) FILTER (label = 1) AS positive_count, count(*) AS total_count, cluster_size,
    count(*) FILTER (label = 1) / count(*)::DOUBLE AS positive_ratio
    FROM long JOIN c USING (doc_id) JOIN s USING (cluster) GROUP BY cluster, target, cluster_size)"""


@query(
    "targets_by_cluster",
    _BY_CLUSTER + " SELECT * REPLACE (round(positive_ratio, 6) AS positive_ratio) FROM t",
)
def targets_by_cluster(spark, sf_dir):
    out = C.targets_by_cluster(given_clusters(spark, sf_dir), known_labels(spark, sf_dir), "doc_id")
    return rounded(out, "positive_ratio")


@query(
    "top_cluster_by_target",
    _BY_CLUSTER
    + """ SELECT target, cluster, round(positive_ratio, 6) AS positive_ratio, positive_count, total_count FROM t
       QUALIFY row_number() OVER (PARTITION BY target ORDER BY t.positive_ratio DESC, cluster) = 1""",
)
def top_cluster_by_target(spark, sf_dir):
    by_cluster = C.targets_by_cluster(given_clusters(spark, sf_dir), known_labels(spark, sf_dir), "doc_id")
    return rounded(C.top_cluster_by_target(by_cluster), "positive_ratio")


QUICK_RUN = R.ScreeningSettings(
    cv_folds=3,
    models=(M.FOREST, M.LOGISTIC),
    selection=S.SelectionSettings(univariate_k=20, model_top_n=10, importance_trees=10),
    model=QUICK,
    variance_limit=0.0,
)


def _run(spark, sf_dir, folder):
    """The features and the overview of a run; an error if a target or one of its models failed."""
    rows = labelled_vectors(spark, sf_dir)
    features = rows.select(F.col("vec_id").alias(R.ID), F.col("x").alias(R.X))
    labels = long_labels(rows.withColumnRenamed("vec_id", R.ID), [R.ID], [f"is_{c}" for c in CLASSES])
    report = R.run_screening(features, labels, NAMES, folder, QUICK_RUN)
    return features, report.overview


@query("screening_overview")
def screening_overview(spark, sf_dir):
    _, overview = _run(spark, sf_dir, scratch_path(spark, "run"))
    return rounded(overview, "roc_auc_mean", "pr_auc_mean")


@query("model_descriptions")
def model_descriptions(spark, sf_dir):
    folder = scratch_path(spark, "run")
    _run(spark, sf_dir, folder)
    return R.model_info(spark, folder).select(
        "target",
        F.get_json_object("document", "$.performance.best_model").alias("best_model"),
        F.get_json_object("document", "$.selected_features_count").cast("int").alias("n_features"),
        F.get_json_object("document", "$.training_config.cv_folds").cast("int").alias("cv_folds"),
    )


@query("stored_run_scores")
def stored_run_scores(spark, sf_dir):
    folder = scratch_path(spark, "run")
    features, _ = _run(spark, sf_dir, folder)
    return rounded(R.score_run(features, NAMES, folder), "probability")
