"""Two-dimensional projection, k-means with a choice of k, and target shares by cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.scalars import ratio
from screenspark.operators.prep import Moments, doubles, fit_moments, numbers
from screenspark.operators.select import row_slices
from screenspark.session import materialise

# Seed, grid of cluster numbers and its upper limits.
SEED = 42
GRID_STEP = 5
GRID_LIMIT = 25
ROWS_PER_CLUSTER = 100
CLASS_GRID_LIMIT = 10
CLASS_ROWS_PER_CLUSTER = 10
# Starts per k and steps of each.
STARTS = 10
STEPS = 300
#: Rows of a block of the silhouettes, at least, and blocks at most: every row moves once per block, so what moves grows with
#: the rows alone. Distances that a task holds at a time.
BLOCK, BLOCKS, AT_ONCE = 1024, 48, 1 << 20
#: Features from which on axes are found without the covariance matrix, and passes over the rows at most.
WIDE, PASSES = 1000, 40


@dataclass(frozen=True)
class Projection:
    components: list[list[float]]
    explained: list[float]


def project(df: DataFrame, features: str, k: int = 2, out: str = "coordinates") -> tuple[DataFrame, Projection]:
    """Add the k leading principal coordinates of centred features, with the explained variance shares.

    Up to WIDE features through the covariance matrix, which the driver holds; wider ones through ``principal_axes``.
    """
    moments = fit_moments(df, features)
    if len(moments.mean) > WIDE:
        axes, variances = principal_axes(df, features, k, moments)
        centred = F.zip_with(doubles(features), constant(moments.mean), lambda x, m: x - m)
        along = [F.aggregate(F.zip_with("_centred", constant(axis), lambda x, a: x * a), F.lit(0.0), lambda t, v: t + v) for axis in axes]
        projected = df.withColumn("_centred", centred).withColumn(out, F.array(*along)).drop("_centred")
        total = sum(moments.variance)
        return projected, Projection(axes, [v / total if total else 0.0 for v in variances])
    centred = F.zip_with(doubles(features), numbers(moments.mean), lambda x, m: x - m)
    vectors = df.withColumn("_centred", array_to_vector(centred))
    model = PCA(k=k, inputCol="_centred", outputCol="_pca").fit(vectors)
    projected = model.transform(vectors).withColumn(out, vector_to_array("_pca")).drop("_centred", "_pca")
    components = model.pc.toArray().T.tolist()
    return projected, Projection(components, model.explainedVariance.toArray().tolist())


def constant(values: Sequence[float]) -> Column:
    """Many numbers as one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _covariance_times(df: DataFrame, features: str, mean: np.ndarray, count: int, block: np.ndarray) -> np.ndarray:
    """Population covariance matrix times a block of columns, without the matrix: tasks add x (x . block) over their rows."""
    width = len(mean)

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rest, some = np.zeros(block.shape), np.zeros(0), False
        for frame in frames:
            flat = np.concatenate([rest, *frame["v"]])
            whole = len(flat) // width * width
            rest = flat[whole:]
            rows = flat[:whole].reshape(-1, width) - mean
            total += rows.T @ (rows @ block)
            some = some or len(rows) > 0
        if some:
            yield pd.DataFrame({"place": np.arange(width), "v": list(total)})

    parts = row_slices(df, features, width).mapInPandas(of_frames, "place int, v array<double>")
    added = parts.groupBy("place").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    out = np.zeros(block.shape)
    for r in added.select("place", vector_to_array("v").alias("v")).collect():  # as many numbers as the block has
        out[r["place"]] = r["v"]
    return out / count


def principal_axes(df: DataFrame, features: str, k: int, moments: Moments | None = None, tolerance: float = 1e-7) -> tuple[list[list[float]], list[float]]:
    """The k leading axes of centred features and the variances along them, by a block Krylov space.

    A block of k + 8 random directions is multiplied by the covariance matrix, one pass over the rows each time; the blocks
    so far are kept orthogonal, and the best axes within them are found on the driver, which holds width x (k + 8) numbers
    per pass. It ends when the residuals of the axes are below ``tolerance`` of the largest variance (the variances are then right to about
    its square), or when the blocks span everything or PASSES passes are over. The entry of an axis that is largest in size is positive.
    """
    moments = moments or fit_moments(df, features)
    mean = np.array(moments.mean)
    width = len(mean)
    k = min(k, width)
    draw = np.random.default_rng(SEED)
    block = np.linalg.qr(draw.normal(size=(width, min(width, k + 8))))[0]
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(PASSES):
        image = _covariance_times(df, features, mean, moments.count, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:k]
        axes, values = basis @ vectors[:, best], values[best]
        residual = np.linalg.norm(images @ vectors[:, best] - axes * values, axis=0)
        if residual.max() <= tolerance * max(values.max(), 1e-300) or basis.shape[1] >= width:
            break
        # The next directions: what the images add to the blocks so far; twice, against rounding.
        image = image - basis @ (basis.T @ image)
        image = image - basis @ (basis.T @ image)
        left, sizes, _ = np.linalg.svd(image, full_matrices=False)
        block = left[:, sizes > 1e-10 * max(sizes.max(), 1e-300)][:, : width - basis.shape[1]]
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            break
        block = np.linalg.qr(block)[0]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return axes.T.tolist(), values.tolist()


def cluster_grid(n_rows: int) -> list[int]:
    return list(range(GRID_STEP, min(GRID_LIMIT, n_rows // ROWS_PER_CLUSTER) + 1, GRID_STEP))


def class_cluster_grid(n_rows: int) -> list[int]:
    if n_rows < CLASS_ROWS_PER_CLUSTER:
        return []
    return list(range(2, min(CLASS_GRID_LIMIT, n_rows // CLASS_ROWS_PER_CLUSTER) + 1))


@dataclass(frozen=True)
class Clustering:
    model: KMeansModel | None
    k: int
    scores: list[tuple[int, float]]


def _fit_clusters(vectors: DataFrame, k: int, seed: int, starts: int) -> KMeansModel:
    """The start with the smallest sum of squared distances."""
    models = [
        KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster", maxIter=STEPS).fit(vectors)
        for i in range(starts)
    ]
    return min(models, key=lambda m: m.summary.trainingCost)


def _distance_sums(rows: DataFrame, kind: str, offsets: Sequence[int], width: int, n: int, block: int) -> DataFrame:
    """``(_id, _k, _sums)``: the distances of every row to all others, summed by cluster, for several clusterings at once.

    ``rows`` has ``_id``, the features ``_x`` and ``_k``, the place of the row's cluster in each clustering. The sums of a clustering
    begin at its offset among ``width`` sums. Distances, which all clusterings share, are taken once.
    """
    blocks = min(-(-n // block), BLOCKS)
    own = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    placed = rows.select("_id", "_k", "_x", own.alias("_at"))
    # A row of block p is the first of the pairs p .. last and the second of the pairs 0 .. p - 1.
    as_first = F.transform(F.sequence("_at", F.lit(blocks - 1)), lambda j: F.struct(F.col("_at").alias("_i"), j.alias("_j")))
    earlier = F.filter(F.sequence(F.lit(0), F.col("_at")), lambda i: i < F.col("_at"))
    as_second = F.transform(earlier, lambda i: F.struct(i.alias("_i"), F.col("_at").alias("_j")))
    dealt = placed.select("_id", "_k", "_x", "_at", F.inline(F.concat(as_first, as_second)))

    def hot(side: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(side), width))
        for offset, places in zip(offsets, np.stack(side["_k"].to_list()).T):
            out[np.arange(len(side)), offset + places] = 1
        return out

    def added(pair: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pair["_i"].iloc[0]), int(pair["_j"].iloc[0])
        a, b = pair[pair["_at"] == i], pair[pair["_at"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"_id": pair["_id"].iloc[:0], "_k": pair["_k"].iloc[:0], "_sums": []})
        x, y = np.stack(a["_x"].to_list()), np.stack(b["_x"].to_list())
        centre = y.mean(axis=0)
        x, y = x - centre, y - centre
        of_a, of_b = hot(a), hot(b)
        length, sums_a, sums_b = (y * y).sum(axis=1), np.zeros(of_a.shape), np.zeros(of_b.shape)
        step = max(1, AT_ONCE // len(y))
        for start in range(0, len(x), step):
            part = slice(start, start + step)
            apart = (x[part] * x[part]).sum(axis=1)[:, None] + length[None, :]
            apart -= 2 * x[part] @ y.T
            np.sqrt(np.maximum(apart, 0, out=apart), out=apart)
            if i == j:
                np.fill_diagonal(apart[:, start:], 0)
            sums_a[part] = apart @ of_b
            if i != j:
                sums_b += apart.T @ of_a[part]
        out = [(a, sums_a)]
        if i != j:
            out.append((b, sums_b))
        return pd.concat([pd.DataFrame({"_id": of["_id"].to_numpy(), "_k": list(of["_k"]), "_sums": list(sums)}) for of, sums in out])

    parts = dealt.groupBy("_i", "_j").applyInPandas(added, f"_id {kind}, _k array<int>, _sums array<double>")
    return parts.groupBy("_id", "_k").agg(vector_to_array(Summarizer.sum(array_to_vector("_sums"))).alias("_sums"))


def silhouettes_of_all(df: DataFrame, id_column: str, features: str, clusters: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``(id, of, cluster, silhouette)`` for several clusterings of the same rows; ``of`` is the place of the clustering.

    All pairs are compared once, whatever the number of clusterings. Clusters of one type; rows without features or one of the
    clusters are left out.
    """
    known = F.col(features).isNotNull()
    for c in clusters:
        known = known & F.col(c).isNotNull()
    rows = df.where(known)
    kind = df.schema[id_column].dataType.simpleString()
    named = F.array(*[F.col(c) for c in clusters])
    # One row per cluster.
    counted = rows.select(F.posexplode(named).alias("of", "c")).groupBy("of", "c").agg(F.count(F.lit(1)).alias("n")).orderBy("of", "c").collect()
    sizes = [[(r["c"], r["n"]) for r in counted if r["of"] == k] for k in range(len(clusters))]
    offsets = np.cumsum([0, *[len(s) for s in sizes]]).tolist()
    n = sum(m for _, m in sizes[0])
    names = [F.array(*[F.lit(c) for c, _ in s]) for s in sizes]
    if not n or all(len(s) < 2 for s in sizes):
        alone = rows.select(F.col(id_column), F.posexplode(named).alias("of", "cluster"))
        return alone.withColumn("silhouette", F.lit(None).cast("double"))
    places = F.array(*[(F.array_position(own, F.col(c)) - 1).cast("int") for own, c in zip(names, clusters)])
    placed = rows.select(F.col(id_column).alias("_id"), places.alias("_k"), doubles(features).alias("_x"))
    summed = _distance_sums(placed, kind, offsets[:-1], offsets[-1], n, block)
    each = [
        F.struct(F.lit(k).alias("_of"), F.get("_k", F.lit(k)).alias("_place"), F.slice("_sums", offsets[k] + 1, len(s)).alias("_part"))
        for k, s in enumerate(sizes)
    ]
    flat = summed.select("_id", F.inline(F.array(*each)))
    total = flat.groupBy("_id", "_of", "_place").agg(vector_to_array(Summarizer.sum(array_to_vector("_part"))).alias("_sums"))
    counts = F.get(F.array(*[F.array(*[F.lit(float(m)) for _, m in s]) for s in sizes]), F.col("_of"))
    mine = F.get(counts, F.col("_place"))
    means = F.transform("_sums", lambda s, k: F.when(k != F.col("_place"), s / F.get(counts, k)))
    told = total.withColumns({"_own": F.get("_sums", F.col("_place")) / F.nullif(mine - 1, F.lit(0.0)), "_next": F.array_min(means)})
    most = F.greatest("_own", "_next")
    value = F.when(mine == 1, 0.0).when(most == 0, 0.0).otherwise((F.col("_next") - F.col("_own")) / F.nullif(most, F.lit(0.0)))
    value = F.when(F.size("_sums") > 1, value)  # a single cluster has no silhouette
    cluster = F.get(F.get(F.array(*names), F.col("_of")), F.col("_place"))
    return told.select(F.col("_id").alias(id_column), F.col("_of").alias("of"), cluster.alias("cluster"), value.alias("silhouette"))


def silhouettes(df: DataFrame, id_column: str, features: str, cluster: str, block: int = BLOCK) -> DataFrame:
    """``(id, cluster, silhouette)`` by plain Euclidean distance, exact.

    The mean distance of a row to every cluster needs all pairs: rows are cut into BLOCKS blocks at most, a task takes the distances of two
    blocks and returns their sums per row and cluster, and the sums of a row are added. A row alone in its cluster has 0;
    with a single cluster all have NULL. Rows without features or a cluster are left out. Ids are distinct.
    """
    found = silhouettes_of_all(df, id_column, features, [cluster], block)
    return found.select(id_column, F.col("cluster").alias(cluster), "silhouette")


def choose_clusters(
    df: DataFrame, features: str, grid: Sequence[int], seed: int = SEED, starts: int = STARTS, id_column: str | None = None
) -> Clustering:
    """K-means for every k of the grid; the best silhouette wins, the smaller k on a tie.

    The silhouette is the squared-Euclidean one, whose work is linear in the rows; with ``id_column`` it is the plain Euclidean
    one of ``silhouettes``, which compares all pairs, once for all k. An empty grid means one cluster.
    """
    if id_column is not None:
        rows = materialise(df.select(id_column, features))
        vectors = rows.select(array_to_vector(doubles(features)).alias("features"))
        models = [_fit_clusters(vectors, k, seed, starts) for k in grid]
        if not models:
            return Clustering(None, 1, [])
        assigned = rows
        for place, model in enumerate(models):
            assigned = assign_clusters(assigned, features, Clustering(model, 0, [])).withColumnRenamed("cluster", f"_cluster{place}")
        found = silhouettes_of_all(materialise(assigned), id_column, features, [f"_cluster{k}" for k in range(len(models))])
        mean = {r["of"]: r["s"] or 0.0 for r in found.groupBy("of").agg(F.avg("silhouette").alias("s")).collect()}
        fitted = [(k, mean.get(place, 0.0), model) for place, (k, model) in enumerate(zip(grid, models))]
        best = max(fitted, key=lambda f: (f[1], -f[0]))
        return Clustering(best[2], best[0], [(k, s) for k, s, _ in fitted])
    vectors = df.select(array_to_vector(doubles(features)).alias("features")).persist()
    try:
        fitted = []
        for k in grid:
            model = _fit_clusters(vectors, k, seed, starts)
            evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
            score = evaluator.evaluate(model.transform(vectors))
            fitted.append((k, score, model))
    finally:
        vectors.unpersist()
    if not fitted:
        return Clustering(None, 1, [])
    best = max(fitted, key=lambda f: (f[1], -f[0]))
    return Clustering(best[2], best[0], [(k, s) for k, s, _ in fitted])


def assign_clusters(df: DataFrame, features: str, clustering: Clustering) -> DataFrame:
    if clustering.model is None:
        return df.withColumn("cluster", F.lit(0))
    vectors = df.withColumn("features_", array_to_vector(doubles(features)))
    model = clustering.model.copy()
    model.setFeaturesCol("features_")
    return model.transform(vectors).drop("features_")


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows and percentage per cluster."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    total = F.sum("cluster_size").over(Window.partitionBy())  # one row per cluster
    return sizes.select(cluster, "cluster_size", (ratio(F.col("cluster_size"), total) * 100).alias("cluster_pct"))


def targets_by_cluster(entities: DataFrame, labels: DataFrame, id_column: str, cluster: str = "cluster") -> DataFrame:
    """Positives, known labels and positive share per cluster and target, with the size of the whole cluster."""
    sizes = entities.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    counts = (
        labels.where(F.col("label").isNotNull())
        .join(entities.select(id_column, cluster), id_column)
        .groupBy(cluster, "target")
        .agg(F.count_if(F.col("label") == 1).alias("positive_count"), F.count(F.lit(1)).alias("total_count"))
    )
    return counts.join(sizes, cluster).withColumn(
        "positive_ratio", ratio(F.col("positive_count"), F.col("total_count"))
    )


def top_cluster_by_target(by_cluster: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The cluster with the highest positive share per target; the lower cluster number on a tie."""
    order = F.struct(F.col("positive_ratio"), -F.col(cluster))
    return by_cluster.groupBy("target").agg(
        F.max_by(F.struct(cluster, "positive_ratio", "positive_count", "total_count"), order).alias("top")
    ).select("target", "top.*")
