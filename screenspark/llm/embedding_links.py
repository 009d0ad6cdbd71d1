"""Near-duplicate vectors by Euclidean p-stable hashing, followed by exact cosine checks.

Vectors of one label are normalised, so a cosine of c is a Euclidean distance of sqrt(2 - 2c). Each of TABLES tables
projects them on PROJECTIONS random Gaussian directions, shifts and cuts the line into cells of WIDTH, and vectors with
equal cells in all directions of a table share its bucket. At the threshold 0.93 (distance 0.374) a projection keeps a
pair together with probability 0.85, a table with 0.20, all tables miss it with probability 0.0008; a pair at 0.97 is
missed with probability 1e-6 and unrelated vectors meet in a table with probability 0.0007.

Equal vectors are collapsed before hashing. Buckets are compared in blocks by matrix products, a block pair is one
group of a few thousand vectors at most, so a bucket of any size spreads over many tasks. Every linked pair is counted
once, in the first table that holds it; only counts and the edges of a spanning forest leave the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenspark.llm.common import sorted_runs
from screenspark.llm.graph import components
from screenspark.session import materialise

THRESHOLD = 0.93
TABLES, PROJECTIONS, WIDTH, SEED = 32, 10, 2.0, 11
#: Vectors of a bucket compared with as many others in one group.
BLOCK = 1024
#: Groups up to this size are compared many at a time, larger ones each by a matrix product.
SMALL = 48


def cell_keys(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(n, tables) bucket keys of normalised vectors; the label is part of the key."""
    draw = np.random.default_rng(SEED)
    directions = draw.standard_normal((unit.shape[1], tables * PROJECTIONS))
    shifts = draw.uniform(0, WIDTH, tables * PROJECTIONS)
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).reshape(len(unit), tables, PROJECTIONS)
    factors = np.random.default_rng(SEED + 1).integers(1, 1 << 62, (tables, PROJECTIONS), dtype=np.int64) | 1
    mixed = (cells * factors).sum(2) + labels[:, None].astype(np.int64) * 0x9E3779B97F4A7C1 + np.arange(tables) * 0x5851F42D4C957F
    return mixed


def _hash_frames(tables: int):
    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, same in frame.groupby(frame["vec"].str.len()):  # vectors of one length share a product
                raw = np.array(same["vec"].tolist(), np.float64)
                top = np.abs(raw).max(1, keepdims=True)
                raw = raw / top  # squares of huge and tiny components stay finite
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                keys = cell_keys(unit, same["label"].to_numpy(), tables) + unit.shape[1]
                yield pd.DataFrame({"node": same["node"], "n": same["n"], "unit": [u.tobytes() for u in unit], "keys": list(keys)})

    return of_frames


def _cosine_at_least(a: np.ndarray, b: np.ndarray, threshold: float, cosines: np.ndarray) -> np.ndarray:
    """Which pairs of rows reach the threshold; close calls are settled by one fixed order of summation."""
    near = cosines >= threshold
    for k in np.flatnonzero(np.abs(cosines - threshold) < 1e-12):
        near[k] = float(np.dot(a[k], b[k])) >= threshold
    return near


def _small_groups(unit: np.ndarray, keys: np.ndarray, t: np.ndarray, group: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (x, y) of rows within groups of adjacent rows: row after row with the first, second, ... row below."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    x = np.arange(len(group))
    for step in range(1, len(group)):
        x = x[x + step < len(group)]
        x = x[group[x] == group[x + step]]
        if not len(x):
            break
        for part in np.array_split(x, -(-len(x) // BLOCK)):
            y = part + step
            near = _cosine_at_least(unit[part], unit[y], threshold, np.einsum("ij,ij->i", unit[part], unit[y]))
            a, b = part[near], y[near]
            met = (keys[a] == keys[b]) & (np.arange(keys.shape[1]) < t[a][:, None])
            first = ~met.any(axis=1)
            xs.append(a[first])
            ys.append(b[first])
    return np.concatenate(xs), np.concatenate(ys)


def _block_pair(unit: np.ndarray, keys: np.ndarray, t: int, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (x, y) of rows a with rows b, each pair once."""
    cosines = unit[a] @ unit[b].T
    x, y = np.nonzero(cosines >= threshold - 1e-12)
    if len(a) == len(b) and (a == b).all():
        x, y = x[x < y], y[x < y]
    near = np.ones(len(x), bool)
    for at in range(0, len(x), BLOCK * 64):
        part = slice(at, at + BLOCK * 64)
        of_x, of_y = a[x[part]], b[y[part]]
        near[part] = _cosine_at_least(unit[of_x], unit[of_y], threshold, cosines[x[part], y[part]])
        for earlier in range(t):
            near[part] &= keys[of_x, earlier] != keys[of_y, earlier]
    return a[x[near]], b[y[near]]


def _compare(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows (node, links, other): partial link counts, and edges to one other member of the forest."""
    key = ["t", "key", "i", "j"]
    for whole in sorted_runs(frames, key):
        for _, frame in whole.groupby(whole["unit"].str.len(), sort=False):  # vectors of one length
            unit = np.frombuffer(b"".join(frame["unit"]), np.float64).reshape(len(frame), -1)
            keys, t = np.stack(frame["keys"].to_list()), frame["t"].to_numpy()
            group = frame.groupby(key, sort=False).ngroup().to_numpy()
            size = np.bincount(group)
            inside = (frame["i"] == frame["j"]).to_numpy()
            small = np.flatnonzero((size[group] <= SMALL) & inside)
            x, y = _small_groups(unit[small], keys[small], t[small], group[small], threshold)
            pairs = [(small[x], small[y])]
            for g in np.unique(group[(size[group] > SMALL) | ~inside]):
                rows = np.flatnonzero(group == g)
                side = frame["side"].to_numpy()[rows]
                a = rows[side == 0]
                pairs.append(_block_pair(unit, keys, int(t[rows[0]]), a, a if inside[rows[0]] else rows[side == 1], threshold))
            x, y = (np.concatenate(p) for p in zip(*pairs))
            if not len(x):
                continue
            nodes, n = frame["node"].to_numpy(), frame["n"].to_numpy()
            links = np.zeros(len(frame), np.int64)
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            some = links > 0
            yield pd.DataFrame({"node": nodes[some], "links": links[some], "other": pd.array([None] * int(some.sum()), "Int64")})
            member, root = _forest(x, y, len(frame))
            yield pd.DataFrame({"node": nodes[member], "links": np.zeros(len(member), np.int64), "other": pd.array(nodes[root], "Int64")})


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) of the components of the pairs (x, y) over 0 .. n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def linked_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
) -> DataFrame:
    """(id, n_links, component): direct links of each row to other rows of its label, and the smallest id reachable.

    Rows are linked if their labels are equal and not NULL and their cosine, in double precision, is at least the
    threshold. Vectors that are NULL, empty, zero or hold NULL or non-finite components, and vectors of different
    length, are not linked. Repeated rows link with each other like any two. A NULL id is never the smallest. Further
    columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vec")
    )
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(F.col("label").isNotNull() & sound, F.col("vec")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one number
    rows = rows.withColumn("h", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    valid = rows.where(F.col("vec").isNotNull())
    distinct = valid.groupBy("h", "label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()))
    hashed = distinct.select("node", "n", "label", "vec").mapInPandas(
        _hash_frames(tables), "node bigint, n bigint, unit binary, keys array<bigint>"
    )
    hashed = materialise(hashed)

    bucket = Window.partitionBy("t", "key")
    member = hashed.select("node", F.posexplode("keys").alias("t", "key")).withColumn("size", F.count(F.lit(1)).over(bucket))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    member = member.where("size > 1").withColumn("blocks", blocks)
    member = member.withColumn("at", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
    # A vector of block p meets blocks 0 .. p as the second and p .. last as the first; inside its own block once.
    as_first = F.transform(F.sequence("at", F.col("blocks") - 1), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_second = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("at")), lambda i: i < F.col("at")),
        lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(1).alias("side")),
    )
    member = member.select("node", "t", "key", F.inline(F.concat(as_first, as_second)))
    groups = member.join(hashed, "node").repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    compared = materialise(
        groups.select("t", "key", "i", "j", "side", "node", "n", "unit", "keys").mapInPandas(
            lambda frames: _compare(frames, threshold), "node bigint, links bigint, other bigint"
        )
    )
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    edges = compared.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = materialise(components(edges))
    told = distinct.join(counts, "node", "left").join(roots, "node", "left")
    told = told.select("h", "label", "vec", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    smallest = told.groupBy("root").agg(F.min("first").alias("component"))
    told = told.join(smallest, "root").select("h", "label", "vec", (F.col("links") + F.col("n") - 1).alias("n_links"), "component")
    linked = valid.join(told, ["h", "label", "vec"]).select("id", "n_links", "component")
    alone = rows.where(F.col("vec").isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)


def vector_components(embeddings: DataFrame) -> DataFrame:
    """Links and component of every vector; the smallest id of each component is kept."""
    found = linked_vectors(embeddings)
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


#: For DuckDB: all pairs of a label, then the closure. Meant for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
smallest AS (SELECT a, min(b) AS least_b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least_b, vec_id)) AS component_id,
  vec_id <= coalesce(least_b, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN smallest ON smallest.a = vec_id
"""
