"""Plain Lloyd clustering of integer vectors: broadcast centroids, exact integer arithmetic.

Each round is one narrow pass over the vectors: a task compares its batches with the centroids (K rows of a
fixed length, in the closure), and gives back one row of integer sums for each cluster it met. Those rows,
at most K for each partition, meet in a ``groupBy``; the driver sees K sums and nothing that grows with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch

K, DIM, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
#: Components are held within this bound, so that a squared distance fits 64 bits: 64 * (2 * EDGE)^2 = 2^62.
EDGE = 1 << 27
LARGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of exactly ``dim`` components, none null or non-finite, as integers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    sound = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.lit(float(-EDGE)), F.least(F.lit(float(EDGE)), e * scale))).cast("long"))
    return vectors.filter(F.size("embedding") == dim).filter(F.forall(x, sound)).select("vec_id", whole.alias("v"))


def first_centroids(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order; a top-k, so k rows reach the driver."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = points.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64) if rows else np.empty((0, 0), dtype=np.int64)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the nearest centroids and the squared distances; of equal ones the smaller number."""
    far = np.empty((len(x), len(centroids)), dtype=np.int64)
    for c, centroid in enumerate(centroids):
        gap = x - centroid
        far[:, c] = np.einsum("ij,ij->i", gap, gap)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).reshape(-1, dim) if len(column) else np.empty((0, dim), dtype=np.int64)


def cluster_sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums): the number and the componentwise sums of the vectors nearest to each centroid."""
    k, dim = centroids.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch["v"], dim)
            best, _ = _nearest(x, centroids)
            n += np.bincount(best, minlength=k)
            for c in np.unique(best):
                total[c] += x[best == c].sum(axis=0)
        met = np.flatnonzero(n)
        if len(met):
            yield pd.DataFrame({"cluster": met.astype("int32"), "n": n[met], "sums": list(total[met])})

    parts = points.select("v").mapInPandas(partial, "cluster int, n long, sums array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    return merged.select("cluster", "n", F.array(*[f"s{i}" for i in range(dim)]).alias("sums"))


def lloyd(points: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds: exact floors of the means; an empty cluster's centroid stays."""
    for _ in range(rounds):
        moved = centroids.copy()
        for r in cluster_sums(points, centroids).collect():  # at most K rows
            moved[r.cluster] = [s // r.n for s in r.sums]
        centroids = moved
    return centroids


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector, by its nearest centroid."""
    dim = centroids.shape[1]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, distance = _nearest(_matrix(batch["v"], dim), centroids)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": best.astype("int32"), "distance": distance})

    return points.mapInPandas(nearest, f"vec_id {points.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(spark: SparkSession, vectors: DataFrame, k: int = K, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors`` (vec_id, embedding).

    Kept are rows with exactly ``dim`` components, none null or non-finite; null, shorter and longer vectors give no row.
    Repeated rows are vectors of their own, a null vec_id counts as empty text in the hash, and ties of the hash go by the
    vector. With fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives no row. Components
    beyond 2^27 are held at that bound, and inertias at 2^63 - 1. Other columns are not read.
    """
    points = quantised(vectors, dim, scale)
    start = first_centroids(points, k, seed)
    kind = points.schema["vec_id"].dataType.simpleString()
    if not len(start):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = lloyd(points, start, rounds)
    scratch = Scratch(spark, "kmeans")
    found = scratch.cut(assigned(points, centroids), "assigned")  # computed once, for the rows and for the inertias
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # at most K rows
    every = min(sum(sums.values()), LARGEST)
    facts = [(c, min(d, LARGEST), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(rounds: int) -> str:
    """The rounds as common table expressions: a{r} assigns by the centroids c{r}, which c{r + 1} replaces."""
    text = ""
    for r in range(rounds + 1):
        far = f"list_sum(list_transform(list_zip(p.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        text += f""",
a{r} AS (SELECT row, vec_id, v, best.cluster AS cluster, CAST(best.d AS BIGINT) AS distance FROM (
      SELECT p.row, any_value(p.vec_id) AS vec_id, any_value(p.v) AS v, arg_min({{'cluster': cluster, 'd': {far}}}, {{'d': {far}, 'cluster': cluster}}) AS best FROM p, c{r} GROUP BY p.row))"""
        if r < rounds:
            text += f""",
m{r} AS (SELECT cluster, list(f ORDER BY i) AS v FROM (SELECT cluster, i, CAST(floor_div AS BIGINT) AS f FROM (
      SELECT cluster, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, {DIM + 1})) u(i) GROUP BY ALL))) GROUP BY 1),
c{r + 1} AS (SELECT c{r}.cluster, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c{r}.cluster)"""
    return text


OP11_SQL = f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {DIM}),
k AS (SELECT vec_id, e FROM q WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
p AS (SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda x: CAST(floor(greatest(-{EDGE}.0::DOUBLE, least({EDGE}.0::DOUBLE, x * {SCALE}))) AS BIGINT)) AS v FROM k),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM p) ORDER BY h, v LIMIT {K}){_rounds(ROUNDS)},
s AS (SELECT cluster, sum(distance) AS d FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(least(s.d, {LARGEST}) AS BIGINT) AS cluster_inertia, CAST(least((SELECT sum(d) FROM s), {LARGEST}) AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN s ON s.cluster = a.cluster JOIN c{ROUNDS} c ON c.cluster = a.cluster
"""
