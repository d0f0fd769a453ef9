"""Centroid clustering of integer vectors, with bounds loosened by the geometry of the centroids' moves.

Vectors are floor(scale * component); centroids start as the vectors whose salted ids have the least hashes.  A round assigns
every vector to its nearest centroid, of equal ones the first, and replaces each centroid that has vectors by the
floors of their mean components.  All decisions are on integers.

A vector carries a lower bound on its distance to every centroid but its own.  When centroid p moves to p', the
distance of x to it falls by (|x - p|^2 - |x - p'|^2) / (|x - p| + |x - p'|).  With m the middle of the move, d its length and z its
direction, that is 2 d (x - m).z / (|x - p| + |x - p'|), which is at most d cos(x - m, z), as |x - p| + |x - p'| >= 2 |x - m|.
The vectors of a cluster lie in a sphere around their centroid c, whose radius R is measured.  In the plane through
c and the move the sphere is seen from m under the half angle asin(R / |c - m|), so no vector of the cluster has a smaller angle
to z than angle(c - m, z) less that half angle; bounds are loosened by d times its cosine, at most by d, and by nothing
where the whole sphere lies behind.  A vector whose exact distance to its own moved centroid is still below its bound
stays; all others are compared with all centroids exactly.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; null ids never
start a cluster, but are assigned (where no vector has an id there is no result); of repeated ids each row is a vector, and starting vectors with equal ids are taken in
the order of their components; fewer vectors than centroids give as many clusters; components of 2^27 or more in
magnitude raise, as squared distances would not fit a long; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, shared_dir, small_batches

CLUSTERS, ROUNDS, DIMS, SCALE, SALT = 16, 3, 64, 64, "1:"
LIMIT = 2**27
#: What rounding in double precision may take from a bound, as a share and as a distance.
SHARE, ABSOLUTE = 1e-9, 1e-6


def integers(v: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of the components; null for vectors that are left out."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = lambda x: F.when(F.abs(x) < LIMIT, F.floor(x)).otherwise(F.raise_error(F.lit("a vector's component is too large")))
    made = F.transform(v, lambda x: fits(x.cast("double") * scale).cast("int"))
    return F.when(F.coalesce((F.size(v) == dims) & finite, F.lit(False)), made)


def drops(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the bound of each cluster's vectors is to be loosened when centroids move from ``old`` to ``new``."""
    k = len(old)
    out = np.zeros(k)
    for j in range(k):
        move = new[j] - old[j]
        d = float(np.sqrt(move @ move))
        if d == 0:
            continue
        away = old - (old[j] + new[j]) / 2  # from the middle of the move to the centres of the spheres
        far = np.sqrt((away * away).sum(axis=1))
        along = away @ move / d
        across = np.sqrt(np.maximum(far * far - along * along, 0))
        outside = far > radius * (1 + SHARE) + ABSOLUTE
        r, f = radius[outside], far[outside]
        sine, cosine = r / f, np.sqrt(np.maximum(1 - (r / f) ** 2, 0))  # of the half angle of the sphere
        ahead = np.full(k, 1.0)
        # the cosine of (angle to the centre - half angle), or 1 where the move points into the sphere
        ahead[outside] = np.where(along[outside] >= f * cosine, 1.0, np.clip((along[outside] * cosine + across[outside] * sine) / f, 0, 1))
        loose = d * np.minimum(ahead + SHARE, 1) + ABSOLUTE
        loose[j] = 0  # its own vectors have exact distances to it
        out = np.maximum(out, loose)
    return out


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if v.shape[1] * max(int(np.abs(v).max(initial=0)), 1) * max(int(np.abs(c).max(initial=0)), 1) < 2**52:
        dot = (v.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        dot = v @ c.T
    return (v * v).sum(axis=1)[:, None] - 2 * dot + (c * c).sum(axis=1)


def assigned(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None, loose: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters, lower bounds, squared distances and how many vectors were compared with all centroids."""
    if cluster is None:
        cluster, lower, distance = np.zeros(len(v), dtype=np.int64), np.zeros(len(v)), np.zeros(len(v), dtype=np.int64)
        look = np.arange(len(v))
    else:
        away = v - centroids[cluster]
        distance = (away * away).sum(axis=1)
        lower = np.maximum(lower - loose[cluster], 0)
        look = np.flatnonzero(np.sqrt(distance) >= lower * (1 - SHARE) - ABSOLUTE)
    if len(look):
        found = squared(v[look], centroids)
        best = found.argmin(axis=1)
        at = np.arange(len(look))
        cluster, lower, distance = cluster.copy(), lower.copy(), distance.copy()
        cluster[look], distance[look] = best, found[at, best]
        found[at, best] = np.iinfo(np.int64).max
        lower[look] = np.sqrt(found.min(axis=1)) if len(centroids) > 1 else np.inf
    return cluster, lower, distance, len(look)


@frugal
def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, loose: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        listed = batch.column("v")
        v = listed.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
        before = (None, None) if loose is None else (batch.column("cluster").to_numpy().astype(np.int64), batch.column("lower").to_numpy())
        cluster, lower, distance, _ = assigned(v, centroids, *before, loose)
        yield pa.RecordBatch.from_arrays([batch.column("id"), listed, pa.array(cluster.astype(np.int32)), pa.array(lower), pa.array(distance)], ["id", "v", "cluster", "lower", "distance"])


def _totals(state: DataFrame, dims: int) -> dict[int, tuple[int, float, list[int]]]:
    """{cluster: (vectors, greatest distance, sums of components)}; a row a cluster."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
    found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect()
    return {r["cluster"]: (r["n"], float(np.sqrt(r["far"])), [r[f"s{i}"] for i in range(dims)]) for r in found}


def clusters(
    vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT
) -> DataFrame:
    """(``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    shared_dir(spark)
    small_batches(spark)
    scratch = Scratch(spark)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), integers(F.col(vector), dims, scale).alias("v")).where("v IS NOT NULL")
    lead = rows.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in lead], dtype=np.int64).reshape(-1, dims)
    schema = f"id {kind}, v array<int>, cluster int, lower double, distance bigint"
    state, loose = rows, None
    if not len(centroids):  # no vector with an id: one cluster at the origin would be made up
        state = rows.limit(0).select("id", "v", F.lit(0).alias("cluster"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"))
    for step in range(rounds + 1 if len(centroids) else 0):
        state = scratch.stored(state.mapInArrow(partial(_assign, centroids=centroids, loose=loose), schema), f"round-{step}")
        scratch.release(f"round-{step}")
        if step < rounds:
            totals = _totals(state, dims)
            moved = centroids.copy()
            for c, (n, _, sums) in totals.items():
                moved[c] = [x // n for x in sums]
            radius = np.array([totals[c][1] if c in totals else 0.0 for c in range(len(centroids))])
            loose = drops(centroids.astype(np.float64), moved.astype(np.float64), radius)
            centroids = moved
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    total = sum(int(r["s"]) for r in sums)
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = spark.createDataFrame([(r["cluster"], int(r["s"]), total, names[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("id", "cluster", "distance").join(F.broadcast(each), "cluster")  # ``k`` rows at most
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
