import math
import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from kohorta.llm import centroid_clusters, near_vectors, queries
from kohorta.llm.common import Scratch
from kohorta.llm.centroid_clusters import assigned, clusters, drops
from kohorta.llm.near_vectors import linked, quantised, unit

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 4, [NAN, 1.0, 0.0, 0.0], [INF, 1.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [3.0], [-3.0], [5e-30, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 1e290]]


def plain_links(rows, threshold=0.95):
    """rows: (id, vector); (id, n_links, component_id, kept) by all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = defaultdict(set)
    for i, (_, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if ok[i] and ok[j] and len(v) == len(w):
                a, b = (np.array(x) / max(map(abs, x)) for x in (v, w))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((key, len(near[i]), least, key == least))
    return out


def made_vectors(n, dims, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(2, n // 12), dims))
    noise = r.choice([0.02, 0.2, 0.33], size=(n, 1)) * r.normal(size=(n, dims))
    return (centres[r.integers(0, len(centres), n)] + noise).astype(np.float32).astype(float).tolist()


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("tile_rows", [8192, 37])
def test_links_equal_all_pairs(spark, tile_rows):
    vectors = made_vectors(400, 16, 1) + made_vectors(100, 5, 2) + ODD
    vectors += [vectors[0]] * 40 + [[2 * x for x in vectors[0]]] + [None]
    rows = [(3 * i, v) for i, v in enumerate(vectors)] + [(None, vectors[1]), (None, [9.0, 9.0, 1.0]), (0, vectors[0]), (3, vectors[7])]
    random.Random(0).shuffle(rows)
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = near_vectors.near_vectors(table.repartition(3), tile_rows=tile_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = by_text(plain_links(rows))
    assert by_text(got.collect()) == want
    assert sum(r[1] > 0 for r in want) > 200 and len({r[2] for r in want}) > 60


def test_a_large_group_of_near_copies_gives_few_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + 0.01 * r.normal(size=8)).tolist()) for i in range(3000)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tile_rows=500)
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(2999, 0)}


def test_bounds_hold_and_decide_most_pairs():
    u = unit(np.array(made_vectors(600, 32, 4)))
    q, s, e = quantised(u)
    exact = u @ u.T
    about = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(exact - about) <= e[:, None] + e + e[:, None] * e + 1e-12).all()
    i, j, again = (np.concatenate(x) if isinstance(x[0], np.ndarray) else sum(x) for x in zip(*linked(u, u, 0.95, True), strict=True))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in np.argwhere(exact >= 0.95).tolist() if a < b}
    assert 0 < again < len(i)


def test_far_tiles_are_left_out(spark):
    r = np.random.default_rng(8)
    corners = np.eye(8)
    rows = [(i, (corners[i % 8] + 0.05 * r.normal(size=8)).tolist()) for i in range(1600)]
    nodes = spark.createDataFrame([(str(i).encode(), 1, v, 8) for i, v in rows], "node binary, copies long, v array<double>, dims int")
    scratch = Scratch(spark)
    tiles = scratch.stored(near_vectors._tiles(nodes, scratch, 100), "tiles")
    boxes, cells = tiles.select("tile").distinct().count(), near_vectors._cells(tiles, 0.95, scratch).collect()
    assert boxes >= 12 and len(cells) < boxes * (boxes + 1) / 2 / 2
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile_rows=100)
    assert by_text(got.collect()) == by_text(plain_links(rows))


def test_no_vectors_and_bad_thresholds(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors.near_vectors(none).collect() == [] and clusters(none).collect() == []
    only = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert by_text(near_vectors.near_vectors(only).collect()) == by_text([(1, 0, 1, True), (None, 0, None, True)])
    with pytest.raises(ValueError, match="threshold"):
        near_vectors.near_vectors(only, threshold=0.0)


def plain_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in seeds[:k]]
    if not centroids:
        return []
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        best = [min((away(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), b in zip(kept, best, strict=True) if b[1] == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = sum(d for d, _ in best)
    of = [sum(d for d, c in best if c == j) for j in range(len(centroids))]
    return [(i, c, d, of[c], total, sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, best, strict=True)]


def test_clusters_equal_plain_rounds(spark):
    vectors = [[x / 8 for x in v] for v in made_vectors(500, 64, 5)]
    vectors += [None, [], [1.0] * 63, [NAN] * 64, [None] * 64, [INF] * 64, [0.0] * 64, [-0.0] * 64, [1e5] * 64] + [vectors[3]] * 90
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (5, vectors[9]), (5, vectors[9])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    got = clusters(table.repartition(3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert by_text(got.collect()) == by_text(plain_clusters(rows))
    few = rows[:7] + rows[-3:]
    assert by_text(clusters(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()) == by_text(plain_clusters(few))
    with pytest.raises(Exception, match="too large"):
        clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_loosened_bounds_hold_and_beat_the_full_drift():
    r = np.random.default_rng(6)
    tighter = 0
    for _ in range(200):
        k, dims = 5, int(r.integers(2, 6))
        old = r.integers(-40, 40, (k, dims))
        new = old + r.integers(-9, 9, (k, dims)) * (r.random((k, 1)) < 0.7)
        v = r.integers(-45, 45, (300, dims))
        cluster, lower, distance, _ = assigned(v, old, None, None, None)
        radius = np.array([np.sqrt(distance[cluster == c].max(initial=0)) for c in range(k)])
        loose = drops(old.astype(float), new.astype(float), radius)
        far = np.sqrt(((v[:, None] - new) ** 2).sum(axis=2))
        far[np.arange(len(v)), cluster] = np.inf
        assert (lower - loose[cluster] <= far.min(axis=1) + 1e-9).all()
        full = np.array([max(np.linalg.norm(new[j] - old[j]) for j in range(k) if j != c) for c in range(k)])
        assert (loose <= full + 1e-5).all()
        tighter += (loose < 0.9 * full).sum()
        again = assigned(v, new, cluster, lower, loose)
        plain = assigned(v, new, None, None, None)
        assert (again[0] == plain[0]).all() and (again[2] == plain[2]).all() and again[3] <= len(v)
    assert tighter > 100


def test_oracles_on_planted_vectors(spark, tmp_path):
    import duckdb

    vectors = [[x / 8 for x in v] for v in made_vectors(250, 64, 7)] + [[0.0] * 64, None, [1.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000, vectors[0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("op12_near_vectors", "op13_centroid_clusters"):
        got = queries.queries()[name](spark, str(tmp_path))
        made = base.execute(queries.oracle_sql()[name])
        assert [c[0] for c in made.description] == got.columns
        assert by_text(got.collect()) == by_text(made.fetchall())
