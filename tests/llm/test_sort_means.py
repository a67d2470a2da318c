"""Sorted scans against all distances, in numpy, in Spark and in SQL; odd input."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tickflow.llm import queries, sort_means
from tickflow.llm.sort_means import Centroids, Settings, cluster_vectors


def brute(rows, s):
    """rows: (id, components or None). Returns the multiset of (id, cluster, distance) and the centroids."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(s.scale * x) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (hashlib.sha256(f"{s.seed}:{'' if kept[k][0] is None else kept[k][0]}".encode()).hexdigest(), kept[k][1]))
    centroids = [whole[k] for k in order[: s.k]]

    def assign():
        out = []
        for v in whole:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)))
        return out

    for _ in range(s.rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for v, (_, k) in zip(whole, found, strict=True) if k == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign() if centroids else []
    return [(i, k, d) for (i, _), (d, k) in zip(kept, found, strict=True)], centroids


@pytest.mark.parametrize("span", [3, 1000, 1 << 22, 1 << 40])
def test_scan_finds_the_nearest_and_the_smaller_number(span):
    rng = np.random.default_rng(span)
    for _ in range(30):
        k, dims, n = rng.integers(1, 9), rng.integers(1, 5), rng.integers(0, 60)
        points = rng.integers(-span, span + 1, (k, dims)).tolist()
        vectors = rng.integers(-span, span + 1, (n, dims))
        if n > 4:
            vectors[:2] = points[0]
        clusters, distances = Centroids(points).assign(vectors, rng.integers(0, k, n).astype(np.int32))
        for v, c, d in zip(vectors.tolist(), clusters.tolist(), distances.tolist(), strict=True):
            assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), j) for j, p in enumerate(points))


def test_scan_stops(monkeypatch):
    """Far clusters are never compared: distances are taken to the present centroid alone."""
    points = [[1000 * k, 0] for k in range(6)]
    vectors = np.array([[1000 * k + 3, 4] for k in range(6)] * 50)
    model, pairs = Centroids(points), []
    real = np.searchsorted
    monkeypatch.setattr(sort_means.np, "searchsorted", lambda a, v, side: pairs.append(int(n := real(a, v, side=side))) or n)
    clusters, distances = model.assign(vectors, np.array(list(range(6)) * 50, np.int32))
    assert sum(pairs) == 0 and set(distances.tolist()) == {25} and clusters.tolist() == list(range(6)) * 50


def test_spark_rounds(spark, monkeypatch):
    monkeypatch.setattr(sort_means, "BLOCK", 16)
    s = Settings(k=4, rounds=5, dims=3)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 3)]) for i in rng.integers(0, 60, 150)]
    rows += [(None, [0.25, 0.5, 0.75]), (None, [0.25, 0.5, 0.75]), (7, None), (8, []), (9, [1.0, None, 2.0]), (10, [1.0, float("nan"), 2.0])]
    rows += [(11, [1.0, float("inf"), 2.0]), (12, [1.0, 2.0]), (13, [1.0, 2.0, 3.0, 4.0]), (14, [-0.0, -1e-9, 1e-9])] + [(500, [0.1, 0.1, 0.1])] * 40
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids string").repartition(3)
    found = cluster_vectors(table, settings=s)
    expected, centroids = brute(rows, s)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, found.rows.collect()), key=key) == sorted(expected, key=key)
    assert found.centroids == centroids
    assert found.inertias == [sum(d for _, k, d in expected if k == c) for c in range(4)]


def test_large_components(spark):
    s = Settings(k=2, rounds=2, dims=2)
    rows = [(1, [1e5, 2e5]), (2, [-1e6, 3e6]), (3, [1.5, 2.5]), (4, [1e5, 2.1e5]), (5, [3e6, -1e6])]
    found = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), settings=s)
    expected, centroids = brute(rows, s)
    assert sorted(map(tuple, found.rows.collect())) == sorted((i, k, d if d < 1 << 63 else None) for i, k, d in expected)
    assert found.centroids == centroids
    huge = cluster_vectors(spark.createDataFrame([*rows, (6, [1e300, 0.0])], "vec_id long, embedding array<double>"), settings=Settings(k=1, rounds=1, dims=2))
    assert huge.rows.filter("distance IS NULL").count() == 6 and huge.inertias == [None]
    digests = queries.cluster_digests(huge).collect()
    assert len(digests) == 6 and digests[0].cluster_inertia is None and digests[0].inertia is None


def test_few_and_none(spark):
    none = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    assert queries.cluster_digests(cluster_vectors(none)).collect() == []
    assert queries.cluster_digests(cluster_vectors(none.limit(0))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = cluster_vectors(spark.createDataFrame([(1, [0.5] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>"))
    assert len(few.centroids) == 2 and {r.distance for r in few.rows.collect()} == {0}


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = queries.op12_sort_means(spark, sf_dir)
    expected = db.sql(queries.ORACLE["op12_sort_means"])
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(expected.fetchall())
