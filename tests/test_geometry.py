import math
import random

import pytest

from prismgrid.operators import geometry, knn

SCHEMA = "cloud_id int, point_id long, x double, y double, z double, r double, g double, b double"


def sphere(n=80, cloud=0, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(3)]
        d = math.hypot(*v)
        out.append((cloud, i, *(c / d for c in v), 0.2, 0.3, 0.4))
    return out


def brute(points, queries, k):
    out = set()
    for c, q, x, y, z, *_ in queries:
        near = sorted((math.dist((x, y, z), p[2:5]), p[1]) for p in points if p[0] == c)[:k]
        out |= {(c, q, p, rank, round(d, 9)) for rank, (d, p) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("broadcast_points", [10_000, 10])
def test_knn_is_exact(spark, broadcast_points):
    rng = random.Random(5)
    points = [*sphere(60), *sphere(7, 1), *((2, i, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) for i in range(12)), *((3, i, rng.random() * 100, rng.random(), 0.0, 0.0, 0.0, 0.0) for i in range(40))]
    df = spark.createDataFrame(points, SCHEMA).repartition(3)
    found = knn.knn(df, df.withColumnRenamed("point_id", "query_id"), 9, broadcast_points=broadcast_points)
    assert {(r["cloud_id"], r["query_id"], r["point_id"], r["rank"], round(r["dist"], 9)) for r in found.collect()} == brute(points, points, 9)


@pytest.mark.parametrize("broadcast_points", [10_000, 10])
def test_an_outlier_goes(spark, broadcast_points):
    points = [*sphere(), (0, 999, 30.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    kept = {r["point_id"] for r in knn.remove_outliers(spark.createDataFrame(points, SCHEMA), 10, 3.0, broadcast_points=broadcast_points).collect()}
    assert kept == set(range(80))


def test_identical_points_are_all_dropped(spark):
    points = [(0, i, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0) for i in range(12)]
    assert knn.remove_outliers(spark.createDataFrame(points, SCHEMA)).count() == 0


def test_colours_come_from_the_nearest_point(spark):
    points = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 0.9, 0.8, 0.7), (0, 2, 10.0, 0.0, 0.0, 0.1, 0.2, 0.3)], SCHEMA)
    mesh = spark.createDataFrame([(0, 1, 0.5, 0.0, 0.0), (0, 2, 0.51, 0.0, 0.0), (0, 3, 9.9, 0.0, 0.0)], "cloud_id int, vertex_id long, x double, y double, z double")
    found = {r["vertex_id"]: (r["r"], r["point_id"]) for r in knn.transfer_colors(mesh, points).collect()}
    assert found == {1: (0.9, 1), 2: (0.1, 1), 3: (0.1, 2)}


def test_normals_of_a_sphere_point_outwards(spark):
    rows = [(0, i, x, y, z, 0.0, 0.0, 0.0) for i, (x, y, z) in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1.0), (0, 0, -1), (0, 0, 0)])]
    rows = [(c, i, float(x), float(y), float(z), r, g, b) for c, i, x, y, z, r, g, b in rows]
    for r in geometry.outward_normals(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r["nx"], r["ny"], r["nz"]) == ((r["x"], r["y"], r["z"]) if r["point_id"] != 6 else (None, None, None))


def test_guard_and_trim(spark):
    df = spark.createDataFrame([*sphere(9, 1), *sphere(10, 2)], SCHEMA)
    assert {r["cloud_id"] for r in geometry.enough_points(df).collect()} == {2}
    mesh = spark.createDataFrame([(0, i, float(i)) for i in range(101)] + [(1, i, 5.0) for i in range(5)], "mesh_id int, vertex_id long, density double")
    kept = geometry.density_trim(mesh, 0.05).groupBy("mesh_id").count().collect()
    assert {r["mesh_id"]: r["count"] for r in kept} == {0: 96, 1: 5}


def test_vertex_normals_of_a_flat_square(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 1.0, 1.0, 0.0), (0, 3, 0.0, 1.0, 0.0), (0, 4, 9.0, 9.0, 9.0)], "mesh_id int, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 3)], "mesh_id int, face_id long, v0 long, v1 long, v2 long")
    assert {(r["vertex_id"], r["nx"], r["ny"], r["nz"]) for r in geometry.vertex_normals(v, f).collect()} == {(i, 0.0, 0.0, 1.0) for i in range(4)}
