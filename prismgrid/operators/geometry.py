"""Point clouds and meshes as scalar columns: counts, centroids, normals, trimming, rotation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_POINTS = 10
TRIM = 0.01
SPIN = 0.005


def enough_points(points: DataFrame, least: int = MIN_POINTS, cloud: str = "cloud_id") -> DataFrame:
    """The points of clouds with at least ``least`` of them."""
    counts = points.groupBy(cloud).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(cloud)
    return points.join(counts, cloud, "left_semi")


def centroids(points: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    return points.groupBy(cloud).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))


def outward_normals(points: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    """nx, ny, nz: unit vectors away from the cloud's centroid; null for a point that is the centroid."""
    joined = points.drop("nx", "ny", "nz").join(centroids(points, cloud), cloud)
    d = [F.col(a) - F.col(c) for a, c in zip("xyz", ("cx", "cy", "cz"), strict=True)]
    joined = joined.withColumn("_len", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return joined.withColumns({f"n{a}": F.try_divide(v, F.col("_len")) for a, v in zip("xyz", d, strict=True)}).drop("cx", "cy", "cz", "_len")


def density_trim(vertices: DataFrame, share: float = TRIM, mesh: str = "mesh_id") -> DataFrame:
    """The vertices not below the mesh's exact, interpolated density quantile."""
    cut = vertices.groupBy(mesh).agg(F.percentile("density", share).alias("_cut"))
    return vertices.join(cut, mesh).where(F.col("density") >= F.col("_cut")).drop("_cut")


def rotate(points: DataFrame, angle: float = SPIN, a: str = "x", b: str = "z") -> DataFrame:
    """Rotated in the plane of two axes."""
    c, s = math.cos(angle), math.sin(angle)
    return points.withColumns({a: F.col(a) * c - F.col(b) * s, b: F.col(a) * s + F.col(b) * c})


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def vertex_normals(vertices: DataFrame, faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Unit normals of the vertices that have faces, weighted by area; null where they cancel out.

    Corners are met one at a time by equi-joins on (mesh, vertex); face normals are summed by vertex.
    """
    at = faces.select(mesh, "face_id", "v0", "v1", "v2")
    for i in range(3):
        corner = vertices.select(F.col(mesh), F.col("vertex_id").alias(f"v{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz"))
        at = at.join(corner, [mesh, f"v{i}"])
    u, v = ([F.col(f"{c}{i}") - F.col(f"{c}0") for c in "xyz"] for i in (1, 2))
    at = at.withColumns(dict(zip(("fx", "fy", "fz"), _cross(u, v), strict=True)))
    spread = at.select(mesh, F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), "fx", "fy", "fz")
    total = spread.groupBy(mesh, "vertex_id").agg(*(F.sum(f"f{c}").alias(f"s{c}") for c in "xyz"))
    size = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    return total.select(mesh, "vertex_id", *(F.try_divide(F.col(f"s{c}"), size).alias(f"n{c}") for c in "xyz"))
