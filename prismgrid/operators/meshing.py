"""Surface reconstruction as a pluggable stage, and its fallback to the raw cloud."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESH = "vertex_id long, x double, y double, z double, density double"


def reconstruct(points: DataFrame, backend: Callable[[pd.DataFrame], pd.DataFrame] | None, cloud: str = "cloud_id", least: int = 10) -> DataFrame:
    """Vertices with densities of each cloud, by ``backend(points of one cloud)``; one cloud is one task's.

    Without a backend, and for clouds below ``least`` points or on which the backend fails, there are no vertices:
    ``with_fallback`` then takes the raw cloud.
    """
    kind = points.schema[cloud].dataType.simpleString()
    out = f"{cloud} {kind}, {MESH}"
    if backend is None:
        return points.sparkSession.createDataFrame([], out)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="float64") for c in MESH.split(", ")}).assign(**{cloud: None})
        try:
            made = backend(rows) if len(rows) >= least else None
        except Exception:  # noqa: BLE001  one cloud's failure doesn't stop the others
            made = None
        return empty[[cloud, *(c.split()[0] for c in MESH.split(", "))]] if made is None else made.assign(**{cloud: key[0]})[[cloud, *(c.split()[0] for c in MESH.split(", "))]]

    return points.groupBy(cloud).applyInPandas(run, out)


def with_fallback(points: DataFrame, vertices: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    """The mesh's vertices of each cloud that has any, else its raw points, marked by ``origin``."""
    mesh = vertices.select(cloud, F.col("vertex_id").alias("point_id"), "x", "y", "z", F.lit("mesh").alias("origin"))
    raw = points.join(vertices.select(cloud).distinct(), cloud, "left_anti").select(cloud, "point_id", "x", "y", "z", F.lit("raw").alias("origin"))
    return mesh.unionByName(raw)
