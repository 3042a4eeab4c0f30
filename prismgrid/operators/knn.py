"""Exact k nearest neighbours, outlier removal and nearest-point attribute transfer.

Up to ``BROADCAST_POINTS`` points are broadcast as arrays and compared in numpy blocks, so nothing is shuffled.
Beyond that a grid join runs: queries meet the points of the cells within a ring by an equi-join; a query is done when
its k-th distance is within what the ring covers, and the others go on with a ring twice as wide. Ties go to the least
point id; both ways return the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.storage import importable, materialize

BROADCAST_POINTS = 200_000
NEIGHBOURS = 50
STD_RATIO = 1.0
MAX_DISTANCE = 0.5
GREY = 0.1
_BLOCK = 1 << 22


def _blocked(points: DataFrame, queries: DataFrame, k: int, cloud: str) -> DataFrame:
    rows = points.select(cloud, "point_id", "x", "y", "z").toPandas()
    table = {c: (g["point_id"].to_numpy(np.int64), g[["x", "y", "z"]].to_numpy(np.float64)) for c, g in rows.sort_values("point_id").groupby(cloud, dropna=False)}
    shared = points.sparkSession.sparkContext.broadcast(table)
    kind = queries.schema[cloud].dataType.simpleString()
    names = [cloud, "query_id", "point_id", "dist", "rank"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            clouds = batch.column(0).to_pylist()
            ids, at = np.array(batch.column(1)), np.stack([np.array(batch.column(i), np.float64) for i in (2, 3, 4)], axis=1) if batch.num_rows else np.zeros((0, 3))
            out = []
            for c in dict.fromkeys(clouds):
                if c not in shared.value:
                    continue
                names_of, places = shared.value[c]
                mine = np.array([i for i, x in enumerate(clouds) if x == c])
                for part in np.array_split(mine, max(1, len(mine) * len(places) // _BLOCK)):
                    d = np.zeros((len(part), len(places)))
                    for axis in range(3):
                        d += (at[part, axis][:, None] - places[:, axis][None]) ** 2
                    size = min(k, len(places))
                    if size < len(places):
                        edge = np.partition(d, size - 1, axis=1)[:, size - 1]
                        picks = [np.flatnonzero(row <= e) for row, e in zip(d, edge, strict=True)]
                        near = np.array([p[np.argsort(row[p], kind="stable")][:size] for row, p in zip(d, picks, strict=True)])
                    else:
                        near = np.argsort(d, axis=1, kind="stable")
                    dist = np.sqrt(np.take_along_axis(d, near, axis=1))
                    out.append((np.repeat(part, size), names_of[near].ravel(), dist.ravel(), np.tile(np.arange(1, size + 1, dtype=np.int32), len(part))))
            if out:
                q, p, dist, rank = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(ids[q]), pa.array(p), pa.array(dist), pa.array(rank)], names)

    importable(points.sparkSession)
    return queries.select(cloud, "query_id", "x", "y", "z").mapInArrow(run, f"{cloud} {kind}, query_id long, point_id long, dist double, rank int")


def _gridded(points: DataFrame, queries: DataFrame, k: int, cloud: str, cell: float | None) -> DataFrame:
    both = points.select("x", "y", "z").unionByName(queries.select("x", "y", "z"))
    box = both.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in "xyz" for f in (F.min, F.max)), F.count("*").alias("n")).first()
    if not box["n"]:
        return queries.select(cloud, "query_id", F.lit(None).cast("long").alias("point_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    spans = [box[f"{c}_max"] - box[f"{c}_min"] for c in "xyz"]
    span = max(max(spans), 1e-12)
    cell = cell or max((reduce(lambda a, b: a * max(b, span / 1000), spans, 1.0) * k / box["n"]) ** (1 / 3), span / 100_000)
    at = lambda df: df.withColumns({f"c{c}": F.floor((F.col(c) - F.lit(box[f"{c}_min"])) / cell) for c in "xyz"})
    placed = materialize(at(points.select(cloud, "point_id", "x", "y", "z")), "knn-points")
    todo, done, ring = materialize(queries.select(cloud, "query_id", "x", "y", "z"), "knn-queries"), [], 1
    while True:
        last = ring * cell >= span
        side = F.sequence(F.lit(-ring), F.lit(ring))
        spread = at(todo)
        for c in "xyz":
            spread = spread.withColumn(f"d{c}", F.explode(side)).withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"d{c}")).drop(f"d{c}")
        right = placed.select(cloud, "cx", "cy", "cz", "point_id", *(F.col(c).alias(f"p{c}") for c in "xyz"))
        met = spread.join(right, [cloud, "cx", "cy", "cz"])
        squared = reduce(lambda a, b: a + b, ((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz"))
        order = Window.partitionBy(cloud, "query_id").orderBy("dist", "point_id")
        best = met.select(cloud, "query_id", "point_id", F.sqrt(squared).alias("dist")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = materialize(best, "knn-best")
        if last:
            return reduce(DataFrame.unionByName, [*done, best])
        sure = best.groupBy(cloud, "query_id").agg(F.count("*").alias("n"), F.max("dist").alias("far")).where((F.col("n") == k) & (F.col("far") < ring * cell)).select(cloud, "query_id")
        done.append(best.join(sure, [cloud, "query_id"], "left_semi"))
        todo = materialize(todo.join(sure, [cloud, "query_id"], "left_anti"), "knn-queries")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        ring *= 2


def knn(points: DataFrame, queries: DataFrame, k: int, cloud: str = "cloud_id", broadcast_points: int = BROADCAST_POINTS, cell: float | None = None) -> DataFrame:
    """cloud, query_id, point_id, dist, rank: the k nearest points of a query's own cloud (fewer if it has fewer)."""
    if points.limit(broadcast_points + 1).count() <= broadcast_points:
        return _blocked(points, queries, k, cloud)
    return _gridded(points, queries, k, cloud, cell)


def remove_outliers(points: DataFrame, k: int = NEIGHBOURS, std_ratio: float = STD_RATIO, cloud: str = "cloud_id", broadcast_points: int = BROADCAST_POINTS) -> DataFrame:
    """Points whose mean distance to their k nearest (themselves included) is above 0 and below mean + ratio * std of
    their cloud. The deviation is the sample's."""
    near = knn(points, points.withColumnRenamed("point_id", "query_id"), k, cloud, broadcast_points)
    means = materialize(near.groupBy(cloud, F.col("query_id").alias("point_id")).agg(F.avg("dist").alias("mean_dist")), "knn-means")
    whole = means.groupBy(cloud).agg(F.avg("mean_dist").alias("_m"), F.coalesce(F.stddev_samp("mean_dist"), F.lit(0.0)).alias("_s"))
    inside = means.join(whole, cloud).where((F.col("mean_dist") > 0) & (F.col("mean_dist") < F.col("_m") + std_ratio * F.col("_s"))).select(cloud, "point_id")
    return points.join(inside, [cloud, "point_id"], "left_semi")


def transfer_colors(vertices: DataFrame, points: DataFrame, max_dist: float = MAX_DISTANCE, grey: float = GREY, cloud: str = "cloud_id", broadcast_points: int = BROADCAST_POINTS) -> DataFrame:
    """Each vertex with the colour of its nearest point, or grey beyond ``max_dist``."""
    near = knn(points, vertices.withColumnRenamed("vertex_id", "query_id"), 1, cloud, broadcast_points).drop("rank")
    colored = near.join(points.select(cloud, "point_id", "r", "g", "b"), [cloud, "point_id"])
    far = (F.col("dist") > max_dist) & ~F.isnan("dist")
    picked = colored.select(cloud, F.col("query_id").alias("vertex_id"), "point_id", "dist", *(F.when(far, F.lit(grey)).otherwise(F.col(c)).alias(c) for c in "rgb"))
    return vertices.drop("r", "g", "b").join(picked, [cloud, "vertex_id"])
