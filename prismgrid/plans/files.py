"""Queries of the file sources and sinks: each writes the rows of ``nation`` as files and scans them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prismgrid.operators import images, status
from prismgrid.sources import blobs, media
from prismgrid.storage import importable, materialize, scratch_path, table

KEY = "n_nationkey"


def _written(spark: SparkSession, sf_dir: str, label: str, path: Callable[[Column], Column], content: Callable[[Column], Column]) -> str:
    """The folder with a file for each nation, its path and content made from the nation's key."""
    importable(spark)
    blobs.register(spark)
    folder, key = scratch_path(spark, label), F.col(KEY)
    table(spark, sf_dir, "nation").select(path(key).alias("path"), content(key).cast("binary").alias("content")).write.format("blobs").mode("append").save(folder)
    return folder


def _bytes(key: Column) -> Column:
    return F.repeat(F.lit("x"), (key + 1).cast("int"))


def landing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("job"), k % 5, F.lit("/f"), k, F.when(k % 2 == 0, ".mp4").otherwise(".jpg"))
    return media.landed(spark, _written(spark, sf_dir, "landing", name, _bytes)).drop("modified")


def written_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.file_metadata(spark, _written(spark, sf_dir, "metadata", lambda k: F.concat(F.lit("f"), k, F.lit(".bin")), _bytes), "*.bin")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def status_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = lambda k: F.when(k % 5 == 0, F.lit("{cut")).otherwise(F.to_json(F.struct(F.lit("Processing").alias("status"), (k * 4).alias("progress"))))
    files = media.status_files(spark, _written(spark, sf_dir, "status", lambda k: F.concat(F.lit("job"), k, F.lit("/status.json")), body))
    return status.parse(files).select("job_id", "status", "progress")


def sub_model_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("sparse/"), F.when(k % 4 == 0, "m").otherwise(""), k, F.lit("/points3D.bin"))
    return media.sub_models(spark, _written(spark, sf_dir, "models", name, _bytes))


ARTIFACTS = ("database.db", "sparse/0/points3D.bin", "dense/fused.ply", "dense/final_textured_model.ply")


def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("job"), k, F.lit("/"), F.element_at(F.array(*map(F.lit, ARTIFACTS)), (k % 4 + 1).cast("int")))
    return media.artifacts(spark, _written(spark, sf_dir, "artifacts", name, _bytes))


def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos whose injected decoder finds as many frames as the file has bytes, and can't open every sixth."""

    def decoder(content: bytes):
        if len(content) % 6 == 0:
            raise OSError("can't be opened")
        return -1, (np.full((2, 2, 3), i) for i in range(len(content)))

    folder = _written(spark, sf_dir, "videos", lambda k: F.concat(F.lit("v"), k, F.when(k % 2 == 0, ".MP4").when(k % 3 == 0, ".mov").otherwise(".txt")), _bytes)
    found = media.decode_videos(spark, folder, decoder)
    return found.select(F.regexp_extract("path", r"/v([0-9]+)\.", 1).cast("int").alias("video"), "nominal", "frame_no", F.octet_length("data").alias("bytes"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain image for each nation: key + 1 rows of four pixels of ten times the key."""
    picture = F.udf(lambda k: images.png(np.full((k + 1, 4, 3), k * 10)), "binary")  # a fixture of 25 files
    return media.images(spark, _written(spark, sf_dir, "images", lambda k: F.concat(F.lit("i"), k, F.lit(".png")), picture))


def _name(column: str) -> Column:
    return F.regexp_extract(column, r"/([^/.]+)\.[a-z]+$", 1)


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select(_name("image.origin").alias("name"), "image.height", "image.width", "image.nChannels", F.octet_length("image.data").alias("bytes"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked by an injected model: half transparent everywhere; it fails on every seventh image."""

    def model():
        def alpha(bgr: np.ndarray) -> np.ndarray:
            if len(bgr) % 7 == 1:
                raise ValueError("no foreground")
            return np.full(bgr.shape[:2], 128)

        return alpha

    return images.mask_images(_images(spark, sf_dir), model)


def masked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked images written as files of a second version and read again."""
    made, folder = images.encoded(_masked(spark, sf_dir), 2), scratch_path(spark, "masked")
    made.write.format("blobs").mode("append").save(folder)
    back = media.images(spark, f"{folder}/masked/v2")
    return back.select(_name("image.origin").alias("name"), "image.height", "image.width", F.conv(F.hex(F.substring("image.data", 1, 1)), 16, 10).cast("int").alias("level"))


def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.mask_counts(_masked(spark, sf_dir))


def mask_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the run itself reported while it wrote."""
    progress = Observation("masking")
    materialize(images.observed(_masked(spark, sf_dir), progress).select("origin", "error"), "masking")
    return spark.createDataFrame([(progress.get["masked"], progress.get["failed"])], "masked long, failed long")


ALL = (landing_scan, written_file_metadata, status_file_scan, sub_model_scan, artifact_scan, video_frames, image_scan, masked_files, mask_counts, mask_progress)

FILE_ORACLES = {
    "landing_scan": "SELECT 'job' || n_nationkey % 5 AS job_id, 'f' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.mp4' ELSE '.jpg' END AS filename, n_nationkey + 1 AS length FROM nation",
    "written_file_metadata": "SELECT 'f' || n_nationkey || '.bin' AS name, n_nationkey + 1 AS length FROM nation",
    "status_file_scan": "SELECT 'job' || n_nationkey AS job_id, CASE WHEN n_nationkey % 5 = 0 THEN 'Error' ELSE 'Processing' END AS status, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 4 END AS progress FROM nation",
    "sub_model_scan": "SELECT n_nationkey::VARCHAR AS model_id, n_nationkey + 1 AS size_bytes FROM nation WHERE n_nationkey % 4 <> 0",
    "artifact_scan": "SELECT 'job' || n_nationkey AS job_id, ['database', 'sparse', 'dense', 'mesh'][n_nationkey % 4 + 1] AS artifact, n_nationkey + 1 AS length FROM nation",
    "video_frames": "SELECT n_nationkey AS video, -1 AS nominal, i AS frame_no, 12 AS bytes FROM nation, unnest(range(n_nationkey + 1)) AS u(i) WHERE (n_nationkey % 2 = 0 OR n_nationkey % 3 = 0) AND (n_nationkey + 1) % 6 <> 0",
    "image_scan": "SELECT 'i' || n_nationkey AS name, n_nationkey + 1 AS height, 4 AS width, 3 AS \"nChannels\", (n_nationkey + 1) * 12 AS bytes FROM nation",
    "masked_files": "SELECT 'i' || n_nationkey AS name, n_nationkey + 1 AS height, 4 AS width, round(n_nationkey * 10 * 128 / 255)::INT AS level FROM nation WHERE n_nationkey % 7 <> 0",
    "mask_counts": "SELECT count(*) FILTER (n_nationkey % 7 <> 0) AS masked, count(*) FILTER (n_nationkey % 7 = 0) AS failed FROM nation",
    "mask_progress": "SELECT count(*) FILTER (n_nationkey % 7 <> 0) AS masked, count(*) FILTER (n_nationkey % 7 = 0) AS failed FROM nation",
}
