"""File listings and images through Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.operators.routing import VIDEO, has_suffix


def file_metadata(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length of files; their content is never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def sub_models(spark: SparkSession, path: str) -> DataFrame:
    """model_id, size_bytes of <digits>/points3D.bin below a sparse folder (ASCII digits)."""
    files = file_metadata(spark, path, "points3D.bin")
    number = F.regexp_extract("path", r"/([0-9]+)/points3D\.bin$", 1)
    return files.select(number.alias("model_id"), F.col("length").alias("size_bytes")).where("model_id != ''")


def images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded images of a folder of frames."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(path)


def status_files(spark: SparkSession, path: str) -> DataFrame:
    """job_id and body of <job>/status.json below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "status.json").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"/([^/]+)/status\.json$", 1).alias("job_id"), F.col("content").cast("string").alias("body"))


def landed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Uploads in a landing folder <job>/<file>: job_id, filename, length, modified; as a stream or in one go. Empty files
    are passed over by Spark's file listing."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{path}/*/*")
    shape = rf"/{re.escape(path.rstrip('/').rpartition('/')[2])}/([^/]+)/([^/]+)$"
    job, name = (F.regexp_extract("path", shape, i) for i in (1, 2))
    return files.select(job.alias("job_id"), name.alias("filename"), "length", F.col("modificationTime").alias("modified")).where("job_id != ''")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """What each job's folder holds: job_id, artifact, length."""
    files = file_metadata(spark, path)
    at = F.regexp_extract("path", r"/([^/]+)/(database\.db|sparse/[0-9]+/points3D\.bin|dense/fused\.ply|dense/final_textured_model\.ply)$", 1)
    name = F.regexp_extract("path", r"/(database\.db|sparse|dense/fused\.ply|dense/final_textured_model\.ply)[^.]*(?:\.bin)?$", 1)
    kind = F.when(name == "database.db", "database").when(name == "sparse", "sparse").when(name == "dense/fused.ply", "dense").otherwise("mesh")
    return files.select(at.alias("job_id"), kind.alias("artifact"), "length").where("job_id != ''")


def decode_videos(spark: SparkSession, path: str, decoder: Callable[[bytes], tuple[int, Iterable[np.ndarray]]]) -> DataFrame:
    """Frames of the videos below a folder: path, nominal, frame_no, height, width, data (blue, green, red).

    ``decoder(content)`` returns the nominal count and the frames as (h, w, 3) arrays. A video that it can't open
    yields no rows. Frames leave one at a time, so a task holds one video and one frame.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["path", "nominal", "frame_no", "height", "width", "data"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    nominal, frames = decoder(content)
                except Exception:  # noqa: BLE001  unopenable: no rows
                    continue
                for i, f in enumerate(frames):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([nominal], pa.int32()), pa.array([i], pa.int64()), pa.array([f.shape[0]], pa.int32()), pa.array([f.shape[1]], pa.int32()), pa.array([f.astype(np.uint8).tobytes()], pa.binary())], names)

    return files.where(has_suffix(F.col("path"), VIDEO)).mapInArrow(run, "path string, nominal int, frame_no long, height int, width int, data binary")
