"""Uploads: routing by suffix, file names, last writer wins, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Recognised suffixes.
VIDEO = (".mp4", ".mov", ".avi", ".mkv")
IMAGE = (".jpg", ".jpeg", ".png")


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def suffix(name: Column) -> Column:
    """The extension with its dot and in its own case; empty if there is none (a leading dot isn't one)."""
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def base_name(name: Column) -> Column:
    """The name without folders; a client can't choose where its file goes."""
    return F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)


def route(uploads: DataFrame) -> DataFrame:
    """Adds ``path`` in the job's folder: videos become video_{index}{suffix}, all else keeps its name in images/."""
    video = F.col("is_video") & has_suffix(F.col("filename"), VIDEO)
    path = F.when(video, F.concat(F.lit("video_"), F.col("file_idx"), suffix(F.col("filename")))).otherwise(F.concat(F.lit("images/"), base_name(F.col("filename"))))
    return uploads.withColumn("path", path)


def stored(routed: DataFrame) -> DataFrame:
    """What each job's folder holds: of files with one path the last index wins. Combined before the shuffle."""
    return routed.groupBy("job_id", "path").agg(F.max("file_idx").alias("file_idx"))


def client_says_video(uploads: DataFrame) -> DataFrame:
    """The client's own test: any name that ends in .mp4 (the other suffixes aren't tested)."""
    return uploads.groupBy("job_id").agg(F.bool_or(F.lower("filename").endswith(".mp4")).alias("is_video"))


def listing(files: DataFrame, suffixes: tuple[str, ...], path: str = "path") -> DataFrame:
    """The files with one of the suffixes, whatever their case."""
    return files.where(has_suffix(F.col(path), suffixes))


def nonempty(requests: DataFrame, files: str = "files") -> DataFrame:
    """Requests that hold at least one file; the others do nothing."""
    return requests.where(F.size(files) > 0)


def new_jobs(requests: DataFrame) -> DataFrame:
    """Each request with a fresh job id and where its status is asked for."""
    return requests.withColumn("job_id", F.uuid()).withColumn("status_url", F.concat(F.lit("/jobs/"), F.col("job_id"), F.lit("/status")))


def each_file(requests: DataFrame, files: str = "files") -> DataFrame:
    """A row for each file of a request, numbered from 0 in the request's order."""
    return requests.select(*(c for c in requests.columns if c != files), F.posexplode(files).alias("file_idx", "filename"))
