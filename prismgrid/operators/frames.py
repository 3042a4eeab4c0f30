"""Frame sampling: stride, sharpness filter, forced re-sampling and numbering across videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = 80
THRESHOLD = 15.0
MIN_KEPT = 5
MIN_FRAMES = 10
UNKNOWN_FRAMES = 300


def nominal_frames(nominal: Column) -> Column:
    """The container's frame count; 300 where it is unknown or not positive."""
    return F.when(nominal > 0, nominal).otherwise(F.lit(UNKNOWN_FRAMES))


def positions(frames: DataFrame, video: list[str], order: str = "frame_no") -> DataFrame:
    """``pos``: a frame's place in its video, from 0."""
    return frames.withColumn("pos", F.row_number().over(Window.partitionBy(*video).orderBy(order)) - 1)


def stride_sample(frames: DataFrame, target: int = TARGET, video: list[str] | None = None, order: str = "frame_no") -> DataFrame:
    """Every step-th frame, step = max(1, nominal div target). The step uses the nominal count, positions the actual frames."""
    count = nominal_frames(F.col("nominal"))
    step = F.greatest(F.lit(1), F.floor(count / target).cast("int"))
    return positions(frames, video or ["video_id"], order).withColumn("step", step).where("pos % step = 0")


def sharp_enough(target: int = TARGET, threshold: float = THRESHOLD) -> Column:
    """Short videos keep every sampled frame; others those above the threshold. A missing image has sharpness 0."""
    return (nominal_frames(F.col("nominal")) < target) | (F.coalesce(F.col("sharpness"), F.lit(0.0)) > threshold)


def sharp_frames(frames: DataFrame, target: int = TARGET, threshold: float = THRESHOLD, video: list[str] | None = None) -> DataFrame:
    return stride_sample(frames, target, video).where(sharp_enough(target, threshold))


def extract(frames: DataFrame, target: int = TARGET, threshold: float = THRESHOLD, min_kept: int = MIN_KEPT, video: list[str] | None = None) -> DataFrame:
    """Kept frames with ``pass`` and ``frame_id`` (dense from 0 in each video).

    Where fewer than ``min_kept`` pass the filter, all sampled frames are appended again, after those kept. All
    windows share one partitioning, so there is one shuffle.
    """
    video = video or ["video_id"]
    sampled = stride_sample(frames, target, video).withColumn("keep", sharp_enough(target, threshold))
    sampled = sampled.withColumn("kept", F.sum(F.col("keep").cast("int")).over(Window.partitionBy(*video)))
    passes = F.filter(F.array(F.when(F.col("keep"), F.lit(1)), F.when(F.col("kept") < min_kept, F.lit(2))), lambda p: p.isNotNull())
    rows = sampled.withColumn("pass", F.explode(passes)).drop("keep", "kept")
    return rows.withColumn("frame_id", F.row_number().over(Window.partitionBy(*video).orderBy("pass", "pos")) - 1)


def frame_name(frame_id: Column) -> Column:
    return F.format_string("frame_%04d.jpg", frame_id)


def number_across_videos(extracted: DataFrame, job: str = "job_id", video: str = "video_id", ordinal: str = "video_id") -> DataFrame:
    """``frame_id`` goes on from video to video of a job: its start is the sum of the frames kept of earlier videos."""
    kept = extracted.groupBy(job, video, *([ordinal] if ordinal != video else [])).agg(F.count("*").alias("n"))
    before = Window.partitionBy(job).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.select(job, video, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = extracted.join(starts, [job, video]).withColumn("frame_id", F.col("frame_id") + F.col("start")).drop("start")
    return numbered.withColumn("name", frame_name(F.col("frame_id")))


def frame_totals(videos: DataFrame, extracted: DataFrame, job: str = "job_id", min_frames: int = MIN_FRAMES) -> DataFrame:
    """Frames of each job, summed over its videos; a job below ``min_frames`` fails."""
    totals = extracted.groupBy(job).agg(F.count("*").alias("n"))
    joined = videos.select(job).distinct().join(totals, job, "left").select(job, F.coalesce("n", F.lit(0)).alias("frames"))
    return joined.withColumn("status", F.when(F.col("frames") < min_frames, "Failed").otherwise("Processing"))
