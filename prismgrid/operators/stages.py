"""Stage planning: mode parameters, commands, skipping, candidate pairs, model choice and fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNTABLE = "turntable"
#: Fixed values: (mode, camera model, peak threshold, overlap, window radius); any other mode takes the second row.
MODES = (("turntable", "SIMPLE_RADIAL", "0.00001", 40, 7), ("default", "PINHOLE", "0.01", 20, 11))
#: The stages in order with their arguments; {name} is a mode parameter.
STAGES = (
    ("feature_extractor", ("--database_path", "{database}", "--image_path", "{images}", "--ImageReader.camera_model", "{camera_model}", "--ImageReader.single_camera", "1", "--SiftExtraction.peak_threshold", "{peak_threshold}")),
    ("sequential_matcher", ("--database_path", "{database}", "--SequentialMatching.overlap", "{overlap}", "--SequentialMatching.loop_detection", "1")),
    ("mapper", ("--database_path", "{database}", "--image_path", "{images}", "--output_path", "{sparse}", "--Mapper.ba_global_function_tolerance", "0.000001")),
    ("image_undistorter", ("--image_path", "{images}", "--input_path", "{model}", "--output_path", "{dense}", "--output_type", "COLMAP", "--max_image_size", "2000")),
    ("patch_match_stereo", ("--workspace_path", "{dense}", "--workspace_format", "COLMAP", "--PatchMatchStereo.geom_consistency", "true", "--PatchMatchStereo.window_radius", "{window_radius}", "--PatchMatchStereo.min_ncc", "0.05")),
    ("stereo_fusion", ("--workspace_path", "{dense}", "--workspace_format", "COLMAP", "--output_path", "{fused}", "--StereoFusion.check_num_images", "1", "--StereoFusion.min_num_pixels", "5")),
    ("model_converter", ("--input_path", "{model}", "--output_path", "{fused}", "--output_type", "PLY")),
)
#: Where a job keeps each artifact.
PLACES = {"database": "/database.db", "images": "/images", "sparse": "/sparse", "model": "/sparse/0", "dense": "/dense", "fused": "/dense/fused.ply"}
#: A stage is skipped where its artifact exists.
ARTIFACT = {"feature_extractor": "database", "mapper": "sparse"}
#: Fixed value: a smaller dense cloud counts as empty.
MIN_DENSE_BYTES = 5000


def mode_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, camera_model string, peak_threshold string, overlap int, window_radius int")


def with_mode_params(jobs: DataFrame, mode: str = "scan_mode") -> DataFrame:
    """Each job with its mode's parameters; the mode is free text, and all but one take the default row."""
    key = F.when(F.col(mode) == TURNTABLE, TURNTABLE).otherwise("default")
    return jobs.withColumn("mode", key).join(F.broadcast(mode_table(jobs.sparkSession)), "mode")  # two rows


def stage_plan(jobs: DataFrame) -> DataFrame:
    """A row for each job and stage with its arguments: job_id, stage_no, stage, args. Paths start at the job's id.

    A ``model_id`` column names the chosen sparse model; without one it is 0.
    """
    folder = F.col("job_id").cast("string")
    model = F.col("model_id").cast("string") if "model_id" in jobs.columns else F.lit("0")
    places = {name: F.concat(folder, F.lit(path)) for name, path in PLACES.items()} | {"model": F.concat(folder, F.lit("/sparse/"), model)}

    def filled(args: tuple[str, ...]) -> Column:
        return F.array(*(F.lit(a) if a[0] != "{" else places[a[1:-1]] if a[1:-1] in places else F.col(a[1:-1]).cast("string") for a in args))

    each = F.array(*(F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), filled(args).alias("args")) for i, (name, args) in enumerate(STAGES)))
    return with_mode_params(jobs).select("job_id", F.inline(each))


def pending(plan: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The plan without stages whose artifact (job_id, artifact) exists."""
    needs = F.create_map(*(F.lit(x) for kv in ARTIFACT.items() for x in kv))
    return plan.withColumn("artifact", needs[F.col("stage")]).join(artifacts.select("job_id", "artifact").distinct(), ["job_id", "artifact"], "left_anti").drop("artifact")


def sequential_pairs(images: DataFrame, overlap: Column | int, job: str = "job_id", place: str = "frame_id") -> DataFrame:
    """Each image with its next ``overlap`` neighbours: offsets are spread and met by an equi-join, never by a range."""
    width = F.lit(overlap) if isinstance(overlap, int) else overlap
    left = images.select(F.col(job).alias("j"), F.col(place).alias("image_a"), F.explode(F.sequence(F.lit(1), width)).alias("d"))
    left = left.select("j", "image_a", (F.col("image_a") + F.col("d")).alias("image_b"))
    right = images.select(F.col(job).alias("j"), F.col(place).alias("image_b"))
    return left.join(right, ["j", "image_b"]).select(F.col("j").alias(job), "image_a", "image_b")


def largest_model(models: DataFrame, job: str = "job_id", model: str = "model_id", size: str = "size_bytes") -> DataFrame:
    """Each job's largest sub-model that has a points file, and how many sub-models there are. Names must be digits.

    Of equal sizes the least number wins. One aggregation with partial results, no window.
    """
    named = models.where(F.col(model).cast("string").rlike("^[0-9]+$"))
    number = F.col(model).cast("decimal(38,0)")
    best = F.max(F.when(F.col(size).isNotNull(), F.struct(F.col(size).alias("size"), (-number).alias("number"), F.col(model).cast("string").alias("name"))))
    return named.groupBy(job).agg(F.count("*").alias("models"), best.alias("best")).select(job, "models", F.col("best.name").alias("model_id"), F.col("best.size").alias("size_bytes"))


def final_artifact(jobs: DataFrame, min_dense: int = MIN_DENSE_BYTES) -> DataFrame:
    """``cloud``: the dense cloud, or the sparse model's where that is missing or small; ``model``: the mesh, or the cloud."""
    dense = F.col("dense_bytes").isNotNull() & (F.col("dense_bytes") >= min_dense)
    jobs = jobs.withColumn("cloud", F.when(dense, F.lit("dense")).when(F.col("sparse_model").isNotNull(), F.lit("sparse")))
    return jobs.withColumn("model", F.coalesce(F.col("mesh_path"), F.col("cloud"))).withColumn("status", F.when(F.col("model").isNull(), "Failed").otherwise("Completed"))


def run_stages(plan: DataFrame, runner: Callable[[str, str, list[str]], tuple[bool, int, str]]) -> DataFrame:
    """Run the injected ``runner(job, stage, args)`` in stage order for each job; results are rows, failures too."""
    names = ["job_id", "stage_no", "stage", "ok", "rc", "stderr"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            jobs, plans, args = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok, rc, stderr = zip(*(runner(j, s, list(a)) for j, s, a in zip(jobs, plans, args, strict=True)), strict=True) if jobs else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ok, pa.bool_()), pa.array(rc, pa.int32()), pa.array(stderr, pa.string())], names)

    rows = plan.select("job_id", F.col("stage_no").cast("int").alias("stage_no"), "stage", "args").repartition("job_id").sortWithinPartitions("job_id", "stage_no")
    return rows.mapInArrow(run, f"job_id {plan.schema['job_id'].dataType.simpleString()}, stage_no int, stage string, ok boolean, rc int, stderr string")
