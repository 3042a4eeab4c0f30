"""One query for each operator, over stand-ins for its entities; parameters are chosen so that every branch fires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismgrid.operators import frames, geometry, images, knn, meshing, routing, stages, status
from prismgrid.plans import files, standins
from prismgrid.sources import media, ply
from prismgrid.storage import importable, materialize, scratch_path, table
from prismgrid.streaming import status as stream

DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def frame_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stride_sample(standins.frames(spark, sf_dir), 20).select("video_id", "frame_no", "pos", "step")


def frame_sharpness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sharp_frames(standins.frames(spark, sf_dir), 40).select("video_id", "frame_no", "sharpness")


def frame_fallback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.extract(standins.frames(spark, sf_dir), 20, 200.0).select("video_id", "frame_no", "pass", "frame_id")


def multi_video_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frames.extract(standins.frames(spark, sf_dir), 20, 200.0, video=["job_id", "video_id"])
    return frames.number_across_videos(kept).select("job_id", "video_id", "frame_id", "frame_no", "name")


def job_frame_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = standins.frames(spark, sf_dir).withColumn("job_id", F.col("video_id"))
    kept = frames.extract(every, 20, 200.0, video=["job_id", "video_id"])
    return frames.frame_totals(every, kept, min_frames=12).select("job_id", "frames", "status")


def laplacian_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return rounded(images.plane_sharpness(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8), "sharpness")


def grayscale_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = standins.points(spark, sf_dir)
    return rounded(p.select("point_id", images.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma")), "luma")


def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda i: F.pmod(F.floor(F.abs(F.col("embedding")[i].cast("double")) * 1000), F.lit(256)).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", level(0).alias("c"), level(1).alias("a"))
    return rows.select("vec_id", images.on_black(F.col("c"), F.col("a")).alias("masked"))


def upload_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(standins.uploads(spark, sf_dir)).select("job_id", "file_idx", "filename", "path")


def upload_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.stored(routing.route(standins.uploads(spark, sf_dir)))


def client_video_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.client_says_video(standins.uploads(spark, sf_dir))


def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.listing(standins.uploads(spark, sf_dir), routing.IMAGE, "filename").select("job_id", "file_idx", "filename")


def mode_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.with_mode_params(standins.jobs(spark, sf_dir)).drop("scan_mode")


def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_plan(standins.jobs(spark, sf_dir)).select("job_id", "stage_no", "stage", F.array_join("args", " ").alias("args"))


def stage_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.pending(stages.stage_plan(standins.jobs(spark, sf_dir)), standins.artifacts(spark, sf_dir)).select("job_id", "stage_no", "stage")


def sequential_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frames.extract(standins.frames(spark, sf_dir), 20, 200.0, video=["job_id", "video_id"])
    numbered = frames.number_across_videos(kept).select("job_id", "frame_id")
    return stages.sequential_pairs(numbered, F.when(F.col("job_id") % 2 == 0, 40).otherwise(20))


def largest_submodel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.largest_model(standins.models(spark, sf_dir))


def dense_or_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 20).cast("long")).alias("dense_bytes"),
        F.when(F.col("o_orderkey") % 3 != 0, F.lit("0")).alias("sparse_model"),
        F.when(F.col("o_orderstatus") == "F", F.lit("mesh.ply")).alias("mesh_path"),
    )
    return stages.final_artifact(rows).select("job_id", "cloud", "model", "status")


def cloud_min_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.enough_points(standins.clouds(spark, sf_dir), 8).select("cloud_id", "point_id")


def outlier_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.remove_outliers(standins.points(spark, sf_dir)).select("point_id")


def cloud_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.centroids(standins.clouds(spark, sf_dir)), "cx", "cy", "cz")


def outward_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    normals = geometry.outward_normals(standins.points(spark, sf_dir)).select("point_id", "nx", "ny", "nz")
    return rounded(normals, "nx", "ny", "nz")


def density_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.density_trim(standins.vertices(spark, sf_dir), 0.1).select("vertex_id")


def color_transfer_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    colored = knn.transfer_colors(standins.vertices(spark, sf_dir), standins.points(spark, sf_dir), MAX_DISTANCE)
    return rounded(colored.select("vertex_id", "point_id", "r", "g", "b"), "r", "g", "b")


#: So that some vertices are far and some near.
MAX_DISTANCE = 0.05


def cleanup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough points, outliers out, normals outwards, sparse vertices off, colours over."""
    cloud = knn.remove_outliers(geometry.enough_points(standins.points(spark, sf_dir)))
    cloud = geometry.outward_normals(cloud)
    mesh = geometry.density_trim(standins.vertices(spark, sf_dir))
    colored = knn.transfer_colors(mesh, cloud, MAX_DISTANCE)
    normals = cloud.select("cloud_id", "point_id", "nx", "ny", "nz")
    return rounded(colored.join(normals, ["cloud_id", "point_id"]).select("vertex_id", "point_id", "r", "g", "b", "nx", "ny", "nz"), "r", "g", "b", "nx", "ny", "nz")


def rotate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.rotate(standins.points(spark, sf_dir)).select("point_id", "x", "z"), "x", "z")


def mesh_vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    normals = geometry.vertex_normals(standins.vertices(spark, sf_dir), standins.faces(spark, sf_dir))
    return rounded(normals.select("vertex_id", "nx", "ny", "nz"), "nx", "ny", "nz")


def job_status_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.current(standins.status_log(spark, sf_dir)).select("job_id", "seq", "status", "step", "progress")


def job_status_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.current(standins.status_log(spark, sf_dir), strict=True).select("job_id", "seq", "status", "step", "progress")


def job_status_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), (F.col("c_custkey") * 2).cast("string"), F.lit(" ")).alias("job_id"))
    state = status.current(standins.status_log(spark, sf_dir)).select("job_id", "status", "step", "progress")
    return status.response(asked, state).select("job_id", "status", "step", "progress", "model_url", status.is_terminal(F.col("status")).alias("polling_ends"))


def hud_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.hud(status.current(standins.status_log(spark, sf_dir))).select("job_id", "hud_step", "hud_state")


def cancel_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.lost_cancels(standins.status_log(spark, sf_dir))


def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("job_id"))
    return status.cancel(standins.status_log(spark, sf_dir), asked)


def status_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props as status files: some are missing, some cut short, some without a status."""
    k = F.col("event_id") % 5
    whole = F.concat(F.lit('{"status": "Processing", "step": "'), F.col("event_type"), F.lit('", "progress": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    body = F.when(k == 1, F.col("props")).when(k == 2, F.lit('{"status": ')).when(k == 3, F.lit('{"status": "Cancelled", "message": "stop"}')).when(k == 4, whole)
    return status.parse(table(spark, sf_dir, "events").select("event_id", body.alias("body"))).select("event_id", "status", "step", "progress", "message")


def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream; the last state emitted for each job equals the batch answer."""
    importable(spark)
    out = spark.read.parquet(stream.run_available(stream.current_states(stream_writes(spark, sf_dir))))
    newest = Window.partitionBy("job_id").orderBy(F.desc("batch"))
    return out.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("job_id", "seq", "status", "step", "progress")


def stream_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of status writes."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    kind = F.col("event_type")
    cls = F.when(kind == "error", "C").when(kind.isin("click", "view"), "U").otherwise("G")
    state = F.when(kind == "error", "Cancelled").when(kind == "purchase", "Completed").otherwise("Processing")
    step = F.when(kind == "view", "Video Processing").when(kind == "click", "Masking").when(kind == "signup", "Meshing").when(kind == "purchase", "Completed")
    progress = F.when(kind != "error", F.pmod(F.floor("value").cast("int"), F.lit(101)))
    return source.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), cls.alias("cls"), state.alias("status"), step.alias("step"), progress.alias("progress"))


def ply_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points written by the "ply" sink and read back by its source."""
    importable(spark)
    ply.register(spark)
    path = scratch_path(spark, "cloud") + ".ply"
    standins.points(spark, sf_dir).select("x", "y", "z").write.format("ply").mode("append").save(path)
    return rounded(spark.read.format("ply").load(path).select("x", "y", "z"), "x", "y", "z", digits=9)


def file_metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.file_metadata(spark, sf_dir, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def run_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full run of each job would write, by the artifacts that it has."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_totalprice") < 100000).alias("database"), (F.col("o_orderkey") % 7 == 0).alias("sparse"), (F.col("o_orderkey") % 5 == 0).alias("dense_empty"))
    return status.emitted(rows).drop("message")


def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that the check between stages lets go on."""
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    return status.going_on(every, status.current(standins.status_log(spark, sf_dir)))


def elapsed_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", status.elapsed_minutes(F.lit(0.0), F.floor(F.col("value")) * 60).alias("minutes"))



def video_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.listing(standins.uploads(spark, sf_dir), routing.VIDEO, "filename").select("job_id", "file_idx", "filename")


def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that hold their files' names, taken apart again."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "filename"))), lambda x: x["filename"])
    requests = standins.uploads(spark, sf_dir).groupBy(F.col("job_id").alias("request_id")).agg(held.alias("files"))
    return routing.each_file(requests)


def new_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each customer: whether the id has its form, the address names it, and how many jobs have it."""
    made = materialize(routing.new_jobs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"))), "new-jobs")
    uses = made.groupBy("job_id").agg(F.count("*").alias("uses"))
    form = F.col("job_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return made.join(uses, "job_id").select("request_id", form.alias("well_formed"), (F.col("status_url") == F.concat(F.lit("/jobs/"), "job_id", F.lit("/status"))).alias("own_url"), "uses")


def nonempty_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests and their orders as files; those without orders do nothing."""
    files = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("files"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")).join(files, "job_id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return routing.nonempty(requests).select("job_id", F.size("files").cast("long").alias("files"))


def failed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("order "), F.col("o_orderkey")))
    return status.failures(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), error.alias("error")))


def stage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users read while a full run of each job goes on."""
    mode = F.when(F.col("o_orderstatus") == "F", "turntable").otherwise("handheld")
    no = F.lit(False)
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), no.alias("database"), no.alias("sparse"), F.lit(True).alias("dense_empty"), mode.alias("scan_mode"))
    return status.emitted(jobs).select("job_id", "step", "message")


def status_json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.bodies(status.current(standins.status_log(spark, sf_dir)))


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of every job by an injected runner, which fails one stage of most jobs."""
    importable(spark)
    run = lambda job, stage, args: (job % 10 != ORDER[stage], int(job % 10 == ORDER[stage]), "")
    return stages.run_stages(stages.stage_plan(standins.jobs(spark, sf_dir)), run).drop("stderr")


ORDER = {name: i for i, (name, _) in enumerate(stages.STAGES)}


def mesh_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds meshed by an injected backend, which takes the first four points and fails on every third cloud; the
    others keep their raw points."""
    importable(spark)

    def backend(rows):
        if rows["cloud_id"].iloc[0] % 3 == 0:
            raise RuntimeError("no surface")
        return rows.sort_values("point_id").head(4).assign(vertex_id=lambda r: r["point_id"], density=1.0)

    points = standins.clouds(spark, sf_dir)
    found = meshing.with_fallback(points, meshing.reconstruct(points, backend, least=8))
    return found.groupBy("cloud_id", "origin").agg(F.count("*").alias("points"))


def status_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log polled every second; each change is handed on, and the last one handed on counts."""
    importable(spark)
    base = scratch_path(spark, "poll")
    writes = stream_writes(spark, sf_dir)
    query = stream.poll(stream.current_states(writes), lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}"), f"{base}/checkpoint", 1)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    newest = F.max_by(F.struct("seq", "status"), "batch").alias("x")
    return spark.read.parquet(f"{base}/rows").groupBy("job_id").agg(newest).select("job_id", "x.seq", "x.status")


ALL = (
    run_writes, running_jobs, elapsed_minutes,
    frame_stride_sample, frame_sharpness_filter, frame_fallback_append, multi_video_numbering, job_frame_totals, laplacian_sharpness, grayscale_luma,
    alpha_composite, upload_routing, upload_last_wins, client_video_detection, image_listing, mode_params, stage_plan, stage_skip, sequential_pairs,
    largest_submodel, dense_or_sparse, cloud_min_points, outlier_removal, cloud_centroid, outward_normals, density_trim, color_transfer_nn, cleanup_chain,
    rotate_points, mesh_vertex_normals, job_status_current, job_status_strict, job_status_response, hud_steps, cancel_lost, cancel_requests,
    status_json_parse, status_stream, ply_roundtrip, file_metadata_scan, video_listing, request_files, new_jobs, nonempty_uploads, failed_writes,
    stage_messages, status_json_bodies, stage_runs, mesh_fallback, status_poll, *files.ALL,
)
