"""Job status: an append-only log whose current state is a guarded last write.

Write classes: G is guarded (ignored while the job is cancelled), U always writes, C cancels. G writes never change a
cancelled state, so a G write counts exactly if the latest U or C write before it isn't C: a window decides it.
``strict`` guards U writes too, so that nothing follows a cancellation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The statuses that end polling.
TERMINAL = ("Completed", "Failed", "Cancelled")
#: The steps shown, in order.
HUD = ("Video Processing", "Masking", "Meshing", "AI Analysis")
SCHEMA = "status string, step string, progress int, message string, timestamp double"


def effective(log: DataFrame, strict: bool = False, job: str = "job_id") -> DataFrame:
    """The writes that took effect."""
    before = Window.partitionBy(job).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    if strict:
        cancelled = F.coalesce(F.max((F.col("cls") == "C").cast("int")).over(before), F.lit(0)) == 1
        return log.withColumn("_c", cancelled).where((F.col("cls") == "C") | ~F.col("_c")).drop("_c")
    last = F.last(F.when(F.col("cls").isin("U", "C"), F.col("cls")), ignorenulls=True).over(before)
    return log.withColumn("_last", last).where((F.col("cls") != "G") | F.col("_last").isNull() | (F.col("_last") != "C")).drop("_last")


def current(log: DataFrame, strict: bool = False, job: str = "job_id") -> DataFrame:
    """Each job's current state: its latest effective write, never the furthest progress. One aggregation with partial
    results: the last U or C write and the last write decide it, or with ``strict`` the last C write."""
    row, seq, cls = F.struct(*log.columns), F.col("seq"), F.col("cls")
    last = lambda kept: F.max_by(F.when(kept, row), F.when(kept, seq))
    found = log.groupBy(F.col(job).alias("_job")).agg(F.max_by(row, seq).alias("_any"), last(cls == "C" if strict else cls.isin("U", "C")).alias("_set"))
    state = F.when(F.col("_set.cls") == "C", F.col("_set")).otherwise(F.col("_any"))
    return found.select(state.alias("_state")).select("_state.*")


def lost_cancels(log: DataFrame, job: str = "job_id") -> DataFrame:
    """Cancellations that a later unguarded write undid."""
    after = Window.partitionBy(job).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    undone = F.coalesce(F.max((F.col("cls") == "U").cast("int")).over(after), F.lit(0)) == 1
    return log.withColumn("_u", undone).where((F.col("cls") == "C") & F.col("_u")).select(job, "seq")


def parse(files: DataFrame, body: str = "body") -> DataFrame:
    """Status files: null is "Not Found", unreadable is "Error"."""
    parsed = F.from_json(F.col(body), SCHEMA, {"mode": "PERMISSIVE"})
    rows = files.withColumn("_s", parsed)
    status = F.when(F.col(body).isNull(), "Not Found").when(F.col("_s.status").isNull(), "Error").otherwise(F.col("_s.status"))
    return rows.select(*files.columns, status.alias("status"), "_s.step", "_s.progress", "_s.message", "_s.timestamp")


def response(requests: DataFrame, state: DataFrame, url: str = "http://localhost:8000/files/", job: str = "job_id") -> DataFrame:
    """Each request with its job's state; unknown jobs are "Not Found"; completed ones have a model's address."""
    wanted = requests.withColumn(job, F.trim(F.col(job).cast("string")))
    known = state.withColumn(job, F.col(job).cast("string"))
    joined = wanted.join(known, job, "left").withColumn("status", F.coalesce("status", F.lit("Not Found")))
    return joined.withColumn("model_url", F.when(F.col("status") == "Completed", F.concat(F.lit(url), F.col(job), F.lit("/dense/final_textured_model.ply"))))


def hud(state: DataFrame) -> DataFrame:
    """A row for each shown step: completed beyond (index + 1) * 20, active if it is the current step, else pending."""
    steps = F.posexplode(F.array(*(F.lit(s) for s in HUD)))
    rows = state.select("*", steps.alias("hud_index", "hud_step"))
    shown = F.when(F.col("progress") > (F.col("hud_index") + 1) * 20, "completed").when(F.col("step") == F.col("hud_step"), "active").otherwise("pending")
    return rows.withColumn("hud_state", shown)


def is_terminal(status: Column) -> Column:
    """Whether polling ends; it goes on after "Error" and "Not Found"."""
    return status.isin(*TERMINAL)


def cancel(log: DataFrame, requests: DataFrame, job: str = "job_id") -> DataFrame:
    """Cancel writes for the requested jobs that exist, and the answer to each request."""
    newest = log.groupBy(job).agg(F.max("seq").alias("seq"))
    known = F.col("seq").isNotNull()
    return requests.join(newest, job, "left").select(job, (F.col("seq") + 1).alias("seq"), F.when(known, F.lit("C")).alias("cls"), F.when(known, "Cancelled").alias("status"), F.when(known, "Cancellation requested").otherwise("Job not found").alias("message"))


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes between two epoch seconds, with one decimal."""
    return F.format_string("%.1f", (end - start) / 60)


#: What a full run writes, in order: (write class, status, step, progress).
RUN = (
    ("G", "Processing", "Initializing", 0),
    ("G", "Processing", "Video Processing", 5),
    ("G", "Processing", "Masking", 20),
    ("U", "Processing", "Feature Extraction", 10),
    ("U", "Processing", "Matching", 25),
    ("U", "Processing", "Sparse Reconstruction", 40),
    ("U", "Processing", "Undistorting", 60),
    ("U", "Processing", "Depth Maps", 75),
    ("U", "Processing", "Point Fusion", 90),
    ("U", "Processing", "Fallback", 95),
    ("U", "Processing", "Completed", 100),
    ("G", "Processing", "Meshing", 85),
    ("G", "Completed", "Completed", 100),
)


#: The message of each step; of the two writes of the last step the first one's is "Done.".
MESSAGES = {
    "Initializing": "Uploading files...",
    "Video Processing": "Extracting frames...",
    "Matching": "Matching video frames...",
    "Sparse Reconstruction": "Building sparse model...",
    "Undistorting": "Undistorting images...",
    "Depth Maps": "Calculating depth maps...",
    "Point Fusion": "Fusing points...",
    "Fallback": "Dense failed. Using Sparse model...",
    "Meshing": "Generating textured mesh...",
    "Completed": "Ready to View.",
}
DONE = "Done."
#: Messages that depend on the mode.
MASKING = ("AI removing backgrounds...", "Handheld mode enabled...")


def message_of(cls: str, step: str, mode: Column) -> Column:
    if step == "Feature Extraction":
        return F.concat(F.lit("Extracting ("), mode, F.lit(")..."))
    if step == "Masking":
        return F.when(mode == "turntable", MASKING[0]).otherwise(MASKING[1])
    return F.lit(DONE if (cls, step) == ("U", "Completed") else MESSAGES[step])


def emitted(jobs: DataFrame) -> DataFrame:
    """The writes of a full run of each job (job_id, database, sparse, dense_empty, and scan_mode, else a turntable's):
    stages whose artifact exists are silent, and the fallback speaks only where the dense cloud is empty. A job's
    writes come from its own row, so nothing is shuffled."""
    mode = F.coalesce(F.col("scan_mode"), F.lit("turntable")) if "scan_mode" in jobs.columns else F.lit("turntable")
    each = F.array(*(F.struct(F.lit(c).alias("cls"), F.lit(s).alias("status"), F.lit(step).alias("step"), F.lit(p).alias("progress"), message_of(c, step, mode).alias("message")) for c, s, step, p in RUN))
    silent = lambda w: ((w["step"] == "Feature Extraction") & F.col("database")) | ((w["step"] == "Sparse Reconstruction") & F.col("sparse")) | ((w["step"] == "Fallback") & ~F.col("dense_empty"))
    rows = jobs.select("job_id", F.posexplode(F.filter(each, lambda w: ~silent(w))).alias("seq", "w"))
    return rows.select("job_id", "seq", "w.*")


def bodies(state: DataFrame) -> DataFrame:
    """job_id and the status file's text; absent fields are left out."""
    fields = [c for c in ("status", "step", "progress", "message", "timestamp") if c in state.columns]
    return state.select("job_id", F.to_json(F.struct(*fields)).alias("body"))


def failures(results: DataFrame) -> DataFrame:
    """A guarded Failed write for each job (job_id, error) that has an error."""
    return results.where(F.col("error").isNotNull()).select("job_id", F.lit("G").alias("cls"), F.lit("Failed").alias("status"), F.lit("Failed").alias("step"), F.lit(0).alias("progress"), F.col("error").alias("message"))


def going_on(jobs: DataFrame, state: DataFrame, job: str = "job_id") -> DataFrame:
    """The check between stages: jobs that aren't cancelled."""
    return jobs.join(state.where("status = 'Cancelled'").select(job), job, "left_anti")
