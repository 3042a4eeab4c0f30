"""The test tables read as photogrammetry entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismgrid.storage import table

SUFFIXES = (".mp4", ".MOV", ".avi", ".mkv", ".jpg", ".png")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a video, user % 10 its job, the event id the frame number and the value the sharpness."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), (F.col("user_id") % 10).alias("job_id"), F.col("event_id").alias("frame_no"), F.col("value").alias("sharpness"))
    return events.withColumn("nominal", F.count("*").over(Window.partitionBy("video_id")).cast("int"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a job, the event id the order; the type tells the write's class and status."""
    kind, value = F.col("event_type"), F.col("value")
    cls = F.when(kind == "error", "C").when(kind.isin("click", "view"), "U").otherwise("G")
    status = F.when(kind == "error", "Cancelled").when(kind == "purchase", "Completed").otherwise("Processing")
    step = F.when(kind == "view", "Video Processing").when(kind == "click", "Masking").when(kind == "signup", "Meshing").when(kind == "purchase", "Completed")
    progress = F.when(kind != "error", F.pmod(F.floor(value).cast("int"), F.lit(101)))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), cls.alias("cls"), status.alias("status"), step.alias("step"), progress.alias("progress"))


def _e(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: the first three elements are a place, the next three a colour; all one cloud."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit(0).alias("cloud_id"), F.col("vec_id").alias("point_id"), *(_e(i).alias(c) for i, c in enumerate("xyz")), *(F.abs(_e(3 + i)).alias(c) for i, c in enumerate("rgb")))


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points in a cloud for each (label, vec_id % 7), so that some clouds are too small."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select((F.col("label") * 10 + F.col("vec_id") % 7).cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), *(_e(i).alias(c) for i, c in enumerate("xyz")))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings moved outwards by a half, with their seventh element as density."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit(0).alias("cloud_id"), F.lit(0).alias("mesh_id"), F.col("vec_id").alias("vertex_id"), *((_e(i) * 1.5).alias(c) for i, c in enumerate("xyz")), _e(6).alias("density"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip of triangles over the embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    third = rows.withColumnRenamed("vec_id", "v0")
    made = third.select(F.lit(0).alias("mesh_id"), F.col("v0").alias("face_id"), "v0", (F.col("v0") + 1).alias("v1"), (F.col("v0") + 2).alias("v2"))
    return made.join(rows.select(F.col("vec_id").alias("v2")), "v2", "left_semi")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: two to a name, six suffixes, fifty jobs; every third job says that it uploads videos."""
    name = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2 / 50) * 50 + F.col("doc_id") % 50, F.element_at(F.array(*(F.lit(s) for s in SUFFIXES)), (F.col("doc_id") % 6 + 1).cast("int")))
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("job_id"), F.col("doc_id").alias("file_idx"), name.alias("filename"))
    return rows.withColumn("is_video", F.col("job_id") % 3 == 0)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: one of the three status letters is the turntable."""
    mode = F.when(F.col("o_orderstatus") == "F", "turntable").when(F.col("o_orderstatus") == "O", "handheld")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), mode.alias("scan_mode"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: cheap ones have a database already, every seventh a sparse model."""
    rows = table(spark, sf_dir, "orders")
    database = rows.where("o_totalprice < 100000").select(F.col("o_orderkey").alias("job_id"), F.lit("database").alias("artifact"))
    return database.unionByName(rows.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("sparse").alias("artifact")))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: the customer is the job, the order the sub-model; urgent ones have no points file, every ninth name isn't digits."""
    size = F.when(F.col("o_orderpriority") != "1-URGENT", F.floor(F.col("o_totalprice") / 1000).cast("long"))
    name = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("m"), F.col("o_orderkey"))).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), name.alias("model_id"), size.alias("size_bytes"))
