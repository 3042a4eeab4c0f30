"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.storage import scratch_path

#: Spark's own limit for a bucketed table.
MOST_BUCKETS = 100_000
BUCKET_BYTES = 256 << 20


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_string(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo ``modulus``; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is held out. A null key is never held out."""
    return F.coalesce(crc_mod(key, modulus) == remainder, F.lit(False))


def batches(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pieces_of(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def append_columns(df: DataFrame, extra: str) -> str:
    """DDL of ``df`` followed by the columns in ``extra``."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), extra])


def materialize_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``: one shuffle here, none of its rows in joins on ``key``.

    There are as many buckets as shuffle partitions, and more where the plan's estimate of ``df`` would otherwise put
    over ``BUCKET_BYTES`` into one. The session's catalog knows the table only until it is read back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # no estimate
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES), MOST_BUCKETS)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name, format="parquet")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def leading(counts: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows of ``counts`` with the largest ``n``.

    A histogram of the counts (steps of about 3 %) gives the least count that so many rows reach, where a distributed
    top-k would send ``size`` rows from every partition.
    """
    steps = counts.withColumn("step", F.floor(F.log(F.col("n")) * 32))
    taken, least = 0, None
    for r in sorted(steps.groupBy("step").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):
        if taken + r["rows"] > size:
            break
        taken, least = taken + r["rows"], r["step"]
    return steps.where(F.col("step") >= least if least is not None else F.lit(False)).drop("step")
