"""Table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
PACKAGE = "prismgrid-package.zip"
_SCRATCH: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Ship this package to the Python workers, wherever they run; once a session."""
    context = spark.sparkContext
    if PACKAGE in context._python_includes:
        return
    path = os.path.join(SparkFiles.getRootDirectory(), "ship", PACKAGE)  # Spark serves it from here while the session lasts
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(Path(ROOT, "prismgrid").rglob("*.py")):
            out.write(f, f.relative_to(ROOT))
    context.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='prismgrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, in the part that ``clean`` removes; at the driver's exit, if not before."""
    folder = f"{shared_dir(spark)}/prismgrid-{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _remove(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Remove this session's intermediate tables. DataFrames that were returned before can't be read afterwards."""
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), f"{shared_dir(spark)}/prismgrid-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
