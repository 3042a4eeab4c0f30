"""Configuration: where jobs are kept and where external tools are."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import SparkSession


def storage_path(spark: SparkSession | None = None, default: str = "./jobs") -> str:
    """The session's prismgrid.storage.path, else STORAGE_PATH, else the default."""
    return (spark.conf.get("prismgrid.storage.path", None) if spark else None) or os.environ.get("STORAGE_PATH") or default


def tool_path(name: str, *places: str) -> str:
    """The tool on PATH, else the first of ``places`` that exists, else its bare name."""
    return shutil.which(name) or next((p for p in places if os.path.exists(p)), name)
