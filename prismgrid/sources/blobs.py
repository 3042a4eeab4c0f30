"""The sink "blobs": writes each row's ``content`` to ``path`` below the target folder.

Names are made safe (no absolute paths, no parents). Tasks write under temporary names; the commit renames them, so a
retried task leaves no half-written file. Files are never replaced in place unless the mode is overwrite. The folder
must be mounted on every node.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def safe(path: str) -> str:
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", ".", ".."))


@dataclass
class Files(WriterCommitMessage):
    names: list[tuple[str, str]]


class BlobWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.base, self.overwrite = options["path"].removeprefix("file://"), overwrite

    def write(self, rows: Iterator) -> Files:
        from pyspark import TaskContext

        attempt, out = TaskContext.get().taskAttemptId(), []
        for row in rows:
            final = os.path.join(self.base, safe(row["path"]))
            os.makedirs(os.path.dirname(final), exist_ok=True)
            with open(temporary := f"{final}.{attempt}.tmp", "wb") as h:
                h.write(row["content"])
            out.append((temporary, final))
        return Files(out)

    def commit(self, messages: list) -> None:
        pairs = [p for m in messages for p in m.names]
        if not self.overwrite and (there := [f for _, f in pairs if os.path.exists(f)]):
            self.abort(messages)
            raise FileExistsError(there[0])
        for temporary, final in pairs:
            os.replace(temporary, final)

    def abort(self, messages: list) -> None:
        for temporary, _ in (p for m in messages if m is not None for p in m.names):
            if os.path.exists(temporary):
                os.remove(temporary)


class BlobDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlobDataSource)
