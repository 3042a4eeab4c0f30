"""PLY point clouds: a Python data source "ply" (ASCII and binary little-endian), and a scan of files in any store.

``spark.read.format("ply").load(path)`` splits the vertices of a file (or of every .ply file of a folder) into row
ranges. ``df.write.format("ply").save(path)`` writes one file: tasks write rows beside it, the commit joins them under
one header. Both open paths as local files, so on a cluster the folder must be mounted on every node; ``scan_ply``
reads through Spark's own file source instead, one file a row.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Property types of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
COLUMNS = ("x", "y", "z", "nx", "ny", "nz", "red", "green", "blue")
SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("point_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])


@dataclass
class Header:
    binary: bool
    count: int
    fields: list[tuple[str, str]]
    size: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, TYPES[t]) for n, t in self.fields])


def parse_header(data: bytes) -> Header:
    """The header up to the vertices. Raises ValueError for anything that isn't such a file."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    size = data.index(b"\n", end) + 1
    binary, count, fields, element, first = False, 0, [], "", True
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            if words[1] not in ("ascii", "binary_little_endian"):
                raise ValueError(f"unsupported PLY format {words[1]}")
            binary = words[1] != "ascii"
        elif words[:1] == ["element"]:
            element = words[1]
            if element == "vertex":
                if not first:
                    raise ValueError("vertices must come first")
                count = int(words[2])
            first = False
        elif words[:1] == ["property"] and element == "vertex":
            fields.append((words[2], words[1]))
    return Header(binary, count, fields, size)


def parse_columns(header: Header, data: bytes, first: int, last: int) -> list[pa.Array]:
    """``COLUMNS`` of rows first..last, nulls where the file has none; ``data`` begins at row ``first``, or at the first
    row of an ASCII file. A truncated file raises."""
    n = last - first
    if header.binary:
        if len(data) < n * header.dtype.itemsize:
            raise ValueError("truncated PLY file")
        rows = np.frombuffer(data, header.dtype, n)
        found = {c: rows[c].astype(np.float64) for c in rows.dtype.names or ()}
    else:
        lines = data.split(b"\n")
        if len([x for x in lines if x.strip()]) < n:
            raise ValueError("truncated PLY file")
        words = [line.split() for line in lines[first:last]]
        found = {name: np.array([float(w[i]) for w in words]) for i, (name, _) in enumerate(header.fields) if name in COLUMNS}
    return [pa.array(found[c], pa.float64()) if c in found else pa.nulls(n, pa.float64()) for c in COLUMNS]


def parse_rows(header: Header, data: bytes, first: int, last: int) -> Iterator[tuple]:
    """The same as tuples (point_id, columns..)."""
    yield from zip(range(first, last), *(c.to_pylist() for c in parse_columns(header, data, first, last)), strict=True)


def batch_of(path: str, header: Header, data: bytes, first: int, last: int) -> pa.RecordBatch:
    ids = pa.array(np.arange(first, last, dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), last - first), ids, *parse_columns(header, data, first, last)], SCHEMA.names)


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class PlyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"].removeprefix("file://"), int(options.get("rows", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else [os.path.join(d, f) for d, _, names in os.walk(self.path) for f in sorted(names) if f.lower().endswith(".ply")]
        out: list[InputPartition] = []
        for f in files:
            with open(f, "rb") as h:
                header = parse_header(h.read(1 << 16))
            step = self.rows if header.binary else max(1, header.count)  # ASCII rows have no fixed place
            out += [Rows(f, i, min(header.count, i + step)) for i in range(0, header.count, step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as h:
            header = parse_header(h.read(1 << 16))
            wide = header.dtype.itemsize if header.binary else 0
            h.seek(header.size + partition.first * wide)
            data = h.read((partition.last - partition.first) * wide) if header.binary else h.read()
        yield batch_of(partition.path, header, data, partition.first, partition.last)


@dataclass
class Part(WriterCommitMessage):
    path: str
    count: int
    faces: int = 0


class PlyWriter(DataSourceArrowWriter):
    """Rows with x, y, z and, if there, normals and colours, as doubles. Rows with v0, v1, v2 instead are faces: they
    follow all vertices, which they name by their place in partition order (see ``save_mesh``)."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite
        self.names, self.mesh = [c for c in COLUMNS if c in schema.names], "v0" in schema.names
        if not {"x", "y", "z"} <= set(self.names):
            raise ValueError("x, y and z are needed")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        path, count, faces = f"{self.path}.part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "wb") as h, open(f"{path}.faces", "wb") as f:
            for batch in iterator:
                if self.mesh:
                    marked = batch.column("v0").is_valid()
                    corners = batch.filter(marked)
                    made = np.empty(corners.num_rows, [("n", "u1"), ("v", "<i4", 3)])
                    made["n"] = 3
                    for i in range(3):
                        made["v"][:, i] = corners.column(f"v{i}").to_numpy(zero_copy_only=False)
                    f.write(made.tobytes())
                    faces += len(made)
                    batch = batch.filter(pc.invert(marked))
                # nulls become NaN
                columns = [batch.column(c).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in self.names]
                h.write(np.stack(columns, axis=1).astype("<f8").tobytes())
                count += batch.num_rows
        return Part(path, count, faces)

    def commit(self, messages: list) -> None:
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        messages = sorted((m for m in messages if m is not None), key=lambda m: m.path)
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {sum(m.count for m in messages)}", *(f"property double {c}" for c in self.names)]
        if self.mesh:
            lines += [f"element face {sum(m.faces for m in messages)}", "property list uchar int vertex_indices"]
        with open(f"{self.path}.tmp", "wb") as out:
            out.write(("\n".join([*lines, "end_header"]) + "\n").encode())
            for path in [*(m.path for m in messages), *(f"{m.path}.faces" for m in messages)]:
                with open(path, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
        os.replace(f"{self.path}.tmp", self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for path in (p for m in messages if m is not None for p in (m.path, f"{m.path}.faces")):
            if os.path.exists(path):
                os.remove(path)


class PlyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PlyReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return PlyWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlyDataSource)


def scan_ply(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from any store that Spark reads; files that aren't clouds yield no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    header = parse_header(data)
                    made = batch_of(path, header, data[header.size :], 0, header.count)
                except (ValueError, IndexError):
                    continue
                yield made

    return files.mapInArrow(run, SCHEMA)


def save_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One PLY file of a mesh (vertex_id, x, y, z and colours; v0, v1, v2). Faces of missing vertices are left out.

    Vertices are sorted by id; a vertex's place is its rank, found from the sizes of the sorted ranges (two passes,
    one number a range), so no task sees all of them.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from prismgrid.storage import materialize

    names = [c for c in COLUMNS if c in vertices.columns]
    ranged = vertices.select("vertex_id", *names).repartitionByRange("vertex_id").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mesh-vertices")
    sizes, base, bases = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()), 0, []
    for part, n in sizes:
        bases.append((part, base))
        base += n
    placed = ranged.join(F.broadcast(vertices.sparkSession.createDataFrame(bases, "part int, base long")), "part")  # one row a range
    rank = F.row_number().over(Window.partitionBy("part").orderBy("vertex_id")) - 1 + F.col("base")
    placed = placed.withColumn("place", rank)
    at = faces.select("v0", "v1", "v2")
    for i in range(3):
        at = at.join(placed.select(F.col("vertex_id").alias(f"v{i}"), F.col("place").alias(f"p{i}")), f"v{i}")
    none = F.lit(None).cast("long")
    rows = placed.select("place", *names, *(none.alias(f"v{i}") for i in range(3)))
    rows = rows.unionByName(at.select(F.lit(None).cast("long").alias("place"), *(F.lit(None).cast("double").alias(c) for c in names), *(F.col(f"p{i}").alias(f"v{i}") for i in range(3))))
    rows.repartitionByRange(F.asc_nulls_last("place")).sortWithinPartitions(F.asc_nulls_last("place")).drop("place").write.format("ply").mode("append").save(path)
