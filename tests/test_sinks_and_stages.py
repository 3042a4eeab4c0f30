import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismgrid import config
from prismgrid.operators import meshing, routing, status
from prismgrid.sources import blobs, media, ply


def test_mesh_file(spark, tmp_path):
    ply.register(spark)
    rows = [(i * 3, float(i), i / 2, 0.0, 0.1) for i in range(40)]
    vertices = spark.createDataFrame(rows, "vertex_id long, x double, y double, z double, red double").repartition(5)
    faces = spark.createDataFrame([(0, 3, 6), (117, 114, 60), (0, 1, 2)], "v0 long, v1 long, v2 long")
    path = tmp_path / "mesh.ply"
    ply.save_mesh(vertices, faces, str(path))
    data = path.read_bytes()
    header = ply.parse_header(data)
    found = list(ply.parse_rows(header, data[header.size :], 0, header.count))
    assert [r[1] for r in found] == [float(i) for i in range(40)]
    tail = np.frombuffer(data[header.size + 40 * header.dtype.itemsize :], np.dtype([("n", "u1"), ("v", "<i4", 3)]))
    assert {tuple(r["v"].tolist()) for r in tail} == {(0, 1, 2), (39, 38, 20)} and set(tail["n"].tolist()) == {3}


def test_blobs(spark, tmp_path):
    blobs.register(spark)
    df = spark.createDataFrame([("images/frame_0001.jpg", b"a"), ("../../x", b"b"), ("c:\\y", b"c")], "path string, content binary")
    df.write.format("blobs").mode("append").save(str(tmp_path / "job"))
    assert sorted(str(p.relative_to(tmp_path / "job")) for p in (tmp_path / "job").rglob("*") if p.is_file()) == ["c:/y", "images/frame_0001.jpg", "x"]
    with pytest.raises(Exception, match="Exists"):
        df.write.format("blobs").mode("append").save(str(tmp_path / "job"))
    df.limit(1).select("path", F.lit(b"z").alias("content")).write.format("blobs").mode("overwrite").save(str(tmp_path / "job"))
    assert (tmp_path / "job/images/frame_0001.jpg").read_bytes() == b"z"


def test_landing_artifacts_and_videos(spark, tmp_path):
    for name, data in {"j1/database.db": b"1", "j1/sparse/0/points3D.bin": b"22", "j1/dense/fused.ply": b"333", "j2/a.MP4": b"\2", "j2/b.mov": b"\0", "j2/c.jpg": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {tuple(r) for r in media.artifacts(spark, str(tmp_path)).collect()} == {("j1", "database", 1), ("j1", "sparse", 2), ("j1", "dense", 3)}
    assert {(r["job_id"], r["filename"]) for r in media.landed(spark, str(tmp_path)).collect()} == {("j1", "database.db"), ("j2", "a.MP4"), ("j2", "b.mov"), ("j2", "c.jpg")}
    assert media.landed(spark, str(tmp_path), stream=True).isStreaming

    def decoder(content):
        if not content[0]:
            raise OSError("can't be opened")
        return -1, (np.full((2, 2, 3), i) for i in range(content[0]))

    frames = media.decode_videos(spark, str(tmp_path), decoder).collect()
    assert [(r["frame_no"], r["nominal"], r["data"][0]) for r in sorted(frames, key=lambda r: r["frame_no"])] == [(0, -1, 0), (1, -1, 1)]


def test_reconstruction_falls_back(spark):
    points = spark.createDataFrame([(c, i, float(i), 0.0, 0.0) for c, n in ((0, 12), (1, 3), (2, 12)) for i in range(n)], "cloud_id int, point_id long, x double, y double, z double")

    def backend(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["cloud_id"].iloc[0] == 2:
            raise RuntimeError
        return rows.head(4).assign(vertex_id=rows["point_id"], density=1.0)

    found = meshing.with_fallback(points, meshing.reconstruct(points, backend)).groupBy("cloud_id", "origin").count()
    assert {tuple(r) for r in found.collect()} == {(0, "mesh", 4), (1, "raw", 3), (2, "raw", 12)}
    assert meshing.with_fallback(points, meshing.reconstruct(points, None)).where("origin = 'raw'").count() == 27


def test_status_writes(spark):
    jobs = spark.createDataFrame([("a", False, False, True), ("b", True, True, False)], "job_id string, database boolean, sparse boolean, dense_empty boolean")
    log = status.emitted(jobs)
    assert {r["job_id"]: r["n"] for r in log.groupBy("job_id").agg(F.count("*").alias("n")).collect()} == {"a": 13, "b": 10}
    state = status.current(log)
    assert {r["status"] for r in state.collect()} == {"Completed"} and status.going_on(jobs, state).count() == 2
    failed = status.failures(spark.createDataFrame([("a", "boom"), ("b", None)], "job_id string, error string")).collect()
    assert [(r["job_id"], r["status"], r["progress"], r["message"]) for r in failed] == [("a", "Failed", 0, "boom")]
    assert spark.range(1).select(status.elapsed_minutes(F.lit(0.0), F.lit(90000.0))).first()[0] == "1500.0"


def test_config_and_empty_uploads(spark, monkeypatch):
    monkeypatch.delenv("STORAGE_PATH", raising=False)
    assert config.storage_path(spark) == "./jobs" and config.tool_path("no-such-tool", "/nowhere", "/bin") == "/bin"
    monkeypatch.setenv("STORAGE_PATH", "/data")
    assert config.storage_path() == "/data"
    requests = spark.createDataFrame([(1, ["a"]), (2, [])], "job_id int, files array<string>")
    assert [r["job_id"] for r in routing.nonempty(requests).collect()] == [1]
