import struct
import zlib

import numpy as np
import pytest

from prismgrid.operators import images
from prismgrid.sources import media, ply


def png(path, pixels):
    h, w, c = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_sharpness_of_image_files(spark, tmp_path):
    board = np.repeat((np.indices((6, 8)).sum(axis=0) % 2 * 255)[..., None], 3, axis=2)
    png(tmp_path / "flat.png", np.full((6, 8, 3), 90))
    png(tmp_path / "board.png", board)
    png(tmp_path / "dot.png", np.full((1, 1, 3), 7))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    found = {r["origin"].rsplit("/", 1)[-1]: r["sharpness"] for r in images.image_sharpness(media.images(spark, str(tmp_path))).collect()}
    assert found["flat.png"] == 0 and found["dot.png"] == 0 and min(found.values()) == 0
    sign = np.where(board[..., 0] > 0, -1, 1) * 4.0 * 255
    assert found["board.png"] == pytest.approx(sign.var())


def test_laplacian_by_hand():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(5, 7))
    at = lambda i, j: p[min(abs(i), 8 - i), min(abs(j), 12 - j)]
    want = [[at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * p[i, j] for j in range(7)] for i in range(5)]
    assert np.allclose(images.laplacian(p[None])[0], want)


def test_masking_keeps_going(spark, tmp_path):
    png(tmp_path / "a.png", np.full((2, 3, 3), 200))
    png(tmp_path / "b.png", np.full((5, 5, 3), 200))

    def model():
        def alpha(bgr):
            if bgr.shape[0] == 5:
                raise ValueError("too large")
            return np.array([[0, 128, 255]] * bgr.shape[0], np.uint8)

        return alpha

    masked = images.mask_images(media.images(spark, str(tmp_path)), model)
    found = {r["origin"][-5:]: r for r in masked.collect()}
    assert found["b.png"]["error"] == "too large" and list(found["a.png"]["data"][:9]) == [0] * 3 + [100] * 3 + [200] * 3
    assert tuple(images.mask_counts(masked).first()) == (1, 1)


def test_ply_round_trip(spark, tmp_path):
    ply.register(spark)
    rows = [(float(i), i * 0.1, -float(i), i / 10, i / 20, 0.5) for i in range(25)]
    df = spark.createDataFrame(rows, "x double, y double, z double, red double, green double, blue double").repartition(3)
    path = str(tmp_path / "cloud.ply")
    df.write.format("ply").mode("append").save(path)
    back = spark.read.format("ply").option("rows", 7).load(path)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in back.select("x", "y", "z", "red", "green", "blue").collect()) == sorted(rows)
    assert sorted(r["point_id"] for r in back.collect()) == list(range(25)) and {r["nx"] for r in back.collect()} == {None}
    assert [p.name for p in tmp_path.iterdir()] == ["cloud.ply"]
    scanned = ply.scan_ply(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in scanned.collect()) == sorted(tuple(r)[1:] for r in back.collect())
    with pytest.raises(Exception, match="Exists|exists"):
        df.write.format("ply").mode("append").save(path)


def test_ascii_and_bad_ply(spark, tmp_path):
    ply.register(spark)
    head = "ply\nformat ascii 1.0\ncomment c\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head + "1 2 3 255\n4 5 6 0\n3 0 1 1\n")
    assert [(r["x"], r["z"], r["red"], r["green"]) for r in spark.read.format("ply").load(str(tmp_path / "a.ply")).collect()] == [(1.0, 3.0, 255.0, None), (4.0, 6.0, 0.0, None)]
    (tmp_path / "b.ply").write_bytes(head.replace("ascii", "binary_little_endian").encode() + b"\0" * 5)
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("ply").load(str(tmp_path / "b.ply")).collect()
    (tmp_path / "c.ply").write_text("no")
    assert ply.scan_ply(spark, str(tmp_path)).count() == 2


def test_file_scans(spark, tmp_path):
    for name, size in (("0", 5), ("12", 9), ("x1", 99)):
        (tmp_path / "sparse" / name).mkdir(parents=True)
        (tmp_path / "sparse" / name / "points3D.bin").write_bytes(b"\0" * size)
    assert {(r["model_id"], r["size_bytes"]) for r in media.sub_models(spark, str(tmp_path / "sparse")).collect()} == {("0", 5), ("12", 9)}
    (tmp_path / "jobs" / "j1").mkdir(parents=True)
    (tmp_path / "jobs" / "j1" / "status.json").write_text('{"status": "Failed"}')
    assert [tuple(r) for r in media.status_files(spark, str(tmp_path / "jobs")).collect()] == [("j1", '{"status": "Failed"}')]
