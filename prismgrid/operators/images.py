"""Image measurements in Arrow batches: luma, Laplacian sharpness and compositing on black."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The BT.601 luma weights.
RED, GREEN, BLUE = 0.299, 0.587, 0.114


def luma(red: Column, green: Column, blue: Column) -> Column:
    return RED * red + GREEN * green + BLUE * blue


def luma_plane(bgr: np.ndarray) -> np.ndarray:
    """8-bit luma of an (h, w, 3) blue-green-red image."""
    return np.floor(bgr[..., 2] * RED + bgr[..., 1] * GREEN + bgr[..., 0] * BLUE + 0.5)


def laplacian(planes: np.ndarray) -> np.ndarray:
    """The [0 1 0; 1 -4 1; 0 1 0] stencil over (n, h, w) planes; borders reflect without repeating the edge."""
    mode = ["reflect" if size > 1 else "edge" for size in planes.shape[1:]]
    p = np.pad(planes, ((0, 0), (1, 1), (0, 0)), mode[0])
    q = np.pad(planes, ((0, 0), (0, 0), (1, 1)), mode[1])
    return p[:, :-2] + p[:, 2:] + q[:, :, :-2] + q[:, :, 2:] - 4 * planes


def sharpness_of(planes: np.ndarray) -> np.ndarray:
    """Population variance of the Laplacian of each plane."""
    return laplacian(planes.astype(np.float64)).var(axis=(1, 2))


def plane_sharpness(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """Sharpness of images given as flat arrays of floats, row by row; a null or ragged one has 0."""
    kind = df.schema[key].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = np.zeros(batch.num_rows)
            shapes: dict[int, list[int]] = {}
            rows = batch.column(1).to_pylist()
            for i, v in enumerate(rows):
                if v and len(v) % width == 0 and None not in v:
                    shapes.setdefault(len(v), []).append(i)
            for size, at in shapes.items():
                out[at] = sharpness_of(np.array([rows[i] for i in at], np.float64).reshape(len(at), size // width, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [key, "sharpness"])

    return df.select(key, F.col(values).cast("array<double>").alias("v")).mapInArrow(run, f"`{key}` {kind}, sharpness double")


def image_sharpness(images: DataFrame) -> DataFrame:
    """origin and sharpness of Spark's ``image`` source; images that can't be read have 0."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = []
            for x in batch.to_pylist():
                h, w, c, data = x["height"], x["width"], x["nChannels"], x["data"]
                if not data or h <= 0 or w <= 0 or c not in (1, 3, 4):
                    out.append(0.0)
                    continue
                planes = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                out.append(float(sharpness_of((planes[..., 0] if c == 1 else luma_plane(planes))[None])[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["origin", "sharpness"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "origin string, sharpness double")


def on_black(channel: Column, alpha: Column) -> Column:
    """An 8-bit channel pasted on black with an 8-bit mask: c * a / 255, rounded."""
    t = channel * alpha + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def mask_images(images: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Each image with its background black. ``model()`` is called once a task and returns (h, w, 3) bytes -> (h, w)
    alpha. A failing image yields its error and doesn't stop the others. Columns: origin, height, width, data (blue,
    green, red), error."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alpha_of = model()
        for batch in found:
            data, error = [], []
            for x in batch.to_pylist():
                try:
                    bgr = np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], -1)[..., :3].astype(np.int32)
                    t = bgr * alpha_of(bgr.astype(np.uint8)).astype(np.int32)[..., None] + 128
                    data.append(((t + (t >> 8)) >> 8).astype(np.uint8).tobytes())
                    error.append(None)
                except Exception as e:  # noqa: BLE001  one bad image is a row, not a failure
                    data.append(None)
                    error.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column("origin"), batch.column("height"), batch.column("width"), pa.array(data, pa.binary()), pa.array(error, pa.string())], ["origin", "height", "width", "data", "error"])

    rows = images.select("image.origin", "image.height", "image.width", "image.data")
    return rows.mapInArrow(run, "origin string, height int, width int, data binary, error string")


def png(bgr: np.ndarray) -> bytes:
    """An 8-bit (h, w, 3) image as a PNG file."""
    h, w, _ = bgr.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), bgr[..., ::-1].astype(np.uint8).reshape(h, w * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encoded(masked: DataFrame, version: int) -> DataFrame:
    """path and content of the masked images as PNG files of a new version of their folder; the originals stay, and
    failed images have none."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for x in batch.to_pylist():
                name = x["origin"].rpartition("/")[2].rpartition(".")[0]
                content = png(np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], 3))
                yield pa.RecordBatch.from_arrays([pa.array([f"masked/v{version}/{name}.png"]), pa.array([content], pa.binary())], ["path", "content"])

    return masked.where(F.col("error").isNull()).select("origin", "height", "width", "data").mapInArrow(run, "path string, content binary")


def observed(masked: DataFrame, progress: Observation) -> DataFrame:
    """``masked``, whose next action fills ``progress`` with the counts of masked and failed images."""
    return masked.observe(progress, F.count_if(F.col("error").isNull()).alias("masked"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def mask_counts(masked: DataFrame) -> DataFrame:
    return masked.agg(F.count_if(F.col("error").isNull()).alias("masked"), F.count_if(F.col("error").isNotNull()).alias("failed"))
