import random

import pytest
from pyspark.sql import functions as F

from prismgrid.operators import frames

SCHEMA = "job_id int, video_id int, nominal int, frame_no int, sharpness double"


def loop(nominal, sharp, target, threshold, start=0, min_kept=5):
    """The sampling loop, restated row by row."""
    n = nominal if nominal and nominal > 0 else 300
    step = max(1, n // target)
    out = [(i, 1) for i in range(0, len(sharp), step) if n < target or (sharp[i] or 0.0) > threshold]
    if len(out) < min_kept:
        out += [(i, 2) for i in range(0, len(sharp), step)]
    return [(start + k, i, p) for k, (i, p) in enumerate(out)]


def videos():
    rng = random.Random(4)
    made = [(n, [rng.choice([1.0, 15.0, 15.1, 40.0, None]) for _ in range(m)]) for n, m in [(0, 300), (-1, 10), (3, 3), (79, 79), (80, 80), (81, 81), (159, 159), (160, 160), (240, 239), (None, 5)]]
    made += [(100, [0.0] * 100), (90, [20.0] * 4 + [0.0] * 86), (90, [20.0] * 5 + [0.0] * 85), (50, [])]
    return made


@pytest.mark.parametrize(("target", "threshold"), [(80, 15.0), (20, 15.0), (100, 39.0)])
def test_extract_equals_the_loop(spark, target, threshold):
    rows = [(v % 3, v, n, i, s) for v, (n, sharp) in enumerate(videos()) for i, s in enumerate(sharp)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = frames.extract(df, target, threshold, video=["job_id", "video_id"])
    numbered = frames.number_across_videos(found)
    got = sorted((r["job_id"], r["video_id"], r["frame_id"], r["frame_no"], r["pass"]) for r in numbered.collect())
    want, totals = [], {}
    for job in range(3):
        start = 0
        for v, (n, sharp) in enumerate(videos()):
            if v % 3 == job:
                kept = loop(n, sharp, target, threshold, start)
                want += [(job, v, k, i, p) for k, i, p in kept]
                start += len(kept)
        totals[job] = start
    assert got == sorted(want)
    assert {p for *_, p in got} == {1, 2}
    jobs = spark.createDataFrame([(0,), (1,), (2,), (9,)], "job_id int")
    assert {r["job_id"]: (r["frames"], r["status"]) for r in frames.frame_totals(jobs, found).collect()} == {j: (n, "Processing" if n >= 10 else "Failed") for j, n in totals.items()} | {9: (0, "Failed")}


def test_frame_names(spark):
    names = spark.createDataFrame([(0,), (12345,)], "i int").select(frames.frame_name(F.col("i")).alias("n")).collect()
    assert [r["n"] for r in names] == ["frame_0000.jpg", "frame_12345.jpg"]


def test_one_shuffle(spark):
    df = spark.createDataFrame([(0, 0, 9, 0, 1.0)], SCHEMA)
    plan = frames.extract(df, video=["job_id", "video_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
