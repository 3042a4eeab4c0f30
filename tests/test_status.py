import random

import pytest

from prismgrid.operators import status
from prismgrid.streaming import status as stream

SCHEMA = "job_id long, seq long, cls string, status string, step string, progress int"


def logs(n=200):
    rng = random.Random(2)
    out = []
    for job in range(n):
        for seq in range(rng.randrange(1, 9)):
            cls = rng.choice("GUC")
            out.append((job, seq, cls, "Cancelled" if cls == "C" else rng.choice(["Processing", "Completed"]), None if cls == "C" else "Masking", None if cls == "C" else rng.randrange(100)))
    return out


def fold(rows, strict):
    now = None
    for r in sorted(rows, key=lambda r: r[1]):
        if now is not None and now[3] == "Cancelled" and (r[2] == "G" or strict and r[2] == "U"):
            continue
        now = r
    return now


@pytest.mark.parametrize("strict", [False, True])
def test_current_equals_the_fold(spark, strict):
    rows = logs()
    found = sorted(tuple(r) for r in status.current(spark.createDataFrame(rows, SCHEMA), strict).select("job_id", "seq", "cls", "status").collect())
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert found == sorted(fold(x, strict)[:4] for x in by.values())


def test_a_cancel_can_be_lost(spark):
    rows = [(1, 0, "U", "Processing", "a", 1), (1, 1, "C", "Cancelled", None, None), (1, 2, "G", "Processing", "b", 2), (1, 3, "U", "Processing", "c", 3), (2, 0, "C", "Cancelled", None, None), (2, 1, "G", "Completed", "d", 100)]
    log = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in status.lost_cancels(log).collect()] == [(1, 1)]
    assert {r["job_id"]: r["seq"] for r in status.current(log).collect()} == {1: 3, 2: 0}
    assert {r["job_id"]: r["seq"] for r in status.current(log, strict=True).collect()} == {1: 1, 2: 0}


def test_parse_and_response(spark):
    bodies = [("a", None), ("b", "{bad"), ("c", '{"status": "Completed", "progress": 100}'), ("d", '{"status": "Cancelled", "message": "m"}'), ("e", "{}")]
    state = status.parse(spark.createDataFrame(bodies, "job_id string, body string"))
    assert {r["job_id"]: r["status"] for r in state.collect()} == {"a": "Not Found", "b": "Error", "c": "Completed", "d": "Cancelled", "e": "Error"}
    asked = spark.createDataFrame([(" c ",), ("zz",)], "job_id string")
    found = {r["job_id"]: (r["status"], r["model_url"]) for r in status.response(asked, state.drop("body")).collect()}
    assert found["zz"] == ("Not Found", None) and found["c"][1].endswith("/c/dense/final_textured_model.ply")


def test_stream_equals_batch(spark, tmp_path):
    rows = logs(40)
    log = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):  # three files, in order
        log.where(f"seq div 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    writes = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = spark.read.parquet(stream.run_available(stream.current_states(writes)))
    newest = {}
    for r in sorted(out.collect(), key=lambda r: r["batch"]):
        newest[r["job_id"]] = (r["seq"], r["status"])
    assert newest == {r["job_id"]: (r["seq"], r["status"]) for r in status.current(log).collect()}
