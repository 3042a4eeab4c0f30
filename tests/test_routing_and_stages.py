from prismgrid.operators import routing, stages


def test_routing(spark):
    rows = [(1, 0, "a.MP4", True), (1, 1, "b.jpg", True), (1, 2, "dir/../b.jpg", True), (1, 3, "c.mov", False), (2, 0, "x.y.avi", True), (2, 1, "noext", True), (3, 0, "c:\\d\\e.png", False)]
    routed = routing.route(spark.createDataFrame(rows, "job_id int, file_idx int, filename string, is_video boolean"))
    assert {(r["job_id"], r["file_idx"]): r["path"] for r in routed.collect()} == {(1, 0): "video_0.MP4", (1, 1): "images/b.jpg", (1, 2): "images/b.jpg", (1, 3): "images/c.mov", (2, 0): "video_0.avi", (2, 1): "images/noext", (3, 0): "images/e.png"}
    assert {tuple(r) for r in routing.stored(routed).where("job_id = 1").collect()} == {(1, "video_0.MP4", 0), (1, "images/b.jpg", 2), (1, "images/c.mov", 3)}
    assert {r["job_id"]: r["is_video"] for r in routing.client_says_video(routed).collect()} == {1: True, 2: False, 3: False}


def test_plan_runs_and_goes_on_after_failures(spark):
    jobs = spark.createDataFrame([("a", "turntable"), ("b", "Turntable"), ("c", None)], "job_id string, scan_mode string")
    plan = stages.stage_plan(jobs)
    args = {(r["job_id"], r["stage"]): " ".join(r["args"]) for r in plan.collect()}
    assert len(args) == 21
    assert "overlap 40" in args["a", "sequential_matcher"] and "overlap 20" in args["b", "sequential_matcher"] and "PINHOLE" in args["c", "feature_extractor"]
    done = spark.createDataFrame([("a", "database"), ("b", "sparse"), ("a", "database")], "job_id string, artifact string")
    left = {(r["job_id"], r["stage"]) for r in stages.pending(plan, done).collect()}
    assert set(args) - left == {("a", "feature_extractor"), ("b", "mapper")}
    ran = stages.run_stages(plan, lambda job, stage, args: (stage != "mapper", 0 if stage != "mapper" else 1, "")).collect()
    assert len(ran) == 21 and sum(not r["ok"] for r in ran) == 3


def test_largest_model_ties_and_gaps(spark):
    rows = [("a", "10", 5), ("a", "9", 5), ("a", "x", 50), ("b", "0", None), ("c", "y", 3)]
    found = {r["job_id"]: (r["models"], r["model_id"], r["size_bytes"]) for r in stages.largest_model(spark.createDataFrame(rows, "job_id string, model_id string, size_bytes long")).collect()}
    assert found == {"a": (2, "9", 5), "b": (1, None, None)}


def test_pairs(spark):
    df = spark.createDataFrame([(0, i) for i in range(6)] + [(1, 0)], "job_id int, frame_id int")
    found = {tuple(r) for r in stages.sequential_pairs(df, 2).collect()}
    assert found == {(0, i, j) for i in range(6) for j in range(i + 1, min(6, i + 3))}


def test_fallback_chain(spark):
    rows = [(1, 5000, "0", "m"), (2, 4999, "0", None), (3, None, None, None), (4, None, "0", None)]
    found = {r["job_id"]: (r["cloud"], r["model"], r["status"]) for r in stages.final_artifact(spark.createDataFrame(rows, "job_id int, dense_bytes long, sparse_model string, mesh_path string")).collect()}
    assert found == {1: ("dense", "m", "Completed"), 2: ("sparse", "sparse", "Completed"), 3: (None, None, "Failed"), 4: ("sparse", "sparse", "Completed")}
