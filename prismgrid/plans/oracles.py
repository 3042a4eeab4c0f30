"""DuckDB SQL for the queries: written from the operators' definitions, independent of the Spark plans."""

from __future__ import annotations

import math

from prismgrid.operators.stages import PLACES, STAGES
from prismgrid.operators.status import HUD, RUN
from prismgrid.plans.catalogue import MAX_DISTANCE
from prismgrid.plans.files import FILE_ORACLES
from prismgrid.plans.standins import SUFFIXES

FRAMES = """
frames AS (SELECT user_id AS video_id, user_id % 10 AS job_id, event_id AS frame_no, value AS sharpness, count(*) OVER (PARTITION BY user_id) AS nominal FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 AS pos, greatest(1, CASE WHEN nominal > 0 THEN nominal ELSE 300 END // {target}) AS step FROM frames),
sampled AS (SELECT * FROM placed WHERE pos % step = 0)"""
EXTRACT = (
    FRAMES.format(target=20)
    + """,
first AS (SELECT *, 1 AS pass FROM sampled WHERE nominal < 20 OR sharpness > 200),
few AS (SELECT video_id FROM (SELECT DISTINCT video_id FROM sampled) v LEFT JOIN (SELECT video_id, count(*) AS n FROM first GROUP BY 1) c USING (video_id) WHERE coalesce(n, 0) < 5),
extracted AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pass, pos) - 1 AS frame_id FROM (SELECT * FROM first UNION ALL SELECT *, 2 AS pass FROM sampled WHERE video_id IN (SELECT video_id FROM few)))"""
)
NUMBERED = (
    EXTRACT
    + """,
starts AS (SELECT job_id, video_id, coalesce(sum(n) OVER (PARTITION BY job_id ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT job_id, video_id, count(*) AS n FROM extracted GROUP BY ALL)),
numbered AS (SELECT job_id, video_id, frame_id + start AS frame_id, frame_no FROM extracted JOIN starts USING (job_id, video_id))"""
)
LOG = """
log AS (SELECT user_id AS job_id, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'C' WHEN event_type IN ('click', 'view') THEN 'U' ELSE 'G' END AS cls,
  CASE event_type WHEN 'error' THEN 'Cancelled' WHEN 'purchase' THEN 'Completed' ELSE 'Processing' END AS status,
  CASE event_type WHEN 'view' THEN 'Video Processing' WHEN 'click' THEN 'Masking' WHEN 'signup' THEN 'Meshing' WHEN 'purchase' THEN 'Completed' END AS step,
  CASE WHEN event_type <> 'error' THEN (floor(value)::INT % 101 + 101) % 101 END AS progress FROM events)"""
STATE = (
    LOG
    + """,
state AS (
  SELECT a.* FROM log a
  WHERE (cls <> 'G' OR coalesce((SELECT arg_max(b.cls, b.seq) FROM log b WHERE b.job_id = a.job_id AND b.seq < a.seq AND b.cls <> 'G'), '') <> 'C')
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1)"""
)
POINTS = """
points AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, abs(embedding[4]::DOUBLE) AS r, abs(embedding[5]::DOUBLE) AS g, abs(embedding[6]::DOUBLE) AS b FROM embeddings),
vertices AS (SELECT vec_id AS vertex_id, embedding[1]::DOUBLE * 1.5 AS x, embedding[2]::DOUBLE * 1.5 AS y, embedding[3]::DOUBLE * 1.5 AS z, embedding[7]::DOUBLE AS density FROM embeddings)"""
CLOUDS = "clouds AS (SELECT (label * 10 + vec_id % 7)::BIGINT AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
CLEAN = (
    POINTS
    + """,
near AS (SELECT p.point_id, sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) AS dist FROM points p, points q QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY dist, q.point_id) <= 50),
means AS (SELECT point_id, avg(dist) AS m FROM near GROUP BY 1),
clean AS (SELECT points.* FROM points JOIN means USING (point_id) WHERE m > 0 AND m < (SELECT avg(m) + coalesce(stddev_samp(m), 0) FROM means))"""
)


def _nearest(cloud: str, mesh: str) -> str:
    return f"""
nearest AS (SELECT v.vertex_id, p.point_id, p.r, p.g, p.b, sqrt((v.x-p.x)*(v.x-p.x) + (v.y-p.y)*(v.y-p.y) + (v.z-p.z)*(v.z-p.z)) AS dist FROM {mesh} v, {cloud} p QUALIFY row_number() OVER (PARTITION BY v.vertex_id ORDER BY dist, p.point_id) = 1),
colored AS (SELECT vertex_id, point_id, CASE WHEN dist > {MAX_DISTANCE} THEN 0.1 ELSE r END AS r, CASE WHEN dist > {MAX_DISTANCE} THEN 0.1 ELSE g END AS g, CASE WHEN dist > {MAX_DISTANCE} THEN 0.1 ELSE b END AS b FROM nearest)"""


def _normals(cloud: str) -> str:
    return f"normals AS (SELECT point_id, (x - cx) / len AS nx, (y - cy) / len AS ny, (z - cz) / len AS nz FROM (SELECT *, nullif(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)), 0) AS len FROM {cloud}, (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {cloud})))"


def _round(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _modes() -> str:
    return "modes(mode, camera_model, peak_threshold, overlap, window_radius) AS (VALUES ('turntable', 'SIMPLE_RADIAL', '0.00001', 40, 7), ('default', 'PINHOLE', '0.01', 20, 11)), jobs AS (SELECT o_orderkey AS job_id, modes.* FROM orders JOIN modes ON mode = CASE WHEN o_orderstatus = 'F' THEN 'turntable' ELSE 'default' END)"


def _plan() -> str:
    def text(args: tuple[str, ...]) -> str:
        out = []
        for a in args:
            name = a[1:-1]
            out.append(f"'{a}'" if a[0] != "{" else f"job_id || '{PLACES[name]}'" if name in PLACES else f"{name}::VARCHAR")
        return " || ' ' || ".join(out)

    return _modes() + ", plan AS (" + " UNION ALL ".join(f"SELECT job_id, {i} AS stage_no, '{name}' AS stage, {text(args)} AS args FROM jobs" for i, (name, args) in enumerate(STAGES)) + ")"


_SUFFIX = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END"
UPLOADS = f"""
uploads AS (SELECT doc_id % 50 AS job_id, doc_id AS file_idx, 'f' || (floor(doc_id / 2.0 / 50)::BIGINT * 50 + doc_id % 50) || {_SUFFIX} AS filename, doc_id % 50 % 3 = 0 AS is_video FROM documents),
routed AS (SELECT *, CASE WHEN is_video AND regexp_matches(lower(filename), '\\.(mp4|mov|avi|mkv)$') THEN 'video_' || file_idx || regexp_extract(filename, '\\.[^.]*$') ELSE 'images/' || filename END AS path FROM uploads)"""

LAPLACIAN = """
WITH cells AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, embedding AS e, i FROM embeddings, unnest(range(64)) AS u(i)),
sums AS (SELECT vec_id,
  e[(7 - abs(7 - abs(r - 1))) * 8 + c + 1]::DOUBLE + e[(7 - abs(7 - abs(r + 1))) * 8 + c + 1]::DOUBLE + e[r * 8 + 7 - abs(7 - abs(c - 1)) + 1]::DOUBLE + e[r * 8 + 7 - abs(7 - abs(c + 1)) + 1]::DOUBLE - 4 * e[i + 1]::DOUBLE AS l FROM cells)
SELECT vec_id, round(var_pop(l), 6) + 0.0 AS sharpness FROM sums GROUP BY vec_id"""

ORACLES = {
    "frame_stride_sample": f"WITH {FRAMES.format(target=20)} SELECT video_id, frame_no, pos, step FROM sampled",
    "frame_sharpness_filter": f"WITH {FRAMES.format(target=40)} SELECT video_id, frame_no, sharpness FROM sampled WHERE nominal < 40 OR sharpness > 15",
    "frame_fallback_append": f"WITH {EXTRACT} SELECT video_id, frame_no, pass, frame_id FROM extracted",
    "multi_video_numbering": f"WITH {NUMBERED} SELECT job_id, video_id, frame_id, frame_no, 'frame_' || CASE WHEN frame_id < 10000 THEN lpad(frame_id::VARCHAR, 4, '0') ELSE frame_id::VARCHAR END || '.jpg' AS name FROM numbered",
    "job_frame_totals": f"WITH {EXTRACT} SELECT video_id AS job_id, coalesce(n, 0) AS frames, CASE WHEN coalesce(n, 0) < 12 THEN 'Failed' ELSE 'Processing' END AS status FROM (SELECT DISTINCT video_id FROM frames) v LEFT JOIN (SELECT video_id, count(*) AS n FROM extracted GROUP BY 1) c USING (video_id)",
    "laplacian_sharpness": LAPLACIAN,
    "grayscale_luma": f"WITH {POINTS} SELECT point_id, round(0.299 * r + 0.587 * g + 0.114 * b, 6) + 0.0 AS luma FROM points",
    "alpha_composite": "WITH l AS (SELECT vec_id, floor(abs(embedding[1]::DOUBLE) * 1000)::BIGINT % 256 AS c, floor(abs(embedding[2]::DOUBLE) * 1000)::BIGINT % 256 AS a FROM embeddings) SELECT vec_id, (c * a + 128 + ((c * a + 128) >> 8)) >> 8 AS masked FROM l",
    "upload_routing": f"WITH {UPLOADS} SELECT job_id, file_idx, filename, path FROM routed",
    "upload_last_wins": f"WITH {UPLOADS} SELECT job_id, path, max(file_idx) AS file_idx FROM routed GROUP BY ALL",
    "client_video_detection": f"WITH {UPLOADS} SELECT job_id, bool_or(lower(filename) LIKE '%.mp4') AS is_video FROM uploads GROUP BY ALL",
    "image_listing": f"WITH {UPLOADS} SELECT job_id, file_idx, filename FROM uploads WHERE regexp_matches(lower(filename), '\\.(jpg|jpeg|png)$')",
    "mode_params": f"WITH {_modes()} SELECT * FROM jobs",
    "stage_plan": f"WITH {_plan()} SELECT * FROM plan",
    "stage_skip": f"WITH {_plan()} SELECT job_id, stage_no, stage FROM plan JOIN orders ON o_orderkey = job_id WHERE NOT (stage = 'feature_extractor' AND o_totalprice < 100000) AND NOT (stage = 'mapper' AND o_orderkey % 7 = 0)",
    "sequential_pairs": f"WITH {NUMBERED} SELECT a.job_id, a.frame_id AS image_a, b.frame_id AS image_b FROM numbered a JOIN numbered b ON a.job_id = b.job_id AND b.frame_id > a.frame_id AND b.frame_id <= a.frame_id + CASE WHEN a.job_id % 2 = 0 THEN 40 ELSE 20 END",
    "largest_submodel": """WITH models AS (SELECT o_custkey AS job_id, o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN floor(o_totalprice / 1000)::BIGINT END AS size_bytes FROM orders WHERE o_orderkey % 9 <> 0),
best AS (SELECT * FROM models WHERE size_bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY size_bytes DESC, o_orderkey) = 1)
SELECT job_id, models, best.o_orderkey::VARCHAR AS model_id, size_bytes FROM (SELECT job_id, count(*) AS models FROM models GROUP BY 1) LEFT JOIN best USING (job_id)""",
    "dense_or_sparse": """WITH a AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 <> 0 AND floor(o_totalprice / 20) >= 5000 THEN 'dense' WHEN o_orderkey % 3 <> 0 THEN 'sparse' END AS cloud, CASE WHEN o_orderstatus = 'F' THEN 'mesh.ply' END AS mesh FROM orders)
SELECT job_id, cloud, coalesce(mesh, cloud) AS model, CASE WHEN coalesce(mesh, cloud) IS NULL THEN 'Failed' ELSE 'Completed' END AS status FROM a""",
    "cloud_min_points": f"WITH {CLOUDS} SELECT cloud_id, point_id FROM clouds QUALIFY count(*) OVER (PARTITION BY cloud_id) >= 8",
    "outlier_removal": f"WITH {CLEAN} SELECT point_id FROM clean",
    "cloud_centroid": f"WITH {CLOUDS}, c AS (SELECT cloud_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM clouds GROUP BY 1) SELECT cloud_id, {_round('cx', 'cy', 'cz')} FROM c",
    "outward_normals": f"WITH {POINTS}, {_normals('points')} SELECT point_id, {_round('nx', 'ny', 'nz')} FROM normals",
    "density_trim": f"WITH {POINTS} SELECT vertex_id FROM vertices WHERE density >= (SELECT quantile_cont(density, 0.1) FROM vertices)",
    "color_transfer_nn": f"WITH {POINTS}, {_nearest('points', 'vertices')} SELECT vertex_id, point_id, {_round('r', 'g', 'b')} FROM colored",
    "cleanup_chain": f"WITH {CLEAN}, {_normals('clean')}, mesh AS (SELECT * FROM vertices WHERE density >= (SELECT quantile_cont(density, 0.01) FROM vertices)), {_nearest('clean', 'mesh')} SELECT vertex_id, point_id, {_round('r', 'g', 'b', 'nx', 'ny', 'nz')} FROM colored JOIN normals USING (point_id) WHERE (SELECT count(*) FROM points) >= 10",
    "rotate_points": f"WITH {POINTS}, turned AS (SELECT point_id, x * {math.cos(0.005)!r}::DOUBLE - z * {math.sin(0.005)!r}::DOUBLE AS x, x * {math.sin(0.005)!r}::DOUBLE + z * {math.cos(0.005)!r}::DOUBLE AS z FROM points) SELECT point_id, {_round('x', 'z')} FROM turned",
    "mesh_vertex_normals": f"""WITH {POINTS}, faces AS (SELECT vec_id AS v0, vec_id + 1 AS v1, vec_id + 2 AS v2 FROM embeddings),
edges AS (SELECT v0, v1, v2, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS wx, c.y-a.y AS wy, c.z-a.z AS wz FROM faces JOIN vertices a ON a.vertex_id = v0 JOIN vertices b ON b.vertex_id = v1 JOIN vertices c ON c.vertex_id = v2),
crossed AS (SELECT unnest([v0, v1, v2]) AS vertex_id, uy*wz - uz*wy AS fx, uz*wx - ux*wz AS fy, ux*wy - uy*wx AS fz FROM edges),
total AS (SELECT vertex_id, sum(fx) AS sx, sum(fy) AS sy, sum(fz) AS sz FROM crossed GROUP BY 1),
normal AS (SELECT vertex_id, sx / len AS nx, sy / len AS ny, sz / len AS nz FROM (SELECT *, nullif(sqrt(sx*sx + sy*sy + sz*sz), 0) AS len FROM total))
SELECT vertex_id, {_round('nx', 'ny', 'nz')} FROM normal""",
    "job_status_current": f"WITH {STATE} SELECT job_id, seq, status, step, progress FROM state",
    "job_status_strict": f"WITH {LOG} SELECT job_id, seq, status, step, progress FROM log a WHERE cls = 'C' OR NOT EXISTS (SELECT 1 FROM log b WHERE b.job_id = a.job_id AND b.seq < a.seq AND b.cls = 'C') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1",
    "job_status_response": f"WITH {STATE}, asked AS (SELECT c_custkey * 2 AS job FROM customer) SELECT job::VARCHAR AS job_id, coalesce(status, 'Not Found') AS status, step, progress, CASE WHEN status = 'Completed' THEN 'http://localhost:8000/files/' || job || '/dense/final_textured_model.ply' END AS model_url, coalesce(status, '') IN ('Completed', 'Failed', 'Cancelled') AS polling_ends FROM asked LEFT JOIN state ON job_id = job",
    "hud_steps": f"WITH {STATE}, hud(i, hud_step) AS (VALUES {', '.join(f'({i}, {s!r})' for i, s in enumerate(HUD))}) SELECT job_id, hud_step, CASE WHEN progress > (i + 1) * 20 THEN 'completed' WHEN step = hud_step THEN 'active' ELSE 'pending' END AS hud_state FROM state, hud",
    "cancel_lost": f"WITH {LOG} SELECT job_id, seq FROM log a WHERE cls = 'C' AND EXISTS (SELECT 1 FROM log b WHERE b.job_id = a.job_id AND b.seq > a.seq AND b.cls = 'U')",
    "cancel_requests": "WITH n AS (SELECT user_id, max(event_id) + 1 AS seq FROM events GROUP BY 1) SELECT c_custkey * 2 AS job_id, seq, CASE WHEN seq IS NOT NULL THEN 'C' END AS cls, CASE WHEN seq IS NOT NULL THEN 'Cancelled' END AS status, CASE WHEN seq IS NOT NULL THEN 'Cancellation requested' ELSE 'Job not found' END AS message FROM customer LEFT JOIN n ON user_id = c_custkey * 2",
    "status_json_parse": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Not Found' WHEN 3 THEN 'Cancelled' WHEN 4 THEN 'Processing' ELSE 'Error' END AS status,
CASE WHEN event_id % 5 = 4 THEN event_type END AS step, CASE WHEN event_id % 5 = 4 THEN event_id % 100 END AS progress, CASE WHEN event_id % 5 = 3 THEN 'stop' END AS message FROM events""",
    "status_stream": f"WITH {STATE} SELECT job_id, seq, status, step, progress FROM state",
    "run_writes": f"WITH run(place, cls, status, step, progress) AS (VALUES {', '.join(f'({i}, {c!r}, {t!r}, {step!r}, {p})' for i, (c, t, step, p) in enumerate(RUN))}) SELECT o_orderkey AS job_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY place) - 1 AS seq, cls, status, step, progress FROM orders, run WHERE NOT (step = 'Feature Extraction' AND o_totalprice < 100000) AND NOT (step = 'Sparse Reconstruction' AND o_orderkey % 7 = 0) AND NOT (step = 'Fallback' AND o_orderkey % 5 <> 0)",
    "running_jobs": f"WITH {STATE} SELECT c_custkey AS job_id FROM customer WHERE c_custkey NOT IN (SELECT job_id FROM state WHERE status = 'Cancelled')",
    "elapsed_minutes": "SELECT event_id, printf('%.1f', floor(value)) AS minutes FROM events",
    "video_listing": f"WITH {UPLOADS} SELECT job_id, file_idx, filename FROM uploads WHERE regexp_matches(lower(filename), '\\.(mp4|mov|avi|mkv)$')",
    "request_files": f"WITH {UPLOADS} SELECT job_id AS request_id, filename, row_number() OVER (PARTITION BY job_id ORDER BY file_idx) - 1 AS file_idx FROM uploads",
    "new_jobs": "SELECT c_custkey AS request_id, true AS well_formed, true AS own_url, 1 AS uses FROM customer",
    "nonempty_uploads": "SELECT c_custkey AS job_id, count(*) AS files FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "failed_writes": "SELECT o_orderkey AS job_id, 'G' AS cls, 'Failed' AS status, 'Failed' AS step, 0 AS progress, 'order ' || o_orderkey AS message FROM orders WHERE o_orderstatus = 'F'",
    "stage_messages": """SELECT o_orderkey AS job_id, step, m AS message FROM orders, (VALUES ('Initializing', 'Uploading files...'), ('Video Processing', 'Extracting frames...'), ('Masking', NULL), ('Feature Extraction', NULL), ('Matching', 'Matching video frames...'), ('Sparse Reconstruction', 'Building sparse model...'), ('Undistorting', 'Undistorting images...'), ('Depth Maps', 'Calculating depth maps...'), ('Point Fusion', 'Fusing points...'), ('Fallback', 'Dense failed. Using Sparse model...'), ('Completed', 'Done.'), ('Meshing', 'Generating textured mesh...'), ('Completed', 'Ready to View.')) v(step, text),
LATERAL (SELECT CASE WHEN step = 'Masking' THEN CASE WHEN o_orderstatus = 'F' THEN 'AI removing backgrounds...' ELSE 'Handheld mode enabled...' END WHEN step = 'Feature Extraction' THEN 'Extracting (' || CASE WHEN o_orderstatus = 'F' THEN 'turntable' ELSE 'handheld' END || ')...' ELSE text END AS m)""",
    "status_json_bodies": f"WITH {STATE} SELECT job_id, '{{\"status\":\"' || status || '\"' || coalesce(',\"step\":\"' || step || '\"', '') || coalesce(',\"progress\":' || progress, '') || '}}' AS body FROM state",
    "stage_runs": f"WITH {_plan()} SELECT job_id, stage_no, stage, job_id % 10 <> stage_no AS ok, CASE WHEN job_id % 10 = stage_no THEN 1 ELSE 0 END AS rc FROM plan",
    "mesh_fallback": f"WITH {CLOUDS}, sized AS (SELECT *, count(*) OVER (PARTITION BY cloud_id) AS n, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) AS k FROM clouds) SELECT cloud_id, CASE WHEN n >= 8 AND cloud_id % 3 <> 0 THEN 'mesh' ELSE 'raw' END AS origin, count(*) AS points FROM sized WHERE NOT (n >= 8 AND cloud_id % 3 <> 0 AND k > 4) GROUP BY ALL",
    "status_poll": f"WITH {STATE} SELECT job_id, seq, status FROM state",
    "ply_roundtrip": f"WITH {POINTS} SELECT {_round('x', 'y', 'z', digits=9)} FROM points",
}
ORACLES |= FILE_ORACLES
