"""Further relations and statements in the form of ``sql``: agents and their futures, feature vectors,
composite evaluations, geometry, selections over rounds."""

from __future__ import annotations

#: Steps of an agent's future, and of the ego plan.
FUTURE, PLAN = 12, 6

_ago = "PARTITION BY scene, inst ORDER BY ts, sample"
_offsets = ", ".join(f"CASE WHEN lead(x, {k}) OVER w IS NULL THEN 0 ELSE lead(x, {k}) OVER w - lead(x, {k - 1}) OVER w END AS dx{k}, CASE WHEN lead(y, {k}) OVER w IS NULL THEN 0 ELSE lead(y, {k}) OVER w - lead(y, {k - 1}) OVER w END AS dy{k}" for k in range(1, FUTURE + 1))
_steps = " + ".join(f"CASE WHEN lead(x, {k}) OVER w IS NULL THEN 0 ELSE 1 END" for k in range(1, FUTURE + 1))
_moved = " + ".join(f"sqrt(dx{k} * dx{k} + dy{k} * dy{k})" for k in range(1, FUTURE + 1))
_six = ("x", "y", "step_speed", "cumulative", "cmd", "mask")

#: Separating axes of two rectangles: u from a to b, d the difference of yaw, half lengths and widths.
_apart = """abs(ux * cos(ya) + uy * sin(ya)) <= hla + hlb * abs(cos(d)) + hwb * abs(sin(d)) AND abs(-ux * sin(ya) + uy * cos(ya)) <= hwa + hlb * abs(sin(d)) + hwb * abs(cos(d))
    AND abs(ux * cos(yb) + uy * sin(yb)) <= hlb + hla * abs(cos(d)) + hwa * abs(sin(d)) AND abs(-ux * sin(yb) + uy * cos(yb)) <= hwb + hla * abs(sin(d)) + hwa * abs(cos(d))"""


def _yaw(x: str, y: str) -> str:
    """The yaw of a plan's steps: central differences from the origin on, the last backward; fixed if it hardly moves."""
    return f"""SELECT token, step, {x} AS x, {y} AS y, CASE WHEN sqrt(power(last_value({x}) OVER f - first_value({x}) OVER f, 2) + power(last_value({y}) OVER f - first_value({y}) OVER f, 2)) < 0.5 THEN pi() / 2
        ELSE atan2(coalesce(lead({y}) OVER w, {y}) - lag({y}, 1, 0) OVER w, coalesce(lead({x}) OVER w, {x}) - lag({x}, 1, 0) OVER w) END AS yaw FROM plans
        WINDOW w AS (PARTITION BY token ORDER BY step), f AS (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _hit(poses: str) -> str:
    """Whether the ego box (4.084 x 1.85, half a metre ahead) meets an agent's box of its sample and step."""
    return f"""SELECT token, step, max(CASE WHEN {_apart} THEN 1 ELSE 0 END) AS hit FROM (SELECT e.token, e.step, a.x - e.x - 0.5 * cos(e.yaw) AS ux, a.y - e.y - 0.5 * sin(e.yaw) AS uy, a.yaw - e.yaw AS d, e.yaw AS ya, a.yaw AS yb,
        2.042 AS hla, 0.925 AS hwa, a.len / 2 AS hlb, a.w / 2 AS hwb FROM {poses} e JOIN agents a ON a.token = e.token AND a.step = e.step) p GROUP BY token, step"""


BASE = {
    "objects": "SELECT l_orderkey AS token, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS obj, l_quantity - 25 AS x, l_extendedprice / 1000 - 50 AS y, l_tax * 10 AS z, 1 + l_discount * 10 AS w, 2 + l_tax * 10 AS l, 1.5 + l_discount AS h, l_tax * 100 - 4 AS vx, l_discount * 100 - 5 AS vy, CAST(l_suppkey % 4 AS INT) AS pts, CAST(l_partkey % 11 - 1 AS INT) AS label, l_discount * 10 AS score, l_returnflag <> 'R' AS valid FROM {lineitem}",
    "tracks": "SELECT o_custkey AS scene, o_orderkey AS sample, o_orderdate AS ts, l_suppkey % 5 AS inst, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / count(*) AS x, CAST(sum(CAST(round(l_extendedprice / 1000) AS BIGINT)) AS DOUBLE) / count(*) AS y FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate, l_suppkey % 5",
    "futures": f"SELECT scene, sample, inst, {_offsets}, {_steps} AS steps FROM tracks WINDOW w AS ({_ago})",
    "ego_rows": "SELECT token, step, x / 10 AS x, y / 10 AS y, sqrt(power((x - lag(x, 1, 0) OVER w) / 10, 2) + power((y - lag(y, 1, 0) OVER w) / 10, 2)) AS step_speed, sqrt(x * x + y * y) / 10 AS cumulative, CAST(token % 3 AS DOUBLE) AS cmd, CAST(1 AS DOUBLE) AS mask FROM steps WHERE step <= 6 WINDOW w AS (PARTITION BY token ORDER BY step)",
    "plans": f"SELECT token, step, sum(dx) OVER w * 40 AS gx, sum(dy) OVER w * 40 AS gy, sum(dx) OVER w * 40 + x / 50 AS px, sum(dy) OVER w * 40 + y / 100 AS py FROM (SELECT *, count(*) OVER (PARTITION BY token) AS n FROM steps) s WHERE n >= {PLAN} AND step <= {PLAN} WINDOW w AS (PARTITION BY token ORDER BY step)",
    "agents": "SELECT a.token, p.step, a.x / 2 + p.step AS x, a.y / 2 AS y, a.w, a.l AS len, atan2(a.vy + 0.1, a.vx + 0.1) AS yaw FROM objects a JOIN plans p ON p.token = a.token",
    "gt_poses": _yaw("gx", "gy"),
    "plan_poses": _yaw("px", "py"),
    "gt_hits": _hit("gt_poses"),
    "plan_hits": _hit("plan_poses"),
    "plan_steps": "SELECT p.step, avg(sqrt(power(p.px - p.gx, 2) + power(p.py - p.gy, 2))) AS l2, avg(CAST(coalesce(g.hit, 0) AS DOUBLE)) AS obj_col, avg(CASE WHEN coalesce(h.hit, 0) = 1 AND coalesce(g.hit, 0) = 0 THEN 1.0 ELSE 0.0 END) AS obj_box_col FROM plans p LEFT JOIN gt_hits g ON g.token = p.token AND g.step = p.step LEFT JOIN plan_hits h ON h.token = p.token AND h.step = p.step GROUP BY p.step",
    # map lines: all lines are ground truth; predictions are all lines, shifted
    "segments": "SELECT line, label, step, x, y, nx, ny, sqrt(power(nx - x, 2) + power(ny - y, 2)) AS d FROM (SELECT line, label, step, x, y, lead(x) OVER (PARTITION BY line ORDER BY step) AS nx, lead(y) OVER (PARTITION BY line ORDER BY step) AS ny FROM points) a WHERE nx IS NOT NULL",
    "lengths": "SELECT *, coalesce(sum(d) OVER (PARTITION BY line ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, sum(d) OVER (PARTITION BY line) AS total FROM segments",
    "resampled": "SELECT line, label, k, x0 + (x1 - x0) * t AS x, y0 + (y1 - y0) * t AS y FROM (SELECT p.line, p.label, g.k, p.x AS x0, p.y AS y0, p.nx AS x1, p.ny AS y1, CASE WHEN p.d > 0 THEN (g.k / 9.0 * p.total - p.upto) / p.d ELSE 0 END AS t, row_number() OVER (PARTITION BY p.line, g.k ORDER BY p.step DESC) AS rn FROM lengths p CROSS JOIN (SELECT $series(0, 9) AS k) g WHERE p.upto <= g.k / 9.0 * p.total + 1e-9) t WHERE rn = 1",
    "map_gt": "SELECT line % 20 AS frame, line, label, k, x, y FROM resampled",
    "map_pred": "SELECT line % 20 AS frame, line, label, k, x + (line % 7) * 0.15 AS x, y FROM resampled",
    # at 200 points a line, as arrays: a frame has 25 lines however many there are, so that pairs grow with the lines
    "fine": "SELECT line, label, k, x0 + (x1 - x0) * t AS x, y0 + (y1 - y0) * t AS y FROM (SELECT p.line, p.label, g.k, p.x AS x0, p.y AS y0, p.nx AS x1, p.ny AS y1, CASE WHEN p.d > 0 THEN (g.k / 199.0 * p.total - p.upto) / p.d ELSE 0 END AS t, row_number() OVER (PARTITION BY p.line, g.k ORDER BY p.step DESC) AS rn FROM lengths p CROSS JOIN (SELECT $series(0, 199) AS k) g WHERE p.upto <= g.k / 199.0 * p.total + 1e-9) t WHERE rn = 1",
    "map_arrays": "SELECT CAST(floor(line / 25.0) AS BIGINT) AS frame, line, label, $listed(k, x, y) AS g, $listed(k, x + (line % 7) * 0.15, y) AS p FROM fine GROUP BY line, label",
    "map_pairs": "SELECT a.frame, a.label, a.line AS pred, b.line AS gt, ($near(a.p, b.g) + $near(b.g, a.p)) / 2 AS distance FROM map_arrays a JOIN map_arrays b ON b.frame = a.frame AND b.label = a.label",
    "map_nearest": "SELECT frame, label, pred, gt, distance, CAST(pred * 7919 % 1000 AS DOUBLE) / 1000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame, label, pred ORDER BY round(distance, 9), gt) AS rn FROM map_pairs) t WHERE rn = 1",
    # the single nearest line counts: the most confident prediction within the threshold takes it
    "map_tp": "SELECT label, thr, pred, score, CASE WHEN near = 1 AND row_number() OVER (PARTITION BY frame, label, thr, gt, near ORDER BY score DESC, pred) = 1 THEN 1 ELSE 0 END AS tp FROM (SELECT n.*, t.thr, CASE WHEN round(distance, 9) <= t.thr THEN 1 ELSE 0 END AS near FROM map_nearest n CROSS JOIN (SELECT CAST(0.5 AS DOUBLE) AS thr UNION ALL SELECT CAST(1.0 AS DOUBLE) UNION ALL SELECT CAST(1.5 AS DOUBLE)) t) a",
    "map_curve": "SELECT t.label, t.thr, t.pred, t.score, CAST(sum(t.tp) OVER w AS DOUBLE) / g.n AS recall, CAST(sum(t.tp) OVER w AS DOUBLE) / count(*) OVER w AS prec FROM map_tp t JOIN (SELECT label, count(DISTINCT line) AS n FROM map_gt GROUP BY label) g ON g.label = t.label WINDOW w AS (PARTITION BY t.label, t.thr ORDER BY t.score DESC, t.pred ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "map_area": "SELECT label, thr, sum((recall - before) * env) AS ap FROM (SELECT label, thr, recall, lag(recall, 1, CAST(0 AS DOUBLE)) OVER (PARTITION BY label, thr ORDER BY score DESC, pred) AS before, max(prec) OVER (PARTITION BY label, thr ORDER BY score, pred DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS env FROM map_curve) t GROUP BY label, thr",
    "rounds": "SELECT l_linenumber AS round, l_orderkey AS pos, l_partkey AS token FROM {lineitem}",
}

QUERIES = {
    # scans and lookups
    "point_lookup": "SELECT sample_token, scene_token, split, domain_id FROM manifest WHERE sample_token = 33",
    "feature_gather": "SELECT g.pos, g.token, e.embedding FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id DESC) AS BIGINT) AS pos, doc_id AS token FROM {labels}) g JOIN {embeddings} e ON e.vec_id = g.token",
    "manifest_features": "SELECT m.sample_token, coalesce(CAST(e.label AS DOUBLE), m.teacher_loss) AS teacher_loss, e.embedding IS NULL AS missing FROM manifest m LEFT JOIN {embeddings} e ON e.vec_id = m.sample_token",
    "resolved_paths": "SELECT page_id, CASE WHEN p LIKE '/%' THEN p ELSE '/data/' || p END AS path FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/abs/' || regexp_replace(url, '^.*/', '') ELSE regexp_replace(url, '^.*/', '') END AS p FROM {pages}) t",
    "token_index": "SELECT sample_token, CAST(row_number() OVER (ORDER BY ts, sample_token) - 1 AS BIGINT) AS idx FROM manifest",
    "scene_order": "SELECT scene_token, ts, sample_token, CAST(row_number() OVER (PARTITION BY scene_token ORDER BY ts, sample_token) AS BIGINT) AS place FROM manifest",
    "head_per_split": "SELECT split, sample_token FROM (SELECT split, sample_token, row_number() OVER (PARTITION BY split ORDER BY ts, sample_token) AS rn FROM manifest) t WHERE rn <= 40",
    "train_val_concat": "SELECT 'train' AS part, sample_token FROM manifest WHERE split = 'train' UNION ALL SELECT 'val', sample_token FROM manifest WHERE split = 'val'",
    "keyframe_files": "SELECT l_orderkey AS sample, file, is_key_frame OR file LIKE 'samples/%' AS key_frame, file LIKE '%/LIDAR_TOP/%' AS lidar FROM (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'samples/' ELSE 'sweeps/' END || CASE l_returnflag WHEN 'N' THEN 'LIDAR_TOP/' ELSE 'CAM_FRONT/' END || CAST(l_partkey AS STRING) || '.bin' AS file, l_discount > 0.08 AS is_key_frame FROM {lineitem}) t",
    "archives_complete": "SELECT count(*) = 0 AS complete FROM (SELECT DISTINCT l_suppkey FROM {lineitem}) a LEFT JOIN {supplier} s ON s.s_suppkey = a.l_suppkey WHERE s.s_suppkey IS NULL",
    # masks and filters over a sample's objects
    "valid_objects": "SELECT token, obj, coalesce(vx, 0) AS vx, coalesce(vy, 0) AS vy FROM objects WHERE valid OR pts > 0",
    "known_objects": "SELECT token, obj, label, x, y FROM objects WHERE label >= 0",
    "complete_masks": "SELECT token, min(m) AS complete FROM (SELECT p.token, g.step, CASE WHEN s.token IS NULL THEN 0 ELSE 1 END AS m FROM (SELECT DISTINCT token FROM steps) p CROSS JOIN (SELECT $series(1, 6) AS step) g LEFT JOIN steps s ON s.token = p.token AND s.step = g.step) t GROUP BY token",
    "topk_threshold": "SELECT token, obj, score FROM (SELECT token, obj, score, row_number() OVER (PARTITION BY token ORDER BY score DESC, obj) AS rn FROM objects) t WHERE rn <= 3 AND score >= 0.5",
    "topk_gather": "SELECT token, CAST(rn AS BIGINT) AS place, obj, x, y, vx, vy FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, obj) AS rn FROM objects) t WHERE rn <= 4",
    "topk_modes": "SELECT scene, inst, CAST(rn AS BIGINT) AS mode, sample, round(d, 6) AS d FROM (SELECT scene, inst, sample, d, row_number() OVER (PARTITION BY scene, inst ORDER BY round(d, 9) DESC, sample) AS rn FROM (SELECT scene, inst, sample, sqrt(x * x + y * y) AS d FROM tracks) a) t WHERE rn <= 2",
    "attribute_rules": "SELECT token, obj, CASE WHEN sqrt(vx * vx + vy * vy) > 0.2 THEN CASE WHEN label IN (0, 1, 2, 3, 4) THEN 'vehicle.moving' WHEN label IN (6, 7) THEN 'cycle.with_rider' WHEN label = 8 THEN 'pedestrian.moving' ELSE '' END ELSE CASE WHEN label = 8 THEN 'pedestrian.standing' WHEN label = 3 THEN 'vehicle.stopped' WHEN label IN (0, 1, 2, 4) THEN 'vehicle.parked' WHEN label IN (6, 7) THEN 'cycle.without_rider' ELSE '' END END AS attribute, label NOT IN (5, 8, 9) AS tracked FROM objects WHERE label >= 0",
    "map_submission": "SELECT line, label, count(*) AS n_points, round(min(x), 6) AS lo_x, round(max(x), 6) AS hi_x FROM points GROUP BY line, label HAVING count(*) >= 2",
    # joins
    "info_assembly": "SELECT o.o_orderkey AS sample, c.c_name AS scene, coalesce(n.n_name, 'unknown') AS location, r.r_name AS log, coalesce(l.cams, 0) AS cams, coalesce(l.sensors, '') AS sensors, coalesce(l.top, -1) AS lidar FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS cams, $joined(CAST(l_suppkey AS STRING)) AS sensors, min(p_partkey) AS top FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey",
    "sensor_files": "SELECT DISTINCT token, file FROM (SELECT l_orderkey AS token, 'samples/' || CAST(l_suppkey AS STRING) AS file FROM {lineitem} UNION ALL SELECT o_orderkey, 'samples/key-' || CAST(o_custkey AS STRING) FROM {orders}) t",
    "prev_chain": "SELECT a.event_id, h.hop, b.event_id AS prev FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY us, event_id) AS i FROM messages) a CROSS JOIN (SELECT $series(1, 4) AS hop) h JOIN (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY us, event_id) AS i FROM messages) b ON b.scene = a.scene AND b.i = a.i - h.hop",
    "agent_future": f"SELECT scene, sample, inst, {', '.join(f'round(dx{k}, 6) AS dx{k}, round(dy{k}, 6) AS dy{k}' for k in range(1, FUTURE + 1))}, steps FROM futures",
    "instance_match": "SELECT scene, sample, inst, CASE WHEN lag(x) OVER w > 20 THEN lag(sample) OVER w END AS carried_from FROM tracks WINDOW w AS (PARTITION BY scene, inst ORDER BY ts, sample)",
    "instance_arrays": "SELECT scene, sample, inst, CAST(least(row_number() OVER w, 4) AS BIGINT) AS period, x AS x0, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3, y AS y0, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(y, 3) OVER w AS y3 FROM tracks WINDOW w AS (PARTITION BY scene, inst ORDER BY ts, sample)",
    "mode_rescore": f"SELECT token, mode, max(hit) AS collides, round(max(score) - CASE WHEN max(hit) = 1 THEN 1000 ELSE 0 END, 6) AS score FROM (SELECT token, mode, score, CASE WHEN {_apart} THEN 1 ELSE 0 END AS hit FROM (SELECT e.token, m.mode, 1.0 / (1 + m.mode) AS score, a.x - (e.x + m.mode) - 0.5 * cos(e.yaw) AS ux, a.y - e.y - 0.5 * sin(e.yaw) AS uy, a.yaw - e.yaw AS d, e.yaw AS ya, a.yaw AS yb, 2.042 AS hla, 0.925 AS hwa, a.len / 2 AS hlb, a.w / 2 AS hwb FROM plan_poses e CROSS JOIN (SELECT 0 AS mode UNION ALL SELECT 1 UNION ALL SELECT 2) m JOIN agents a ON a.token = e.token AND a.step = e.step) p) q GROUP BY token, mode",
    # aggregates
    "utility_modes": "SELECT user_id, m.mode, round(CASE m.mode WHEN 'final' THEN last WHEN 'best' THEN best WHEN 'delta' THEN first - last ELSE (first - last) / greatest(abs(first), 1e-6) END, 6) AS utility FROM (SELECT user_id, avg(value) FILTER (WHERE a <= 3) AS first, avg(value) FILTER (WHERE z <= 3) AS last, min(value) AS best FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM {events}) t GROUP BY user_id) u CROSS JOIN (SELECT 'final' AS mode UNION ALL SELECT 'best' UNION ALL SELECT 'delta' UNION ALL SELECT 'relative_delta') m",
    "loss_components": "SELECT event_type, round(sum(mean), 6) AS loss FROM (SELECT event_type, user_id, avg(value) AS mean FROM {events} GROUP BY event_type, user_id) t GROUP BY GROUPING SETS ((event_type), ())",
    "box_stats": "SELECT token, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"n": "count(*) / 128.0", "d_mean": "avg(sqrt(x * x + y * y)) / 80", "d_std": "stddev_pop(sqrt(x * x + y * y)) / 80", "d_min": "min(sqrt(x * x + y * y)) / 80", "d_max": "max(sqrt(x * x + y * y)) / 80", "w_mean": "avg(w) / 10", "l_mean": "avg(l) / 10", "h_mean": "avg(h) / 10", "w_std": "stddev_pop(w) / 10", "l_std": "stddev_pop(l) / 10", "h_std": "stddev_pop(h) / 10", "in20": "avg(CASE WHEN sqrt(x * x + y * y) < 20 THEN 1.0 ELSE 0.0 END)", "in40": "avg(CASE WHEN sqrt(x * x + y * y) < 40 THEN 1.0 ELSE 0.0 END)", "in60": "avg(CASE WHEN sqrt(x * x + y * y) < 60 THEN 1.0 ELSE 0.0 END)", "lane": "avg(CASE WHEN abs(x) < 10 THEN 1.0 ELSE 0.0 END)", "ahead": "avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END)"}.items()) + " FROM objects GROUP BY token",
    "velocity_stats": "SELECT token, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"v_mean": "avg(sqrt(vx * vx + vy * vy)) / 15", "v_std": "stddev_pop(sqrt(vx * vx + vy * vy)) / 15", "v_max": "max(sqrt(vx * vx + vy * vy)) / 15", "moving": "avg(CASE WHEN sqrt(vx * vx + vy * vy) > 1 THEN 1.0 ELSE 0.0 END)", "fast": "avg(CASE WHEN sqrt(vx * vx + vy * vy) > 5 THEN 1.0 ELSE 0.0 END)", "vx_mean": "avg(vx) / 15", "vy_mean": "avg(vy) / 15", "drift": "sqrt(avg(vx) * avg(vx) + avg(vy) * avg(vy)) / 15"}.items()) + " FROM objects GROUP BY token",
    "future_summary": "SELECT sample, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"mean": "avg(per) / 20", "std": "stddev_pop(per) / 20", "max": "max(per) / 20", "final_mean": "avg(final) / 20", "final_std": "stddev_pop(final) / 20", "over1": "avg(CASE WHEN per > 1 THEN 1.0 ELSE 0.0 END)", "over5": "avg(CASE WHEN per > 5 THEN 1.0 ELSE 0.0 END)", "whole": f"avg(CASE WHEN steps >= {FUTURE} THEN 1.0 ELSE 0.0 END)", "mask": f"sum(steps) / (count(*) * {FUTURE}.0)", "n": "count(*) / 128.0"}.items()) + f" FROM (SELECT sample, ({_moved}) / greatest(steps, 1) AS per, sqrt(dx{FUTURE} * dx{FUTURE} + dy{FUTURE} * dy{FUTURE}) AS final, steps FROM futures) t GROUP BY sample",
    "traj_summary": "SELECT token, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for f, n in (("avg", "mean"), ("stddev_pop", "std")) for c in _six) + ", " + ", ".join(f"round(max(CASE WHEN last = 1 THEN {c} END), 6) AS {c}_last" for c in _six) + " FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY step DESC) AS last FROM ego_rows) t GROUP BY token",
    "traj_uncertainty": "SELECT token, round(greatest(least(0.5 * coalesce(curve, 0) + 0.5 * cv, 1.0), 0.0), 6) AS uncertainty FROM (SELECT token, stddev_pop(step_speed) / (avg(step_speed) + 1e-3) AS cv, avg(abs(unwrapped)) AS curve, count(*) AS n FROM (SELECT token, step, step_speed, CASE WHEN step > 1 THEN sum(CASE WHEN step = 2 THEN h WHEN step > 2 THEN j - 2 * pi() * floor((j + pi()) / (2 * pi())) ELSE 0 END) OVER (PARTITION BY token ORDER BY step) END AS unwrapped FROM (SELECT *, h - lag(h) OVER (PARTITION BY token ORDER BY step) AS j FROM (SELECT *, atan2(y, x) - lag(atan2(y, x)) OVER (PARTITION BY token ORDER BY step) AS h FROM ego_rows) a) b) c GROUP BY token) d WHERE n >= 2",
    "difficulty_proxy": "SELECT sample_token, round((p - lo) / greatest(hi - lo, 1e-6), 6) AS difficulty FROM (SELECT sample_token, 0.45 * least(agent_count / 80.0, 1.5) + 0.2 * least(ego_speed / 20, 1.5) + 0.2 * least(teacher_uncertainty * 10, 1.0) + 0.15 * least(agent_count * 3 / 120.0, 1.5) AS p FROM manifest) a CROSS JOIN (SELECT min(0.45 * least(agent_count / 80.0, 1.5) + 0.2 * least(ego_speed / 20, 1.5) + 0.2 * least(teacher_uncertainty * 10, 1.0) + 0.15 * least(agent_count * 3 / 120.0, 1.5)) AS lo, max(0.45 * least(agent_count / 80.0, 1.5) + 0.2 * least(ego_speed / 20, 1.5) + 0.2 * least(teacher_uncertainty * 10, 1.0) + 0.15 * least(agent_count * 3 / 120.0, 1.5)) AS hi FROM manifest) b",
    "map_counts": "SELECT line % 20 AS frame, count(CASE WHEN label % 3 = 0 THEN 1 END) AS ped_crossing, count(CASE WHEN label % 3 = 1 THEN 1 END) AS divider, count(CASE WHEN label % 3 = 2 THEN 1 END) AS boundary FROM (SELECT DISTINCT line, label FROM points) t GROUP BY line % 20",
    "cluster_profiles": "SELECT c.domain_id AS cluster, c.n, c.mean_loss, c.mean_speed, c.mean_agents, h.histogram, r.firsts FROM (SELECT domain_id, count(*) AS n, round(avg(teacher_loss), 6) AS mean_loss, round(avg(ego_speed), 6) AS mean_speed, round(avg(agent_count), 6) AS mean_agents FROM train GROUP BY domain_id) c JOIN (SELECT domain_id, $joined(location || '=' || CAST(k AS STRING)) AS histogram FROM (SELECT domain_id, location, count(*) AS k FROM train GROUP BY domain_id, location) a GROUP BY domain_id) h ON h.domain_id = c.domain_id JOIN (SELECT domain_id, $joined(CAST(sample_token AS STRING)) AS firsts FROM (SELECT domain_id, sample_token, row_number() OVER (PARTITION BY domain_id ORDER BY sample_token) AS rn FROM train) b WHERE rn <= 5 GROUP BY domain_id) r ON r.domain_id = c.domain_id",
    "label_counts": "SELECT domain_name, split, count(*) AS n, CAST(sum(CASE WHEN domain_id > 2 THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks, min(score) AS lo, max(score) AS hi, round(avg(score), 6) AS mean FROM scored GROUP BY GROUPING SETS ((domain_name), (split), ())",
    # evaluations
    "planning_eval": "SELECT step, round(avg(l2) OVER w, 6) AS l2, round(avg(obj_col) OVER w, 6) AS obj_col, round(avg(obj_box_col) OVER w, 6) AS obj_box_col FROM plan_steps WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "planning_avg": "SELECT round(avg(l2), 6) AS l2, round(avg(obj_col), 6) AS obj_col, round(avg(obj_box_col), 6) AS obj_box_col FROM (SELECT step, avg(l2) OVER w AS l2, avg(obj_col) OVER w AS obj_col, avg(obj_box_col) OVER w AS obj_box_col FROM plan_steps WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t WHERE step IN (2, 4, 6)",
    "ego_collision": "SELECT token, step, hit FROM plan_hits",
    "pairwise_distance": "SELECT frame, label, pred, gt, round(distance, 6) AS distance FROM map_pairs",
    "map_matches": "SELECT label, thr, pred, score, tp FROM map_tp",
    "map_ap": "SELECT label, thr, round(ap, 6) AS ap FROM map_area",
    "map_mean_ap": "SELECT round(avg(ap), 6) AS mean_ap, round(sum(ap) / 9, 6) AS map_normal FROM (SELECT label, thr, ap FROM map_area) t",
    # selections over rounds
    "first_seen": "SELECT token, round, CAST(row_number() OVER (ORDER BY round, pos, token) AS BIGINT) AS place FROM (SELECT token, round, pos, row_number() OVER (PARTITION BY token ORDER BY round, pos) AS rn FROM rounds) t WHERE rn = 1",
    "reward_advantage": "SELECT episode, round(reward - coalesce(base, 0), 6) AS advantage FROM (SELECT a.episode, a.reward, sum(power(CAST(0.9 AS DOUBLE), a.i - b.i - 1) * 0.1 * b.reward) AS base FROM (SELECT episode, reward, row_number() OVER (ORDER BY episode) AS i FROM rewards) a LEFT JOIN (SELECT episode, reward, row_number() OVER (ORDER BY episode) AS i FROM rewards) b ON b.i < a.i GROUP BY a.episode, a.reward) t",
    "capped_apportion": "SELECT domain_id, n, least(n, base) + CASE WHEN spare > 0 AND before < total - taken THEN least(spare, total - taken - before) ELSE 0 END AS k FROM (SELECT *, coalesce(sum(spare) OVER (ORDER BY frac DESC, n DESC, domain_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT domain_id, n, base, frac, total, sum(least(n, base)) OVER () AS taken, greatest(n - least(n, base), 0) AS spare FROM (SELECT domain_id, n, CAST(floor(exact) AS BIGINT) AS base, round(exact - floor(exact), 9) AS frac, total FROM (SELECT domain_id, n, weight, total, total * weight * (1 + 20 * domain_id) / sum(weight * (1 + 20 * domain_id)) OVER () AS exact FROM weights CROSS JOIN (SELECT 8 * total AS total FROM budget) b) e) f) g) h",
    # scalar functions
    "round_cutoffs": "SELECT DISTINCT CAST(trim(c) AS BIGINT) AS cutoff FROM (SELECT $pieces(c) AS c FROM (SELECT '10, 20,30,20, 40,10' AS c) a) t WHERE CAST(trim(c) AS BIGINT) BETWEEN 1 AND 100",
    "percent_text": "SELECT user_id, coalesce($fixed(100 * hits / CAST(nullif(n, 0) AS DOUBLE)) || '%', 'n/a') AS share FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS hits, count(*) FILTER (WHERE event_type <> 'error') AS n FROM {events} GROUP BY user_id) t",
    "metric_keys": "SELECT event_id, coalesce(l2, big_l2, 0) AS l2, coalesce(col, 0) AS obj_col FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS l2, CASE WHEN event_id % 2 = 1 THEN value END AS big_l2, CASE WHEN event_type = 'click' THEN value / 100 END AS col FROM {events}) t",
    "canonical_hash": "SELECT domain_id, count(*) AS n, $sha(chr(123) || '\"tokens\": [' || $joined(CAST(sample_token AS STRING)) || ']' || chr(125)) AS sha256 FROM selected GROUP BY domain_id",
    "one_hot": "SELECT token, " + ", ".join(f"CASE WHEN token % 3 = {k} THEN 1 ELSE 0 END AS c{k}" for k in range(3)) + ", CASE WHEN token % 3 = 0 THEN 0 WHEN token % 3 = 1 THEN 1 ELSE 2 END AS argmax FROM (SELECT DISTINCT token FROM steps) t",
    "ego_speed": "SELECT t.token, CASE WHEN o.o_totalprice > 100000 THEN abs(o.o_totalprice / 10000) ELSE round(t.mean, 6) END AS speed FROM (SELECT token, avg(step_speed) AS mean FROM ego_rows GROUP BY token) t JOIN {orders} o ON o.o_orderkey = t.token",
    # geometry
    "box_corners_3d": "SELECT token, obj, c.i AS corner, round(x + cos(a) * c.sx * l / 2 - sin(a) * c.sy * w / 2, 6) AS cx, round(y + sin(a) * c.sx * l / 2 + cos(a) * c.sy * w / 2, 6) AS cy, round(z + c.sz * h / 2, 6) AS cz FROM (SELECT *, atan2(vy + 0.1, vx + 0.1) AS a FROM objects) o CROSS JOIN (SELECT 0 AS i, -1 AS sx, -1 AS sy, -1 AS sz UNION ALL SELECT 1, -1, -1, 1 UNION ALL SELECT 2, -1, 1, 1 UNION ALL SELECT 3, -1, 1, -1 UNION ALL SELECT 4, 1, -1, -1 UNION ALL SELECT 5, 1, -1, 1 UNION ALL SELECT 6, 1, 1, 1 UNION ALL SELECT 7, 1, 1, -1) c",
    "box_rotate": "SELECT token, obj, round(cos(0.3) * x - sin(0.3) * y, 6) AS x, round(sin(0.3) * x + cos(0.3) * y, 6) AS y, round(atan2(vy + 0.1, vx + 0.1) + 0.3, 6) AS yaw, round(cos(0.3) * vx - sin(0.3) * vy, 6) AS vx, round(sin(0.3) * vx + cos(0.3) * vy, 6) AS vy FROM objects",
    "lidar2agent": "SELECT scene, sample, inst, " + ", ".join(f"round(sum_x{k} * cos(a) + sum_y{k} * sin(a), 6) AS ax{k}, round(-sum_x{k} * sin(a) + sum_y{k} * cos(a), 6) AS ay{k}" for k in range(1, FUTURE + 1)) + " FROM (SELECT scene, sample, inst, " + ", ".join(f"{' + '.join(f'd{c}{i}' for i in range(1, k + 1))} AS sum_{c}{k}" for k in range(1, FUTURE + 1) for c in "xy") + ", atan2(dy1, dx1) AS a FROM futures) t",
    "corner_collision": "SELECT token, obj, other, max(inside) AS hit FROM (SELECT a.token, a.obj, b.obj AS other, CASE WHEN abs(cos(b.yaw) * (a.x + c.sx * a.l / 2 * cos(a.yaw) - c.sy * a.w / 2 * sin(a.yaw) - b.x) + sin(b.yaw) * (a.y + c.sx * a.l / 2 * sin(a.yaw) + c.sy * a.w / 2 * cos(a.yaw) - b.y)) <= b.l / 2 AND abs(-sin(b.yaw) * (a.x + c.sx * a.l / 2 * cos(a.yaw) - c.sy * a.w / 2 * sin(a.yaw) - b.x) + cos(b.yaw) * (a.y + c.sx * a.l / 2 * sin(a.yaw) + c.sy * a.w / 2 * cos(a.yaw) - b.y)) <= b.w / 2 THEN 1 ELSE 0 END AS inside FROM (SELECT *, atan2(vy + 0.1, vx + 0.1) AS yaw FROM objects) a JOIN (SELECT *, atan2(vy + 0.1, vx + 0.1) AS yaw FROM objects) b ON b.token = a.token AND b.obj <> a.obj CROSS JOIN (SELECT -1 AS sx, -1 AS sy UNION ALL SELECT -1, 1 UNION ALL SELECT 1, -1 UNION ALL SELECT 1, 1) c) t GROUP BY token, obj, other",
    "quaternion_rotate": "SELECT vec_id, round((1 - 2 * (qy * qy + qz * qz)) * px + 2 * (qx * qy - qz * qw) * py + 2 * (qx * qz + qy * qw) * pz + 1, 6) AS gx, round(2 * (qx * qy + qz * qw) * px + (1 - 2 * (qx * qx + qz * qz)) * py + 2 * (qy * qz - qx * qw) * pz - 2, 6) AS gy, round(2 * (qx * qz - qy * qw) * px + 2 * (qy * qz + qx * qw) * py + (1 - 2 * (qx * qx + qy * qy)) * pz + 0.5, 6) AS gz FROM (SELECT vec_id, x / n AS qx, y / n AS qy, z / n AS qz, w / n AS qw, px, py, pz FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM (SELECT vec_id, $at(embedding, 1) AS x, $at(embedding, 2) AS y, $at(embedding, 3) AS z, $at(embedding, 4) AS w, $at(embedding, 5) AS px, $at(embedding, 6) AS py, $at(embedding, 7) AS pz FROM {embeddings}) a) b WHERE n > 0) q",
    "resample_step": "SELECT line, k, round(x0 + (x1 - x0) * t, 6) AS x, round(y0 + (y1 - y0) * t, 6) AS y FROM (SELECT p.line, g.k, p.x AS x0, p.y AS y0, p.nx AS x1, p.ny AS y1, CASE WHEN p.d > 0 THEN (least(g.k * 2.0, p.total) - p.upto) / p.d ELSE 0 END AS t, row_number() OVER (PARTITION BY p.line, g.k ORDER BY p.step DESC) AS rn FROM lengths p JOIN (SELECT line, $series(0, CAST(ceil(total / 2.0) AS INT)) AS k FROM (SELECT DISTINCT line, total FROM lengths) d) g ON g.line = p.line WHERE p.upto <= least(g.k * 2.0, p.total) + 1e-9) t WHERE rn = 1",
    "permute_line": "SELECT p.line, o.turn, p.k, CASE WHEN o.turn = 0 THEN p.k ELSE 9 - p.k END AS place, round(p.x, 6) AS x, round(p.y, 6) AS y FROM resampled p CROSS JOIN (SELECT 0 AS turn UNION ALL SELECT 1) o",
    "permute_ring": "SELECT p.line, o.turn, s.shift, CASE WHEN o.turn = 0 THEN (p.k + s.shift) % 9 ELSE (9 - p.k + s.shift) % 9 END AS place, round(p.x, 6) AS x, round(p.y, 6) AS y FROM (SELECT * FROM resampled WHERE k < 9) p CROSS JOIN (SELECT 0 AS turn UNION ALL SELECT 1) o CROSS JOIN (SELECT $series(0, 8) AS shift) s",
    "line_cost": "SELECT frame, pred, gt, CASE WHEN round(c0, 6) <= round(c1, 6) THEN 0 ELSE 1 END AS turn, round(least(c0, c1), 6) AS cost FROM (SELECT p.frame, p.line AS pred, g.line AS gt, sum(CASE WHEN g.k = p.k THEN abs(p.x - g.x) + abs(p.y - g.y) ELSE 0 END) AS c0, sum(CASE WHEN g.k = 9 - p.k THEN abs(p.x - g.x) + abs(p.y - g.y) ELSE 0 END) AS c1 FROM map_pred p JOIN map_gt g ON g.frame = p.frame AND g.label = p.label GROUP BY p.frame, p.line, g.line) t",
    "project_points": "SELECT token, obj, CAST(floor(u) AS BIGINT) AS u, CAST(floor(v) AS BIGINT) AS v, round(depth, 6) AS depth FROM (SELECT token, obj, 800.0 * -x / depth + 400 AS u, 800.0 * (1.5 - z) / depth + 225 AS v, depth FROM (SELECT *, y + 60 AS depth FROM objects) a WHERE depth > 0.1) t WHERE u >= 0 AND u < 800 AND v >= 0 AND v < 450",
    "depth_map": "SELECT token, u, v, round(min(depth), 6) AS depth FROM (SELECT token, CAST(floor((800.0 * -x / depth + 400) / 8) AS BIGINT) AS u, CAST(floor((800.0 * (1.5 - z) / depth + 225) / 8) AS BIGINT) AS v, depth FROM (SELECT *, y + 60 AS depth FROM objects) a WHERE depth > 0.1) t WHERE u >= 0 AND u < 100 AND v >= 0 AND v < 57 GROUP BY token, u, v",
    "sensor_extrinsics": "SELECT token, obj, round(cos(e - s) * (cos(s) * x - sin(s) * y + 1.2) + sin(e - s) * (sin(s) * x + cos(s) * y - 0.4) - 0.7, 6) AS x, round(-sin(e - s) * (cos(s) * x - sin(s) * y + 1.2) + cos(e - s) * (sin(s) * x + cos(s) * y - 0.4) + 0.2, 6) AS y FROM (SELECT token, obj, x, y, obj * 0.5 AS s, obj * 0.5 + 0.1 AS e FROM objects) t",
}
