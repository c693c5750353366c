"""Declarative queries over the bound relations, as SQL for Spark and as DuckDB SQL for checks.

``BASE`` binds the engine's relations (manifest, trajectory steps, episodes, polylines, messages) to
the star-schema and event tables. ``QUERIES`` holds one statement per operator. A statement is
rendered for an engine by the macros of ``DIALECTS``; relations that it names are put before it
as common table expressions, so that the optimiser sees one plan and prunes and pushes through it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Macro -> (Spark, DuckDB); $1, $2 are the arguments.
DIALECTS = {
    "uniform": ("(CAST(conv(substr(sha2($1, 256), 1, 13), 16, 10) AS BIGINT) / 4503599627370496D)", "(('0x' || substr(sha256($1), 1, 13))::BIGINT / 4503599627370496.0)"),
    "sha": ("sha2($1, 256)", "sha256($1)"),
    "quantile": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "joined": ("array_join(array_sort(collect_list($1)), ',')", "array_to_string(list_sort(list($1)), ',')"),
    "micros": ("unix_micros(CAST($1 AS TIMESTAMP))", "epoch_us($1)"),
    "hour": ("CAST(hour($1) AS INT)", "CAST(hour($1) AS INTEGER)"),
    "json_k": ("CAST(get_json_object($1, '$.k') AS BIGINT)", "CAST(json_extract_string($1, '$.k') AS BIGINT)"),
    "at": ("CAST(element_at($1, CAST($2 AS INT)) AS DOUBLE)", "CAST($1[CAST($2 AS INTEGER)] AS DOUBLE)"),
    "series": ("explode(sequence($1, $2))", "unnest(range($1, $2 + 1))"),
    "last_known": ("last_value($1) IGNORE NULLS", "last_value($1 IGNORE NULLS)"),
    "big": ("CAST($1 AS BIGINT)", "CAST($1 AS BIGINT)"),
    "pieces": ("explode(split($1, ','))", "unnest(string_split($1, ','))"),
    "listed": ("array_sort(collect_list(named_struct('k', $1, 'x', $2, 'y', $3)))", "list({'k': $1, 'x': $2, 'y': $3} ORDER BY $1)"),
    "near": (
        "(aggregate(transform($1, u -> array_min(transform($2, v -> sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y))))), CAST(0 AS DOUBLE), (s, v) -> s + v) / size($1))",
        "list_avg(list_transform($1, lambda u: list_min(list_transform($2, lambda v: sqrt((u['x'] - v['x']) * (u['x'] - v['x']) + (u['y'] - v['y']) * (u['y'] - v['y']))))))",
    ),
    "fixed": ("replace(format_number($1, 2), ',', '')", "format('{:.2f}', $1)"),
}

#: Raw category names and their classes; a name without one keeps itself.
CLASSES = {
    "movable_object.barrier": "barrier",
    "vehicle.bicycle": "bicycle",
    "vehicle.bus.bendy": "bus",
    "vehicle.bus.rigid": "bus",
    "vehicle.car": "car",
    "vehicle.construction": "construction_vehicle",
    "vehicle.motorcycle": "motorcycle",
    "human.pedestrian.adult": "pedestrian",
    "human.pedestrian.child": "pedestrian",
    "human.pedestrian.construction_worker": "pedestrian",
    "human.pedestrian.police_officer": "pedestrian",
    "movable_object.trafficcone": "traffic_cone",
    "vehicle.trailer": "trailer",
    "vehicle.truck": "truck",
    "animal": None,
    "static_object.bicycle_rack": None,
}

BASE = {
    "manifest": """SELECT o.o_orderkey AS sample_token, o.o_custkey AS scene_token, o.o_orderdate AS ts, CASE WHEN o.o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split,
        CAST(CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 3 ELSE 4 END AS INT) AS domain_id, o.o_orderpriority AS domain_name, n.n_name AS location,
        CAST(coalesce(l.agents, 0) AS INT) AS agent_count, coalesce(l.speed, 0) AS ego_speed, o.o_totalprice / 100000 AS teacher_loss, coalesce(l.uncertainty, 0) AS teacher_uncertainty
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS agents, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS speed, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS uncertainty FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "train": "SELECT * FROM manifest WHERE split = 'train'",
    "spans": "SELECT min(teacher_loss) AS lo_l, greatest(max(teacher_loss) - min(teacher_loss), 1e-8) AS w_l, min(teacher_uncertainty) AS lo_u, greatest(max(teacher_uncertainty) - min(teacher_uncertainty), 1e-8) AS w_u, min(agent_count) AS lo_a, greatest(max(agent_count) - min(agent_count), 1e-8) AS w_a FROM train",
    "scored": "SELECT m.*, round(0.6 * (teacher_loss - lo_l) / w_l + 0.3 * (teacher_uncertainty - lo_u) / w_u + 0.1 * (agent_count - lo_a) / w_a, 9) AS score FROM manifest m CROSS JOIN spans",
    "train_scored": "SELECT * FROM scored WHERE split = 'train'",
    "weights": "SELECT domain_id, count(*) AS n, round(count(*) * (0.5 + avg(score)), 6) AS weight FROM train_scored GROUP BY domain_id",
    "budget": "SELECT CASE WHEN 0.1 <= 1 THEN greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT)) ELSE least(count(*), CAST(0.1 AS BIGINT)) END AS total FROM train",
    "shares": "SELECT domain_id, n, weight, total, total * weight / sum(weight) OVER () AS exact FROM weights CROSS JOIN budget",
    "floors": "SELECT *, CAST(floor(exact) AS BIGINT) AS base, round(exact - floor(exact), 9) AS frac FROM shares",
    "apportioned": "SELECT domain_id, n, weight, CAST(base + CASE WHEN row_number() OVER (ORDER BY frac DESC, n DESC, domain_id) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS k FROM floors",
    "ranked": "SELECT s.*, CAST(row_number() OVER (PARTITION BY domain_id ORDER BY score DESC, sample_token) AS BIGINT) AS rn FROM train_scored s",
    "selected": "SELECT r.domain_id, r.rn, r.sample_token, r.scene_token, r.location, r.score FROM ranked r JOIN apportioned a ON a.domain_id = r.domain_id WHERE r.rn <= a.k",
    "steps": "SELECT l_orderkey AS token, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS step, l_quantity AS x, l_extendedprice / 1000 AS y, l_tax AS dx, l_discount AS dy, 1 + l_discount * 10 AS w, 2 + l_tax * 10 AS len FROM {lineitem}",
    "episodes": """SELECT user_id AS episode, round(coalesce(avg(value) FILTER (WHERE event_type = t1), 0), 6) AS l2_s, round(coalesce(avg(value) FILTER (WHERE event_type = t2), 0), 6) AS l2_r,
        round(coalesce(min(value) FILTER (WHERE event_type = t1), 0), 6) AS box_s, round(coalesce(min(value) FILTER (WHERE event_type = t2), 0), 6) AS box_r,
        round(coalesce(max(value) FILTER (WHERE event_type = t1), 0) / 1000, 6) AS obj_s, round(coalesce(max(value) FILTER (WHERE event_type = t2), 0) / 1000, 6) AS obj_r
        FROM {events} CROSS JOIN (SELECT min(event_type) AS t1, max(event_type) AS t2 FROM {events}) k GROUP BY user_id""",
    "rewards": "SELECT *, round(l2_s + 5 * box_s + 0.05 * obj_s, 9) AS cost_s, round(l2_r + 5 * box_r + 0.05 * obj_r, 9) AS cost_r, round(l2_r + 5 * box_r + 0.05 * obj_r - l2_s - 5 * box_s - 0.05 * obj_s, 9) AS reward FROM episodes",
    "messages": "SELECT event_id, user_id AS scene, ts, $micros(ts) AS us, event_type, value FROM {events}",
    "points": "SELECT vec_id AS line, label, step, $at(embedding, 2 * step + 1) AS x, $at(embedding, 2 * step + 2) AS y FROM (SELECT vec_id, label, embedding, $series(0, 31) AS step FROM {embeddings}) e",
    "line_arrays": "SELECT CAST(floor(line / 25.0) AS BIGINT) AS frame, line, label, $listed(step, x, y) AS g FROM points GROUP BY line, label",
    "moves": "SELECT token, step, x - lag(x, 1, 0) OVER (PARTITION BY token ORDER BY step) AS vx, y - lag(y, 1, 0) OVER (PARTITION BY token ORDER BY step) AS vy, x, y FROM steps",
    "turns": "SELECT *, vx - lag(vx) OVER (PARTITION BY token ORDER BY step) AS ax, vy - lag(vy) OVER (PARTITION BY token ORDER BY step) AS ay, atan2(vy, vx) - lag(atan2(vy, vx)) OVER (PARTITION BY token ORDER BY step) AS turn FROM moves WHERE step > 1",
    "boxes": "SELECT token, step, x, y, w / 2 AS hw, len / 2 AS hl, atan2(dy + 0.01, dx + 0.01) AS yaw FROM steps",
    "sessions": "SELECT event_id, user_id, ts, CAST(1 + sum(CASE WHEN gap > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM (SELECT event_id, user_id, ts, $micros(ts) AS us, $micros(ts) - lag($micros(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {events}) e",
    "detections": "SELECT l_orderkey AS det, l_suppkey % 3 AS class, round(l_extendedprice / 100000 + l_discount / 10 + l_linenumber / 1e7, 9) AS conf, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS tp, l_linenumber FROM {lineitem}",
    "pr": "SELECT class, det, l_linenumber, conf, sum(tp) OVER w AS ctp, count(*) OVER w AS n, sum(tp) OVER (PARTITION BY class) AS npos FROM detections WINDOW w AS (PARTITION BY class ORDER BY conf DESC, det, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "envelope": "SELECT class, det, l_linenumber, conf, CAST(ctp AS DOUBLE) / npos AS recall, CAST(ctp AS DOUBLE) / n AS prec, max(CAST(ctp AS DOUBLE) / n) OVER (PARTITION BY class ORDER BY conf, det DESC, l_linenumber DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS env FROM pr",
}

QUERIES = {
    # selection
    "stratified_topk": "SELECT domain_id, rn, sample_token, score FROM selected",
    "filter_split_domain": "SELECT sample_token, domain_id, location FROM manifest WHERE split = 'train' AND domain_id = 2",
    "exclude_tokens": "SELECT sample_token FROM train t WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.sample_token = t.sample_token)",
    "manifest_scan": "SELECT sample_token, scene_token, ts, split, domain_id, domain_name, location, agent_count, round(ego_speed, 6) AS ego_speed, round(teacher_loss, 8) AS teacher_loss, round(teacher_uncertainty, 6) AS teacher_uncertainty FROM manifest",
    "manifest_summary": "SELECT split, CAST(domain_id AS STRING) || ':' || domain_name AS domain, count(*) AS n FROM manifest GROUP BY split, domain_id, domain_name",
    "by_domain": "SELECT domain_id, $joined(sample_token) AS tokens FROM train GROUP BY domain_id",
    "domain_counts": "SELECT w.domain_id, count(s.sample_token) AS n FROM (SELECT DISTINCT domain_id FROM manifest) w LEFT JOIN selected s ON s.domain_id = w.domain_id AND s.score > 0.9 GROUP BY w.domain_id",
    "score_summary": "SELECT round(coalesce(avg(t.score), 0), 6) AS all_mean, round(coalesce(avg(CASE WHEN s.sample_token IS NOT NULL THEN t.score END), 0), 6) AS selected_mean, coalesce(min(CASE WHEN s.sample_token IS NOT NULL THEN t.score END), 0) AS selected_min, coalesce(max(CASE WHEN s.sample_token IS NOT NULL THEN t.score END), 0) AS selected_max FROM train_scored t JOIN apportioned a ON a.domain_id = t.domain_id AND a.k > 0 LEFT JOIN selected s ON s.sample_token = t.sample_token",
    "domain_bias": "SELECT domain_id, round(avg(score) - max(g), 6) AS bias FROM train_scored CROSS JOIN (SELECT avg(score) AS g FROM train_scored) a GROUP BY domain_id",
    "mosaic_score": "SELECT sample_token, domain_id, score FROM scored",
    "mosaic_weights": "SELECT domain_id, n, weight FROM weights",
    "apportion": "SELECT domain_id, n, k FROM apportioned",
    "budget_count": "SELECT domain_id, count(*) AS n, CASE WHEN b <= 1 THEN greatest(1, CAST(ceil(count(*) * b) AS BIGINT)) ELSE least(count(*), CAST(floor(b) AS BIGINT)) END AS budget, b FROM train CROSS JOIN (SELECT CAST(0.05 AS DOUBLE) AS b UNION ALL SELECT CAST(1 AS DOUBLE) UNION ALL SELECT CAST(37.9 AS DOUBLE)) g GROUP BY domain_id, b",
    "loss_mining": "SELECT sample_token, round(teacher_loss, 9) AS score FROM train ORDER BY teacher_loss DESC, sample_token LIMIT 50",
    "uncertainty": "SELECT sample_token, round(teacher_uncertainty, 9) AS score FROM train ORDER BY teacher_uncertainty DESC, sample_token LIMIT 50",
    "topk_global": "SELECT sample_token, score FROM train_scored ORDER BY score DESC, sample_token LIMIT 100",
    "hash_random": "SELECT sample_token, $uniform('7:' || CAST(domain_id AS STRING) || ':' || CAST(sample_token AS STRING)) AS u FROM train",
    "gumbel_topk": "SELECT domain_id, rn, sample_token FROM (SELECT domain_id, sample_token, row_number() OVER (PARTITION BY domain_id ORDER BY round(score + 0.1 * -ln(-ln(greatest(least(u, 1 - 1e-8), 1e-8))), 9) DESC, sample_token) AS rn FROM (SELECT domain_id, sample_token, score, $uniform('gumbel:' || CAST(sample_token AS STRING)) AS u FROM train_scored) a) b WHERE rn <= 20",
    "replay_penalty": "SELECT t.sample_token, round(t.score - CASE WHEN p.sample_token IS NULL THEN 0 ELSE 0.25 END, 9) AS score FROM train_scored t LEFT JOIN (SELECT DISTINCT s.sample_token FROM selected s JOIN rewards r ON r.episode = s.scene_token WHERE r.reward <= 0) p ON p.sample_token = t.sample_token",
    "selection_hash": "SELECT $sha($joined(CAST(sample_token AS STRING))) AS selection_hash, substr($sha($joined(CAST(sample_token AS STRING))), 1, 12) AS hash12, count(*) AS n FROM selected",
    "holdout_split": "SELECT sample_token, CASE WHEN rn <= round(n * 0.2) AND n >= 10 THEN 1 ELSE 0 END AS held FROM (SELECT sample_token, row_number() OVER (ORDER BY $sha('hold:' || CAST(sample_token AS STRING)), sample_token) AS rn, count(*) OVER () AS n FROM train) t",
    "split_80_20": "SELECT scene_token, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS part FROM (SELECT scene_token, row_number() OVER (ORDER BY scene_token) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT scene_token FROM manifest) s) t",
    "strided_sample": "SELECT sample_token, ts FROM (SELECT sample_token, ts, row_number() OVER (PARTITION BY domain_id ORDER BY ts, sample_token) AS rn FROM manifest) t WHERE (rn - 1) % 5 = 0",
    "flat_topk": "SELECT token, idx, cls, score FROM (SELECT token, (step - 1) * 3 + cls AS idx, cls, round(y / (1 + cls), 9) AS score, row_number() OVER (PARTITION BY token ORDER BY round(y / (1 + cls), 9) DESC, (step - 1) * 3 + cls) AS rn FROM steps CROSS JOIN (SELECT 0 AS cls UNION ALL SELECT 1 UNION ALL SELECT 2) c) t WHERE rn <= 4",
    "centerness_rescore": "SELECT token, step, score, CAST(row_number() OVER (PARTITION BY token ORDER BY score DESC, step) AS BIGINT) AS place FROM (SELECT token, step, round(y / 100 * (1 / (1 + exp(-dx))), 9) AS score FROM steps) t",
    "mode_argmax": "SELECT token, step AS best_step, x, y FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY y DESC, step) AS rn FROM steps WHERE x >= 10) t WHERE rn = 1",
    # normalisation and heuristics
    "standardize": "SELECT sample_token, round((teacher_loss - m) / s, 6) AS z FROM train CROSS JOIN (SELECT avg(teacher_loss) AS m, stddev_pop(teacher_loss) + 1e-6 AS s FROM train) a",
    "minmax_normalize": "SELECT sample_token, round((ego_speed - lo) / w, 6) AS v FROM train CROSS JOIN (SELECT min(ego_speed) AS lo, greatest(max(ego_speed) - min(ego_speed), 1e-6) AS w FROM train) a",
    "rank_normalize": "SELECT sample_token, domain_id, round((row_number() OVER (PARTITION BY domain_id ORDER BY teacher_loss, sample_token) - 1) / CAST(greatest(count(*) OVER (PARTITION BY domain_id) - 1, 1) AS DOUBLE), 9) AS v FROM train",
    "raw_features": "SELECT sample_token, round(agent_count / 32.0, 6) AS agent_count_norm, round(ego_speed / 30.0, 6) AS ego_speed_norm, round(teacher_loss, 8) AS teacher_loss, round(teacher_uncertainty, 6) AS teacher_uncertainty FROM manifest",
    "heuristic_scores": "SELECT sample_token, CASE WHEN domain_id IN (0, 1) THEN 'fast' WHEN domain_id = 2 THEN 'crowded' ELSE 'default' END AS heuristic, domain_id > 2 AS fallback_used, round(greatest(least(CASE WHEN domain_id IN (0, 1) THEN 0.1 + 0.7 * ego_speed / 30 + 0.2 * teacher_loss WHEN domain_id = 2 THEN 0.8 * agent_count / 32.0 + 0.2 * teacher_uncertainty ELSE teacher_loss END, 2.0), 0.0) * 0.5 + 0.1, 6) AS target_score FROM train",
    "linear_selector_score": "SELECT s.sample_token, round(0.2 + 0.5 * s.teacher_loss + 0.3 * s.agent_count / 32.0 + b.bias, 9) AS score FROM train_scored s JOIN (SELECT domain_id, round(avg(score), 6) AS bias FROM train_scored GROUP BY domain_id) b ON b.domain_id = s.domain_id",
    "target_summary": "SELECT domain_name, count(*) AS n, min(score) AS lo, round(avg(score), 6) AS mean, max(score) AS hi, CAST(sum(CASE WHEN domain_id > 2 THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks FROM train_scored GROUP BY GROUPING SETS ((domain_name), ())",
    "resolve_label": "SELECT event_id, coalesce(nullif(CAST($json_k(props) AS STRING), '0'), nullif(event_type, ''), 'default') AS label FROM {events}",
    "label_join": "SELECT d.doc_id, coalesce(CAST(l.quality AS STRING), 'default') AS label FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id",
    "priority_lookup": "SELECT m.sample_token, coalesce(a.v, b.v, c.v, -1) AS v FROM manifest m LEFT JOIN (SELECT n_name AS k, CAST(n_nationkey AS INT) AS v FROM {nation} WHERE n_nationkey % 3 = 0) a ON a.k = m.location LEFT JOIN (SELECT '1-URGENT' AS k, 100 AS v) b ON b.k = m.domain_name LEFT JOIN (SELECT 2 AS k, 200 AS v) c ON c.k = m.domain_id",
    "targets_semi": "SELECT sample_token, score FROM scored s WHERE EXISTS (SELECT 1 FROM train t WHERE t.sample_token = s.sample_token)",
    "missing_tokens": "SELECT o.l_orderkey AS token, count(*) AS n FROM {lineitem} o WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.sample_token = o.l_orderkey) GROUP BY o.l_orderkey",
    "class_mapping": "SELECT p_partkey, coalesce(m.c, m.raw) AS class FROM {part} JOIN (" + " UNION ALL ".join(f"SELECT {i} AS i, '{raw}' AS raw, {f"'{c}'" if c else 'CAST(NULL AS STRING)'} AS c" for i, (raw, c) in enumerate(CLASSES.items())) + f") m ON m.i = p_size % {len(CLASSES)}",
    "time_tag": "SELECT event_id, CASE WHEN ts IS NULL THEN 'unknown' WHEN $hour(ts) < 6 OR $hour(ts) >= 20 THEN 'night' ELSE 'day' END AS tag FROM {events}",
    "drive_command": "SELECT token, CASE WHEN last_x - first_x >= 2 THEN 'right' WHEN last_x - first_x <= -2 THEN 'left' ELSE 'straight' END AS command FROM (SELECT token, max(CASE WHEN step = 1 THEN x END) AS first_x, max(CASE WHEN step = n THEN x END) AS last_x FROM (SELECT *, count(*) OVER (PARTITION BY token) AS n FROM steps) a GROUP BY token) t",
    "class_range_filter": "SELECT token, step FROM steps WHERE sqrt(x * x + y * y) <= CASE token % 3 WHEN 0 THEN 30 WHEN 1 THEN 45 ELSE 60 END",
    "known_class_filter": "SELECT token, count(*) AS kept FROM steps WHERE step % 4 <> 3 GROUP BY token",
    "sample_class_ids": "SELECT l_orderkey AS token, $joined(c) AS classes FROM (SELECT DISTINCT l_orderkey, CAST(l_suppkey % 10 AS STRING) AS c FROM {lineitem}) t GROUP BY l_orderkey",
    "vehicle_id": "SELECT page_id, substr(regexp_replace(url, '^.*/', ''), 1, 4) AS vehicle FROM {pages}",
    "json_path": "SELECT event_id, $json_k(props) AS k FROM {events}",
    "round_from_id": "SELECT event_id, CAST(regexp_extract('sel_r' || CAST(event_id % 97 AS STRING) || '_x', '_r([0-9]+)(_|$)', 1) AS BIGINT) AS round FROM {events}",
    # joins
    "scene_summary": "SELECT c.c_custkey AS scene, coalesce(n.n_name, 'unknown') AS location, coalesce(o.k, 0) AS samples FROM {customer} c LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS k FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
    "required_files": "SELECT DISTINCT o.o_orderkey AS token, 'samples/' || CAST(l.l_suppkey AS STRING) AS file FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey",
    "prev_sweeps": "SELECT a.token, a.step, b.step AS sweep, b.x FROM steps a JOIN steps b ON b.token = a.token AND b.step BETWEEN a.step - 3 AND a.step - 1",
    "asof_nearest": """SELECT event_id, CASE WHEN next_us IS NULL THEN prev_us WHEN prev_us IS NULL THEN next_us WHEN us - prev_us < next_us - us THEN prev_us ELSE next_us END AS matched_us FROM
        (SELECT event_id, us, is_sample, $last_known(msg_us) OVER (PARTITION BY scene ORDER BY us, is_sample DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_us,
         $last_known(msg_us) OVER (PARTITION BY scene ORDER BY us DESC, is_sample, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS next_us
         FROM (SELECT m.*, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_sample, CASE WHEN event_type <> 'click' THEN us END AS msg_us FROM messages m) a) b WHERE is_sample = 1""",
    "future_frames": "SELECT token, step, count(*) OVER f AS frames, round(avg(x) OVER f, 6) AS mean_x FROM steps WINDOW f AS (PARTITION BY token ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)",
    "gt_pred_align": "SELECT g.sample_token AS token, coalesce(p.n, 0) AS preds FROM manifest g LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_discount > 0.05 GROUP BY l_orderkey) p ON p.l_orderkey = g.sample_token WHERE g.split = 'val'",
    "leave_one_out": "SELECT episode, round((total - reward) / (n - 1), 6) AS rest_mean FROM rewards CROSS JOIN (SELECT sum(reward) AS total, count(*) AS n FROM rewards) t",
    "candidate_fold_scores": "SELECT s.domain_id AS cand, f.fold, count(*) AS n, round(avg(s.score * (1 + f.fold * 0.1)), 6) AS mean FROM selected s CROSS JOIN (SELECT 0 AS fold UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) f GROUP BY s.domain_id, f.fold",
    "instance_carry": "SELECT token, step, CASE WHEN lag(dx) OVER (PARTITION BY token ORDER BY step) > 0.02 THEN 1 ELSE 0 END AS carried FROM steps",
    "file_location": "SELECT l_partkey AS member, min(l_suppkey) AS archive FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size < 20) GROUP BY l_partkey",
    "box_collision": """SELECT token, step, bool_or(abs(ux * cos(ya) + uy * sin(ya)) <= hla + hlb * abs(cos(d)) + hwb * abs(sin(d)) AND abs(-ux * sin(ya) + uy * cos(ya)) <= hwa + hlb * abs(sin(d)) + hwb * abs(cos(d))
        AND abs(ux * cos(yb) + uy * sin(yb)) <= hlb + hla * abs(cos(d)) + hwa * abs(sin(d)) AND abs(-ux * sin(yb) + uy * cos(yb)) <= hwb + hla * abs(sin(d)) + hwa * abs(cos(d))) AS hit
        FROM (SELECT a.token, a.step, b.x - a.x AS ux, b.y - a.y AS uy, b.yaw - a.yaw AS d, a.yaw AS ya, b.yaw AS yb, a.hl AS hla, a.hw AS hwa, b.hl AS hlb, b.hw AS hwb FROM boxes a JOIN boxes b ON b.token = a.token AND b.step <> a.step) p GROUP BY token, step""",
    # sets
    "token_union": "SELECT sample_token FROM selected UNION SELECT sample_token FROM train WHERE teacher_loss > 4",
    "overlap_counts": "SELECT count(*) AS overlap FROM (SELECT sample_token FROM selected INTERSECT SELECT sample_token FROM train WHERE teacher_uncertainty > 0.06) t",
    "missing_files": "SELECT l_partkey FROM {lineitem} EXCEPT SELECT p_partkey FROM {part} WHERE p_size < 25",
    "reference_sets": "SELECT DISTINCT CAST(sign(r.reward) AS INT) AS side, s.sample_token FROM selected s JOIN rewards r ON r.episode = s.scene_token WHERE r.reward <> 0",
    # feedback episodes
    "reward_cost": "SELECT episode, cost_s, cost_r, reward FROM rewards",
    "reweight_episodes": "SELECT episode, rho, round(l2_r - l2_s + rho * (box_r - box_s) + 0.05 * (obj_r - obj_s), 6) AS reward FROM episodes CROSS JOIN (SELECT CAST(0 AS DOUBLE) AS rho UNION ALL SELECT CAST(10 AS DOUBLE)) g",
    "rho_sensitivity": "SELECT rho, round(avg(l2_r - l2_s + rho * (box_r - box_s)), 6) AS mean_reward, count(*) FILTER (WHERE l2_r - l2_s + rho * (box_r - box_s) > 0) AS wins FROM episodes CROSS JOIN (SELECT CAST(0 AS DOUBLE) AS rho UNION ALL SELECT CAST(1 AS DOUBLE) UNION ALL SELECT CAST(5 AS DOUBLE) UNION ALL SELECT CAST(25 AS DOUBLE)) g GROUP BY rho",
    "break_even_rho": "SELECT episode, CASE WHEN abs(box_s - box_r) < 1e-12 THEN NULL WHEN (l2_r - l2_s + 0.05 * (obj_r - obj_s)) / (box_s - box_r) < 0 THEN NULL ELSE round((l2_r - l2_s + 0.05 * (obj_r - obj_s)) / (box_s - box_r), 6) END AS rho FROM episodes",
    "reward_scale": "SELECT greatest(coalesce($quantile(abs(reward), 0.5), 1.0), 1e-6) AS scale FROM rewards WHERE abs(reward) > 1e-12",
    "feedback_metrics": "SELECT round(avg(power(greatest(least(reward / 100, 1.0), -1.0) - gap, 2)), 6) AS mse, round(avg(CASE WHEN gap = 0 OR (gap > 0) = (reward > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(gap), 6) AS mean_gap FROM (SELECT reward, (l2_r - l2_s) / 100 AS gap FROM rewards WHERE abs(reward) > 1e-12) t",
    "loo_summary": "SELECT count(*) AS folds, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE reward > 0), 6) AS positive, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE reward < 0), 6) AS negative, round(avg(margin), 6) AS mean_margin, round($quantile(margin, 0.5), 6) AS median_margin, min(margin) AS min_margin, max(margin) AS max_margin FROM (SELECT reward, round(sign(reward) * (l2_r - l2_s), 6) AS margin FROM rewards) t",
    "bootstrap_margin": "SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round($quantile(m, 0.05), 6) AS q_low, round($quantile(m, 0.5), 6) AS median, round($quantile(m, 0.95), 6) AS q_high, round(avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM (SELECT b, CAST(sum(CAST(round(v.reward * 1000000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000000 AS m FROM (SELECT b, i, CAST(floor($uniform('boot:' || CAST(b AS STRING) || ':' || CAST(i AS STRING)) * n) AS BIGINT) + 1 AS pick FROM (SELECT row_number() OVER (ORDER BY episode) AS i, count(*) OVER () AS n FROM rewards) e CROSS JOIN (SELECT $series(1, 100) AS b) s) p JOIN (SELECT reward, row_number() OVER (ORDER BY episode) AS i FROM rewards) v ON v.i = p.pick GROUP BY b) t",
    "random_variance": "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE value > 50) AS better FROM {events} GROUP BY event_type",
    "argmin_row": "SELECT episode, cost_s FROM rewards ORDER BY cost_s, l2_s, episode LIMIT 1",
    "negative_offsets": "SELECT s.sample_token, round(sum(-0.1 * abs(r.reward) / 100), 9) AS v FROM selected s JOIN rewards r ON r.episode = s.scene_token WHERE r.reward < 0 GROUP BY s.sample_token HAVING abs(sum(-0.1 * abs(r.reward) / 100)) > 1e-12",
    "candidate_gate": "SELECT cand, folds_ok, mean, row_number() OVER (ORDER BY CASE WHEN folds_ok >= 3 AND mean > 0.3 THEN 0 ELSE 1 END, mean DESC, cand) AS gate_rank, folds_ok >= 3 AND mean > 0.3 AS passed FROM (SELECT domain_id AS cand, count(DISTINCT CASE WHEN score > 0.4 THEN rn % 4 END) AS folds_ok, round(avg(score), 6) AS mean FROM selected GROUP BY domain_id) t",
    "reward_ema": "SELECT episode, round(sum(power(CAST(0.9 AS DOUBLE), n - i) * 0.1 * reward) OVER (), 6) AS ema FROM (SELECT episode, reward, row_number() OVER (ORDER BY episode) AS i, count(*) OVER () AS n FROM rewards) t",
    "loss_summary": "SELECT user_id, round(avg(value) FILTER (WHERE a <= 3), 6) AS first_mean, round(avg(value) FILTER (WHERE z <= 3), 6) AS last_mean, min(value) AS best, round(avg(value) FILTER (WHERE z <= 3) - avg(value) FILTER (WHERE a <= 3), 6) AS delta, round((avg(value) FILTER (WHERE z <= 3) - avg(value) FILTER (WHERE a <= 3)) / greatest(abs(avg(value) FILTER (WHERE a <= 3)), 1e-6), 6) AS relative_delta FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM {events}) t GROUP BY user_id",
    "unique_ratio": "SELECT count(DISTINCT l_partkey) AS unique_tokens, count(*) AS used, round(count(DISTINCT l_partkey) / CAST(count(*) AS DOUBLE), 9) AS ratio FROM {lineitem}",
    "location_totals": "SELECT location, count(DISTINCT scene_token) AS scenes, count(*) AS samples FROM manifest GROUP BY location",
    # windows and sessions
    "gap_sessions": "SELECT event_id, user_id, session FROM sessions",
    "flag_sequences": "SELECT event_id, user_id, CAST(sum(CASE WHEN rn > 1 AND event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS BIGINT) AS seq FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events}) t",
    "sequence_split": "SELECT event_id, user_id, session, CAST(floor((rn - 1) / ceil(n / 3.0)) AS BIGINT) AS chunk FROM (SELECT event_id, user_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id, session) AS n FROM sessions) t",
    "shard_sequences": "SELECT user_id, session, n, CAST(floor(8 * (upto - n) / CAST(total AS DOUBLE)) AS BIGINT) AS shard FROM (SELECT user_id, session, n, sum(n) OVER (ORDER BY user_id, session) AS upto, sum(n) OVER () AS total FROM (SELECT user_id, session, count(*) AS n FROM sessions GROUP BY user_id, session) a) t",
    "offset_cumsum": "SELECT token, step, round(sum(dx) OVER w, 6) AS px, round(sum(dy) OVER w, 6) AS py FROM steps WINDOW w AS (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "offset_diff": "SELECT token, step, round(vx, 6) AS vx, round(vy, 6) AS vy FROM moves",
    "ego_future": "SELECT token, step, coalesce(lead(x, 1) OVER w, last_x) AS x1, coalesce(lead(x, 2) OVER w, last_x) AS x2, CASE WHEN lead(x, 1) OVER w IS NULL THEN 0 ELSE 1 END AS m1, CASE WHEN lead(x, 2) OVER w IS NULL THEN 0 ELSE 1 END AS m2 FROM (SELECT token, step, x, last_value(x) OVER (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_x FROM steps) s WINDOW w AS (PARTITION BY token ORDER BY step)",
    "dedup_first": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}) t WHERE rn = 1",
    "dedup_aliases": "SELECT p_brand, min(p_partkey) AS keeper, $joined(CASE WHEN rn > 1 THEN CAST(p_partkey AS STRING) END) AS aliases FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM {part}) t WHERE rn > 1 OR rn = 1 GROUP BY p_brand",
    "cumulative_tokens": "SELECT l_partkey AS token, min(l_linenumber) AS first_round FROM {lineitem} GROUP BY l_partkey",
    "cutoff_progression": "SELECT c.cutoff, count(DISTINCT l.l_partkey) AS tokens FROM {lineitem} l JOIN (SELECT 1 AS cutoff UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 7) c ON l.l_linenumber <= c.cutoff GROUP BY c.cutoff",
    "instance_history": "SELECT token, step, count(*) OVER w AS frames, round(sum(x) OVER w, 6) AS sum_x, least(step, 4) AS period FROM steps WINDOW w AS (PARTITION BY token ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "events_tumbling": "SELECT event_type, CAST(floor($micros(ts) / 3600000000) AS BIGINT) AS hour_no, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type, CAST(floor($micros(ts) / 3600000000) AS BIGINT)",
    # trajectories and geometry
    "traj_kinematics": "SELECT token, round(avg(sqrt(vx * vx + vy * vy)), 6) AS speed, round(coalesce(avg(sqrt(ax * ax + ay * ay)), 0), 6) AS accel, round(coalesce(avg(sqrt(power(ax - bx, 2) + power(ay - by_, 2))), 0), 6) AS jerk FROM (SELECT *, lag(ax) OVER (PARTITION BY token ORDER BY step) AS bx, lag(ay) OVER (PARTITION BY token ORDER BY step) AS by_ FROM turns) t GROUP BY token",
    "traj_curvature": "SELECT token, round(coalesce(avg(abs(turn - 2 * pi() * floor((turn + pi()) / (2 * pi())))), 0), 6) AS curvature FROM turns GROUP BY token",
    "rms_norm": "SELECT line, round(sqrt(avg(x * x + y * y) / 2), 6) AS rms FROM points GROUP BY line",
    "limit_period": "SELECT token, step, round(y - floor(y / (2 * pi()) + 0.5) * 2 * pi(), 6) AS wrapped FROM steps",
    "clip_gap": "SELECT token, step, round(1 / (1 + exp(-dx)), 6) AS sig, round(tanh(dy), 6) AS th, greatest(least(y, 40.0), 10.0) AS clipped FROM steps",
    "traj_norm": "SELECT token, step, greatest(least(x / 3, 1.0), -1.0) AS nx, round(greatest(least((y + 0.5) / 8.1, 1.0), 0.0) * 2 - 1, 6) AS ny FROM steps",
    "box_codec": "SELECT token, step, round(ln(hl * 2), 6) AS log_l, round(sin(yaw), 6) AS sin_yaw, round(cos(yaw), 6) AS cos_yaw, round(exp(ln(hl * 2)), 6) AS l, round(atan2(sin(yaw), cos(yaw)), 6) AS yaw FROM boxes",
    "box_corners": "SELECT token, step, c.i AS corner, round(x + c.a * hl * cos(yaw) - c.b * hw * sin(yaw), 6) AS cx, round(y + c.a * hl * sin(yaw) + c.b * hw * cos(yaw), 6) AS cy FROM boxes CROSS JOIN (SELECT 0 AS i, 1 AS a, 1 AS b UNION ALL SELECT 1, 1, -1 UNION ALL SELECT 2, -1, -1 UNION ALL SELECT 3, -1, 1) c",
    "rigid_transform": "SELECT token, step, round(cos(0.5) * x - sin(0.5) * y + 3, 6) AS gx, round(sin(0.5) * x + cos(0.5) * y - 2, 6) AS gy FROM steps",
    "roi_normalize": "SELECT token, step, round((x + 30) / (60 + 1e-5), 6) AS nx, round((y + 15) / (30 + 1e-5), 6) AS ny FROM steps",
    "quat_to_rpy": "SELECT vec_id, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 6) AS roll, round(asin(greatest(least(2 * (w * y - z * x), 1.0), -1.0)), 6) AS pitch, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) AS yaw FROM (SELECT vec_id, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT vec_id, x, y, z, w, sqrt(x * x + y * y + z * z + w * w) AS n FROM (SELECT vec_id, $at(embedding, 1) AS x, $at(embedding, 2) AS y, $at(embedding, 3) AS z, $at(embedding, 4) AS w FROM {embeddings}) a) b WHERE n > 0) q",
    "traj_yaw": "SELECT token, step, round(CASE WHEN sqrt(power(ex - sx, 2) + power(ey - sy, 2)) < 0.5 THEN pi() / 2 ELSE atan2(coalesce(ny, y) - py, coalesce(nx, x) - px) END, 6) AS yaw FROM (SELECT token, step, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x, 1, 0) OVER w AS px, lag(y, 1, 0) OVER w AS py, first_value(x) OVER f AS sx, first_value(y) OVER f AS sy, last_value(x) OVER f AS ex, last_value(y) OVER f AS ey FROM steps WINDOW w AS (PARTITION BY token ORDER BY step), f AS (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) t",
    "resample_polyline": "SELECT line, k, round(x0 + (x1 - x0) * t, 6) AS x, round(y0 + (y1 - y0) * t, 6) AS y FROM (SELECT p.line, g.k, p.x AS x0, p.y AS y0, p.nx AS x1, p.ny AS y1, CASE WHEN p.d > 0 THEN (g.k / 9.0 * p.total - p.upto) / p.d ELSE 0 END AS t, row_number() OVER (PARTITION BY p.line, g.k ORDER BY p.step DESC) AS rn FROM (SELECT line, step, x, y, nx, ny, d, coalesce(sum(d) OVER (PARTITION BY line ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, sum(d) OVER (PARTITION BY line) AS total FROM (SELECT line, step, x, y, nx, ny, sqrt(power(nx - x, 2) + power(ny - y, 2)) AS d FROM (SELECT line, step, x, y, lead(x) OVER (PARTITION BY line ORDER BY step) AS nx, lead(y) OVER (PARTITION BY line ORDER BY step) AS ny FROM points) a WHERE nx IS NOT NULL) b) p CROSS JOIN (SELECT $series(0, 9) AS k) g WHERE p.upto <= g.k / 9.0 * p.total + 1e-9) t WHERE rn = 1",
    "chamfer": "SELECT a.line AS pred, b.line AS gt, round(($near(a.g, b.g) + $near(b.g, a.g)) / 2, 6) AS distance FROM line_arrays a JOIN line_arrays b ON b.label = a.label",
    "floor_height": "SELECT l_suppkey AS sensor, round($quantile(l_extendedprice / 1000, 0.0099), 6) AS floor FROM {lineitem} GROUP BY l_suppkey",
    "depth_raster": "SELECT CAST(floor(x) AS BIGINT) AS u, CAST(floor(dx * 100) AS BIGINT) AS v, min(y) AS depth FROM steps WHERE y > 0 AND x < 40 GROUP BY CAST(floor(x) AS BIGINT), CAST(floor(dx * 100) AS BIGINT)",
    "anchor_projection": "SELECT token, step, round(cos(0.1) * (x - dx * 0.5) - sin(0.1) * (y - dy * 0.5) + 1, 6) AS ax, round(sin(0.1) * (x - dx * 0.5) + cos(0.1) * (y - dy * 0.5) - 1, 6) AS ay FROM steps",
    # evaluation
    "pr_curve": "SELECT class, det, l_linenumber, round(recall, 9) AS recall, round(prec, 9) AS prec FROM envelope",
    "average_precision": "SELECT class, round(sum((recall - before) * env), 6) AS ap FROM (SELECT class, recall, env, lag(recall, 1, CAST(0 AS DOUBLE)) OVER (PARTITION BY class ORDER BY conf DESC, det, l_linenumber) AS before FROM envelope) t GROUP BY class",
    "map_map": "SELECT round(avg(ap), 6) AS map FROM (SELECT class, sum((recall - before) * env) AS ap FROM (SELECT class, recall, env, lag(recall, 1, CAST(0 AS DOUBLE)) OVER (PARTITION BY class ORDER BY conf DESC, det, l_linenumber) AS before FROM envelope) t GROUP BY class) a",
    "recall_interp": """SELECT class, r, round(prec + (nprec - prec) * (r / 100.0 - recall) / (nrecall - recall), 9) AS prec FROM (SELECT class, recall, nrecall, prec, nprec, $series(lo, hi) AS r FROM (SELECT *, CAST(floor((100.0 * ctp + npos - 1) / npos) AS INT) AS lo, CAST(floor((100.0 * nctp + npos - 1) / npos) AS INT) - 1 AS hi FROM
        (SELECT class, ctp, npos, CAST(ctp AS DOUBLE) / npos AS recall, CAST(ctp AS DOUBLE) / n AS prec, lead(ctp) OVER w AS nctp, lead(CAST(ctp AS DOUBLE) / npos) OVER w AS nrecall, lead(CAST(ctp AS DOUBLE) / n) OVER w AS nprec FROM pr WINDOW w AS (PARTITION BY class ORDER BY n)) a WHERE nctp > ctp) b WHERE lo <= hi) c
        UNION ALL SELECT class, $series(0, CAST(floor((100.0 * ctp + npos - 1) / npos) AS INT) - 1), round(CAST(ctp AS DOUBLE) / n, 9) FROM pr WHERE n = 1 AND ctp > 0 UNION ALL SELECT class, 100, round(max(CAST(ctp AS DOUBLE) / n) FILTER (WHERE last = n), 9) FROM (SELECT *, max(n) OVER (PARTITION BY class) AS last FROM pr) d GROUP BY class""",
    "motion_epa": "SELECT class, round((sum(tp) - 0.5 * sum(1 - tp)) / CAST(count(*) AS DOUBLE), 6) AS epa FROM detections GROUP BY class",
    "planning_metrics": "SELECT step, round(l2, 6) AS l2, round(avg(l2) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS prefix_l2 FROM (SELECT step, avg(sqrt(power(x - dx * 100, 2) + power(y - dy * 100, 2))) AS l2 FROM steps WHERE step <= 6 GROUP BY step) t",
    "traj_metrics": "SELECT token, round(min(ade), 6) AS min_ade, round(min(fde), 6) AS min_fde, min(miss) AS miss FROM (SELECT token, m.k, avg(d) AS ade, max(CASE WHEN step = n THEN d END) AS fde, CASE WHEN max(d) > 2 THEN 1 ELSE 0 END AS miss FROM (SELECT s.token, s.step, s.n, m.k, sqrt(power(s.x - s.dx * 100 * m.k, 2) + power(s.y / 10 - s.dy * 100, 2)) AS d FROM (SELECT *, count(*) OVER (PARTITION BY token) AS n FROM steps) s CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) m) t CROSS JOIN (SELECT 0 AS z) z JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) m ON m.k = t.k GROUP BY token, m.k) q GROUP BY token",
    "box_summary": "SELECT token, round(count(*) / 128.0, 6) AS n, round(avg(sqrt(x * x + y * y)) / 80, 6) AS mean_d, round(stddev_pop(sqrt(x * x + y * y)) / 80, 6) AS std_d, round(avg(CASE WHEN sqrt(x * x + y * y) < 20 THEN 1.0 ELSE 0.0 END), 6) AS near20, round(avg(CASE WHEN sqrt(x * x + y * y) < 40 THEN 1.0 ELSE 0.0 END), 6) AS near40, round(avg(CASE WHEN abs(x) < 10 THEN 1.0 ELSE 0.0 END), 6) AS lane, round(avg(len) / 10, 6) AS mean_len FROM steps GROUP BY token",
    "velocity_summary": "SELECT token, round(avg(sqrt(vx * vx + vy * vy)), 6) AS mean_v, round(stddev_pop(sqrt(vx * vx + vy * vy)), 6) AS std_v, round(max(sqrt(vx * vx + vy * vy)), 6) AS max_v FROM moves GROUP BY token",
    "logit_entropy": "SELECT token, round(avg(-(p * log2(p) + (1 - p) * log2(1 - p))), 6) AS entropy FROM (SELECT token, greatest(least(1 / (1 + exp(-(dx * 20 - 1))), 1 - 1e-6), 1e-6) AS p FROM steps) t GROUP BY token",
    "kmeans_assign": "SELECT sample_token, cluster FROM (SELECT sample_token, c.cluster, row_number() OVER (PARTITION BY sample_token ORDER BY power(teacher_loss - c.a, 2) + power(ego_speed / 30 - c.b, 2), c.cluster) AS rn FROM train CROSS JOIN (SELECT 0 AS cluster, 0.5 AS a, 0.5 AS b UNION ALL SELECT 1, 1.5, 0.8 UNION ALL SELECT 2, 2.5, 1.1) c) t WHERE rn = 1",
    "cluster_profile": "SELECT domain_id AS cluster, location, count(*) AS n, round(avg(teacher_loss), 6) AS mean_loss, min(sample_token) AS first FROM train GROUP BY domain_id, location",
}

BASE |= more.BASE
QUERIES |= more.QUERIES

_MACRO = re.compile(r"\$(\w+)\(")


def _macros(text: str, side: int) -> str:
    """Expand macros, the innermost last."""
    while m := _MACRO.search(text):
        depth, start, args = 1, m.end(), []
        for k in range(m.end(), len(text)):
            c = text[k]
            depth += (c == "(") - (c == ")")
            if depth == 0 or depth == 1 and c == ",":
                args.append(text[start:k].strip())
                start = k + 1
            if depth == 0:
                break
        if m[1] == "round":  # the same arithmetic in both engines; what ends in a half, give or take, goes up
            out = f"(floor(({args[0]}) * 1e{args[1]} + 0.501) / 1e{args[1]})" if len(args) > 1 else f"floor({args[0]} + 0.501)"
        else:
            out = DIALECTS[m[1]][side]
        for i, a in enumerate(args, 1):
            out = out.replace(f"${i}", a)
        text = text[: m.start()] + out + text[k + 1 :]
    return text


def _relations(text: str, given: tuple[str, ...] = ()) -> list[str]:
    """The base relations that a statement needs, each after those that it needs itself; given ones need none."""
    out: list[str] = []
    for name in BASE:
        if re.search(rf"\b(?:FROM|JOIN) {name}\b", text) and name not in out:
            out += [x for x in _relations(BASE[name], given) if x not in out] if name not in given else []
            out.append(name)
    return out


def rendered(text: str, side: int = 0, given: tuple[str, ...] = ()) -> str:
    """A statement over the bound relations for an engine; relations that are given are tables of their names."""
    names = _relations(text, given)
    ctes = ", ".join(f"{n} AS ({f'SELECT * FROM {{{n}}}' if n in given else BASE[n]})" for n in names)
    # a literal with a point is a decimal in one engine and a double in the other
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", _macros(re.sub(r"(?<![\w$])round\(", "$round(", f"WITH {ctes} {text}" if names else text), side))


def statement(name: str, side: int) -> str:
    return rendered(QUERIES[name], side)


def tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    """The tables that a rendered statement names."""
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = statement(name, 0)
        return spark.sql(text, **tables(spark, sf_dir, text))

    run.__name__ = name
    return run


def over(name: str, **given: DataFrame) -> Callable[[SparkSession, str], DataFrame]:
    """A query with some of its relations given as DataFrames, in place of their statements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = rendered(QUERIES[name], 0, tuple(given))
        return spark.sql(text, **tables(spark, sf_dir, text), **given)

    return run


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base relation."""
    text = rendered(f"SELECT * FROM {name}")
    return spark.sql(text, **tables(spark, sf_dir, text))


def oracle(name: str) -> str:
    text = statement(name, 1)
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text
