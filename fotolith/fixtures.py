"""Photo-shaped views over the driver's tables, from one text for Spark and DuckDB.

``#1.5#`` stands for a DOUBLE literal; ``{json}``, ``{t_us}`` and ``{phash}`` are the dialects' own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "embeddings", "documents", "labels", "nation", "orders", "lineitem", "part")

_SPARK = {
    "json": "get_json_object(e.props, '$.k')",
    "t_us": "CAST(floor((unix_micros(CAST(e.ts AS TIMESTAMP)) - unix_micros(CAST(date_trunc('DAY', e.ts) AS TIMESTAMP))) / 60) AS BIGINT)",
    "phash": "aggregate(transform(sequence(0, 62), i -> CASE WHEN v.embedding[i] > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, b) -> a + b) ^ CAST(CASE p.photo_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 16383 END AS BIGINT)",
}
_DUCK = {
    "json": "json_extract_string(e.props, '$.k')",
    "t_us": "CAST(floor((epoch_us(e.ts) - epoch_us(date_trunc('day', e.ts)::TIMESTAMP)) / 60) AS BIGINT)",
    "phash": "xor(CAST(list_sum(list_transform(range(63), lambda i: CASE WHEN v.embedding[i + 1] > 0 THEN (1::BIGINT << i::INT) ELSE 0::BIGINT END)) AS BIGINT), CAST(CASE p.photo_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 16383 END AS BIGINT))",
}

VIEWS = {
    "v_photos": """SELECT e.event_id AS photo_id, concat(CAST(CAST(floor(e.user_id / 100) AS BIGINT) AS STRING), '/', CAST(CAST(e.ts AS DATE) AS STRING)) AS session_id, e.user_id AS folder_id, CASE WHEN e.event_type = 'view' THEN 'detail' ELSE 'portrait' END AS scene_type,
  CASE WHEN e.event_type = 'signup' THEN CAST(floor(e.event_id / 7) AS BIGINT) END AS burst_id, CASE WHEN e.event_type = 'view' THEN 0 ELSE CAST(e.event_id % 4 AS INT) END AS face_count,
  e.value AS blur_score, CAST((e.event_id * 37) % 100 AS DOUBLE) / #100.0# AS aesthetic_score, CASE WHEN e.event_id % 3 = 0 THEN 4000 ELSE 6000 END AS width, CASE WHEN e.event_id % 3 = 0 THEN 6000 ELSE 4000 END AS height,
  e.event_type AS scene, CAST({json} AS INT) AS k, {t_us} AS t_us FROM events e""",
    "v_hashed": """SELECT p.*, {phash} AS phash FROM (SELECT p.*, CAST(floor(p.photo_id / 3) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id FROM v_photos p) p JOIN embeddings v ON v.vec_id = p.vec_id""",
    "v_faces": """SELECT p.photo_id, p.session_id, i.i AS face_index, CAST((p.photo_id * 13 + i.i * 29) % 100 AS DOUBLE) / #250.0# AS ear, CAST((p.photo_id * 7 + i.i * 31) % 100 AS DOUBLE) / #120.0# AS blink,
  CAST((p.photo_id * 11 + i.i * 17) % 100 AS DOUBLE) / #140.0# AS gaze_out, CAST((p.photo_id * 5 + i.i * 23) % 61 - 30 AS DOUBLE) AS yaw, CAST((p.photo_id * 3 + i.i * 41) % 100 AS DOUBLE) / #100.0# AS smile_score,
  CAST((p.photo_id * 19 + i.i * 7) % 500 AS DOUBLE) AS sharpness, 100 * i.i AS x, 80 * i.i AS y, CAST(40 + (p.photo_id + i.i * 13) % 200 AS INT) AS w, (p.photo_id + i.i) % 10 <> 0 AS valid,
  CAST((p.photo_id + i.i * 3) % 50 AS DOUBLE) / #100.0# + #0.5# AS confidence, CAST((p.photo_id * 7 + i.i * 3) % 12 AS INT) AS identity_id
  FROM v_photos p JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) i ON i.i <= p.face_count""",
    "v_history": """SELECT photo_id, session_id, folder_id, scene, k, t_us, k % 6 AS rating, CASE WHEN k % 11 = 0 THEN -1 WHEN k % 7 = 0 THEN 1 ELSE 0 END AS pick,
  CAST(k - 50 AS DOUBLE) / #40.0# AS exposure, CAST(k - 50 AS DOUBLE) AS contrast, CAST(photo_id % 40 - 20 AS DOUBLE) AS vibrance,
  CAST(k % 10 AS DOUBLE) / #50.0# AS crop_left, CAST(k % 7 AS DOUBLE) / #50.0# AS crop_top, #1.0# - CAST(k % 5 AS DOUBLE) / #50.0# AS crop_right, #1.0# - CAST(k % 9 AS DOUBLE) / #50.0# AS crop_bottom,
  CAST(k % 21 - 10 AS DOUBLE) / #10.0# AS crop_angle FROM v_photos""",
    "v_files": """SELECT photo_id, concat(CAST(folder_id AS STRING), '/IMG_', CAST(CAST(floor(photo_id / 2) AS BIGINT) AS STRING)) AS stem_path, concat('IMG_', CAST(CAST(floor(photo_id / 2) AS BIGINT) AS STRING)) AS stem,
  CASE WHEN photo_id % 5 < 3 AND photo_id % 2 = 1 THEN 'cr2' ELSE 'jpg' END AS ext, folder_id, k FROM v_photos""",
    "v_light": """SELECT photo_id, session_id, face_count > 0 AS has_people, CASE WHEN k % 9 <> 0 THEN CAST(k - 50 AS DOUBLE) / #2.0# END AS wb_temp, CAST(photo_id % 41 - 20 AS DOUBLE) / #2.0# AS wb_tint,
  #0.02# + CAST(k AS DOUBLE) / #120.0# AS global_lum, CAST(photo_id % 100 AS DOUBLE) / #1000.0# AS clip_frac, blur_score FROM v_photos""",
    "v_sessions": """SELECT o_orderpriority AS event_type, date_trunc('month', o_orderdate) AS month, count(*) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS kept, max(o_orderdate) AS created
  FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)""",
    "v_labels": """SELECT l.doc_id AS photo_id, d.lang AS attribute, l.quality AS value, CASE WHEN l.doc_id % 3 = 0 THEN 1 WHEN l.doc_id % 3 = 1 THEN 0 END AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "v_bursts": """SELECT g.*, sum(CASE WHEN gap IS NULL OR gap > 4000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t_us, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst
  FROM (SELECT p.*, t_us - lag(t_us) OVER (PARTITION BY session_id ORDER BY t_us, photo_id) AS gap FROM v_photos p) g""",
    "v_scored": """SELECT b.photo_id, b.session_id, b.scene_type, b.face_count, CAST(b.burst AS BIGINT) AS burst, b.t_us, b.width, b.height, b.k, b.scene, b.blur_score, b.aesthetic_score,
  #0.6# * least(#1.0#, b.blur_score / #500.0#) + #0.4# * b.aesthetic_score AS score FROM v_bursts b""",
    "v_gate_faces": """SELECT photo_id, session_id, face_index, ear, blink, gaze_out, yaw / #50.0# AS yaw, smile_score, sharpness, w, valid, identity_id FROM v_faces""",
    "v_expressions": """SELECT photo_id, count(*) AS valid_faces, sum(CASE WHEN ear < #0.18# OR blink > #0.5# THEN 1 ELSE 0 END) AS closed, sum(CASE WHEN gaze_out > #0.35# OR abs(yaw) > 28 THEN 1 ELSE 0 END) AS away,
  sum(CASE WHEN smile_score >= #0.5# THEN 1 ELSE 0 END) AS smiling, max(abs(yaw)) AS max_yaw, avg(greatest(#0.0#, #1.0# - abs(yaw) / #40.0#)) AS gaze, max(CASE WHEN identity_id IN (3, 5) THEN 1 ELSE 0 END) AS vip FROM v_faces WHERE valid GROUP BY photo_id""",
    "v_judged": """SELECT s.*, #0.02# + CAST(s.k AS DOUBLE) / #120.0# AS lum, coalesce(e.valid_faces, 0) AS valid_faces, coalesce(e.closed, 0) AS closed, coalesce(e.away, 0) AS away, coalesce(e.smiling, 0) AS smiling, coalesce(e.max_yaw, #0.0#) AS max_yaw,
  coalesce(e.gaze, #0.5#) AS gaze, coalesce(e.vip, 0) AS vip FROM v_scored s LEFT JOIN v_expressions e ON e.photo_id = s.photo_id""",
    "v_decisions": """SELECT photo_id, session_id, k, CASE WHEN k % 3 = 0 THEN 'selected' WHEN k % 5 = 0 THEN 'alternative' WHEN k % 7 = 0 THEN 'closed_eyes' ELSE 'duplicates' END AS label,
  CASE WHEN photo_id % 4 = 0 THEN 'selected' ELSE 'duplicates' END AS truth FROM v_photos""",
    "v_portraits": """SELECT f.*, CASE (photo_id + face_index) % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'partially_open' WHEN 2 THEN 'mid_blink' WHEN 3 THEN 'covered' WHEN 4 THEN 'glasses' ELSE 'open' END AS left_state,
  CASE (photo_id * 7 + face_index * 3) % 4 WHEN 0 THEN 'partially_open' WHEN 1 THEN 'closed' ELSE 'open' END AS right_state, ear * 2 AS left_ear, ear AS right_ear, photo_id % 17 = 0 AS kissing, CAST(photo_id % 45 - 15 AS DOUBLE) AS head_pitch,
  blink AS mouth_open, sharpness / #45.0# - #0.5# AS focus_raw, w AS h FROM v_faces f""",
    "v_lens": """SELECT photo_id, session_id, blur_score * 5 AS subject, CAST((photo_id * 29) % 1000 AS DOUBLE) AS ground, CAST(photo_id % 10 AS DOUBLE) / #8.0# AS dispersion FROM v_photos""",
    "v_batches": """SELECT folder_id, CAST(2000 + folder_id % 25 AS INT) AS year, ' Studio A ' AS creator, CASE WHEN folder_id % 5 <> 0 THEN '(c) {{year}} {{creator}} for {{client}}' END AS notice, CASE folder_id % 3 WHEN 0 THEN 'wedding' WHEN 1 THEN 'birthday' ELSE 'other' END AS event_type,
  CASE folder_id % 4 WHEN 0 THEN '15' WHEN 1 THEN ' 16 años ' WHEN 2 THEN '' END AS age, CASE WHEN folder_id % 7 <> 0 THEN concat(' Client ', CAST(folder_id % 11 AS STRING)) END AS client, CASE WHEN folder_id % 2 = 0 THEN 'Quito' ELSE 'Lima ' END AS city,
  CASE WHEN folder_id % 3 <> 2 THEN 'Portrait, PARTY,,quito , family' END AS tags FROM v_photos GROUP BY folder_id""",
    "v_telemetry": """SELECT photo_id AS event_id, folder_id AS install, CASE k % 7 WHEN 0 THEN 'session_start' WHEN 1 THEN 'user_override' WHEN 2 THEN 'duel_resolved' WHEN 3 THEN 'ingestion_batch' WHEN 4 THEN 'clustering_complete' WHEN 5 THEN 'performance_snapshot' ELSE 'style_applied' END AS kind,
  CASE photo_id % 4 WHEN 0 THEN 'mac' WHEN 1 THEN 'win' WHEN 2 THEN 'win' END AS os, CASE WHEN photo_id % 6 <> 0 THEN concat('gpu ', CAST(photo_id % 8 AS STRING)) END AS gpu, CASE WHEN photo_id % 2 = 0 THEN 'false_negative' ELSE 'false_positive' END AS override_type,
  CASE WHEN photo_id % 5 <> 0 THEN blur_score END AS blur, face_count AS faces, CAST(k AS DOUBLE) / #10.0# AS amount, concat('preset ', CAST(photo_id % 9 AS STRING)) AS preset FROM v_photos""",
    "v_reminders": """SELECT photo_id AS event_id, folder_id AS directory, t_us AS at_us, CASE k % 9 WHEN 0 THEN 'dismiss' WHEN 1 THEN 'snooze' WHEN 2 THEN 'snooze' WHEN 3 THEN 'sync' WHEN 4 THEN 'export' ELSE 'view' END AS action, CAST(k % 5 AS BIGINT) AS hours FROM v_photos""",
}


def _literal(sql: str, spark: bool) -> str:
    return re.sub(r"#([\d.]+)#", r"\1D" if spark else r"\1::DOUBLE", sql)


#: Of each session the folder whose views it has, and how many of :data:`VIEWS`.
_made: dict[str, tuple[str, int]] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; the views and tables it reads are registered as temporary views, unless the
    session has them of this folder already."""
    key = f"{spark.sparkContext.applicationId}/{id(spark)}"
    at, done = _made.get(key, ("", 0))
    if at != sf_dir or not spark.catalog.tableExists(TABLES[-1]):
        done = 0
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    wanted = list(VIEWS).index(name) + 1
    for v in list(VIEWS)[done:wanted]:
        spark.sql(_literal(VIEWS[v].format(**_SPARK), True)).createOrReplaceTempView(v)
    _made[key] = (sf_dir, max(done, wanted))
    return spark.table(name)


def _means(sql: str) -> str:
    """``MEAN(x)`` as a mean over whole numbers of 10^-9: sums of doubles depend on their order."""
    while (at := sql.find("MEAN(")) >= 0:
        end, depth = at + 5, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = sql[at + 5:end - 1]
        sql = f"{sql[:at]}(CAST(sum(CAST(round(({x}) * 1e9) AS HUGEINT)) AS DOUBLE) / (count({x}) * 1e9)){sql[end:]}"
    return sql


def duck(sql: str) -> str:
    """``sql`` after the definitions of the views it reads, for DuckDB."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in wanted:
                need(VIEWS[v])
                wanted.append(v)

    need(sql)
    own = [f"{v} AS ({_literal(VIEWS[v].format(**_DUCK), False)})" for v in wanted]
    sql = _means(_literal(sql, False).strip())
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*own, sql[15:]])}"
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join([*own, sql[5:]])}"
    return f"WITH {', '.join(own)} {sql}" if own else sql
