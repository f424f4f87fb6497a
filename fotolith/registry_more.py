"""Registered queries of gates, winners, develop settings, chapters and maintenance, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view
from .operators import aggs, develop, joins, ranking, rules, sessions, story, windows
from .plans.decide import TARGETS, decide
from .registry import CHAPTERS, HISTORY, _history, _query, _r, _scored
from .sources import tables

_STAGES = [
    ("flash_misfire", "NOT (median(lum) OVER w >= 0.09 AND lum < median(lum) OVER w * #0.4#)"), ("closed_eyes", "NOT (vip_ear < #0.18# OR vip_blink > 0.5)"), ("closed_eyes", "NOT (all_ear < #0.18# OR all_blink > 0.5)"),
    ("looking_away", "NOT (vip_gaze > #0.35# OR vip_yaw > 0.5)"), ("looking_away", "NOT (all_gaze > #0.35# OR all_yaw > 0.5)"), ("vip_no_smile", "coalesce(vip_smile, 0) >= #0.35#"),
    ("soft_face", "face_sharp >= median(CASE WHEN alive THEN face_sharp END) OVER w * #0.5#"),
]


def _gates(alike: bool = False) -> str:
    big = "true" if alike else "CAST(w * w AS DOUBLE) / max(CAST(w * w AS DOUBLE)) OVER (PARTITION BY photo_id) >= #0.35#"
    sql = f"WITH f0 AS (SELECT *, {big} AS big FROM v_gate_faces)," + """
f1 AS (SELECT *, max((valid AND big)::INT) OVER (PARTITION BY photo_id) AS anyone FROM f0), f2 AS (SELECT *, valid AND (big OR anyone = 0) AS vip FROM f1),
f AS (SELECT photo_id, min(ear) FILTER (vip) AS vip_ear, max(blink) FILTER (vip) AS vip_blink, max(gaze_out) FILTER (vip) AS vip_gaze, max(abs(yaw)) FILTER (vip) AS vip_yaw, max(smile_score) FILTER (vip) AS vip_smile,
 min(ear) FILTER (valid) AS all_ear, max(blink) FILTER (valid) AS all_blink, max(gaze_out) FILTER (valid) AS all_gaze, max(abs(yaw)) FILTER (valid) AS all_yaw, min(sharpness) FILTER (big) AS face_sharp FROM f2 GROUP BY photo_id),
g0 AS (SELECT j.*, f.* EXCLUDE (photo_id), count(*) OVER (PARTITION BY session_id, burst) AS n, true AS alive, NULL::VARCHAR AS reason FROM v_judged j LEFT JOIN f USING (photo_id))"""
    for i, (name, ok) in enumerate(_STAGES):
        sql += f""",
a{i} AS (SELECT *, coalesce({ok}, true) AS ok FROM g{i} WINDOW w AS (PARTITION BY session_id, burst)),
b{i} AS (SELECT *, n > 1 AND alive AND NOT ok AND sum((alive AND ok)::INT) OVER (PARTITION BY session_id, burst) > 0 AS out FROM a{i}),
g{i + 1} AS (SELECT * EXCLUDE (ok, out) REPLACE (alive AND NOT out AS alive, CASE WHEN out THEN '{name}' ELSE reason END AS reason) FROM b{i})"""
    return sql + f", gates AS (SELECT * FROM g{len(_STAGES)}) "


GATES = _gates()
HEROES = GATES + """, h1 AS (SELECT *, closed = 0 AND away = 0 AS open, n >= 2 AND valid_faces > 0 AS shot, CASE WHEN vip > 0 THEN least(#1.0#, score * #1.2#) ELSE score END AS s1 FROM gates),
h2 AS (SELECT *, CASE WHEN shot AND open AND (max_yaw < 15 OR gaze >= #0.75#) THEN least(#1.0#, s1 + #0.35#) ELSE s1 END AS s2 FROM h1), h3 AS (SELECT *, CASE WHEN shot AND open AND vip > 0 THEN least(#1.0#, s2 + #0.15#) ELSE s2 END AS s3 FROM h2),
heroes AS (SELECT * REPLACE (CASE WHEN shot AND open AND vip > 0 AND smiling > 0 THEN least(#1.0#, s3 + #0.15#) ELSE s3 END AS score) FROM h3) """


def _adv(a: str, b: str, taste: bool) -> str:
    look = lambda x: f"CASE WHEN coalesce({x}.aesthetic_score, 0) = 0 THEN #0.5# ELSE {x}.aesthetic_score END"
    return (f"({b}.closed - {a}.closed) * #1.8# + ({a}.smiling - {b}.smiling) * #1.2# + ({b}.away - {a}.away) * #0.8# + ({a}.blur_score - {b}.blur_score) / greatest({a}.blur_score, {b}.blur_score, #1.0#) * #1.5#"
            f" + ({look(a)} - {look(b)}) * #2.0#" + (f" + coalesce({a}.taste - {b}.taste, 0) * #1.5#" if taste else ""))


def _game(a: str, b: str, ra: str, rb: str, taste: bool) -> str:
    return f"#32.0# * (1 / (1 + exp(-greatest(-#20.0#, least(#20.0#, {_adv(a, b, taste)})))) - 1 / (1 + power(#10.0#, ({rb} - {ra}) / 400)))"


#: A photo's learned affinity; a ninth have none.
TASTE = "CASE WHEN photo_id % 9 <> 0 THEN CAST((photo_id * 17) % 100 AS DOUBLE) / #40.0# END"


def _elo(taste: bool = False) -> str:
    g = lambda *x: _game(*x, taste)
    return f""", e0 AS (SELECT *, {TASTE} AS taste, row_number() OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) AS r FROM heroes WHERE alive),
e1 AS (SELECT a.session_id, a.burst, a.photo_id AS pa, b.photo_id AS pb, c.photo_id AS pc, {g('a', 'b', '#1500.0#', '#1500.0#')} AS g1, a, b, c FROM e0 a JOIN e0 b ON a.session_id = b.session_id AND a.burst = b.burst AND a.r = 1 AND b.r = 2 AND round_even(a.score - b.score, 4) <= #0.025#
 LEFT JOIN e0 c ON a.session_id = c.session_id AND a.burst = c.burst AND c.r = 3),
e2 AS (SELECT *, CASE WHEN pc IS NULL THEN 0 ELSE {g('a', 'c', '(#1500.0# + g1)', '#1500.0#')} END AS g2 FROM e1), e3 AS (SELECT *, CASE WHEN pc IS NULL THEN 0 ELSE {g('b', 'c', '(#1500.0# - g1)', '(#1500.0# - g2)')} END AS g3 FROM e2),
e4 AS (SELECT session_id, burst, pa, pb, pc, #1500.0# + g1 + g2 AS ra, #1500.0# - g1 + g3 AS rb, CASE WHEN pc IS NOT NULL THEN #1500.0# - g2 - g3 END AS rc FROM e3),
elo AS (SELECT session_id, burst, CASE WHEN ra >= rb AND ra >= coalesce(rc, ra) THEN pa WHEN rb >= coalesce(rc, rb) THEN pb ELSE pc END AS photo_id, greatest(ra, rb, coalesce(rc, ra)) AS elo FROM e4) """


ELO = _elo()
WINNERS = ELO + """, w0 AS (SELECT *, lead(score) OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) AS nxt, row_number() OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) AS r FROM heroes WHERE alive),
winners AS (SELECT w0.session_id, w0.burst, coalesce(elo.photo_id, w0.photo_id) AS photo_id, CASE WHEN nxt IS NULL THEN #1.0# ELSE round_even(score - nxt, 4) END AS margin,
 CASE WHEN n = 1 THEN NULL WHEN elo.photo_id IS NOT NULL THEN 'elo' WHEN nxt IS NULL THEN 'gate' ELSE 'score' END AS decided_by FROM w0 LEFT JOIN elo ON elo.session_id = w0.session_id AND elo.burst = w0.burst WHERE w0.r = 1) """


def _covered(people: str, kept: str) -> str:
    """The photos ``cover`` that cover people of whom no photo of ``kept`` (photo_id) shows any: of ``people`` (photo_id,
    session_id, identity_id, score) those seen three times, one after the other in order of first sight."""
    return f"""pp AS ({people}), ps AS (SELECT session_id, identity_id, min(photo_id) AS seen, arg_max(photo_id, (score, -photo_id)) AS best, max((photo_id IN ({kept}))::INT) AS kept FROM pp GROUP BY session_id, identity_id HAVING count(*) >= 3),
po AS (SELECT ps.session_id, ps.identity_id, best, kept, row_number() OVER (PARTITION BY ps.session_id ORDER BY seen, ps.identity_id) AS i, (SELECT list(b.identity_id) FROM pp b WHERE b.photo_id = ps.best) AS others FROM ps),
pr AS (SELECT session_id, 0::BIGINT AS i, []::BIGINT[] AS covered, NULL::BIGINT AS photo_id FROM po GROUP BY session_id
 UNION ALL SELECT pr.session_id, po.i, CASE WHEN kept = 1 OR list_contains(covered, identity_id) THEN covered ELSE list_concat(covered, others) END, CASE WHEN kept = 1 OR list_contains(covered, identity_id) THEN NULL ELSE best END FROM pr JOIN po ON po.session_id = pr.session_id AND po.i = pr.i + 1),
cover AS (SELECT DISTINCT session_id, photo_id FROM pr WHERE photo_id IS NOT NULL)"""


def _decision(level: str, coverage: bool) -> str:
    """The pipeline from the scores with their bonuses on; ``can`` are photos that may be chosen."""
    enough, target = windows.ALTERNATE_LEVELS[level], TARGETS[level]
    ev = "log2(greatest(lum, #0.0001#) / #0.18#)"
    side = f"(NOT side AND norm >= #{enough}#)" + (f" OR (side AND norm >= #{enough}# * #1.15#)" if level == "more" else "")
    return "WITH RECURSIVE " + (HEROES + WINNERS)[5:] + ", " + CHAPTERS[5:] + f""", q0 AS (SELECT h.*, c.chapter, w.photo_id AS rep, w.margin, w.decided_by, h.k % 50 = 49 AS error,
 (h.k % 6 = 0 AND h.blur_score < #28.0# AND h.blur_score * 2 < 80) OR ({ev} > 2 AND h.k / #100.0# > #0.85#) OR {ev} < -#4.5# OR coalesce(reason = 'flash_misfire', false) AS trash
 FROM heroes h JOIN winners w ON w.session_id = h.session_id AND w.burst = h.burst JOIN c ON c.photo_id = h.photo_id),
q1 AS (SELECT *, NOT error AND NOT trash AS can, width >= height AS wide FROM q0),
q2 AS (SELECT *, median(score) FILTER (can) OVER (PARTITION BY session_id, chapter) AS cm, median(score) FILTER (can) OVER (PARTITION BY session_id) AS gm FROM q1),
q3 AS (SELECT *, CASE WHEN gm IS NULL OR cm IS NULL OR gm <= 0 OR cm <= #0.05# THEN score ELSE score * greatest(#0.7#, least(#1.4#, gm / cm)) END AS norm FROM q2),
q4 AS (SELECT *, max((can AND photo_id = rep)::INT) OVER (PARTITION BY session_id, burst) AS rc, row_number() OVER (PARTITION BY session_id, burst ORDER BY can DESC, norm DESC, photo_id) AS rn FROM q3),
q5 AS (SELECT *, can AND CASE WHEN rc = 1 THEN photo_id = rep ELSE rn = 1 END AS prim FROM q4), q6 AS (SELECT *, max(CASE WHEN prim THEN wide::INT END) OVER (PARTITION BY session_id, burst) AS pw FROM q5),
q7 AS (SELECT *, CASE WHEN can AND NOT prim THEN wide::INT = pw END AS side FROM q6), q8 AS (SELECT *, row_number() OVER (PARTITION BY session_id, burst, side ORDER BY norm DESC, photo_id) AS ro FROM q7),
q9 AS (SELECT *, prim OR coalesce(ro = 1 AND ({side}), false) AS chosen FROM q8),
r0 AS (SELECT *, sum(chosen::INT) OVER (PARTITION BY session_id) AS cn, sum(chosen::INT) OVER (PARTITION BY session_id, burst) AS mates, round_even(count(*) OVER (PARTITION BY session_id) * #{target}#, 0) AS goal,
 row_number() OVER (PARTITION BY session_id ORDER BY chosen DESC, score DESC, photo_id) AS hr, row_number() OVER (PARTITION BY session_id, burst ORDER BY chosen DESC, score DESC, photo_id) AS br FROM q9),
r1 AS (SELECT *, chosen AND hr <= greatest(1, round_even(cn * #0.1#, 0)) AS high FROM r0), r2 AS (SELECT *, cn > round_even(goal * #1.05#, 0) AND chosen AND mates >= 2 AND br > 1 AND NOT high AND vip = 0 AS can_go FROM r1),
r3 AS (SELECT *, can_go AND row_number() OVER (PARTITION BY session_id ORDER BY can_go DESC, score, photo_id) <= cn - goal AS demoted, max(CASE WHEN photo_id = rep THEN closed + away END) OVER (PARTITION BY session_id, burst) AS rep_bad FROM r2),
r4 AS (SELECT *, CASE WHEN error THEN NULL WHEN trash THEN 'blurry' WHEN closed + away > rep_bad AND NOT chosen THEN 'closed_eyes' WHEN high THEN 'highlighted' WHEN chosen AND NOT demoted THEN 'selected' WHEN demoted THEN 'alternative' ELSE 'duplicates' END AS label FROM r3),
""" + _covered("SELECT DISTINCT r4.photo_id, r4.session_id, f.identity_id, r4.score FROM r4 JOIN v_gate_faces f ON f.photo_id = r4.photo_id WHERE f.valid", "SELECT photo_id FROM r4 WHERE chosen AND NOT demoted") + f"""
SELECT photo_id, session_id, burst, round(score, 6) AS score, CASE WHEN {coverage} AND coalesce(label, '') NOT IN ('selected', 'highlighted') AND photo_id IN (SELECT photo_id FROM cover) THEN 'recommended' ELSE label END AS label, reason, decided_by, margin FROM r4"""


def _to_decide(spark, d):
    p = view(spark, d, "v_photos").join(view(spark, d, "v_light").select("photo_id", F.col("global_lum").alias("lum")), "photo_id")
    p = p.withColumns({"clip": F.col("k") / F.lit(100.0), "blur_flag": F.col("k") % 6 == 0, "sharp_anywhere": F.col("blur_score") * 2, "error": F.col("k") % 50 == 49})
    view(spark, d, "v_judged")
    return p, spark.table("v_gate_faces"), spark.table("v_expressions")


@_query(_decision("normal", True))
def decision_pipeline(spark, d):
    return decide(*_to_decide(spark, d))


@_query(_decision("more", False))
def decision_pipeline_more(spark, d):
    return decide(*_to_decide(spark, d), level="more", coverage=False)


@_query(_decision("few", True))
def decision_pipeline_few(spark, d):
    return decide(*_to_decide(spark, d), level="few")


@_query("WITH RECURSIVE " + _covered("SELECT DISTINCT f.photo_id, f.session_id, f.identity_id, s.score FROM v_faces f JOIN v_scored s USING (photo_id)", "SELECT photo_id FROM v_decisions WHERE label = 'selected'") + " SELECT session_id, photo_id FROM cover")
def coverage_promote(spark, d):
    return sessions.coverage_promote(view(spark, d, "v_faces"), view(spark, d, "v_decisions").where("label = 'selected'"), _scored(spark, d)).distinct()


def _gated(spark, d):
    j = view(spark, d, "v_judged")
    return j.join(windows.technical_gates(j, spark.table("v_gate_faces")).select("photo_id", "alive", "reason"), "photo_id")


def _heroes(spark, d):
    from pyspark.sql import Window

    c = F.col
    g = _gated(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("session_id", "burst")))
    return g.withColumn("score", rules.hero_bonus(c("score"), c("vip") > 0, c("n"), c("valid_faces"), c("max_yaw"), c("gaze"), c("closed"), c("away"), c("smiling")))


@_query(GATES + "SELECT photo_id, session_id, burst, alive, reason FROM gates")
def technical_gates(spark, d):
    return _gated(spark, d).select("photo_id", "session_id", "burst", "alive", "reason")


@_query(HEROES + "SELECT photo_id, round(score, 6) AS score FROM heroes")
def hero_bonus(spark, d):
    return _heroes(spark, d).select("photo_id", _r("score"))


@_query(HEROES + ELO + "SELECT session_id, burst, photo_id, round(elo, 6) AS elo FROM elo")
def elo_tiebreak(spark, d):
    return ranking.elo_tiebreak(_heroes(spark, d).where("alive")).select("session_id", "burst", "photo_id", _r("elo"))


@_query(HEROES + _elo(True) + "SELECT session_id, burst, photo_id, round(elo, 6) AS elo FROM elo")
def elo_tiebreak_taste(spark, d):
    taste = F.when(F.col("photo_id") % 9 != 0, (F.col("photo_id") * 17) % 100 / F.lit(40.0))
    return ranking.elo_tiebreak(_heroes(spark, d).where("alive").withColumn("taste", taste)).select("session_id", "burst", "photo_id", _r("elo"))


@_query(HEROES + WINNERS + "SELECT * FROM winners")
def burst_winners(spark, d):
    return ranking.burst_winners(_heroes(spark, d))


@_query(HEROES + WINNERS + """, p AS (SELECT h.*, h.photo_id % 13 = 0 AS duplicate, w.photo_id AS rep, w.decided_by, x.closed AS rc, x.away AS ra, x.blur_score AS rb FROM heroes h JOIN winners w ON w.session_id = h.session_id AND w.burst = h.burst JOIN heroes x ON x.photo_id = w.photo_id),
l AS (SELECT *, concat_ws(';', CASE WHEN duplicate THEN 'duplicate' END, CASE WHEN reason <> 'looking_away' THEN 'gate:' || reason END, CASE WHEN closed > rc AND coalesce(reason, '') <> 'closed_eyes' THEN 'closed:' || closed END, CASE WHEN away > ra THEN 'away:' || away END) AS facts FROM p)
SELECT photo_id, CASE WHEN n = 1 THEN '' WHEN photo_id = rep THEN concat_ws(';', 'by:' || decided_by, CASE WHEN valid_faces > 0 AND closed = 0 THEN 'eyes_open' END, CASE WHEN valid_faces > 0 AND smiling > 0 THEN 'smiling:' || smiling END)
 WHEN facts <> '' THEN facts WHEN blur_score < rb THEN 'less_sharp' ELSE 'scored_less' END AS reasons FROM l""")
def build_reasons(spark, d):
    h = _heroes(spark, d).withColumn("duplicate", F.col("photo_id") % 13 == 0)
    return ranking.build_reasons(h, ranking.burst_winners(h)).select("photo_id", F.array_join("reasons", ";").alias("reasons"))


@_query("""WITH b AS (SELECT photo_id, session_id, t_us, vec_id, lag(t_us) OVER w AS pt, lag(vec_id) OVER w AS pv FROM v_hashed WINDOW w AS (PARTITION BY session_id ORDER BY t_us, photo_id)),
c AS (SELECT b.*, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(x.embedding, lambda z: z::DOUBLE * z::DOUBLE)) * list_sum(list_transform(y.embedding, lambda z: z::DOUBLE * z::DOUBLE))) AS cos
 FROM b JOIN embeddings x ON x.vec_id = b.vec_id LEFT JOIN embeddings y ON y.vec_id = b.pv)
SELECT photo_id, session_id, CAST(sum(CASE WHEN pt IS NULL OR t_us - pt > 4000000 OR cos < #0.82# THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t_us, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS burst FROM c""")
def look_bursts(spark, d):
    p = view(spark, d, "v_hashed").join(spark.table("embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id")
    return windows.gap_bursts(p, 4.0, 0.82).select("photo_id", "session_id", F.col("burst").cast("long").alias("burst"))


@_query("""WITH v AS (SELECT h.photo_id, h.folder_id, CASE WHEN h.k % 10 <> 0 THEN h.t_us END AS t_us, h.vec_id FROM v_hashed h WHERE h.k % 7 <> 0),
b AS (SELECT *, lag(t_us) OVER w AS pt, lag(vec_id) OVER w AS pv FROM v WINDOW w AS (PARTITION BY folder_id ORDER BY t_us NULLS LAST, photo_id)),
c AS (SELECT b.*, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS dot FROM b JOIN embeddings x ON x.vec_id = b.vec_id LEFT JOIN embeddings y ON y.vec_id = b.pv)
SELECT photo_id, folder_id, CAST(sum(CASE WHEN pv IS NULL OR coalesce(abs(t_us - pt) > 30000000, false) OR dot < #0.9# THEN 1 ELSE 0 END) OVER (PARTITION BY folder_id ORDER BY t_us NULLS LAST, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS burst FROM c""")
def history_bursts(spark, d):
    p = view(spark, d, "v_hashed").join(spark.table("embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id")
    p = p.withColumns({"t_us": F.when(F.col("k") % 10 != 0, F.col("t_us")), "vec": F.when(F.col("k") % 7 != 0, F.col("vec"))})
    return windows.history_bursts(p).select("photo_id", "folder_id", F.col("burst").cast("long").alias("burst"))


@_query(HISTORY + """, u AS (SELECT photo_id, folder_id, label, CASE WHEN k % 10 <> 0 THEN t_us END AS t_us FROM h), b AS (SELECT *, lag(t_us) OVER (PARTITION BY folder_id ORDER BY t_us NULLS LAST, photo_id) AS pt FROM u),
c AS (SELECT *, sum(CASE WHEN t_us - pt <= 30000000 THEN 0 ELSE 1 END) OVER (PARTITION BY folder_id ORDER BY t_us NULLS LAST, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM b)
SELECT photo_id, label FROM c WHERE label IN ('positive', 'negative', 'unreviewed') AND EXISTS (SELECT 1 FROM c x WHERE x.folder_id = c.folder_id AND x.burst = c.burst AND x.label = 'positive')""")
def scope_union(spark, d):
    h = _history(spark, d).withColumn("t_us", F.when(F.col("k") % 10 != 0, F.col("t_us")))
    return windows.scope_union(h).select("photo_id", "label")


@_query("""WITH u AS (SELECT photo_id, session_id, CASE WHEN k % 10 <> 0 THEN t_us END AS t_us FROM v_photos) SELECT photo_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY t_us NULLS FIRST, photo_id) AS place,
 row_number() OVER (PARTITION BY session_id ORDER BY t_us NULLS LAST, photo_id) AS develop_place FROM u""")
def chronological(spark, d):
    return windows.chronological(view(spark, d, "v_photos").select("photo_id", "session_id", F.when(F.col("k") % 10 != 0, F.col("t_us")).alias("t_us"))).drop("t_us")


@_query("""WITH d AS (SELECT *, height > width AS tall, photo_id % 3 <> 0 AS can FROM v_scored), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, burst ORDER BY can DESC, score DESC, photo_id) AS r, first_value(tall) OVER (PARTITION BY session_id, burst ORDER BY can DESC, score DESC, photo_id) AS tt,
 row_number() OVER (PARTITION BY session_id, burst, tall ORDER BY can DESC, score DESC, photo_id) AS o FROM d)
SELECT photo_id, session_id, burst, CASE WHEN r = 1 THEN 'winner' ELSE 'alternate' END AS role FROM r WHERE r = 1 OR (can AND o = 1 AND tall <> tt AND score >= #0.3#) OR (can AND o = 2 AND tall = tt AND score >= #0.3# * #1.15#)""")
def orientation_alternates_more(spark, d):
    return windows.orientation_alternates(_scored(spark, d).withColumn("selectable", F.col("photo_id") % 3 != 0), "more").select("photo_id", "session_id", "burst", "role")


@_query()
def storyline_segments(spark, d):
    return story.storyline_segments(story_photos(spark, d))


def story_photos(spark, d):
    """Photos with slowly changing vectors: one of a stretch of an event's mostly, a little the photo's own."""
    p = view(spark, d, "v_hashed").select("photo_id", "session_id", F.when(F.col("k") % 25 != 0, F.col("t_us")).alias("t_us"), "scene_type", "vec_id", "k")
    e = spark.table("embeddings").select("vec_id", "embedding")
    n = F.lit(e.count())
    p = p.withColumn("place", F.pmod(F.xxhash64("session_id") + F.floor(F.coalesce("t_us", F.lit(0)) / F.lit(2e8)), n))
    p = p.join(e.select(F.col("vec_id").alias("place"), F.col("embedding").alias("own")), "place").join(e.select("vec_id", F.col("embedding").alias("light")), "vec_id")
    mixed = F.zip_with("own", "light", lambda x, y: x.cast("double") + y.cast("double") * 0.3)
    # The norm is handed in as an element: named inside the inner lambda, it would be summed again for each number.
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.array(norm), lambda n: F.transform(mixed, lambda x: x / n))[0]
    return p.select("photo_id", "session_id", "t_us", "scene_type", F.when(F.col("k") % 11 != 0, unit).alias("vec"))


_LIGHT = """WITH p AS (SELECT l.photo_id, l.session_id, CAST(floor(p.t_us / 120000000) AS BIGINT) AS ls, has_people, wb_temp, wb_tint, wb_temp IS NOT NULL AND wb_tint IS NOT NULL AS voted, global_lum, clip_frac, CASE WHEN has_people AND p.k % 4 <> 0 THEN #0.02# + CAST(p.k AS DOUBLE) / #150.0# END AS skin_lum FROM v_light l JOIN v_photos p USING (photo_id)),
up AS (SELECT session_id, ls, list_sort(list(wb_temp) FILTER (voted AND has_people)) AS yt, list_sort(list(wb_tint) FILTER (voted AND has_people)) AS yi, list_sort(list(wb_temp) FILTER (voted)) AS xt, list_sort(list(wb_tint) FILTER (voted)) AS xi, list_sort(list(skin_lum) FILTER (skin_lum IS NOT NULL)) AS sk FROM p GROUP BY session_id, ls),
s0 AS (SELECT session_id, ls, coalesce(len(yt), 0) AS np, coalesce(len(xt), 0) AS na, yt[len(yt) // 2 + 1] AS mpt, yi[len(yi) // 2 + 1] AS mpi, xt[len(xt) // 2 + 1] AS mat, xi[len(xi) // 2 + 1] AS mai, greatest(#0.05#, least(#0.45#, sk[len(sk) // 2 + 1])) AS sk0, sk IS NOT NULL AS has_sk FROM up),
s1 AS (SELECT *, CASE WHEN np >= 3 THEN np >= 5 ELSE na >= 5 END AS enough FROM s0), s2 AS (SELECT *, CASE WHEN enough THEN CASE WHEN np >= 3 THEN mpt ELSE mat END END AS ot, CASE WHEN enough THEN CASE WHEN np >= 3 THEN mpi ELSE mai END END AS oi FROM s1),
s AS (SELECT session_id, ls, CASE WHEN has_sk THEN sk0 END AS target, coalesce(last_value(ot IGNORE NULLS) OVER a, first_value(ot IGNORE NULLS) OVER b, first_value(coalesce(mat, 0)) OVER c) AS wt, coalesce(last_value(oi IGNORE NULLS) OVER a, first_value(oi IGNORE NULLS) OVER b, first_value(coalesce(mai, 0)) OVER c) AS wi FROM s2
 WINDOW a AS (PARTITION BY session_id ORDER BY ls ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY session_id ORDER BY ls ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), c AS (PARTITION BY session_id ORDER BY ls ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT p.*, s.wt, s.wi, greatest(-#1.5#, least(#1.5#, CASE WHEN skin_lum IS NOT NULL THEN log2(target / greatest(skin_lum, #0.0001#)) ELSE log2(#0.18# / greatest(global_lum, #0.0001#)) END)) AS stops FROM p JOIN s ON p.session_id = s.session_id AND p.ls = s.ls),
m AS (SELECT session_id, ls, list_sort(list(stops))[count(*) // 2 + 1] AS mid FROM x GROUP BY session_id, ls),
y AS (SELECT x.*, greatest(mid - #0.7#, least(mid + #0.7#, stops)) + #0.28# AS e0, NOT has_people AND voted AND (abs(wb_temp - wt) > 10 OR abs(wb_tint - wi) > 10) AS alone FROM x JOIN m ON x.session_id = m.session_id AND x.ls = m.ls),
z AS (SELECT *, CASE WHEN log2(greatest(global_lum, #0.0001#) / #0.18#) + e0 > #0.28# + #0.5# THEN e0 - (log2(greatest(global_lum, #0.0001#) / #0.18#) + e0 - #0.78#) ELSE e0 END AS e1 FROM y)
SELECT photo_id, session_id, ls AS light_session, round_even(round_even(greatest(-#1.5#, least(#1.5#, CASE WHEN clip_frac > #0.03# AND e1 > 0 THEN 0 ELSE e1 END)) / #0.05#, 0) * #0.05#, 2) + 0 AS exposure,
 round_even(greatest(-#15.0#, least(#15.0#, CASE WHEN alone THEN wb_temp ELSE wt END)), 1) + 0 AS temp, round_even(greatest(-#15.0#, least(#15.0#, CASE WHEN alone THEN wb_tint ELSE wi END)), 1) + 0 AS tint FROM z"""


@_query(_LIGHT)
def pre_edit_values(spark, d):
    p = view(spark, d, "v_photos").select("photo_id", "t_us", "k").join(view(spark, d, "v_light"), "photo_id")
    p = p.withColumns({"light_session": F.floor(F.col("t_us") / 120000000), "skin_lum": F.when(F.col("has_people") & (F.col("k") % 4 != 0), F.lit(0.02) + F.col("k") / F.lit(150.0))})
    return develop.pre_edit_values(p)


_RECIPES = [("purchase", {"Contrast2012": 7.0, "Dehaze": 4.0}), ("click", {})]
_DEFAULTS = [("view", {"Contrast2012": 12.0, "Clarity2012": 12.0}), ("signup", {"Vibrance": 8.0})]


def _recipes(spark, d):
    learned, defaults = (spark.createDataFrame(r, "scene string, recipe map<string, double>") for r in (_RECIPES, _DEFAULTS))
    p = view(spark, d, "v_photos").select("photo_id", "scene", "k", F.when(F.col("k") % 3 == 0, "view").when(F.col("k") % 3 == 1, "purchase").alias("near_scene"))
    return develop.recipe_for_scene(p, learned, defaults, F.create_map(F.lit("Contrast2012"), F.lit(5.0), F.lit("Vibrance"), F.lit(5.0)))


_RECIPE_SQL = """WITH r AS (SELECT photo_id, k, CASE WHEN scene = 'purchase' THEN 'purchase' WHEN k % 3 = 1 THEN 'purchase' WHEN k % 3 = 0 THEN 'view' WHEN scene IN ('view', 'signup') THEN scene ELSE 'plain' END AS s FROM v_photos),
v(s, field, value) AS (VALUES ('purchase', 'Contrast2012', 7.0::DOUBLE), ('purchase', 'Dehaze', 4.0), ('view', 'Contrast2012', 12.0), ('view', 'Clarity2012', 12.0), ('signup', 'Vibrance', 8.0), ('plain', 'Contrast2012', 5.0), ('plain', 'Vibrance', 5.0)) """


@_query(_RECIPE_SQL + "SELECT photo_id, field, value FROM r JOIN v USING (s)")
def recipe_for_scene(spark, d):
    return _recipes(spark, d).select("photo_id", F.explode("recipe").alias("field", "value"))


@_query(_RECIPE_SQL + """, b AS (SELECT photo_id, field, value FROM r JOIN v USING (s) WHERE NOT (field = 'Contrast2012' AND k % 6 = 0) UNION ALL SELECT photo_id, 'Exposure2012', CAST(k AS DOUBLE) / #100.0# FROM r WHERE k % 5 <> 0 UNION ALL SELECT photo_id, 'Contrast2012', -CAST(k AS DOUBLE) FROM r WHERE k % 6 = 0) SELECT * FROM b""")
def blend_develop(spark, d):
    k = F.col("k").cast("double")
    base = F.when(F.col("k") % 5 != 0, F.create_map(F.lit("Exposure2012"), k / F.lit(100.0), F.lit("Sharpness"), F.lit(1.0)))
    rescue = F.when(F.col("k") % 6 == 0, F.create_map(F.lit("Contrast2012"), -k))
    return _recipes(spark, d).select("photo_id", F.explode(develop.blend_develop(F.col("recipe"), base, rescue)).alias("field", "value"))


@_query(_RECIPE_SQL + """, j AS (SELECT photo_id, k, field, value FROM r JOIN v USING (s)) SELECT photo_id, field, CASE WHEN field = 'Contrast2012' THEN greatest(-#100.0#, least(#100.0#, round_even(value + CAST(k AS DOUBLE) * #1.5#, 0))) ELSE value END AS value FROM j
 UNION ALL SELECT photo_id, 'Contrast2012', greatest(-#100.0#, least(#100.0#, round_even(CAST(k AS DOUBLE) * #1.5#, 0))) FROM r WHERE s = 'signup'""")
def add_rescue(spark, d):
    rescue = F.create_map(F.lit("Contrast2012"), F.col("k").cast("double") * F.lit(1.5))
    return _recipes(spark, d).select("photo_id", F.explode(develop.add_rescue(F.col("recipe"), rescue)).alias("field", "value"))


@_query(_RECIPE_SQL + """, j AS (SELECT photo_id, field, round_even(value * greatest(#0.0#, least(#1.5#, CAST(k AS DOUBLE) / #50.0#)), 2) AS value FROM r JOIN v USING (s) WHERE k % 7 <> 0 AND field <> 'Dehaze' UNION ALL SELECT photo_id, 'Saturation', round_even(#3.0# * greatest(#0.0#, least(#1.5#, CAST(k AS DOUBLE) / #50.0#)), 2) FROM r WHERE k % 7 = 0) SELECT * FROM j WHERE value <> 0""")
def lut_adjustments(spark, d):
    none = F.lit(None).cast("map<string, double>")
    custom = F.when(F.col("k") % 7 == 0, F.create_map(F.lit("Saturation"), F.lit(3.0)))
    return _recipes(spark, d).select("photo_id", F.explode(develop.lut_adjustments(custom, F.col("recipe"), none, none, F.col("k") / F.lit(50.0))).alias("field", "value"))


def _sidecars(spark, d):
    tool = F.when(F.col("k") % 4 == 0, "fotolith 1.0").otherwise("Other Tool 7")
    edit = F.when(F.col("k") % 3 == 0, 'crs:Exposure2012="+0.50"').when(F.col("k") % 7 == 0, 'crs:HasSettings="True"').otherwise('crs:HasSettings="False"')
    packet = F.concat(F.lit('<x:xmpmeta x:xmptk="'), tool, F.lit('"><rdf:Description xmp:Rating="'), (F.col("k") % 6).cast("string"), F.lit('" '), edit, F.lit("/></x:xmpmeta>"))
    return view(spark, d, "v_files").select("photo_id", "stem", "stem_path", "folder_id", "ext", "k", F.when(F.col("photo_id") % 9 != 0, packet).alias("packet"))


@_query("SELECT photo_id, photo_id % 9 <> 0 AND k % 4 <> 0 AND (k % 3 = 0 OR k % 7 = 0) AS manual FROM v_files")
def has_manual_edits(spark, d):
    return _sidecars(spark, d).select("photo_id", develop.has_manual_edits(F.col("packet")).alias("manual"))


@_query("""WITH m AS (SELECT *, photo_id % 9 <> 0 AND k % 4 <> 0 AND (k % 3 = 0 OR k % 7 = 0) AS manual FROM v_files) SELECT photo_id, manual, CASE WHEN NOT manual THEN CASE WHEN ext = 'cr2' THEN 1 ELSE 2 END END AS fields, CASE WHEN NOT manual THEN CAST(k % 2 AS INT) END AS crop FROM m""")
def protect_manual_edits(spark, d):
    s = _sidecars(spark, d)
    dec = s.select("photo_id", (F.col("ext") == "cr2").alias("is_raw"), F.create_map(F.lit("Exposure2012"), F.lit(1.0), F.lit("IncrementalTint"), F.lit(2.0)).alias("develop"), (F.col("k") % 2).cast("int").alias("crop"))
    return develop.protect_manual_edits(dec, s.select("photo_id", "packet")).select("photo_id", "manual", F.size("develop").alias("fields"), "crop").withColumn("fields", F.when(F.col("fields") >= 0, F.col("fields")))


@_query("""WITH f AS (SELECT CAST(folder_id AS VARCHAR) AS folder, lower(stem) AS stem, photo_id, ext = 'cr2' AS raw, k % 4 AS label_stars, CASE WHEN k % 8 = 0 THEN 2 END AS synced, CASE WHEN photo_id % 6 <> 0 THEN k % 6 END AS stars, k % 5 < 2 AS edited FROM v_files),
b AS (SELECT folder, stem, arg_min(photo_id, raw::INT * 1000000000 + photo_id) AS photo_id, arg_min(coalesce(synced, label_stars, 0), raw::INT * 1000000000 + photo_id) AS baseline FROM f GROUP BY folder, stem),
c AS (SELECT b.*, (SELECT arg_min(f.stars, f.raw::INT * 1000000000 + f.photo_id) FROM f WHERE f.folder = b.folder AND f.stem = b.stem AND f.stars IS NOT NULL AND f.stars <> b.baseline) AS stars,
 (SELECT arg_min(f.stars >= 2 AND f.edited, (NOT f.edited)::INT * 10000000000 + f.raw::INT * 1000000000 + f.photo_id) FROM f WHERE f.folder = b.folder AND f.stem = b.stem AND f.stars IS NOT NULL) AS keeper FROM b)
SELECT folder, stem, photo_id, baseline, stars, CASE WHEN stars > baseline THEN 1 WHEN stars IS NOT NULL THEN -1 END AS sign, coalesce(keeper, false) AS keeper FROM c""")
def sync_corrections(spark, d):
    f = view(spark, d, "v_files").select(F.col("folder_id").cast("string").alias("folder"), "stem", "photo_id", (F.col("ext") == "cr2").alias("is_raw"), (F.col("k") % 4).alias("label_stars"), F.when(F.col("k") % 8 == 0, 2).alias("synced_stars"),
                                         F.when(F.col("photo_id") % 6 != 0, F.col("k") % 6).alias("stars"), (F.col("k") % 5 < 2).alias("edited"))
    return develop.sync_corrections(f)


@_query("""WITH j AS (SELECT photo_id, k % 6 AS rating, CASE WHEN photo_id % 4 = 0 THEN 0 ELSE photo_id % 6 END AS stars, printf('%09d', photo_id) AS path FROM v_photos WHERE photo_id % 2 = 0)
SELECT count(*) AS reviewed, count(*) FILTER (rating <> stars) AS pending, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM j WHERE rating <> stars ORDER BY path LIMIT 5)) AS examples FROM j""")
def catalog_vs_sidecar(spark, d):
    p = view(spark, d, "v_photos").select("photo_id", F.format_string("%09d", "photo_id").alias("path"), (F.col("k") % 6).alias("rating"))
    side = p.where("photo_id % 4 <> 0").select("path", (F.col("photo_id") % 6).alias("stars"))
    return develop.catalog_vs_sidecar(p.where("photo_id % 2 = 0"), side).withColumn("examples", F.array_join("examples", ","))


@_query("""WITH c AS (SELECT session_id, identity_id, count(DISTINCT photo_id) AS photos, min(photo_id) AS first_photo FROM v_faces GROUP BY session_id, identity_id), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY photos DESC, first_photo, identity_id) AS r FROM c)
SELECT session_id, identity_id, photos, first_photo, CASE WHEN identity_id % 2 = 0 THEN 'known ' || identity_id ELSE 'person ' || identity_id END AS name FROM r WHERE r <= 5""")
def vip_subjects(spark, d):
    f = view(spark, d, "v_faces")
    names = f.where("identity_id % 2 = 0").select("session_id", "identity_id").distinct().withColumn("name", F.concat(F.lit("known "), F.col("identity_id").cast("string")))
    return aggs.vip_subjects(f, names)


@_query("""WITH v AS (SELECT photo_id AS pair, label, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 2 = 0 END AS hit FROM v_decisions WHERE photo_id % 3 <> 0), a AS (SELECT label, count(*) AS pairs, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit IS NULL) AS silent FROM v GROUP BY GROUPING SETS ((label), ()))
SELECT coalesce(label, 'all') AS label, pairs, hits, misses, silent, round(CAST(hits AS DOUBLE) / nullif(hits + misses, 0), 6) AS accuracy FROM a""")
def verdict_report(spark, d):
    v = view(spark, d, "v_decisions").select("photo_id", "label", F.when(F.col("k") % 5 != 0, F.col("k") % 2 == 0).alias("hit"))
    return aggs.verdict_report(v, v.where("photo_id % 3 = 0").select("photo_id"))


@_query("""SELECT photo_id, (k % 4 = 0 AND blur_score < #28.0# AND blur_score * 2 < 80) OR (log2(greatest(lum, #0.0001#) / #0.18#) > 2 AND CAST(k AS DOUBLE) / 100 > #0.85#) OR log2(greatest(lum, #0.0001#) / #0.18#) < -#4.5# OR k % 17 = 0 AS trash FROM v_judged""")
def trash_flag(spark, d):
    c = F.col
    p = view(spark, d, "v_judged")
    return p.select("photo_id", rules.trash_flag(c("k") % 4 == 0, c("blur_score"), c("blur_score") * 2, c("lum"), c("k") / F.lit(100.0), F.when(c("k") % 17 == 0, "flash_misfire")).alias("trash"))


@_query("""SELECT photo_id, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 'blurry' WHEN k % 2 = 0 AND NOT (k % 5 = 0 OR k % 7 = 0) THEN 'closed_eyes' WHEN k % 10 = 0 THEN 'highlighted' WHEN k % 5 = 0 THEN 'selected' WHEN k % 7 = 0 THEN 'alternative' ELSE 'duplicates' END AS label FROM v_photos""")
def final_label(spark, d):
    k = F.col("k")
    return view(spark, d, "v_photos").select("photo_id", rules.final_label(k % 13 == 0, k % 11 == 0, k % 2 == 0, k % 10 == 0, k % 5 == 0, k % 7 == 0).alias("label"))


@_query("""SELECT photo_id, 'f/' || CASE WHEN k % 2 = 0 THEN '2.8' ELSE '4.0' END || ' ' || CASE WHEN k % 3 = 0 THEN '2s' ELSE '1/' || (k + 1) || 's' END || ' ' || (20 + k) || 'mm' AS caption FROM v_photos""")
def exposure_caption(spark, d):
    k = F.col("k")
    return view(spark, d, "v_photos").select("photo_id", rules.exposure_caption(F.when(k % 2 == 0, F.lit(2.8)).otherwise(F.lit(4.0)), F.when(k % 3 == 0, F.lit(2.0)).otherwise(1 / (k + 1)), 20 + k).alias("caption"))


@_query("SELECT f.photo_id, face_index, round((x + w / 2) / p.width, 6) AS cx, round((y + w / 2) / p.height, 6) AS cy, round(w / p.width, 6) AS fw, round(w / p.height, 6) AS fh FROM v_faces f JOIN v_photos p USING (photo_id)")
def region_normalise(spark, d):
    f = view(spark, d, "v_faces").join(view(spark, d, "v_photos").select("photo_id", "width", "height"), "photo_id")
    return rules.region_normalise(f).select("photo_id", "face_index", *[_r(c) for c in ("cx", "cy", "fw", "fh")])


@_query("SELECT photo_id, label FROM v_decisions WHERE label IN ('selected', 'highlighted')")
def client_preview_scope(spark, d):
    return rules.client_preview_scope(view(spark, d, "v_decisions"), "client").select("photo_id", "label")


@_query("SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN truth ELSE label END AS label FROM v_decisions")
def merge_labels(spark, d):
    x = view(spark, d, "v_decisions")
    return joins.merge_labels(x.select("photo_id", "label"), x.where("photo_id % 3 = 0").select("photo_id", F.col("truth").alias("label"))).select("photo_id", "label")


@_query(HISTORY + "SELECT photo_id, label FROM h WHERE label IN ('positive', 'negative') AND photo_id % 5 <> 0 ORDER BY photo_id LIMIT 200")
def unfed_labeled(spark, d):
    h = _history(spark, d).select("photo_id", "label")
    return joins.unfed_labeled(h, joins.mark_fed(h.where("photo_id % 10 = 0"), h.where("photo_id % 5 = 0")), 200)


@_query("SELECT photo_id FROM v_photos WHERE k % 4 = 1")
def filter_by_paths(spark, d):
    p = view(spark, d, "v_photos").withColumn("path", F.concat(F.lit("p"), F.col("photo_id").cast("string")))
    return joins.filter_by_paths(p, p.where("k % 4 = 1").select("path").union(p.where("k % 4 = 1").select("path"))).select("photo_id")


@_query("""WITH v AS (SELECT session_id, identity_id FROM (SELECT session_id, identity_id, row_number() OVER (PARTITION BY session_id ORDER BY count(DISTINCT photo_id) DESC, min(photo_id), identity_id) AS r FROM v_faces GROUP BY session_id, identity_id) WHERE r <= 3),
p AS (SELECT session_id, photo_id, max((smile_score >= 0.5)::INT) AS s FROM v_faces JOIN v USING (session_id, identity_id) GROUP BY session_id, photo_id) SELECT session_id, round(avg(s), 6) AS share, avg(s) < #0.2# AS relaxed FROM p GROUP BY session_id""")
def vip_smile_relaxed(spark, d):
    f = view(spark, d, "v_faces")
    return aggs.vip_smile_relaxed(f, aggs.rank_vip(f))


#: Photos under policy a, to which all faces are alike, with its score, and under b, to which leading faces matter first, with sharpness; their bursts.
POLICIES = f"""WITH a AS ({_gates(True)} SELECT photo_id, session_id, burst, score, alive, reason FROM gates), b AS ({GATES} SELECT photo_id, blur_score, alive, reason FROM gates),
p AS (SELECT photo_id, session_id, burst, score AS score_a, blur_score AS score_b, a.alive AS alive_a, b.alive AS alive_b, a.reason AS reason_a, b.reason AS reason_b FROM a JOIN b USING (photo_id)),
g AS (SELECT session_id, burst, first(photo_id ORDER BY score_a DESC NULLS LAST, photo_id) FILTER (alive_a) AS pa, first(photo_id ORDER BY score_b DESC NULLS LAST, photo_id) FILTER (alive_b) AS pb, count(*) FILTER (alive_a) AS ka, count(*) FILTER (alive_b) AS kb FROM p GROUP BY session_id, burst) """


def _policies(spark, d):
    p = view(spark, d, "v_photos").select("photo_id", "session_id", "t_us", (F.lit(0.02) + F.col("k") / F.lit(120.0)).alias("lum"), rules.cold_score(F.col("blur_score"), F.col("aesthetic_score")).alias("score_a"), F.col("blur_score").alias("score_b"))
    return aggs.policy_ab_report(windows.policy_gates(p, view(spark, d, "v_gate_faces"), {"a": {"alike": True}, "b": {}}, 4.0))


@_query(POLICIES + "SELECT session_id, count(*) AS bursts, count(*) FILTER (pa IS DISTINCT FROM pb) AS different FROM g GROUP BY session_id")
def policy_ab_report(spark, d):
    """The report's first part; :func:`policy_ab_gates` has the rest."""
    return _policies(spark, d).select("session_id", "bursts", "different")


@_query(POLICIES + f""", k AS (SELECT session_id, count(*) FILTER (ka > kb) AS more_a, count(*) FILTER (kb > ka) AS more_b FROM g GROUP BY session_id),
r AS (SELECT session_id, {', '.join(f"count(*) FILTER (reason_{x} = '{r}') AS {r}_{x}" for r in windows.REASONS for x in 'ab')} FROM p GROUP BY session_id) SELECT * FROM k JOIN r USING (session_id)""")
def policy_ab_gates(spark, d):
    return _policies(spark, d).drop("bursts", "different")


@_query("SELECT event_type, month, total FROM v_sessions WHERE total > 0 AND created <= DATE '1997-06-30'")
def pending_reminders(spark, d):
    return windows.pending_reminders(view(spark, d, "v_sessions"), "1997-06-30").select("event_type", "month", "total")


@_query("WITH p AS (SELECT 'Dir' || (photo_id % 50) AS directory, photo_id AS last_access FROM v_photos) SELECT lower(directory) AS directory, max(last_access) AS last_access FROM p GROUP BY lower(directory)")
def library_listing(spark, d):
    p = view(spark, d, "v_photos").select(F.concat(F.when(F.col("k") % 2 == 0, "Dir").otherwise("dir"), (F.col("photo_id") % 50).cast("string")).alias("directory"), F.col("photo_id").alias("last_access"))
    return windows.library_listing(p).select(F.lower("directory").alias("directory"), "last_access")


@_query("SELECT photo_id, CASE WHEN k % 3 = 0 THEN photo_id + 7 ELSE photo_id END AS mtime FROM v_photos")
def refresh_mtimes(spark, d):
    p = view(spark, d, "v_photos").select("photo_id", F.col("photo_id").cast("string").alias("path"), F.col("photo_id").alias("mtime"), "k")
    return tables.refresh_mtimes(p.drop("k"), p.where("k % 3 = 0").select("path", (F.col("mtime") + 7).alias("mtime"))).select("photo_id", "mtime")


@_query("""WITH x AS (SELECT photo_id, label, k FROM v_decisions WHERE k % 10 <> 0) SELECT photo_id, label, CAST(k AS DOUBLE) AS develop, k % 2 = 0 AS crop, k % 3 AS person FROM x UNION ALL SELECT photo_id + 1000000, label, CAST(k AS DOUBLE), k % 2 = 0, k % 3 FROM x WHERE photo_id % 4 = 0""")
def build_snapshot(spark, d):
    x = view(spark, d, "v_decisions").select("photo_id", "label", (F.col("k") % 10 == 0).alias("error"), F.when(F.col("photo_id") % 4 == 0, F.col("photo_id") + 1000000).alias("linked_raw"),
                                              F.col("k").cast("double").alias("develop"), (F.col("k") % 2 == 0).alias("crop"), F.array(F.col("k") % 3).alias("identities"))
    return tables.build_snapshot(x).withColumn("person", F.element_at("identities", 1)).drop("identities")


@_query("""WITH l AS (SELECT session_id, CAST(floor(t_us / 120000000) AS BIGINT) AS i, avg(wb_temp) AS v FROM v_light JOIN (SELECT photo_id, t_us, k FROM v_photos) USING (photo_id) WHERE k % 2 = 0 GROUP BY ALL), n AS (SELECT session_id, i, CASE WHEN i % 3 = 0 THEN round(v, 3) END AS v FROM l),
x AS (SELECT a.session_id, a.i, b.v, row_number() OVER (PARTITION BY a.session_id, a.i ORDER BY abs(b.i - a.i), b.i) AS r FROM n a JOIN n b ON a.session_id = b.session_id AND b.v IS NOT NULL) SELECT n.session_id, n.i, x.v AS filled FROM n LEFT JOIN x ON x.session_id = n.session_id AND x.i = n.i AND x.r = 1""")
def nearest_with_votes(spark, d):
    l = view(spark, d, "v_light").join(view(spark, d, "v_photos").where("k % 2 = 0").select("photo_id", F.floor(F.col("t_us") / 120000000).alias("i")), "photo_id")  # noqa: E741
    n = l.groupBy("session_id", "i").agg(F.avg("wb_temp").alias("v")).withColumn("v", F.when(F.col("i") % 3 == 0, F.round("v", 3)))
    return joins.nearest_with_votes(n, "v", "i", "session_id").select("session_id", "i", F.col("v_filled").alias("filled"))
