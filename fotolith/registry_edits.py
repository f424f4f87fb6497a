"""Registered queries of retouch and crop proposals, batch metadata, reports, client selections, reminders and
of sources, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view
from .operators import edits, joins, learn, ranking, reports, rules
from .registry import _SQL, HISTORY, _history, _query, _r, _scored
from .registry_more import GATES, HEROES, WINNERS, _gated, _heroes
from .registry_more import build_reasons as _reasons
from .sources import tables
from .streaming import streams


@_query("""WITH e AS (SELECT *, greatest(#0.0#, least(#10.0#, focus_raw)) AS focus, left_state = 'mid_blink' AS mid_blink,
 least(CASE left_state WHEN 'open' THEN #1.0# WHEN 'glasses' THEN #1.0# WHEN 'covered' THEN #0.5# WHEN 'partially_open' THEN CASE WHEN left_ear >= #0.6# THEN #0.75# WHEN left_ear >= #0.25# THEN #0.5# ELSE #0.2# END ELSE #0.0# END,
  CASE right_state WHEN 'open' THEN #1.0# WHEN 'partially_open' THEN CASE WHEN right_ear >= #0.6# THEN #0.75# WHEN right_ear >= #0.25# THEN #0.5# ELSE #0.2# END ELSE #0.0# END) AS pair,
 CASE WHEN kissing THEN #0.85# WHEN head_pitch >= 20 THEN #0.8# WHEN smile_score >= #0.75# AND mouth_open >= #0.5# THEN #0.85# END AS floor_ FROM v_portraits),
r AS (SELECT *, CASE WHEN mid_blink THEN -#0.5# ELSE pair END AS raw_eye FROM e), x AS (SELECT *, greatest(raw_eye, coalesce(floor_, raw_eye)) AS eye FROM r)
SELECT photo_id, face_index, raw_eye, eye, floor_ IS NOT NULL AS closed_ok, mid_blink, round(focus, 6) AS focus,
 CASE WHEN focus > 9 THEN 'Perfect Focus' WHEN focus > 7 THEN 'Great Focus' WHEN focus > 5 THEN 'Good Focus' WHEN focus > 3 THEN 'Soft Focus' WHEN focus > 2 THEN 'Very Soft' WHEN focus > 1 THEN 'Poor Focus' ELSE 'Out of Focus' END AS focus_label,
 round(focus * #0.6# + greatest(#0.0#, (eye + #0.5#) / #1.5#) * 10 * #0.4#, 6) AS quality FROM x""")
def evaluate_faces(spark, d):
    f = view(spark, d, "v_portraits").withColumn("sharpness", F.col("focus_raw"))
    return edits.evaluate_faces(f).select("photo_id", "face_index", "raw_eye", "eye", "closed_ok", "mid_blink", _r("focus"), "focus_label", _r("quality"))


@_query("""WITH s AS (SELECT photo_id, greatest(#0.0#, least(#1.0#, 1 - dispersion)) AS c, CASE WHEN subject <= 5 THEN #0.5# ELSE least(#10.0#, (log10(greatest(#10.0#, subject)) - 1) / (log10(#2500.0#) - 1) * 10) END AS a,
 CASE WHEN ground <= 5 THEN #0.5# ELSE least(#10.0#, (log10(greatest(#10.0#, ground)) - 1) / (log10(#2500.0#) - 1) * 10) END AS b FROM v_lens),
v AS (SELECT *, CASE WHEN a >= #4.5# AND a >= #1.8# * b THEN 'bokeh' WHEN a >= #4.5# THEN 'sharp' WHEN c >= #0.6# THEN 'motion' ELSE 'missed_focus' END AS verdict FROM s)
SELECT photo_id, round_even(a, 2) AS subject_score, round_even(b, 2) AS ground_score, round_even(c, 2) AS coherence, verdict, a >= #4.5# AS acceptable, CASE verdict WHEN 'bokeh' THEN 'subject' WHEN 'sharp' THEN 'all' ELSE 'none' END AS sharpen FROM v""")
def blur_report(spark, d):
    return edits.blur_report(view(spark, d, "v_lens")).select("photo_id", "subject_score", "ground_score", "coherence", "verdict", "acceptable", "sharpen")


@_query("""WITH b AS (SELECT photo_id, min(x / #6000.0#) AS x0, max((x + w) / #6000.0#) AS x1, min(y / #4000.0#) AS y0 FROM v_faces GROUP BY photo_id),
p AS (SELECT v.photo_id, x0, x1, y0, CAST(width AS DOUBLE) / height AS r, radians(abs(CAST(k % 21 - 10 AS DOUBLE))) AS t FROM v_photos v LEFT JOIN b ON b.photo_id = v.photo_id),
s AS (SELECT *, greatest(#0.1#, least(#1.0#, CASE WHEN t < #0.00001# THEN 1 ELSE 1 / (greatest(r, 1 / r) * sin(t) + cos(t)) END)) AS c FROM p),
y AS (SELECT *, coalesce((x0 + x1) / 2, #0.5#) AS mx, coalesce(CASE WHEN y0 + c * #0.35# - c / 2 > y0 - #0.04# THEN y0 - #0.04# + c / 2 ELSE y0 + c * #0.35# END, #0.5#) AS my FROM s),
z AS (SELECT *, greatest(c / 2, least(1 - c / 2, mx)) AS cx, greatest(c / 2, least(1 - c / 2, my)) AS cy FROM y)
SELECT photo_id, round(greatest(#0.0#, least(#1.0#, cx - c / 2)), 6) AS "left", round(greatest(#0.0#, least(#1.0#, cx + c / 2)), 6) AS "right", round(greatest(#0.0#, least(#1.0#, cy - c / 2)), 6) AS top, round(greatest(#0.0#, least(#1.0#, cy + c / 2)), 6) AS bottom FROM z""")
def inscribed_crop(spark, d):
    p = view(spark, d, "v_photos").withColumn("tilt", (F.col("k") % 21 - 10).cast("double"))
    f = view(spark, d, "v_faces").select("photo_id", *[(a / F.lit(n)).alias(k) for k, a, n in (("xmin", F.col("x"), 6000.0), ("xmax", F.col("x") + F.col("w"), 6000.0), ("ymin", F.col("y"), 4000.0))])
    return edits.inscribed_crop(p, f).select("photo_id", *[_r(c) for c in ("left", "right", "top", "bottom")])


@_query("""SELECT photo_id, face_index, round_even((x + CAST(w AS DOUBLE) / 2) / width, 4) AS center_x, round_even((y + CAST(w AS DOUBLE) / 2) / height, 4) AS center_y, round_even(w * #0.9# / width, 4) AS radius_x, round_even(w * #1.1# / height, 4) AS radius_y, #0.24# AS exposure_boost, 9 AS highlights_boost, 15 AS shadows_lift
 FROM v_faces JOIN (SELECT photo_id, width, height FROM v_photos) USING (photo_id)""")
def relight_faces(spark, d):
    f = view(spark, d, "v_faces").withColumn("h", F.col("w")).join(view(spark, d, "v_photos").select("photo_id", "width", "height"), "photo_id")
    return edits.relight_faces(f, 0.6).select("photo_id", "face_index", "center_x", "center_y", "radius_x", "radius_y", "exposure_boost", "highlights_boost", "shadows_lift")


@_query("""WITH s AS (SELECT photo_id, face_count > 0 AS skin, greatest(#0.1#, least(#1.0#, CAST(k AS DOUBLE) / #90.0#)) AS s FROM v_photos)
SELECT photo_id, CASE WHEN skin THEN round_even(s, 2) ELSE 0 END AS smoothness, CAST(CASE WHEN skin THEN round_even(s * -35, 0) ELSE 0 END AS INT) AS clarity, CAST(CASE WHEN skin THEN round_even(s * -20, 0) ELSE 0 END AS INT) AS texture, CAST(CASE WHEN skin THEN round_even(s * 8, 0) ELSE 0 END AS INT) AS luminance FROM s""")
def skin_sliders(spark, d):
    p = view(spark, d, "v_photos")
    return p.withColumns(edits.skin_sliders(F.col("face_count") > 0, F.col("k") / F.lit(90.0))).select("photo_id", "smoothness", "clarity", "texture", "luminance")


_TAXONOMY = [("wedding", "Wedding", ["Wedding", "Party"], None), ("birthday", "Birthday", ["Birthday"], "Adult")]


@_query("""WITH t(event_type, label, base_tags, default_age) AS (VALUES ('wedding', 'Wedding', ['Wedding', 'Party'], NULL), ('birthday', 'Birthday', ['Birthday'], 'Adult')),
b AS (SELECT folder_id, year, trim(creator) AS c, coalesce(notice, '© {year} {creator}') AS notice, trim(coalesce(age, '')) AS a, coalesce(age, '') AS age0, trim(coalesce(client, '')) AS cl, trim(city) AS city, coalesce(tags, '') AS tags, coalesce(base_tags, []) AS bt, coalesce(default_age, '') AS da, coalesce(label, '') AS label FROM v_batches LEFT JOIN t USING (event_type)),
e AS (SELECT *, list_filter(list_transform(list_concat(bt, [CASE WHEN age0 = '' THEN da ELSE '' END, CASE WHEN a = '' OR lower(a) LIKE '%años' THEN a ELSE a || ' Años' END, cl, city], string_split(tags, ',')), lambda x: trim(x)), lambda x: x <> '') AS l FROM b)
SELECT folder_id, replace(replace(replace(notice, '{year}', CAST(year AS VARCHAR)), '{creator}', c), '{client}', cl) AS copyright, CASE WHEN cl <> '' THEN cl ELSE label END AS title, CASE WHEN city = 'Quito' THEN 'Ecuador' ELSE '' END AS country,
 array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS keywords FROM e""")
def metadata_payload(spark, d):
    t = spark.createDataFrame(_TAXONOMY, "event_type string, label string, base_tags array<string>, default_age string")
    return edits.metadata_payload(view(spark, d, "v_batches"), t, "Ecuador", ["Quito"]).select("folder_id", "copyright", "title", "country", F.array_join("keywords", "|").alias("keywords"))


_WEIGHTS = {"sharp": 0.3, "expo": 0.2, "composition": 0.0, "eye_sharp": 0.2, "eyes_open": 0.2, "smile": 0.1}
_AREA = """WITH f AS (SELECT photo_id, sum(least(#1.0#, sharpness / #500.0#) * a) / sum(a) AS es, sum(ear * a) / sum(a) AS eo, sum(smile_score * a) / sum(a) AS sm FROM (SELECT *, greatest(#1.0#, CAST(w AS DOUBLE) * w) AS a FROM v_faces) GROUP BY photo_id),
s AS (SELECT v.photo_id, v.session_id, v.burst, v.blur_score, v.k, f.es IS NULL AS bare, v.aesthetic_score AS expo, (least(#1.0#, v.blur_score / #500.0#) * #0.3# + v.aesthetic_score * #0.2# + coalesce(es * #0.2# + eo * #0.2# + sm * #0.1#, 0)) / CASE WHEN es IS NULL THEN #0.3# + #0.2# ELSE #0.3# + #0.2# + #0.2# + #0.2# + #0.1# END AS score FROM v_scored v LEFT JOIN f ON f.photo_id = v.photo_id) """


def _area_scored(spark, d):
    p = _scored(spark, d).drop("score").withColumns({"sharpness": F.col("blur_score"), "salient_sharpness": F.col("blur_score") + F.col("k"), "expo": F.col("aesthetic_score"), "composition": F.lit(0.5)})
    f = view(spark, d, "v_faces").select("photo_id", "w", F.col("w").alias("h"), F.col("sharpness").alias("eye_sharpness"), "ear", "smile_score")
    return edits.area_weighted_score(p, f, _WEIGHTS)


@_query(_AREA + "SELECT photo_id, round(score, 6) AS score FROM s")
def area_weighted_score(spark, d):
    return _area_scored(spark, d).select("photo_id", _r("score"))


@_query(_AREA + """, g AS (SELECT *, blur_score < 60 AND blur_score + k < 90 AS blurry, row_number() OVER (PARTITION BY session_id, burst ORDER BY round(score, 9) DESC, photo_id) AS r, count(*) OVER (PARTITION BY session_id, burst) AS n FROM s),
l AS (SELECT photo_id, CASE WHEN blurry OR r > 1 THEN 'reject' WHEN n = 1 AND NOT (score >= #0.45# OR (bare AND expo >= #0.5#)) THEN NULL WHEN score >= #0.75# THEN 'highlight' ELSE 'keeper' END AS label FROM g) SELECT photo_id, label, CASE WHEN label IN ('highlight', 'keeper') THEN 3 ELSE 0 END AS stars FROM l""")
def decide_groups(spark, d):
    return edits.decide_groups(_area_scored(spark, d).withColumn("score", F.round("score", 9))).select("photo_id", "label", "stars")


@_query("""WITH f AS (SELECT photo_id, valid AND photo_id % 8 <> 0 AS v, (photo_id + face_index) % 9 <> 0 AS seen, CASE WHEN photo_id % 3 = 0 THEN face_index = 1 ELSE ear < #0.18# END AS cl, abs(yaw) > 28 AS aw, CASE WHEN photo_id % 5 = 0 THEN face_index = 2 ELSE smile_score >= #0.5# END AS sm FROM v_faces)
SELECT photo_id, count(*) FILTER (v) AS valid_faces, count(*) FILTER (v AND seen AND cl) AS closed, count(*) FILTER (v AND seen AND aw) AS away, count(*) FILTER (v AND sm) AS smiling, count(*) FILTER (v AND seen AND cl) > 0 AS any_closed FROM f GROUP BY photo_id""")
def refine_face_counts(spark, d):
    c = F.col
    f = view(spark, d, "v_faces").withColumns({
        "eyes_closed": c("ear") < 0.18, "looks_away": F.abs("yaw") > 28, "smiling": c("smile_score") >= 0.5, "said_subject": F.when(c("photo_id") % 8 == 0, "statue"), "said_glasses": F.when((c("photo_id") + c("face_index")) % 9 == 0, "dark"),
        "said_eyes": F.when(c("photo_id") % 3 == 0, F.when(c("face_index") == 1, "closed").otherwise("open")), "said_gaze": F.lit(None).cast("string"), "said_mouth": F.when(c("photo_id") % 5 == 0, F.when(c("face_index") == 2, "smile").otherwise("neutral"))})
    return edits.refine_face_counts(f)


@_query("""SELECT 'rating' AS figure, CAST(rating AS VARCHAR) AS value, count(*) AS n FROM v_history GROUP BY rating UNION ALL SELECT 'pick', CAST(pick AS VARCHAR), count(*) FROM v_history GROUP BY pick UNION ALL SELECT 'scene', scene, count(*) FROM v_history GROUP BY scene""")
def choice_histograms(spark, d):
    return reports.histograms(view(spark, d, "v_history"), ["rating", "pick", "scene"])


@_query("SELECT count(*) AS photos, count(*) FILTER (rating >= 1) AS starred, count(*) FILTER (pick = 1) AS picked, count(*) FILTER (pick = -1) AS rejected, count(*) FILTER (pick = 0 AND rating = 0) AS neutral FROM v_history")
def choice_totals(spark, d):
    return reports.choice_totals(view(spark, d, "v_history"))


@_query("""WITH x AS (SELECT session_id, count(*) AS photos, count(*) FILTER (l = 'selected') AS chosen, count(*) FILTER (l = 'recommended') AS covering FROM (SELECT session_id, CASE label WHEN 'alternative' THEN 'recommended' ELSE label END AS l FROM v_decisions) GROUP BY session_id)
SELECT *, chosen + covering AS deliverable, photos - chosen - covering AS discarded, round(CAST(chosen + covering AS DOUBLE) / photos, 6) AS share FROM x""")
def selection_totals(spark, d):
    return reports.selection_totals(view(spark, d, "v_decisions").withColumn("label", F.when(F.col("label") == "alternative", "recommended").otherwise(F.col("label"))))


@_query(f"""WITH r0 AS ({_SQL['build_reasons']}), x AS (SELECT session_id, unnest(string_split(reasons, ';')) AS reason FROM r0 JOIN v_photos USING (photo_id) WHERE reasons <> ''), n AS (SELECT session_id, reason, count(*) AS n FROM x GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, reason) AS r FROM n) SELECT session_id, reason, n FROM o WHERE r <= 10""")
def top_reasons(spark, d):
    r = _reasons(spark, d).where("reasons <> ''").withColumn("reasons", F.split("reasons", ";"))
    return reports.top_reasons(r.join(view(spark, d, "v_photos").select("photo_id", "session_id"), "photo_id"))


@_query(HEROES + WINNERS.replace("ELSE 'score'", "ELSE 'taste'") + "SELECT session_id, burst, photo_id, decided_by FROM winners")
def taste_winners(spark, d):
    return ranking.burst_winners(_heroes(spark, d), taste=True).select("session_id", "burst", "photo_id", "decided_by")


@_query(GATES + """, b AS (SELECT photo_id, session_id, burst, alive OR vip > 0 AS alive, CASE WHEN NOT (alive OR vip > 0) THEN reason END AS reason FROM gates),
k AS (SELECT g.session_id, g.burst, count(*) FILTER (g.alive) AS a, count(*) FILTER (b.alive) AS b FROM gates g JOIN b USING (photo_id) GROUP BY g.session_id, g.burst)
SELECT reason, count(*) AS a, CAST(sum(CASE WHEN kept THEN 0 ELSE 1 END) AS BIGINT) AS b FROM (SELECT reason, vip > 0 AS kept FROM gates WHERE reason IS NOT NULL) GROUP BY reason UNION ALL SELECT 'more_survivors', count(*) FILTER (a > b), count(*) FILTER (b > a) FROM k""")
def policy_gates_report(spark, d):
    g = _gated(spark, d).select("photo_id", "session_id", "burst", "alive", "reason", "vip")
    saved = F.col("alive") | (F.col("vip") > 0)
    return reports.policy_gates_report(g.drop("vip"), g.withColumns({"alive": saved, "reason": F.when(~saved, F.col("reason"))}).drop("vip"))


@_query("""SELECT count(*) AS photos, count(*) FILTER (k % 19 = 0) AS errors, count(*) FILTER (k % 23 = 0) AS no_blur, count(*) FILTER (k % 10 < 3) AS outdated, count(*) FILTER (face_count > 0) AS with_faces, round(avg((closed > 0)::INT), 6) AS closed_share FROM v_judged""")
def audit_totals(spark, d):
    k = F.col("k")
    p = view(spark, d, "v_judged").withColumns({"error": F.when(k % 19 == 0, "unreadable").when(k % 2 == 0, ""), "blur_score": F.when(k % 23 != 0, F.col("blur_score")), "version": F.when(k % 10 < 3, 9).otherwise(10)})
    return reports.audit_totals(p, 10)


@_query("SELECT 'closed' AS figure, CAST(closed AS VARCHAR) AS value, count(*) AS n FROM v_judged GROUP BY closed UNION ALL SELECT 'face_count', CAST(face_count AS VARCHAR), count(*) FROM v_judged GROUP BY face_count")
def audit_histograms(spark, d):
    return reports.histograms(view(spark, d, "v_judged").select(F.col("closed").cast("long").alias("closed"), "face_count"), ["closed", "face_count"])


@_query("""SELECT session_id, count(*) AS total, count(*) FILTER (k % 13 = 0) AS errors, count(*) FILTER (k % 13 <> 0 AND label = 'selected') AS selected, count(*) FILTER (k % 13 <> 0 AND label = 'highlighted') AS highlighted, count(*) FILTER (k % 13 <> 0 AND label = 'alternative') AS alternative,
 count(*) FILTER (k % 11 = 0) AS demoted, count(*) FILTER (k % 17 = 0) AS promoted, count(DISTINCT CASE WHEN k % 4 <> 0 THEN k % 12 END) AS identities, count(*) - count(*) FILTER (k % 13 = 0) AS success FROM v_decisions GROUP BY session_id""")
def run_report(spark, d):
    k = F.col("k")
    return reports.run_report(view(spark, d, "v_decisions").withColumns({"error": k % 13 == 0, "demoted": k % 11 == 0, "promoted": k % 17 == 0, "identity_id": F.when(k % 4 != 0, k % 12)}))


@_query("""WITH h AS (SELECT crop_left AS l, crop_top AS t, crop_right AS r, crop_bottom AS b, CASE WHEN k % 3 = 0 THEN #0.0# ELSE CAST(k % 4 AS DOUBLE) / #25.0# END AS p FROM v_history),
x AS (SELECT *, (r - l) * (b - t) AS area, greatest(#0.0#, least(r, 1 - p) - greatest(l, p)) * greatest(#0.0#, least(b, 1 - p) - greatest(t, p)) AS i, (1 - 2 * p) * (1 - 2 * p) AS pa FROM h), y AS (SELECT *, area < #0.97# AS u, 1 - pa > #0.02# AS s, i / (pa + area - i) AS ip FROM x)
SELECT count(*) AS n, MEAN(u::INT) AS user_crops, MEAN(s::INT) AS system_crops, MEAN((u = s)::INT) AS agreement, round(median(area) FILTER (u), 6) AS median_area, round(quantile_cont(area, 0.1) FILTER (u), 6) AS p10_area, MEAN(ip) AS iou_proposed, MEAN(area) AS iou_full,
 MEAN(CASE WHEN u THEN ip END) AS iou_proposed_cropped, MEAN(CASE WHEN u THEN area END) AS iou_full_cropped FROM y""")
def crop_agreement(spark, d):
    p = F.when(F.col("k") % 3 != 0, (F.col("k") % 4).cast("double") / 25)
    return reports.crop_agreement(view(spark, d, "v_history").withColumns({"p_left": p, "p_top": p, "p_right": 1 - p, "p_bottom": 1 - p}))


@_query("""WITH h AS (SELECT crop_angle AS a, CASE WHEN photo_id % 5 <> 0 THEN CAST(photo_id % 7 - 3 AS DOUBLE) / 2 END AS d FROM v_history)
SELECT abs(a) > #0.05# AS turned, count(*) AS n, MEAN((d IS NOT NULL)::INT) AS coverage, MEAN(abs(d - a)) AS mae_direct, MEAN(abs(-d - a)) AS mae_flipped, median(abs(d - a)) AS median_direct, median(abs(-d - a)) AS median_flipped,
 CASE WHEN NOT (abs(a) > #0.05#) THEN MEAN((abs(d) > 1)::INT) END AS false_corrections FROM h GROUP BY 1""")
def straighten_coverage(spark, d):
    return reports.straighten_coverage(view(spark, d, "v_history").withColumn("detected", F.when(F.col("photo_id") % 5 != 0, (F.col("photo_id") % 7 - 3).cast("double") / 2)))


@_query("""WITH m AS (SELECT scene, median(exposure) AS m FROM v_history GROUP BY scene), x AS (SELECT exposure AS e, m, abs(exposure) > #0.05# AS real FROM v_history JOIN m USING (scene))
SELECT count(*) AS n, MEAN(abs(e)) AS mae_none, MEAN(abs(e - #0.3#)) AS mae_bias, MEAN(abs(e - m)) AS mae_learned, MEAN((NOT real)::INT) AS right_none, MEAN(real::INT) AS right_bias, MEAN((real = (abs(m) > #0.05#))::INT) AS right_learned FROM x""")
def exposure_rules(spark, d):
    return reports.exposure_rules(view(spark, d, "v_history"))


@_query("""WITH t AS (SELECT *, kind = 'user_override' AND override_type = 'false_negative' AS lost FROM v_telemetry), o AS (SELECT coalesce(os, 'unknown') AS os, count(*) AS n FROM t WHERE kind = 'session_start' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)
SELECT count(*) FILTER (kind = 'session_start') AS sessions, count(DISTINCT install) FILTER (kind = 'session_start') AS installs, (SELECT os FROM o) AS os, count(*) FILTER (kind = 'user_override') AS overrides, count(*) FILTER (lost) AS false_negatives, count(*) FILTER (kind = 'user_override' AND override_type = 'false_positive') AS false_positives,
 round(avg(coalesce(blur, 0)) FILTER (lost), 6) AS lost_blur, round(avg(CAST(faces AS DOUBLE)) FILTER (lost), 6) AS lost_faces, count(*) FILTER (kind = 'duel_resolved') AS duels, round(avg(amount) FILTER (kind = 'duel_resolved'), 6) AS duel_ms, round(avg(amount) FILTER (kind = 'ingestion_batch'), 6) AS ingest_seconds,
 round(avg(amount) FILTER (kind = 'clustering_complete'), 6) AS cluster_seconds, round(max(amount) FILTER (kind = 'performance_snapshot'), 6) AS ram_mb FROM t""")
def telemetry_summary(spark, d):
    return reports.telemetry_summary(view(spark, d, "v_telemetry"))


@_query("""WITH g AS (SELECT 'gpu' AS figure, coalesce(gpu, 'unknown') AS value, count(*) AS n FROM v_telemetry WHERE kind = 'session_start' GROUP BY 2 UNION ALL SELECT 'preset', preset, count(*) FROM v_telemetry WHERE kind = 'style_applied' GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY figure ORDER BY n DESC, value) AS r FROM g) SELECT figure, value, n FROM r WHERE r <= 5""")
def telemetry_top(spark, d):
    return reports.telemetry_top(view(spark, d, "v_telemetry"))


def _client(spark, d):
    f = view(spark, d, "v_files").select("photo_id", "stem", "k")
    names = f.where("k % 10 = 0").select(F.upper("stem").alias("stem")).union(f.where("k % 25 = 0").select(F.concat("stem", F.lit("_x")).alias("stem")))
    return names, joins.import_client_selection(f.where("photo_id % 3 <> 0").withColumns({"label": F.lit("duplicates"), "stars": F.lit(1)}), names, f)


_CLIENT = """WITH n AS (SELECT DISTINCT lower(stem) AS s FROM v_files WHERE k % 10 = 0 UNION SELECT DISTINCT lower(stem) || '_x' FROM v_files WHERE k % 25 = 0), p AS (SELECT photo_id, stem, lower(stem) AS s FROM v_files WHERE photo_id % 3 <> 0),
r AS (SELECT photo_id, s, s IN (SELECT s FROM n) AS hit FROM p UNION ALL SELECT photo_id, lower(stem), true FROM v_files WHERE lower(stem) IN (SELECT s FROM n) AND lower(stem) NOT IN (SELECT s FROM p)) """


@_query(_CLIENT + "SELECT photo_id, CASE WHEN hit THEN 'selected' ELSE 'duplicates' END AS label, CASE WHEN hit THEN 4 ELSE 1 END AS stars, CASE WHEN hit THEN 'Red' END AS color, CASE WHEN hit THEN 'pick' END AS flag FROM r")
def import_client_selection(spark, d):
    return _client(spark, d)[1].select("photo_id", "label", "stars", "color", "flag")


@_query(_CLIENT + "SELECT count(*) FILTER (hit) AS updated, (SELECT count(*) FROM n WHERE s NOT IN (SELECT s FROM r WHERE hit)) AS not_found FROM r")
def client_selection_report(spark, d):
    return joins.client_selection_report(*_client(spark, d))


@_query("""WITH c AS (SELECT CAST(vec_id AS BIGINT) AS scene, embedding AS c FROM embeddings WHERE vec_id < 12), x AS (SELECT e.vec_id, c.scene, round(list_sum(list_transform(list_zip(e.embedding, c.c), lambda z: (z[2]::DOUBLE - z[1]::DOUBLE) * (z[2]::DOUBLE - z[1]::DOUBLE))), 9) AS d FROM embeddings e CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, scene) AS r FROM x) SELECT vec_id, scene FROM r WHERE r = 1""")
def nearest_scene(spark, d):
    view(spark, d, "v_photos")
    e = spark.table("embeddings")
    return joins.nearest_scene(e, e.where("vec_id < 12").select(F.col("vec_id").cast("long").alias("scene"), F.col("embedding").cast("array<double>").alias("centroid")))


@_query("""WITH e AS (SELECT * FROM v_reminders WHERE action <> 'view'), l AS (SELECT directory, max(at_us * 1000000000 + event_id) AS l FROM e WHERE action = 'export' GROUP BY directory), x AS (SELECT e.*, l.l FROM e JOIN l USING (directory) WHERE at_us * 1000000000 + event_id >= l)
SELECT directory, max(at_us) FILTER (action = 'export') AS exported_at, arg_max(at_us + CASE action WHEN 'snooze' THEN hours WHEN 'sync' THEN 8 ELSE 0 END * 60000000, at_us * 1000000000 + event_id) FILTER (action <> 'dismiss') AS remind_after, max(at_us) FILTER (action = 'sync') AS synced_at, bool_or(action = 'dismiss') AS dismissed FROM x GROUP BY directory""")
def sync_reminders(spark, d):
    return streams.reminders(view(spark, d, "v_reminders"), 60_000_000)


@_query("""SELECT photo_id, CASE k % 3 WHEN 0 THEN 1136214245 + photo_id WHEN 1 THEN 1136214245 - photo_id END AS seconds FROM v_photos""")
def parse_capture_time(spark, d):
    at = F.timestamp_seconds(F.lit(1136214245) + F.when(F.col("k") % 3 == 0, F.col("photo_id")).otherwise(-F.col("photo_id")))
    text = F.when(F.col("k") % 3 == 0, F.date_format(at, "yyyy:MM:dd HH:mm:ss")).when(F.col("k") % 3 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    return view(spark, d, "v_photos").select("photo_id", F.unix_seconds(rules.parse_capture_time(text)).alias("seconds"))


@_query("""SELECT photo_id, 'Exposure2012' AS field, CAST(CASE WHEN k % 2 = 0 THEN -k ELSE k END AS DOUBLE) / 4 AS value FROM v_photos WHERE photo_id % 5 <> 0 UNION ALL SELECT photo_id, 'Contrast2012', CAST(k AS DOUBLE) FROM v_photos WHERE photo_id % 5 <> 0 AND k % 3 = 0""")
def parse_settings_blob(spark, d):
    k = F.col("k")
    s = F.concat(F.lit("s = { Exposure2012 = 7,\nIgnored = 3, Exposure2012 = "), (F.when(k % 2 == 0, -k).otherwise(k).cast("double") / 4).cast("string"), F.when(k % 3 == 0, F.concat(F.lit(", Contrast2012 = "), k.cast("string"))).otherwise(""), F.lit(" }"))
    p = view(spark, d, "v_photos").select("photo_id", F.when(F.col("photo_id") % 5 != 0, s).alias("blob"))
    return p.select("photo_id", F.explode(tables.parse_settings_blob(F.col("blob"), ["Exposure2012", "Contrast2012"])).alias("field", "value"))


@_query("""SELECT photo_id, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 6 END AS rating, CASE WHEN k % 3 = 0 THEN 'Red' WHEN k % 5 = 0 THEN 'Blue' END AS label FROM v_files WHERE photo_id % 9 <> 0""")
def sidecar_harvest(spark, d):
    k = F.col("k")
    packet = F.concat(F.lit('<x xmlns:r="r" xmlns:p="p"><r:Description'), F.when(k % 5 == 0, ' p:Label="Blue"').otherwise(""), F.when((k % 2 == 0) & (k % 4 != 0), F.concat(F.lit(' p:Rating="'), (k % 6).cast("string"), F.lit('"'))).otherwise(""), F.lit(">"),
                      F.when(k % 2 == 1, F.concat(F.lit("<p:Rating>"), (k % 6).cast("string"), F.lit("</p:Rating>"))).otherwise(""), F.when(k % 3 == 0, "<p:Label>Red</p:Label>").otherwise(""), F.lit("</r:Description></x>"))
    return tables.sidecar_harvest(view(spark, d, "v_files").select("photo_id", F.when(F.col("photo_id") % 9 != 0, packet).alias("packet"))).select("photo_id", F.col("rating").cast("long").alias("rating"), "label")


@_query("SELECT photo_id, k AS a FROM v_photos WHERE photo_id % 6 > 1")
def tolerant_decode(spark, d):
    text = F.when(F.col("photo_id") % 6 == 0, F.lit(None)).when(F.col("photo_id") % 6 == 1, '{"a": ').otherwise(F.to_json(F.struct(F.col("k").alias("a"))))
    return tables.tolerant_decode(view(spark, d, "v_photos").select("photo_id", text.alias("j")), "j", "a int").select("photo_id", "a")


@_query("SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN 'failed' WHEN photo_id % 2 = 0 THEN 'cleared' ELSE 'restored' END AS outcome, CASE WHEN photo_id % 2 <> 0 THEN 'packet ' || k END AS previous FROM v_files")
def restore_state(spark, d):
    f = view(spark, d, "v_files").select("photo_id", F.col("photo_id").cast("string").alias("path"), F.when(F.col("photo_id") % 2 != 0, F.concat(F.lit("packet "), F.col("k").cast("string"))).alias("packet"))
    kept = tables.capture_state(f.select("path").union(f.select("path")), f)
    return tables.restore_state(kept, f.where("photo_id % 3 <> 0").withColumn("packet", F.lit("new"))).select(F.col("path").cast("long").alias("photo_id"), "outcome", "previous")


@_query("SELECT '/d/' || scene || '/IMG_' || photo_id || '.jpg' AS path, scene, 'positive' AS label, 3 AS rating, 1 AS pick FROM v_photos WHERE scene <> 'click' AND k % 4 <> 0")
def delivered_ingest(spark, d):
    p = view(spark, d, "v_photos").select(F.concat(F.lit("/d/"), "scene", F.lit("/IMG_"), F.col("photo_id").cast("string"), F.lit(".jpg")).alias("path"), "k")
    return tables.delivered_ingest(p.select("path").union(p.select("path")), p.where("k % 4 = 0"), ("CLICK",)).select("path", "scene", "label", "rating", "pick")


@_query("""SELECT photo_id, label, CASE label WHEN 'selected' THEN 4 WHEN 'alternative' THEN 2 ELSE 1 END AS stars, CASE WHEN photo_id % 3 = 0 THEN #0.0# ELSE CAST(k AS DOUBLE) END AS blur_score, label = 'selected' AS representative FROM v_decisions""")
def rehydrate_session(spark, d):
    x = view(spark, d, "v_decisions")
    stars = spark.createDataFrame([("selected", 4), ("alternative", 2)], "label string, stars int")
    return tables.rehydrate_session(x.select("photo_id", "label"), x.where("photo_id % 3 <> 0").select("photo_id", F.col("k").cast("double").alias("blur_score")), stars).select("photo_id", "label", "stars", "blur_score", "representative")


@_query("""SELECT photo_id AS image_id, CASE WHEN folder_id % 3 = 0 THEN '' ELSE '/r' || (folder_id % 3) || '/' END || 'f' || folder_id || '/' || stem || '.' || ext AS path, k % 6 AS rating, CASE WHEN k % 2 = 0 THEN 's' || k END AS settings FROM v_files JOIN (SELECT photo_id, t_us FROM v_photos) USING (photo_id) WHERE t_us >= 30000000""")
def catalog_harvest(spark, d):
    c = F.col
    f = view(spark, d, "v_files").join(view(spark, d, "v_photos").select("photo_id", F.format_string("%015d", "t_us").alias("capture_time")), "photo_id")
    images = f.select(c("photo_id").alias("image_id"), c("photo_id").alias("root_file"), (c("k") % 6).alias("rating"), F.lit(0).alias("pick"), "capture_time")
    files = f.select(c("photo_id").alias("file_id"), c("folder_id").alias("folder"), c("stem").alias("base_name"), c("ext").alias("extension"))
    folders = f.select(c("folder_id").alias("folder_key"), (c("folder_id") % 3).alias("root"), F.concat(F.lit("f"), c("folder_id").cast("string"), F.lit("/")).alias("path_from_root")).distinct()
    roots = folders.where("root > 0").select(c("root").alias("root_id"), F.concat(F.lit("/r"), c("root").cast("string"), F.lit("/")).alias("absolute_path")).distinct()
    develop = f.where("k % 2 = 0").select(c("photo_id").alias("image"), F.concat(F.lit("s"), c("k").cast("string")).alias("settings"))
    return tables.catalog_harvest(images, files, folders, roots, develop, "%015d" % 30_000_000).select("image_id", "path", "rating", "settings")


@_query(HISTORY + """, x AS (SELECT photo_id, CASE label WHEN 'positive' THEN 1 ELSE -1 END AS y FROM h WHERE label IN ('positive', 'negative') UNION SELECT photo_id, 1 FROM h WHERE k % 5 = 0 UNION SELECT photo_id + 1, -1 FROM h WHERE k % 5 = 0) SELECT photo_id, y FROM x""")
def feed_examples(spark, d):
    h = _history(spark, d)
    return learn.feed_examples(h, h.where("k % 5 = 0").select(F.col("photo_id").alias("winner"), (F.col("photo_id") + 1).alias("loser")))


@_query("""WITH e AS (SELECT folder_id AS path, t_us, photo_id, CASE WHEN k % 3 = 0 THEN k END AS rating FROM v_photos), g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY path ORDER BY t_us, photo_id) < 2000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY t_us, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g) SELECT path, min(t_us) AS start_us, max(rating) FILTER (t_us = last_rated) AS rating, count(*) AS merged FROM (SELECT *, max(t_us) FILTER (rating IS NOT NULL) OVER (PARTITION BY path, n) AS last_rated FROM s) GROUP BY path, n""")
def coalesce_deltas(spark, d):
    p = view(spark, d, "v_photos").groupBy(F.col("folder_id").alias("path"), "t_us").agg(F.max(F.when(F.col("k") % 3 == 0, F.col("k"))).alias("rating"), F.count("*").alias("c"))
    p = p.select("path", F.timestamp_micros("t_us").alias("ts"), "rating", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("i"))
    return streams.coalesce_deltas(p, ["rating"], "2 seconds").select("path", F.unix_micros("start").alias("start_us"), "rating", "merged")
