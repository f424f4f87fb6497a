"""Registered queries of dashboards, tilt, summaries and reviews, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view
from .operators import aggs, summaries
from .registry import HISTORY, _history, _query, _scored
from .streaming import streams


@_query("""WITH f AS (SELECT f.folder_id, lower(f.stem_path) AS stem, f.photo_id, CASE WHEN d.k % 8 = 0 THEN 'highlighted' WHEN d.k % 13 = 0 THEN 'blurry' ELSE d.label END AS label FROM v_files f JOIN v_decisions d USING (photo_id)),
o AS (SELECT folder_id, stem, arg_min(label, (CASE WHEN label IN ('selected', 'highlighted') THEN 0 ELSE 1 END) * 100000000 + photo_id) AS label FROM f GROUP BY folder_id, stem), s AS (SELECT folder_id, count(DISTINCT photo_id) AS synced, max(t_us) AS last_synced_us FROM v_photos WHERE k % 9 = 4 GROUP BY folder_id)
SELECT folder_id, count(*) AS total, count(*) FILTER (label IN ('selected', 'highlighted')) AS selected, count(*) FILTER (label = 'highlighted') AS highlighted, count(*) FILTER (label = 'duplicates') AS duplicates, count(*) FILTER (label = 'blurry') AS blurry, count(*) FILTER (label = 'closed_eyes') AS closed_eyes,
 any_value(coalesce(synced, 0)) AS synced, any_value(last_synced_us) AS last_synced_us, count(*) FILTER (label NOT IN ('selected', 'highlighted')) AS discarded, CAST(greatest(1, round_even(count(*) * #0.18#, 0)) AS BIGINT) AS bursts FROM o LEFT JOIN s USING (folder_id) GROUP BY folder_id""")
def dashboard(spark, d):
    k = F.col("k")
    label = F.when(k % 8 == 0, "highlighted").when(k % 13 == 0, "blurry").otherwise(F.col("label"))
    files = view(spark, d, "v_files").drop("k").join(view(spark, d, "v_decisions").select("photo_id", label.alias("label")), "photo_id")
    syncs = view(spark, d, "v_photos").where("k % 9 = 4").select("folder_id", "photo_id", F.col("t_us").alias("synced_us"))
    return summaries.dashboard(files, syncs.union(syncs))


@_query("""WITH e AS (SELECT * FROM v_reminders WHERE action <> 'view'), l AS (SELECT directory, max(at_us * 1000000000 + event_id) AS l FROM e WHERE action = 'export' GROUP BY directory), x AS (SELECT e.*, l.l FROM e JOIN l USING (directory) WHERE at_us * 1000000000 + event_id >= l),
r AS (SELECT directory, max(at_us) FILTER (action = 'export') AS exported_at, arg_max(at_us + CASE action WHEN 'snooze' THEN hours WHEN 'sync' THEN 8 ELSE 0 END * 60000000, at_us * 1000000000 + event_id) FILTER (action <> 'dismiss') AS remind_after, max(at_us) FILTER (action = 'sync') AS synced_at, bool_or(action = 'dismiss') AS dismissed FROM x GROUP BY directory)
SELECT directory, exported_at, synced_at FROM r WHERE NOT dismissed AND remind_after <= 1380000000 AND directory % 5 <> 0""")
def due_reminders(spark, d):
    exports = streams.reminders(view(spark, d, "v_reminders"), 60_000_000).withColumn("photos", F.when(F.col("directory") % 5 != 0, 3).otherwise(0))
    return summaries.due_reminders(exports, 1_380_000_000).select("directory", "exported_at", "synced_at")


@_query("""WITH s AS (SELECT l_orderkey AS grp, CASE l_linenumber % 3 WHEN 0 THEN 86 + CAST(l_discount AS DOUBLE) * 100 WHEN 1 THEN -176 - CAST(l_discount AS DOUBLE) * 70 ELSE CAST(l_discount AS DOUBLE) * 100 - 5 END AS angle, CAST(l_quantity AS DOUBLE) * 2 AS weight FROM lineitem),
a AS (SELECT grp, CASE WHEN angle > 90 THEN angle - 180 WHEN angle < -90 THEN angle + 180 ELSE angle END AS a, weight FROM s WHERE weight >= 20),
o AS (SELECT *, abs(a) <= 6 AS flat, CASE WHEN abs(a) <= 6 THEN a WHEN abs(abs(a) - 90) <= 6 THEN CASE WHEN a > 0 THEN a - 90 ELSE a + 90 END END AS off FROM a),
r AS (SELECT *, sum(weight) OVER (PARTITION BY grp ORDER BY off, weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(weight) OVER (PARTITION BY grp) AS al FROM o WHERE off IS NOT NULL), m AS (SELECT grp, min(off) AS med FROM r WHERE run * 2 >= al GROUP BY grp),
b AS (SELECT r.grp, sum(off * weight) / sum(weight) AS best FROM r JOIN m USING (grp) WHERE abs(off - med) <= 1.5 GROUP BY r.grp),
g AS (SELECT r.grp, any_value(best) AS best, count(*) FILTER (flat) AS horizontal, count(*) FILTER (NOT flat) AS vertical, coalesce(sum(weight) FILTER (abs(off - best) <= 1), 0) AS held, any_value(al) AS al FROM r JOIN b USING (grp) GROUP BY r.grp)
SELECT k.grp, coalesce(horizontal, 0) AS horizontal, coalesce(vertical, 0) AS vertical, CASE WHEN abs(best) >= #0.2# THEN round_even(best, 4) ELSE #0.0# END AS tilt, CASE WHEN al IS NULL THEN #0.0# ELSE round_even(least(#1.0#, held / greatest(#1.0#, al) * least(#1.0#, held / 200)), 3) END AS confidence, coalesce(abs(best) >= #0.2#, false) AS needed FROM (SELECT DISTINCT grp FROM s) k LEFT JOIN g USING (grp)""")
def tilt(spark, d):
    view(spark, d, "v_photos")
    off = F.col("l_discount").cast("double")
    angle = F.when(F.col("l_linenumber") % 3 == 0, 86 + off * 100).when(F.col("l_linenumber") % 3 == 1, -176 - off * 70).otherwise(off * 100 - 5)
    return summaries.tilt(spark.table("lineitem").select(F.col("l_orderkey").alias("grp"), angle.alias("angle"), (F.col("l_quantity").cast("double") * 2).alias("weight")))


@_query(HISTORY + """, m AS (SELECT scene, round_even(median(area), 4) AS a FROM h WHERE label = 'positive' AND real_crop GROUP BY scene HAVING count(*) >= 15), r AS (SELECT scene FROM h WHERE label = 'positive' AND NOT extreme GROUP BY scene HAVING count(*) >= 15)
SELECT count(*) FILTER (label = 'positive') AS positives, count(*) FILTER (label = 'negative') AS negatives, count(DISTINCT scene) AS scenes, 2 * count(*) FILTER (k % 5 = 0) AS examples, (SELECT count(*) FROM r) AS recipes, (SELECT CAST(round_even(MEAN(a) * 100, 0) AS BIGINT) FROM m) AS usual_crop_percent, max(t_us) FILTER (k % 9 = 4) AS last_synced_us FROM h JOIN (SELECT photo_id AS id, t_us AS t FROM v_photos) ON id = photo_id""")
def learning_overview(spark, d):
    h = _history(spark, d)
    examples = h.where("k % 5 = 0").select("photo_id")
    return summaries.learning_overview(h, examples.union(examples), aggs.learn_recipes(h), aggs.learn_crop_style(h), h.where("k % 9 = 4").select(F.col("t_us").alias("synced_us")))


@_query("""WITH f AS (SELECT s.session_id, s.burst, CASE WHEN f.identity_id < 9 THEN 'person ' || f.identity_id ELSE 'face ' || f.face_index END AS who, f.photo_id, f.face_index, f.x FROM v_faces f JOIN v_scored s USING (photo_id))
SELECT session_id, burst, who, photo_id, face_index, x, row_number() OVER (PARTITION BY session_id, burst, who ORDER BY photo_id, face_index) AS place FROM f""")
def burst_face_crops(spark, d):
    f = view(spark, d, "v_faces").withColumns({"identity_id": F.when(F.col("identity_id") < 9, F.col("identity_id")), "h": F.col("w")})
    got = summaries.burst_face_crops(f, _scored(spark, d))
    return got.select("session_id", "burst", "who", F.posexplode("crops").alias("place", "c")).select("session_id", "burst", "who", "c.photo_id", "c.face_index", "c.x", (F.col("place") + 1).cast("long").alias("place"))


@_query("SELECT photo_id AS winner, photo_id + 1 AS loser FROM v_photos WHERE k % 4 = 1 AND photo_id % 3 <> 0 ORDER BY md5(photo_id || '|' || (photo_id + 1)), photo_id LIMIT 200")
def review_sample(spark, d):
    pairs = view(spark, d, "v_photos").where("k % 4 = 1").select(F.col("photo_id").alias("winner"), (F.col("photo_id") + 1).alias("loser"))
    return summaries.review_sample(pairs, pairs.where("winner % 3 = 0"), 200)


@_query(HISTORY + """, x AS (SELECT photo_id, CASE label WHEN 'positive' THEN 1 ELSE -1 END AS y, 'history' AS source FROM h WHERE label IN ('positive', 'negative') UNION SELECT photo_id, 1, 'duel' FROM h WHERE k % 5 = 0 UNION SELECT photo_id + 1, -1, 'duel' FROM h WHERE k % 5 = 0
UNION SELECT photo_id, CASE WHEN k % 6 > 2 THEN 1 ELSE -1 END, 'sync' FROM h WHERE k % 6 <> 2 AND k % 7 = 1 UNION SELECT photo_id, 1, 'delivered' FROM h WHERE k % 11 = 3) SELECT photo_id, y, source FROM x WHERE NOT (photo_id % 4 = 0 AND source IN ('history', 'duel'))""")
def taste_examples(spark, d):
    h = _history(spark, d)
    duels = h.where("k % 5 = 0").select(F.col("photo_id").alias("winner"), (F.col("photo_id") + 1).alias("loser"))
    syncs = h.where("k % 7 = 1").select("photo_id", (F.col("k") % 6).alias("stars"), F.lit(2).alias("was"))
    own = h.select("photo_id").union(duels.select("loser")).where("photo_id % 4 = 0").distinct()
    fed = own.withColumn("source", F.explode(F.array(F.lit("history"), F.lit("duel"))))
    return summaries.taste_examples(h, duels.union(duels), syncs, h.where("k % 11 = 3"), fed)


@_query("""WITH a AS (SELECT photo_id FROM v_decisions WHERE label = 'selected'), b AS (SELECT photo_id FROM v_decisions WHERE truth = 'selected'), n AS (SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b, (SELECT count(*) FROM a JOIN b USING (photo_id)) AS in_both)
SELECT *, CAST(in_both AS DOUBLE) / in_a AS of_a, CAST(in_both AS DOUBLE) / in_b AS of_b, CAST(in_both AS DOUBLE) / (in_a + in_b - in_both) AS of_any FROM n""")
def overlap_report(spark, d):
    x = view(spark, d, "v_decisions")
    return summaries.overlap_report(x.where("label = 'selected'"), x.where("truth = 'selected'"))


@_query("SELECT photo_id, label FROM v_decisions p WHERE label IN ('selected', 'alternative') AND EXISTS (SELECT 1 FROM v_faces f WHERE f.photo_id = p.photo_id AND f.identity_id IN (3, 5))")
def filter_by_people(spark, d):
    return summaries.filter_by_people(view(spark, d, "v_decisions").select("photo_id", "label"), view(spark, d, "v_faces"), [3, 5], ["selected", "alternative"])
