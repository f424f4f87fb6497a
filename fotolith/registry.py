"""Registered queries of the photo engine: each applies an operator to a view; oracles are DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import duck, view
from .operators import aggs, joins, learn, rules, sessions, story, windows
from .sources import tables
from .streaming import streams

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return {k: duck(v) for k, v in _SQL.items()}


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _scored(spark, d):
    p = windows.gap_bursts(view(spark, d, "v_photos"), 4.0).withColumn("score", rules.cold_score(F.col("blur_score"), F.col("aesthetic_score")))
    return p.withColumn("burst", F.col("burst").cast("long"))


def face_vectors(spark, d):
    """Faces with vectors of their own: mostly their person's, a little their photo's."""
    f = view(spark, d, "v_faces").select("session_id", "photo_id", F.col("face_index").cast("int").alias("face_index"), "identity_id")
    e = spark.table("embeddings").select("vec_id", "embedding")
    n = F.lit(e.count())
    who = F.pmod(F.xxhash64("session_id") + F.col("identity_id"), n)
    f = f.withColumns({"p": who, "q": (F.col("photo_id") * 3 + F.col("face_index")) % n})
    f = f.join(e.select(F.col("vec_id").alias("p"), F.col("embedding").alias("own")), "p").join(e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("light")), "q")
    return f.select("session_id", "photo_id", "face_index", "identity_id", F.zip_with("own", "light", lambda x, y: x.cast("double") + y.cast("double") * 0.2).alias("vec"))


def _history(spark, d):
    h = rules.is_real_crop(rules.crop_descriptors(view(spark, d, "v_history")))
    return h.withColumns({"label": rules.classify_history(F.col("rating"), F.col("pick")), "extreme": rules.is_extreme_develop(F.col("exposure"))})


HISTORY = """WITH h0 AS (SELECT *, CASE WHEN pick = -1 THEN 'negative' WHEN rating >= 4 THEN 'ignore' WHEN rating >= 2 THEN 'positive' WHEN rating = 1 THEN 'negative' ELSE 'unreviewed' END AS label, abs(exposure) > 1.0 AS extreme,
 round_even((crop_right - crop_left) * (crop_bottom - crop_top), 4) AS area, round_even((crop_left + crop_right) / 2 - #0.5#, 4) AS dx, round_even((crop_top + crop_bottom) / 2 - #0.5#, 4) AS dy, round_even(crop_angle, 4) AS angle FROM v_history),
h AS (SELECT *, area < 0.98 OR abs(angle) > 0.1 AS real_crop FROM h0) """
RANKED = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) AS r, count(*) OVER (PARTITION BY session_id, burst) AS n, lead(score) OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) AS nxt FROM v_scored) "
CHAPTERS = """WITH c0 AS (SELECT *, last_value(CASE WHEN scene_type <> 'detail' THEN t_us END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t_us, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM v_scored),
c1 AS (SELECT *, sum(CASE WHEN scene_type <> 'detail' AND (was IS NULL OR t_us - was > 900000000) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t_us, photo_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n0 FROM c0),
c AS (SELECT *, CAST(CASE WHEN scene_type = 'detail' THEN 0 ELSE greatest(n0, 1) END AS BIGINT) AS chapter FROM c1) """


@_query(RANKED + "SELECT photo_id, session_id, burst, round(score, 6) AS score, CASE WHEN nxt IS NULL THEN #1.0# ELSE round_even(score - nxt, 4) END AS margin FROM r WHERE r = 1")
def best_per_burst(spark, d):
    return windows.winner_and_margin(_scored(spark, d)).select("photo_id", "session_id", "burst", _r("score"), "margin")


@_query("SELECT photo_id, round(#0.6# * least(#1.0#, blur_score / #500.0#) + #0.4# * aesthetic_score, 6) AS score FROM v_photos")
def cold_score(spark, d):
    return view(spark, d, "v_photos").select("photo_id", F.round(rules.cold_score(F.col("blur_score"), F.col("aesthetic_score")), 6).alias("score"))


@_query(HISTORY + "SELECT photo_id, label, extreme, area, dx, dy, angle, real_crop FROM h")
def classify_history(spark, d):
    return _history(spark, d).select("photo_id", "label", "extreme", "area", "dx", "dy", "angle", "real_crop")


@_query("""WITH s AS (SELECT photo_id, k, CAST(k AS DOUBLE) AS score, CAST(photo_id % 5 AS DOUBLE) / #10.0# AS cpbd, CAST(400 * (1 + photo_id % 8) AS DOUBLE) AS iso FROM v_photos)
SELECT photo_id, CASE WHEN score >= CASE WHEN iso > 800 THEN #80.0# * (1 + #0.15# * log2(iso / #800.0#)) ELSE #80.0# END THEN 'sharp' WHEN cpbd >= 0.25 THEN 'rescued' ELSE 'blurry' END AS verdict FROM s""")
def blur_verdict(spark, d):
    p = view(spark, d, "v_photos").select("photo_id", F.col("k").cast("double").alias("score"), (F.col("photo_id") % 5 / F.lit(10.0)).alias("cpbd"), (400 * (1 + F.col("photo_id") % 8)).cast("double").alias("iso"))
    return p.select("photo_id", rules.blur_verdict(F.col("score"), F.col("iso"), F.col("cpbd")).alias("verdict"))


@_query("""WITH s AS (SELECT photo_id, greatest(#0.0#, least(#1.0#, (CAST(k AS DOUBLE) / #400.0# - #0.05#) / #0.15#)) AS h, CAST(k AS DOUBLE) / #400.0# AS hi, greatest(#0.0#, least(#1.0#, (CAST(photo_id % 50 AS DOUBLE) / #100.0# - #0.1#) / #0.25#)) AS s, CAST(photo_id % 50 AS DOUBLE) / #100.0# AS sh FROM v_photos),
t AS (SELECT photo_id, CASE WHEN hi > 0.05 THEN round_even(#-80.0# * (h * h * (3 - 2 * h)), 0) ELSE #0.0# END AS highlights, CASE WHEN sh > 0.1 THEN round_even(#70.0# * (s * s * (3 - 2 * s)), 0) ELSE #0.0# END AS shadows FROM s)
SELECT photo_id, highlights + 0 AS highlights, round_even(#0.4# * highlights, 0) + 0 AS whites, shadows, round_even(#0.3# * shadows, 0) AS blacks FROM t""".replace("#-80.0#", "(-#80.0#)"))
def tonal_rescue(spark, d):
    p = view(spark, d, "v_photos").select("photo_id", (F.col("k") / F.lit(400.0)).alias("hi"), (F.col("photo_id") % 50 / F.lit(100.0)).alias("sh"))
    return p.select("photo_id", *[(v + F.lit(0.0)).alias(k) for k, v in rules.tonal_rescue(F.col("hi"), F.col("sh")).items()])


@_query("SELECT photo_id, greatest(#-1.2#, least(#1.2#, round_even(log2(#0.18# / global_lum), 2))) AS exposure FROM v_light".replace("#-1.2#", "(-#1.2#)"))
def derive_exposure(spark, d):
    return view(spark, d, "v_light").select("photo_id", rules.derive_exposure(F.col("global_lum")).alias("exposure"))


@_query("SELECT photo_id, substr(sha256(concat(stem_path, '.', ext)), 1, 16) AS anonymous FROM v_files")
def anonymise_path(spark, d):
    return view(spark, d, "v_files").select("photo_id", rules.anonymise_path(F.concat("stem_path", F.lit("."), "ext")).alias("anonymous"))


@_query("""SELECT photo_id, face_index, abs(yaw) > 28 AS looks_away, round(greatest(#0.0#, least(#1.0#, 1 - abs(yaw) / #40.0#)), 6) AS gaze_score,
 CASE WHEN CAST(w * w AS DOUBLE) / max(CAST(w * w AS DOUBLE)) OVER (PARTITION BY photo_id) >= 0.35 THEN #1.0# ELSE greatest(#0.1#, round_even(CAST(w * w AS DOUBLE) / max(CAST(w * w AS DOUBLE)) OVER (PARTITION BY photo_id), 3)) END AS weight FROM v_faces""")
def face_attributes(spark, d):
    return rules.vip_weights(rules.face_attributes(view(spark, d, "v_faces"))).select("photo_id", "face_index", "looks_away", _r("gaze_score"), "weight")


@_query("""WITH f AS (SELECT photo_id, min(w) AS lw, avg(confidence) AS c FROM v_faces GROUP BY photo_id),
p AS (SELECT p.photo_id, p.session_id, CASE WHEN face_count = 0 THEN 3 ELSE 0 END + CASE WHEN face_count >= 8 THEN 1 ELSE 0 END + CASE WHEN lw < 40 THEN 1 ELSE 0 END + CASE WHEN c < 0.75 THEN 1 ELSE 0 END AS hits, count(*) OVER (PARTITION BY session_id) AS n FROM v_photos p LEFT JOIN f USING (photo_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hits DESC, photo_id) AS r FROM p WHERE hits > 0)
SELECT photo_id, session_id, CAST(hits AS BIGINT) AS hits FROM r WHERE r <= greatest(1, floor(n * #0.3#))""")
def second_pass_rules(spark, d):
    return rules.second_pass_rules(view(spark, d, "v_photos").select("photo_id", "session_id", "face_count"), view(spark, d, "v_faces").select("photo_id", "w", "confidence"))


@_query("""WITH d AS (SELECT *, CAST(k AS DOUBLE) / #500.0# AS margin, photo_id % 8 = 0 AS bw FROM v_decisions) SELECT count(*) AS all_photos, count(*) FILTER (label IN ('selected', 'highlighted')) AS recommended, count(*) FILTER (label = 'duplicates') AS repeated,
 count(*) FILTER (label IN ('closed_eyes', 'blurry')) AS discards, count(*) FILTER (margin < 0.05) AS doubtful, count(*) FILTER (bw) AS black_white, count(*) FILTER (label = 'alternative') AS alternatives FROM d""")
def grid_facets(spark, d):
    return rules.grid_facets(view(spark, d, "v_decisions").withColumns({"margin": F.col("k") / F.lit(500.0), "black_white": F.col("photo_id") % 8 == 0}))


@_query("SELECT a.session_id, a.photo_id AS a, b.photo_id AS b, CAST(bit_count(xor(a.phash, b.phash)) AS BIGINT) AS hamming FROM v_hashed a JOIN v_hashed b ON a.session_id = b.session_id AND a.scene_type = b.scene_type AND a.face_count = b.face_count AND (b.t_us > a.t_us OR (b.t_us = a.t_us AND a.photo_id < b.photo_id)) AND b.t_us - a.t_us <= 10000000 WHERE coalesce(a.burst_id = b.burst_id, false) OR b.t_us - a.t_us <= 1500000 OR bit_count(xor(a.phash, b.phash)) + (b.t_us - a.t_us) / #5000000.0# * #6.0# <= 12")
def burst_edges(spark, d):
    return joins.burst_edges(view(spark, d, "v_hashed"))


@_query("SELECT a.session_id, a.photo_id AS a, b.photo_id AS b FROM v_hashed a JOIN v_hashed b ON a.session_id = b.session_id AND a.photo_id < b.photo_id AND abs(a.t_us - b.t_us) <= 3000000 AND bit_count(xor(a.phash, b.phash)) <= 2")
def exact_duplicate_pairs(spark, d):
    return joins.exact_duplicate_pairs(view(spark, d, "v_hashed"))


@_query("SELECT a.session_id, a.photo_id AS a, b.photo_id AS b FROM v_hashed a JOIN v_hashed b ON a.session_id = b.session_id AND a.scene_type = b.scene_type AND a.face_count = b.face_count AND a.photo_id <> b.photo_id AND a.k % 20 = 0 AND (b.k % 20 <> 0 OR a.photo_id < b.photo_id) AND bit_count(xor(a.phash, b.phash)) <= 12")
def untimed_edges(spark, d):
    return joins.untimed_edges(view(spark, d, "v_hashed").withColumn("t_us", F.when(F.col("k") % 20 != 0, F.col("t_us"))))


@_query("""WITH RECURSIVE e AS (SELECT a.photo_id AS a, b.photo_id AS b FROM v_hashed a JOIN v_hashed b ON a.session_id = b.session_id AND a.photo_id <> b.photo_id AND abs(a.t_us - b.t_us) <= 3000000 AND bit_count(xor(a.phash, b.phash)) <= 2),
c AS (SELECT photo_id, photo_id AS r FROM v_photos UNION SELECT c.photo_id, e.b FROM c JOIN e ON c.r = e.a) SELECT photo_id, min(r) AS cluster FROM c GROUP BY photo_id""")
def duplicate_components(spark, d):
    p = view(spark, d, "v_hashed")
    return joins.connected_components(p, joins.exact_duplicate_pairs(p))


@_query(HISTORY + """, b AS (SELECT h.photo_id, h.label, h.session_id, h.t_us, s.burst FROM h JOIN v_scored s USING (photo_id)), l AS (SELECT *, row_number() OVER (PARTITION BY session_id, burst ORDER BY t_us, photo_id) AS n FROM b WHERE label IN ('negative', 'unreviewed'))
SELECT w.session_id, w.burst, w.photo_id AS winner, l.photo_id AS loser FROM b w JOIN l ON w.session_id = l.session_id AND w.burst = l.burst AND l.n <= 3 WHERE w.label = 'positive'""")
def burst_pairs(spark, d):
    return joins.burst_pairs(_history(spark, d).select("photo_id", "label").join(_scored(spark, d).select("photo_id", "session_id", "burst", "t_us"), "photo_id"))


@_query("SELECT photo_id, session_id FROM v_photos p WHERE EXISTS (SELECT 1 FROM v_faces f WHERE f.photo_id = p.photo_id AND f.identity_id IN (3, 5))")
def filter_by_identity(spark, d):
    return joins.filter_by_identity(view(spark, d, "v_photos").select("photo_id", "session_id"), view(spark, d, "v_faces"), [3, 5])


@_query("""WITH c AS (SELECT n_name AS city, CAST(n_nationkey AS DOUBLE) * #3.0# - 36 AS la, CAST(n_regionkey AS DOUBLE) * #7.0# - 80 AS lo FROM nation), p AS (SELECT photo_id, CAST(k AS DOUBLE) / #2.0# - 20 AS lat, CAST(photo_id % 30 AS DOUBLE) - 80 AS lon FROM v_photos),
x AS (SELECT photo_id, city, 12742 * asin(sqrt(least(#1.0#, power(sin((radians(la) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * power(sin((radians(lo) - radians(lon)) / 2), 2)))) AS km FROM p, c), r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY km, city) AS r FROM x)
SELECT photo_id, city, round(km, 6) AS km FROM r WHERE r = 1 AND km <= 300""")
def nearest_city(spark, d):
    p = view(spark, d, "v_photos").select("photo_id", (F.col("k") / F.lit(2.0) - 20).alias("lat"), ((F.col("photo_id") % 30).cast("double") - 80).alias("lon"))
    c = spark.table("nation").select(F.col("n_name").alias("city"), (F.col("n_nationkey") * 3.0 - 36).alias("city_lat"), (F.col("n_regionkey") * 7.0 - 80).alias("city_lon"))
    return joins.nearest_city(p, c, 300.0).select("photo_id", "city", _r("km"))


@_query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def knn(spark, d):
    view(spark, d, "v_photos")
    e = spark.table("embeddings")
    return joins.knn(e.where("vec_id % 20 = 0"), e, 10).select("query", "vec_id", "rank", _r("score"))


@_query("""WITH c AS (SELECT photo_id, session_id, k % 5 AS chapter FROM v_photos), m AS (SELECT c.photo_id, c.session_id, CASE WHEN c.photo_id % 9 = 0 AND EXISTS (SELECT 1 FROM c x WHERE x.session_id = c.session_id AND x.chapter = c.photo_id % 7) THEN CAST(c.photo_id % 7 AS INT) ELSE chapter END AS chapter FROM c)
SELECT *, count(*) OVER (PARTITION BY session_id, chapter) AS n FROM m""")
def apply_overrides(spark, d):
    m = view(spark, d, "v_photos").select("photo_id", "session_id", (F.col("k") % 5).alias("chapter"))
    return story.apply_overrides(m, m.where("photo_id % 9 = 0").select("photo_id", (F.col("photo_id") % 7).cast("int").alias("target")))


@_query("WITH v AS (SELECT CASE WHEN (label = 'selected') = (truth = 'selected') THEN 'agree' WHEN truth = 'selected' THEN 'rescued' ELSE 'purged' END AS verdict FROM v_decisions) SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY verdict")
def compare_selections(spark, d):
    return joins.compare_selections(view(spark, d, "v_decisions").withColumns({"old": F.col("label") == "selected", "new": F.col("truth") == "selected"}), "old", "new")


@_query("""WITH v AS (SELECT photo_id, CASE WHEN photo_id % 20 <> 0 THEN CAST(k AS DOUBLE) END AS dev FROM v_files), du AS (SELECT photo_id AS winner, photo_id + 3 AS loser FROM v_files WHERE photo_id % 10 = 0),
j AS (SELECT winner, loser, w.dev AS wd, l.dev AS ld FROM du LEFT JOIN v w ON w.photo_id = winner LEFT JOIN v l ON l.photo_id = loser),
x AS (SELECT winner AS id, 'selected' AS label, coalesce(wd, ld) AS develop FROM j UNION ALL SELECT loser, 'duplicates', ld FROM j)
SELECT DISTINCT f.photo_id, x.label, x.develop FROM x JOIN v_files a ON a.photo_id = x.id JOIN v_files f ON f.stem_path = a.stem_path""")
def duel_rewrite(spark, d):
    f = view(spark, d, "v_files")
    develops = f.where("photo_id % 20 <> 0").select("photo_id", F.col("k").cast("double").alias("develop"))
    return joins.duel_rewrite(f.where("photo_id % 10 = 0").select(F.col("photo_id").alias("winner"), (F.col("photo_id") + 3).alias("loser")), f, develops)


@_query("SELECT label, count(*) AS n FROM v_decisions GROUP BY label")
def counts_by(spark, d):
    return aggs.counts_by(view(spark, d, "v_decisions"), "label")


@_query(HISTORY + "SELECT count(*) AS total, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'ignore') AS ignore, count(*) FILTER (label = 'unreviewed') AS unreviewed, count(*) FILTER (real_crop) AS with_crop, count(*) FILTER (extreme) AS extreme FROM h")
def bootstrap_summary(spark, d):
    return aggs.bootstrap_summary(_history(spark, d))


@_query(HISTORY + "SELECT scene, field, round_even(median(v), 3) AS median, count(*) AS n FROM (SELECT scene, 'exposure' AS field, exposure AS v FROM h WHERE label = 'positive' AND NOT extreme UNION ALL SELECT scene, 'contrast', contrast FROM h WHERE label = 'positive' AND NOT extreme UNION ALL SELECT scene, 'vibrance', vibrance FROM h WHERE label = 'positive' AND NOT extreme) GROUP BY scene, field HAVING count(*) >= 15")
def learn_recipes(spark, d):
    return aggs.learn_recipes(_history(spark, d))


@_query(HISTORY + "SELECT scene, round_even(median(area), 4) AS m_area, round_even(median(dx), 4) AS m_dx, round_even(median(dy), 4) AS m_dy, round_even(median(angle), 4) AS m_angle, count(*) AS n FROM h WHERE label = 'positive' AND real_crop GROUP BY scene HAVING count(*) >= 15")
def learn_crop_style(spark, d):
    return aggs.learn_crop_style(_history(spark, d))


@_query("""WITH o AS (SELECT f.folder_id, lower(f.stem_path) AS stem, arg_min(CASE WHEN d.label = 'selected' THEN 1 ELSE 0 END, (CASE WHEN d.label = 'selected' THEN 0 ELSE 1 END) * 100000000 + f.photo_id) AS s FROM v_files f JOIN v_decisions d USING (photo_id) GROUP BY f.folder_id, lower(f.stem_path))
SELECT folder_id, count(*) AS total, count(*) FILTER (s = 1) AS selected, count(*) FILTER (s = 0) AS discarded FROM o GROUP BY folder_id""")
def project_dashboard(spark, d):
    return aggs.project_dashboard(view(spark, d, "v_files").join(view(spark, d, "v_decisions").select("photo_id", "label"), "photo_id"))


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY created DESC, month DESC) AS r FROM v_sessions), s AS (SELECT event_type, count(*) AS n, sum(kept) AS kept, sum(total) AS total FROM r WHERE r <= 10 GROUP BY event_type),
x AS (SELECT event_type, n, (1 - least(#0.8#, #0.2# * n)) * #0.35# + least(#0.8#, #0.2# * n) * kept / total AS rate FROM s)
SELECT event_type, n, round(rate, 6) AS rate, CAST(greatest(1, round_even(greatest(#0.05#, least(#0.95#, rate - #0.04#)) * 1000, 0)) AS BIGINT) AS low, CAST(greatest(1, round_even(greatest(#0.05#, least(#0.95#, rate + #0.04#)) * 1000, 0)) AS BIGINT) AS high FROM x""")
def retention_estimate(spark, d):
    return aggs.retention_estimate(view(spark, d, "v_sessions"))


@_query("SELECT attribute, count(*) AS total, count(*) FILTER (value = predicted) AS hits, round_even(CAST(count(*) FILTER (value = predicted) AS DOUBLE) / count(*), 3) AS precision FROM v_labels WHERE predicted IS NOT NULL GROUP BY attribute")
def label_agreement(spark, d):
    return aggs.label_agreement(view(spark, d, "v_labels"))


@_query("WITH c AS (SELECT session_id, identity_id, count(DISTINCT photo_id) AS photos, min(photo_id) AS first_photo FROM v_faces GROUP BY session_id, identity_id), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY photos DESC, first_photo, identity_id) AS rank FROM c) SELECT * FROM r WHERE rank <= 3")
def rank_vip(spark, d):
    return aggs.rank_vip(view(spark, d, "v_faces"))


@_query(CHAPTERS + ", m AS (SELECT session_id, chapter, median(score) AS cm FROM c GROUP BY session_id, chapter), g AS (SELECT session_id, median(score) AS gm FROM c GROUP BY session_id) SELECT photo_id, c.session_id, c.chapter, round(score * CASE WHEN cm <= 0.05 OR gm <= 0 THEN #1.0# ELSE greatest(#0.7#, least(#1.4#, gm / cm)) END, 6) AS norm_score FROM c JOIN m ON c.session_id = m.session_id AND c.chapter = m.chapter JOIN g ON c.session_id = g.session_id")
def chapter_pacing(spark, d):
    return aggs.chapter_pacing(windows.chapters_by_gap(_scored(spark, d))).select("photo_id", "session_id", "chapter", _r("norm_score"))


@_query("""WITH c AS (SELECT count(*) FILTER (label = 'selected' AND truth = 'selected') AS tp, count(*) FILTER (label = 'selected' AND truth <> 'selected') AS fp, count(*) FILTER (label <> 'selected' AND truth = 'selected') AS fn, count(*) FILTER (label <> 'selected' AND truth <> 'selected') AS tn FROM v_decisions)
SELECT tp, fp, fn, tn, round(tp * #100.0# / (tp + fp), 6) AS precision, round(tp * #100.0# / (tp + fn), 6) AS recall, round(2 * tp * #100.0# / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) * #100.0# / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def classification_metrics(spark, d):
    return aggs.classification_metrics(view(spark, d, "v_decisions").select((F.col("label") == "selected").alias("p"), (F.col("truth") == "selected").alias("t")), "p", "t")


@_query("WITH p AS (SELECT CAST(k AS DOUBLE) / #300.0# AS margin, photo_id % 3 = 0 AS hit FROM v_photos), b AS (SELECT hit, CASE WHEN margin < 0.01 THEN 0 WHEN margin < 0.02 THEN 0.01 WHEN margin < 0.05 THEN 0.02 WHEN margin < 0.1 THEN 0.05 WHEN margin < 0.15 THEN 0.1 WHEN margin < 0.2 THEN 0.15 WHEN margin < 0.3 THEN 0.2 ELSE 0.3 END::DOUBLE AS bucket FROM p) SELECT bucket, count(*) AS n, round(avg(hit::INT), 6) AS accuracy FROM b GROUP BY bucket")
def margin_buckets(spark, d):
    return aggs.margin_buckets(view(spark, d, "v_photos").select((F.col("k") / F.lit(300.0)).alias("margin"), (F.col("photo_id") % 3 == 0).alias("hit")))


@_query("""SELECT #0.0# + c AS below, count(*) FILTER (CAST(k AS DOUBLE) / #300.0# < c) AS n, CAST(count(*) FILTER (CAST(k AS DOUBLE) / #300.0# < c) AS DOUBLE) / count(*) AS share,
CAST(count(*) FILTER (CAST(k AS DOUBLE) / #300.0# < c AND photo_id % 3 = 0) AS DOUBLE) / count(*) FILTER (CAST(k AS DOUBLE) / #300.0# < c) AS accuracy FROM v_photos, (SELECT unnest([#0.02#, #0.05#, #0.1#, #0.15#, #0.2#]) AS c) GROUP BY c""")
def margin_cumulative(spark, d):
    return aggs.margin_cumulative(view(spark, d, "v_photos").select((F.col("k") / F.lit(300.0)).alias("margin"), (F.col("photo_id") % 3 == 0).alias("hit")))


def _gear(spark, d):
    view(spark, d, "v_photos")
    g = spark.table("lineitem").join(spark.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return g.select(F.col("p_brand").alias("camera"), F.col("p_type").alias("lens"), (F.col("p_size") - 1).cast("double").alias("focal"), F.col("l_quantity").cast("double").alias("iso"), (F.col("l_linenumber") - 1).cast("double").alias("fstop"))


GEAR = "WITH g AS (SELECT p_brand AS camera, p_type AS lens, nullif(CAST(p_size - 1 AS DOUBLE), 0) AS focal, nullif(CAST(l_quantity AS DOUBLE), 0) AS iso, nullif(CAST(l_linenumber - 1 AS DOUBLE), 0) AS fstop FROM lineitem JOIN part ON p_partkey = l_partkey) "
_AT = "list_sort(list({c}) FILTER ({c} IS NOT NULL))[CAST(floor(count({c}) * #{q}#) AS INT) + 1] AS {name}"


@_query(GEAR + "SELECT camera, count(*) AS shots, count(DISTINCT lens) AS lenses, MEAN(focal) AS focal, MEAN(fstop) AS fstop, MEAN(iso) AS iso, " + ", ".join(
    _AT.format(c=c, q=q, name=n) for n, c, q in (("focal_low", "focal", 0.25), ("focal_high", "focal", 0.75), ("iso_q1", "iso", 0.25), ("iso_q2", "iso", 0.5), ("iso_q3", "iso", 0.75))) + " FROM g GROUP BY camera")
def gear_stats(spark, d):
    return aggs.gear_stats(_gear(spark, d))


@_query(GEAR + "SELECT * FROM (SELECT 'camera' AS figure, camera AS value, count(*) AS n FROM g GROUP BY camera ORDER BY n DESC, value LIMIT 4) UNION ALL SELECT * FROM (SELECT 'lens', lens, count(*) AS n FROM g GROUP BY lens ORDER BY n DESC, lens LIMIT 4)")
def gear_top(spark, d):
    return aggs.gear_top(_gear(spark, d))


@_query("""WITH f AS (SELECT photo_id, min(ear) AS ear, max(blink) AS blink, max(gaze_out) AS gaze_out, max(abs(yaw)) AS yaw, avg(smile_score) AS smile, bool_or(smile_score >= 0.5) AS a FROM v_faces WHERE valid GROUP BY photo_id)
SELECT photo_id, round(coalesce(ear, #1.0#), 6) AS ear, round(coalesce(blink, #0.0#), 6) AS blink, round(coalesce(gaze_out, #0.0#), 6) AS gaze_out, round(coalesce(yaw, #0.0#), 6) AS yaw, round(coalesce(smile, #0.0#), 6) AS smile, coalesce(a, false) AS any_smile FROM v_photos LEFT JOIN f USING (photo_id)""")
def face_rollup(spark, d):
    return aggs.face_rollup(view(spark, d, "v_photos").select("photo_id"), view(spark, d, "v_faces"))


@_query("SELECT s.session_id, s.burst, f.identity_id, count(*) AS crops, count(DISTINCT f.photo_id) AS photos FROM v_faces f JOIN v_scored s USING (photo_id) GROUP BY s.session_id, s.burst, f.identity_id")
def burst_faces_by_person(spark, d):
    return aggs.burst_faces_by_person(view(spark, d, "v_faces"), _scored(spark, d))


@_query("WITH c AS (SELECT attribute, value, count(*) AS n FROM v_labels GROUP BY attribute, value), a AS (SELECT attribute, CAST(sum(n) AS BIGINT) AS labels, count(*) AS classes, min(n) AS smallest FROM c GROUP BY attribute) SELECT *, labels >= 60 AND classes >= 2 AND smallest >= 15 AS ready FROM a")
def class_readiness(spark, d):
    return aggs.class_readiness(view(spark, d, "v_labels"))


@_query("WITH x AS (SELECT s.photo_id, s.session_id, s.burst, h.exposure, l.wb_temp, l.wb_tint FROM v_scored s JOIN v_history h USING (photo_id) JOIN v_light l USING (photo_id)), g AS (SELECT session_id, burst, round_even(median(exposure), 2) AS exposure, round_even(median(wb_temp), 1) AS temp, round_even(median(wb_tint), 1) AS tint FROM x GROUP BY session_id, burst HAVING count(*) > 1) SELECT x.session_id, x.burst, photo_id, g.exposure, g.temp, g.tint FROM x JOIN g ON x.session_id = g.session_id AND x.burst = g.burst")
def harmonise_cluster(spark, d):
    x = _scored(spark, d).select("photo_id", "session_id", "burst").join(view(spark, d, "v_history").select("photo_id", "exposure"), "photo_id").join(view(spark, d, "v_light").select("photo_id", "wb_temp", "wb_tint"), "photo_id")
    return aggs.harmonise_cluster(x)


@_query("SELECT session_id, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY session_id), 6) AS share FROM v_decisions GROUP BY session_id, label")
def selection_summary(spark, d):
    return aggs.selection_summary(view(spark, d, "v_decisions"))


@_query("SELECT session_id, count(*) AS total, count(*) FILTER (label = 'selected') AS selected, count(*) FILTER (label = 'alternative') AS alternatives FROM v_decisions GROUP BY session_id")
def run_stats(spark, d):
    return aggs.run_stats(view(spark, d, "v_decisions"))


@_query("WITH p AS (SELECT session_id, greatest(#10.0#, quantile_cont(blur_score, 0.85)) AS p FROM v_photos GROUP BY session_id) SELECT session_id, round(p, 6) AS sharp, round(p * #0.2#, 6) AS reject_below FROM p")
def session_sharpness_floor(spark, d):
    return aggs.session_sharpness_floor(view(spark, d, "v_photos"))


@_query("SELECT rating, pick, count(*) AS n FROM v_history GROUP BY rating, pick")
def choice_distribution(spark, d):
    return aggs.choice_distribution(view(spark, d, "v_history"))


@_query("SELECT folder_id, count(DISTINCT lower(stem_path)) AS n FROM v_files GROUP BY folder_id")
def session_estimate_count(spark, d):
    return aggs.session_estimate_count(view(spark, d, "v_files"))


@_query("""WITH x AS (SELECT scene, (crop_right - crop_left) * (crop_bottom - crop_top) AS re, greatest(#0.0#, least(crop_right, #0.9#) - greatest(crop_left, #0.1#)) * greatest(#0.0#, least(crop_bottom, #0.9#) - greatest(crop_top, #0.1#)) AS i FROM v_history)
SELECT scene, count(*) AS n, MEAN(i / (re + #0.64# - i)) AS proposed, MEAN(re) AS full_frame, median(i / (re + #0.64# - i)) AS median_proposed FROM x GROUP BY scene""")
def crop_iou_report(spark, d):
    return aggs.crop_iou_report(view(spark, d, "v_history"))


@_query("SELECT scene, count(*) AS n, MEAN(abs(exposure)) AS mae_none, MEAN(abs(exposure - #0.3#)) AS mae_bias FROM v_history GROUP BY scene")
def exposure_rule_report(spark, d):
    return aggs.exposure_rule_report(view(spark, d, "v_history"))


@_query("WITH h AS (SELECT crop_angle AS a, CAST(photo_id % 7 - 3 AS DOUBLE) AS p FROM v_history) SELECT count(*) AS n, MEAN(abs(a)) AS mae_none, MEAN(abs(a - p)) AS mae_same, MEAN(abs(a + p)) AS mae_flipped, median(abs(a - p)) AS median_same, MEAN(CASE WHEN abs(a) < 0.1 AND abs(p) > 1 THEN #1.0# ELSE #0.0# END) AS false_corrections FROM h")
def straighten_report(spark, d):
    return aggs.straighten_report(view(spark, d, "v_history").withColumn("proposed", (F.col("photo_id") % 7 - 3).cast("double")))


@_query("SELECT session_id, count(*) AS photos, count(*) FILTER (blur_score IS NULL) AS no_blur, count(*) FILTER (face_count = 0) AS no_faces, round(avg(CAST(face_count AS DOUBLE)), 6) AS mean_faces FROM v_photos GROUP BY session_id")
def analysis_audit(spark, d):
    return aggs.analysis_audit(view(spark, d, "v_photos"))


@_query("""WITH s AS (SELECT l_orderkey AS grp, CAST(l_discount AS DOUBLE) * 100 - 5 AS angle, CAST(l_quantity AS DOUBLE) AS weight FROM lineitem), n AS (SELECT *, sum(weight) OVER (PARTITION BY grp ORDER BY angle, weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(weight) OVER (PARTITION BY grp) AS al FROM s WHERE abs(angle) <= 6),
m AS (SELECT grp, min(angle) AS med FROM n WHERE run * 2 >= al GROUP BY grp), t AS (SELECT n.grp, med, sum(angle * weight) / sum(weight) AS tilt FROM n JOIN m USING (grp) WHERE abs(angle - med) <= 1.5 GROUP BY n.grp, med) SELECT grp, round(med, 6) AS median, round(CASE WHEN abs(tilt) < 0.2 THEN #0.0# ELSE tilt END, 6) AS tilt FROM t""")
def weighted_median_tilt(spark, d):
    view(spark, d, "v_photos")
    return aggs.weighted_median_tilt(spark.table("lineitem").select(F.col("l_orderkey").alias("grp"), (F.col("l_discount").cast("double") * 100 - 5).alias("angle"), F.col("l_quantity").cast("double").alias("weight")))


@_query(HISTORY + "SELECT count(*) FILTER (label = 'positive') AS positives, count(*) FILTER (label = 'negative') AS negatives, count(DISTINCT scene) AS scenes, round(avg(CASE WHEN real_crop THEN area * 100 END), 6) AS mean_retained FROM h")
def learning_summary(spark, d):
    return aggs.learning_summary(_history(spark, d))


@_query("""WITH s AS (SELECT session_id, t_us, (t_us - lag(t_us) OVER (PARTITION BY session_id ORDER BY t_us, photo_id)) / #1000000.0# AS step FROM v_photos), m AS (SELECT session_id, count(t_us) AS n, median(CASE WHEN step < 60 THEN step END) AS m FROM s GROUP BY session_id)
SELECT session_id, CASE WHEN n > 10 AND m < 1.5 THEN #2.0# WHEN n > 10 AND m > 4 THEN #6.0# ELSE #5.0# END AS gap, CASE WHEN n > 10 AND m < 1.5 THEN #10.0# WHEN n > 10 AND m > 4 THEN #14.0# ELSE #12.0# END AS eps FROM m""")
def adaptive_gap(spark, d):
    return windows.adaptive_gap(view(spark, d, "v_photos"))


@_query("SELECT photo_id, session_id, burst FROM v_scored")
def gap_bursts(spark, d):
    return _scored(spark, d).select("photo_id", "session_id", "burst")


@_query(CHAPTERS + "SELECT photo_id, session_id, chapter FROM c")
def chapters_by_gap(spark, d):
    return windows.chapters_by_gap(view(spark, d, "v_photos")).select("photo_id", "session_id", "chapter")


@_query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id, burst ORDER BY #0.6# * blur_score + #40.0# * aesthetic_score DESC, photo_id) AS r FROM v_scored) SELECT photo_id, session_id, burst FROM r WHERE r = 1")
def base_representative(spark, d):
    return windows.base_representative(_scored(spark, d)).select("photo_id", "session_id", "burst")


@_query("""WITH r AS (SELECT *, height > width AS tall, row_number() OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) AS r, first_value(height > width) OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) AS tt, row_number() OVER (PARTITION BY session_id, burst, height > width ORDER BY score DESC, photo_id) AS o FROM v_scored)
SELECT photo_id, session_id, burst, CASE WHEN r = 1 THEN 'winner' ELSE 'alternate' END AS role FROM r WHERE r = 1 OR (tall <> tt AND o = 1 AND score >= 0.42)""")
def orientation_alternates(spark, d):
    return windows.orientation_alternates(_scored(spark, d)).select("photo_id", "session_id", "burst", "role")


@_query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, photo_id) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM v_scored) SELECT photo_id, session_id FROM r WHERE r <= greatest(1, round_even(n * #0.1#, 0))")
def highlights(spark, d):
    return windows.highlights(_scored(spark, d)).select("photo_id", "session_id")


@_query("""WITH a AS (SELECT *, k % 3 <> 0 AS sel, k % 10 = 0 AS prot, row_number() OVER (PARTITION BY session_id, burst ORDER BY score DESC, photo_id) = 1 AS win FROM v_scored), b AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, sum(sel::INT) OVER (PARTITION BY session_id) AS chosen, sum(sel::INT) OVER (PARTITION BY session_id, burst) AS mates FROM a),
c AS (SELECT *, round_even(n * #0.35#, 0) AS goal FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, photo_id DESC) AS r FROM c WHERE sel AND NOT win AND NOT prot AND mates >= 2 AND chosen > round_even(goal * #1.05#, 0)) SELECT photo_id, session_id FROM e WHERE r <= chosen - goal""")
def trim_to_target(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id", "burst").orderBy(F.col("score").desc(), "photo_id")
    s = _scored(spark, d).withColumns({"selected": F.col("k") % 3 != 0, "protected": F.col("k") % 10 == 0, "winner": F.row_number().over(w) == 1})
    return windows.trim_to_target(s)


PRUNED = RANKED + ", w AS (SELECT *, CASE WHEN n >= 8 AND max(CASE WHEN r = 2 THEN score END) OVER (PARTITION BY session_id, burst) >= 0.75 THEN 2 ELSE 1 END AS w, CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS a FROM r), p AS (SELECT photo_id, session_id, burst, score, CASE WHEN r <= w THEN 'winner' WHEN r <= w + a THEN 'alternate' ELSE 'rejected' END AS role FROM w) "


@_query(PRUNED + "SELECT photo_id, session_id, burst, role FROM p")
def prune_burst(spark, d):
    return windows.prune_burst(_scored(spark, d)).select("photo_id", "session_id", "burst", "role")


@_query(PRUNED + """, o AS (SELECT p.*, s.height > s.width AS tall, first_value(s.height > s.width) OVER (PARTITION BY p.session_id, p.burst ORDER BY role = 'winner' DESC, p.score DESC, p.photo_id) AS won FROM p JOIN v_scored s USING (photo_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE role WHEN 'winner' THEN 0 WHEN 'alternate' THEN 1 ELSE 2 END, CASE WHEN role = 'alternate' AND tall <> won THEN 0 ELSE 1 END, score DESC, photo_id) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM o)
SELECT photo_id, session_id, r, r <= 55 AS hero FROM q WHERE r <= floor(n * #0.35#)""")
def quota_fill(spark, d):
    return windows.quota_fill(windows.prune_burst(_scored(spark, d))).select("photo_id", "session_id", "r", "hero")


@_query(RANKED + ", b AS (SELECT *, max(score) OVER (PARTITION BY session_id, burst) AS best, CAST(k % 10 AS DOUBLE) AS focus, CAST(k % 7 AS DOUBLE) / #6.0# - #0.1# AS eye FROM r) SELECT photo_id, session_id, burst, CASE WHEN focus < 3 OR eye < 0 THEN 'rejected' WHEN r = 1 THEN 'top_pick' WHEN score >= best * #0.9# AND eye >= 0.5 THEN 'alternate' ELSE 'duplicate' END AS lab_class FROM b")
def lab_classes(spark, d):
    return windows.lab_classes(_scored(spark, d).withColumns({"focus": (F.col("k") % 10).cast("double"), "eye": F.col("k") % 7 / F.lit(6.0) - F.lit(0.1)})).select("photo_id", "session_id", "burst", "lab_class")


@_query(CHAPTERS + ", r AS (SELECT *, row_number() OVER (PARTITION BY session_id, chapter ORDER BY t_us, photo_id) AS r, count(*) OVER (PARTITION BY session_id, chapter) AS n, min(t_us) OVER (PARTITION BY session_id, chapter) AS start_us, max(t_us) OVER (PARTITION BY session_id, chapter) AS end_us FROM c) SELECT session_id, chapter, photo_id, start_us, end_us, n FROM r WHERE r = floor(n / 2) + 1")
def chapter_medoid(spark, d):
    return windows.chapter_medoid(windows.chapters_by_gap(view(spark, d, "v_photos")))


@_query(CHAPTERS + "SELECT photo_id, session_id, chapter, lag(chapter) OVER w IS NULL OR lag(chapter) OVER w <> chapter AS header FROM c WINDOW w AS (PARTITION BY session_id ORDER BY t_us, photo_id)")
def chapter_breaks(spark, d):
    return windows.chapter_breaks(windows.chapters_by_gap(view(spark, d, "v_photos"))).select("photo_id", "session_id", "chapter", "header")


@_query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, photo_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS m FROM v_scored), s AS (SELECT DISTINCT session_id, CAST(floor(j * m / 30) AS BIGINT) AS i FROM r, range(30) t(j)) SELECT photo_id, r.session_id, r.i FROM r JOIN s ON r.session_id = s.session_id AND r.i = s.i")
def even_stride_sample(spark, d):
    return windows.even_stride_sample(_scored(spark, d)).select("photo_id", "session_id", "i")


@_query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY created DESC, month DESC) AS r FROM v_sessions) SELECT event_type, total, CAST(kept AS BIGINT) AS kept, r FROM r WHERE r <= 10")
def last_n_sessions(spark, d):
    return windows.last_n_sessions(view(spark, d, "v_sessions")).select("event_type", "total", F.col("kept").cast("long").alias("kept"), "r")


@_query("""WITH r AS (SELECT *, count(*) OVER (PARTITION BY session_id, burst) AS n, row_number() OVER (PARTITION BY session_id, burst ORDER BY #0.6# * blur_score + #40.0# * aesthetic_score DESC, photo_id) = 1 AS rep FROM v_scored) SELECT photo_id, session_id, burst, row_number() OVER (PARTITION BY session_id, burst ORDER BY rep DESC, score DESC, photo_id) AS place FROM r WHERE n > 1""")
def duel_queue(spark, d):
    return windows.duel_queue(_scored(spark, d)).select("photo_id", "session_id", "burst", "place")


@_query("SELECT f.photo_id, f.face_index, round(f.confidence, 6) AS confidence FROM v_faces f WHERE f.valid AND f.w >= 40 AND NOT EXISTS (SELECT 1 FROM v_labels l WHERE l.photo_id = f.photo_id) ORDER BY f.confidence, f.photo_id, f.face_index LIMIT 50")
def calibration_queue(spark, d):
    return windows.calibration_queue(view(spark, d, "v_faces"), view(spark, d, "v_labels")).select("photo_id", "face_index", _r("confidence"))


@_query("WITH c AS (SELECT *, k % 4 = 0 AS closed FROM v_photos), o AS (SELECT *, sum((NOT closed)::INT) OVER (PARTITION BY folder_id) AS op FROM c), r AS (SELECT photo_id, folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY aesthetic_score DESC, photo_id) AS r FROM o WHERE op < 2 OR NOT closed) SELECT * FROM r WHERE r <= 3")
def folder_finalists(spark, d):
    return windows.folder_finalists(view(spark, d, "v_photos").withColumn("closed", F.col("k") % 4 == 0)).select("photo_id", "folder_id", "r")


@_query("""WITH g AS (SELECT stem, min(CASE WHEN ext = 'jpg' THEN photo_id END) AS jpg, min(CASE WHEN ext = 'cr2' THEN photo_id END) AS raw FROM v_files GROUP BY stem) SELECT f.stem, f.photo_id, CASE WHEN jpg IS NOT NULL AND raw IS NOT NULL THEN raw END AS linked_raw FROM v_files f JOIN g USING (stem) WHERE jpg IS NULL OR raw IS NULL OR f.photo_id = jpg""")
def pair_raw_jpeg(spark, d):
    return tables.pair_raw_jpeg(view(spark, d, "v_files"))


@_query("SELECT photo_id % 200 AS path_id, max(photo_id) AS seq, arg_max(k, photo_id) AS k FROM v_photos GROUP BY photo_id % 200")
def upsert(spark, d):
    p = view(spark, d, "v_photos").select((F.col("photo_id") % 200).alias("path_id"), F.col("photo_id").alias("seq"), "k")
    return tables.upsert(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), ["path_id"], "seq")


@_query("SELECT photo_id FROM v_photos WHERE NOT (photo_id % 3 <> 0 AND k % 5 <> 0 AND NOT (face_count > 0 AND k % 7 = 0))")
def incremental_worklist(spark, d):
    p = view(spark, d, "v_photos").withColumns({"path": F.col("photo_id").cast("string"), "mtime": F.col("photo_id")})
    cache = p.select("path", F.when(F.col("photo_id") % 3 != 0, F.col("mtime")).otherwise(-1).alias("mtime"), F.when(F.col("k") % 5 != 0, 10).otherwise(9).alias("version"), "face_count", F.when(F.col("k") % 7 != 0, 1).otherwise(0).alias("n_attrs"))
    return tables.incremental_worklist(p.select("photo_id", "path", "mtime"), cache).select("photo_id")


@_query("WITH x AS (SELECT CASE WHEN label IS NULL THEN 'skipped' WHEN k % 6 > 3 THEN 'skipped' ELSE 'written' END AS outcome FROM v_decisions) SELECT outcome, count(*) AS n FROM x GROUP BY outcome")
def export_outcomes(spark, d):
    dec = view(spark, d, "v_decisions").withColumn("error", F.lit(False))
    mapping = spark.createDataFrame([("selected", 4), ("alternative", 2), ("closed_eyes", 1), ("duplicates", 1)], "label string, stars int")
    existing = dec.select("photo_id", F.when(F.col("k") % 6 > 3, 3).otherwise(0).alias("rating"))
    return tables.export_outcomes(dec.drop("k"), mapping, existing).groupBy("outcome").agg(F.count("*").alias("n"))


@_query("SELECT photo_id FROM v_decisions WHERE label = 'selected' UNION SELECT photo_id FROM v_decisions WHERE truth = 'selected'")
def union_selection(spark, d):
    x = view(spark, d, "v_decisions")
    return x.where("label = 'selected'").select("photo_id").union(x.where("truth = 'selected'").select("photo_id")).distinct()


@_query("SELECT photo_id FROM v_decisions WHERE label = 'selected' INTERSECT SELECT photo_id FROM v_decisions WHERE truth = 'selected'")
def overlap(spark, d):
    x = view(spark, d, "v_decisions")
    return x.where("label = 'selected'").select("photo_id").intersect(x.where("truth = 'selected'").select("photo_id"))


@_query("SELECT photo_id FROM v_decisions WHERE truth = 'selected' EXCEPT SELECT photo_id FROM v_decisions WHERE label = 'selected'")
def missing(spark, d):
    x = view(spark, d, "v_decisions")
    return x.where("truth = 'selected'").select("photo_id").subtract(x.where("label = 'selected'").select("photo_id"))


@_query()
def resolve_duplicates(spark, d):
    p = view(spark, d, "v_hashed")
    return sessions.resolve_duplicates(p.select("photo_id", "session_id", "t_us"), joins.exact_duplicate_pairs(p))


@_query("""WITH RECURSIVE o AS (SELECT session_id, list({'id': photo_id, 'h': phash} ORDER BY t_us, photo_id) AS rest FROM v_hashed GROUP BY session_id),
s AS (SELECT session_id, -1::BIGINT AS cluster, rest, rest[1:0] AS own FROM o
UNION ALL SELECT session_id, cluster + 1, list_filter(rest, lambda x: bit_count(xor(x.h, rest[1].h)) > 10), list_filter(rest, lambda x: bit_count(xor(x.h, rest[1].h)) <= 10) FROM s WHERE len(rest) > 0)
SELECT session_id, m.id AS photo_id, cluster FROM (SELECT session_id, cluster, unnest(own) AS m FROM s)""")
def leader_clusters(spark, d):
    return sessions.leader_clusters(view(spark, d, "v_hashed"))


@_query()
def assign_identities(spark, d):
    return sessions.assign_identities(face_vectors(spark, d))


@_query()
def discover_scenes(spark, d):
    view(spark, d, "v_photos")
    return learn.discover_scenes(spark.table("embeddings"))[0]


@_query()
def taste_scores(spark, d):
    view(spark, d, "v_photos")
    e = spark.table("embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    low = e.agg(F.min("label")).first()[0]
    return learn.taste_score(e, learn.taste_fit(e.select("vec", F.when(F.col("label") == low, 1).otherwise(-1).alias("y")))).select("vec_id", _r("taste"))


@_query("SELECT CAST(time_bucket(INTERVAL 1 hour, ts) AS TIMESTAMP) AS start, event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean_duration FROM events GROUP BY 1, 2")
def telemetry_windows(spark, d):
    view(spark, d, "v_photos")
    e = spark.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("value").alias("duration"))
    return streams.telemetry_stream(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", _r("mean_duration"))
