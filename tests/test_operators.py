"""Literal cases and properties of operators that SQL can't express."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fotolith import registry, registry_more
from fotolith.functions.session import register
from fotolith.operators import develop, joins, learn, ranking, rules, sessions, story, windows
from fotolith.sources import tables
from fotolith.streaming import streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rating_convention(spark):
    df = spark.createDataFrame([(5, -1), (4, 0), (3, 0), (1, 0), (0, 0)], "rating int, pick int")
    assert [r[0] for r in df.select(rules.classify_history(F.col("rating"), F.col("pick"))).collect()] == ["negative", "ignore", "positive", "negative", "unreviewed"]


def test_settings_blob_keeps_last_of_a_repeated_key(spark):
    df = spark.createDataFrame([("a = 1, Exposure = -0.5, b = x, Exposure = 2",), (None,)], "t string")
    got = [r[0] for r in df.select(tables.parse_settings_blob(F.col("t"), ["Exposure", "Contrast"])).collect()]
    assert got == [{"Exposure": 2.0}, {}]


def test_capture_time_formats(spark):
    df = spark.createDataFrame([("2024:05:01 10:00:00",), ("2024-05-01 10:00:00",), ("soon",)], "t string")
    got = [r[0] for r in df.select(rules.parse_capture_time(F.col("t"))).collect()]
    assert got[0] == got[1] == dt.datetime(2024, 5, 1, 10) and got[2] is None


def test_gates_never_empty_a_burst(spark):
    from fotolith.fixtures import view

    gates = windows.technical_gates(view(spark, SF, "v_judged"), spark.table("v_gate_faces"))
    per = gates.groupBy("session_id", "burst").agg(F.count_if("alive").alias("left"), F.count("*").alias("n"), F.count_if(~F.col("alive") & F.col("reason").isNull()).alias("silent"))
    assert per.where("left = 0 or silent > 0").count() == 0
    assert per.where("left < n").count() > 0


#: (lum, faces as (w, ear, blink, gaze_out, yaw, smile, sharpness)) of a burst's photos, what the gates say of each.
BIG, SMALL = 100, 40
GATE_CASES = {
    "one photo is never dropped": ([(0.5, [(BIG, 0.1, 0.9, 0.9, 0.9, 0.0, 1.0)])], {}, [None]),
    "eyes closed, another's open": ([(0.5, [(BIG, 0.1, 0.0, 0.0, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0)])], {}, ["closed_eyes", None]),
    "all closed: none goes": ([(0.5, [(BIG, 0.1, 0.0, 0.0, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.12, 0.0, 0.0, 0.0, 0.9, 50.0)])], {}, [None, None]),
    "limits themselves pass": ([(0.5, [(BIG, 0.18, 0.5, 0.35, 0.5, 0.35, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0)])], {}, [None, None]),
    "blink over the limit": ([(0.5, [(BIG, 0.3, 0.51, 0.0, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0)])], {}, ["closed_eyes", None]),
    "leading face decides before a small one": ([(0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0), (SMALL, 0.1, 0.0, 0.0, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.1, 0.0, 0.0, 0.0, 0.9, 50.0), (SMALL, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0)])], {}, [None, "closed_eyes"]),
    "small faces settle what is even": ([(0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0), (SMALL, 0.1, 0.0, 0.0, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0), (SMALL, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0)])], {}, ["closed_eyes", None]),
    "gaze": ([(0.5, [(BIG, 0.3, 0.0, 0.4, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.1, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.1, -0.6, 0.9, 50.0)])], {}, ["looking_away", None, "looking_away"]),
    "first reason stays": ([(0.5, [(BIG, 0.1, 0.0, 0.9, 0.0, 0.0, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.1, 0.0, 0.9, 50.0)])], {}, ["closed_eyes", None]),
    "smile of the leading face": ([(0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.1, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.4, 50.0)])], {}, ["vip_no_smile", None]),
    "relaxed about smiles": ([(0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.1, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.4, 50.0)])], {"relaxed": True}, [None, None]),
    "least sharp face against the median": ([(0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 90.0), (BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 20.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 60.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0)])], {}, ["soft_face", None, None]),
    "misfired flash": ([(0.03, []), (0.3, []), (0.28, [])], {}, ["flash_misfire", None, None]),
    "dark bursts have no misfires": ([(0.01, []), (0.08, []), (0.07, [])], {}, [None, None, None]),
    "known people lead": ([(0.5, [(BIG, 0.1, 0.0, 0.0, 0.0, 0.9, 50.0), (SMALL, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0)]), (0.5, [(BIG, 0.3, 0.0, 0.0, 0.0, 0.9, 50.0), (SMALL, 0.1, 0.0, 0.0, 0.0, 0.9, 50.0)])], {"vip_ids": [2]}, [None, "closed_eyes"]),
}


def test_gate_cases(spark):
    photos, faces = [], []
    for b, (shots, _, _) in enumerate(GATE_CASES.values()):
        for p, (lum, own) in enumerate(shots):
            photos.append((100 * b + p, "s", b, lum))
            faces += [(100 * b + p, i, *f[1:], f[0], True, i) for i, f in enumerate(own, 1)]
    photos = spark.createDataFrame(photos, "photo_id long, session_id string, burst long, lum double")
    faces = spark.createDataFrame(faces, "photo_id long, face_index int, ear double, blink double, gaze_out double, yaw double, smile_score double, sharpness double, w int, valid boolean, identity_id int")
    for given in ({}, {"relaxed": True}, {"vip_ids": [2]}):
        got = {r["photo_id"]: r["reason"] for r in windows.technical_gates(photos, faces, **given).collect()}
        for b, (name, (shots, options, want)) in enumerate(GATE_CASES.items()):
            if options == given:
                assert [got[100 * b + p] for p in range(len(shots))] == want, name


def test_half_even_rounds_doubles(spark):
    values = [0.575, 0.565, 1.005, -0.125, 0.125, 0.375, 2.5, 3.5, 0.1 + 0.2, *[i / 80 for i in range(-40, 200, 7)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(rules.half_even(F.col("v"), 2), rules.half_even(F.col("v"), 1), rules.half_even(F.col("v"))).collect()]
    assert got == [(round(v * 100) / 100, round(v * 10) / 10, float(round(v))) for v in values] and got[0][0] == round(0.575, 2)


def test_tiebreak_is_a_round_robin(spark):
    """Against games played one after the other."""
    import math
    import random

    rng = random.Random(4)
    data = [("s", b, 10 * b + i, round(0.5 + rng.random() * 0.03, 3), rng.randrange(3), rng.randrange(3), rng.randrange(3), rng.choice([None, 0.0, 80.0, 300.0]), rng.choice([0.0, 0.4, 0.9])) for b in range(60) for i in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(data, "session_id string, burst long, photo_id long, score double, closed int, smiling int, away int, blur_score double, aesthetic_score double")
    want = []
    for b in range(60):
        own = sorted((r for r in data if r[1] == b), key=lambda r: (-r[3], r[2]))
        if len(own) < 2 or round((own[0][3] - own[1][3]) * 1e4) / 1e4 > 0.025:
            continue
        own, elo = own[:3], {r[2]: 1500.0 for r in own[:3]}
        for i, x in enumerate(own):
            for y in own[i + 1:]:
                p, q = x[7] or 0.0, y[7] or 0.0
                adv = (y[4] - x[4]) * 1.8 + (x[5] - y[5]) * 1.2 + (y[6] - x[6]) * 0.8 + (p - q) / max(p, q, 1.0) * 1.5 + ((x[8] or 0.5) - (y[8] or 0.5)) * 2
                gain = 32 * (1 / (1 + math.exp(-max(-20, min(20, adv)))) - 1 / (1 + 10 ** ((elo[y[2]] - elo[x[2]]) / 400)))
                elo[x[2]] += gain
                elo[y[2]] -= gain
        best = max(own, key=lambda r: elo[r[2]])[2]
        want.append((b, best, round(elo[best], 6)))
    got = ranking.elo_tiebreak(df).select("burst", "photo_id", F.round("elo", 6)).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_storyline_against_one_fold(spark):
    """Pauses and looks in one pass over each session, with numpy."""
    import numpy as np

    photos = registry_more.story_photos(spark, SF).cache()
    got = {r["photo_id"]: r["segment"] for r in story.storyline_segments(photos).collect()}
    cuts = {"look": 0, "pause": 0}
    for s in {r["session_id"] for r in photos.collect()}:
        own = sorted((r for r in photos.collect() if r["session_id"] == s and r["t_us"] is not None), key=lambda r: (r["t_us"], r["photo_id"]))
        segments, recent = [[own[0]]], [own[0]["vec"]] if own[0]["vec"] else []
        for was, r in zip(own, own[1:], strict=False):
            gap, cut = r["t_us"] - was["t_us"], None
            if gap > 300e6:
                cut = "pause"
            elif len(segments[-1]) >= 5 and r["vec"] and recent:
                mean = np.mean(recent[-3:], axis=0)
                change = 1 - float(np.dot(r["vec"], mean / np.linalg.norm(mean)))
                if change > 0.18 or len(segments[-1]) >= 10 and r["t_us"] - segments[-1][0]["t_us"] >= 180e6 and change > 0.12:
                    cut = "look"
            if cut:
                cuts[cut] += 1
                segments.append([])
                recent = []
            segments[-1].append(r)
            if r["vec"]:
                recent.append(r["vec"])
        for i, seg in enumerate(segments, 1):
            main = sum(r["scene_type"] != "detail" for r in seg)
            for r in seg:
                assert got[r["photo_id"]] == (0 if main >= 8 and r["scene_type"] == "detail" else i)
    assert cuts["look"] > 10


def test_duplicates_against_the_plain_double_loop(spark):
    import random

    rng = random.Random(2)
    data = [("s%d" % (i % 3), i, None if rng.random() < 0.2 else rng.randrange(0, 9_000_000), rng.choice([0, 1, 3, 7, 1 << 40])) for i in range(90)]
    photos = spark.createDataFrame(data, "session_id string, photo_id long, t_us long, phash long")
    pairs = joins.exact_duplicate_pairs(photos)
    want_pairs, want = set(), set()
    for s in ("s0", "s1", "s2"):
        own = sorted((r for r in data if r[0] == s), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        of = {}
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                if bin(a[3] ^ b[3]).count("1") <= 2 and (a[2] is None or b[2] is None or b[2] - a[2] <= 3_000_000):
                    want_pairs.add((min(a[1], b[1]), max(a[1], b[1])))
            if a[1] in of:
                continue
            for b in own[i + 1:]:
                if a[2] is not None and b[2] is not None and b[2] - a[2] > 3_000_000:
                    break
                if b[1] not in of and bin(a[3] ^ b[3]).count("1") <= 2:
                    of[b[1]] = a[1]
        want |= set(of.items())
    assert set(rows(pairs.select("a", "b"))) == want_pairs
    assert set(rows(sessions.resolve_duplicates(photos.select("photo_id", "session_id", "t_us"), pairs).select("photo_id", "master"))) == want


def test_people_are_told_apart(spark):
    """Each person's faces are one identity and no other's are in it."""
    f = registry.face_vectors(spark, SF)
    got = sessions.assign_identities(f).join(f.select("photo_id", "face_index", F.col("identity_id").alias("who")), ["photo_id", "face_index"])
    per = got.groupBy("session_id", "identity_id").agg(F.countDistinct("who").alias("people"))
    assert per.where("people > 1").count() == 0 and got.where("identity_id < 0").count() == 0


def test_light_session_chain(spark):
    """Sessions without votes take the one before over, those at the front the first that has its own."""
    data = [("e", ls, 10 * ls + i, True, wb, wb / 2, 0.2, 0.0, None) for ls, n, wb in ((0, 2, 3.0), (1, 5, 4.0), (2, 1, 9.0), (3, 0, 0.0), (4, 6, -6.0)) for i in range(n)] + [("f", 0, 90, True, 2.0, 1.0, 0.2, 0.0, None), ("f", 1, 91, True, 8.0, 1.0, 0.2, 0.0, None)]
    df = spark.createDataFrame(data, "session_id string, light_session long, photo_id long, has_people boolean, wb_temp double, wb_tint double, global_lum double, clip_frac double, skin_lum double")
    got = {(r["session_id"], r["light_session"]): r["temp"] for r in develop.pre_edit_values(df).collect()}
    assert got == {("e", 0): 4.0, ("e", 1): 4.0, ("e", 2): 4.0, ("e", 4): -6.0, ("f", 0): 2.0, ("f", 1): 2.0}


def test_preferences_once_over_batches(spark, tmp_path):
    schema = "event_id long, winner long, loser long"
    for n, events in enumerate(([(1, 10, 11), (1, 10, 11), (2, 12, 13)], [(2, 12, 13), (3, 14, 15)])):
        spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
        q = streams.preference_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("event_id", "photo_id", "y")) == [(1, 10, 1), (1, 11, -1), (2, 12, 1), (2, 13, -1), (3, 14, 1), (3, 15, -1)]


def test_greedy_duplicates_and_leaders(spark):
    day = dt.date(2024, 1, 1)
    photos = spark.createDataFrame([(day, 1, 0, 0), (day, 2, 1, 1), (day, 3, 2, 3), (day, 4, 9, -1)], "session_id date, photo_id long, t_us long, phash long")
    pairs = joins.exact_duplicate_pairs(photos)
    assert rows(pairs.select("a", "b")) == [(1, 2), (1, 3), (2, 3)]
    assert rows(sessions.resolve_duplicates(photos, pairs).select("photo_id", "master")) == [(2, 1), (3, 1)]
    assert rows(sessions.leader_clusters(photos, 2).select("photo_id", "cluster")) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    assert rows(joins.connected_components(photos, pairs)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_light_session_needs_a_run(spark):
    day = dt.date(2024, 1, 1)
    lum = [0.18] * 6 + [0.9] * 2 + [0.18] * 3 + [0.9] * 5
    photos = spark.createDataFrame([(day, i, i, x, 0.0, 0.0) for i, x in enumerate(lum)], "session_id date, photo_id long, t_us long, global_lum double, wb_temp double, wb_tint double")
    got = [r["light_session"] for r in sessions.light_sessions(photos).orderBy("photo_id").collect()]
    assert got == [0] * 11 + [1] * 5


def test_neighbour_wb_takes_the_nearer_then_the_earlier(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 1, None), ("s", 2, 3.0), ("s", 3, None), ("s", 4, None)], "g string, i int, wb double")
    assert [r["wb_filled"] for r in joins.nearest_with_votes(df, "wb", "i", "g").orderBy("i").collect()] == [1.0, 1.0, 3.0, 3.0, 3.0]


def test_sidecars(spark):
    x = "<x:xmpmeta xmlns:x='a' xmlns:rdf='r' xmlns:xmp='p'><rdf:RDF><rdf:Description xmp:Rating='3' xmp:Label='Red'>%s</rdf:Description></rdf:RDF></x:xmpmeta>"
    df = spark.createDataFrame([(1, x % ""), (2, x % "<xmp:Rating>5</xmp:Rating><xmp:Label>Blue</xmp:Label>")], "id int, packet string")
    assert rows(tables.sidecar_harvest(df).select("id", "rating", "label")) == [(1, 3, "Red"), (2, 5, "Blue")]


def test_restore_and_tolerant_decode(spark):
    current = spark.createDataFrame([("a", "old"), ("b", None)], "path string, packet string")
    state = tables.capture_state(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), current)
    assert rows(tables.restore_state(state, current).select("path", "outcome")) == [("a", "restored"), ("b", "cleared"), ("c", "failed")]
    df = spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "j string")
    assert [r["k"] for r in tables.tolerant_decode(df, "j", "k int").collect()] == [1]


def test_taste_separates(spark):
    data = [([1.0 + i / 100, 0.0], 1) for i in range(40)] + [([-1.0 - i / 100, 0.0], -1) for i in range(40)]
    df = spark.createDataFrame(data, "vec array<double>, y int")
    s = learn.taste_score(df, learn.taste_fit(df)).collect()
    assert all((r["taste"] > 0.6) == (r["y"] > 0) for r in s)
    assert learn.taste_fit(df.limit(10)).mean is None


def test_registered_functions(spark):
    register(spark)
    assert spark.sql("SELECT hamming64(5, 6), round(cosine(array(1D, 0D), array(1D, 1D)), 4), round(haversine_km(0D, 0D, 0D, 1D), 1), iou(0D, 0D, 2D, 2D, 1D, 1D, 3D, 3D)").first()[:3] == (2, 0.7071, 111.2)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, "s", t0 + dt.timedelta(seconds=s), "p%d" % (i % 2), i if i % 3 else None, "view", float(i)) for i, s in enumerate([0, 1, 2, 30, 31, 90, 500, 90000])]
    df = spark.createDataFrame(data, "photo_id long, session_id string, ts timestamp, path string, rating int, kind string, duration double").withColumn("event_id", F.col("photo_id"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, op in (("b", streams.burst_stream), ("c", lambda x: streams.coalesce_deltas(x, ["rating"], "2 seconds")), ("t", streams.telemetry_stream)):
        q = op(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        batch = [tuple(r) for r in op(df).collect()]
        stream = rows(spark.table(name))
        assert stream and set(stream) < set(batch)
        assert len(batch) - len(stream) == 1  # the last window waits for the watermark


@pytest.mark.parametrize("name", ["decision_pipeline", "coverage_promote", "assign_identities", "discover_scenes", "taste_scores", "light_sessions", "leader_clusters", "storyline_segments"])
def test_rows_only_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_components_of_a_long_path_against_the_order_of_ids(spark):
    """The path 0, L, L - 1, ..., 1 is one component; a bound that is met is an error."""
    n = 40
    path = [0, *range(n, 0, -1)]
    photos = spark.range(n + 2).select(F.col("id").alias("photo_id"))
    pairs = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long").coalesce(1)
    assert rows(joins.connected_components(photos, pairs)) == [*[(i, 0) for i in range(n + 1)], (n + 1, n + 1)]
    with pytest.raises(RuntimeError):
        joins.connected_components(photos, pairs, 1)
