"""Cases that the driver's larger tables hold and its small ones don't."""

import datetime as dt
import os
import shutil
import statistics

import duckdb
from pyspark.sql import functions as F

from fotolith import registry, registry_edits, registry_learn, registry_more, registry_reports, registry_state  # noqa: F401  the others add to the first
from fotolith.fixtures import view
from fotolith.llm import neardup
from fotolith.operators import aggs, models
from fotolith.plans.decide import TASK_ROWS, by_session
from fotolith.registry_state import cut
from fotolith.sources import maintenance
from fotolith.streaming import streams

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def folder(spark, path, events):
    """A folder of the smallest tables with events of its own."""
    os.makedirs(path)
    for t in os.listdir(SF):
        if t != "events.parquet":
            (shutil.copytree if os.path.isdir(f"{SF}/{t}") else shutil.copy)(f"{SF}/{t}", f"{path}/{t}")
    events.write.parquet(f"{path}/events.parquet")
    return path


def both(spark, path, name):
    """A query's rows and its SQL's, in order."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(path):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{path}/{t}{'/*.parquet' if os.path.isdir(f'{path}/{t}') else ''}')")
    df = registry.queries()[name](spark, path)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=str), sorted(want, key=str)


def test_policies_of_large_ids(spark, tmp_path):
    """Two photos of a burst whose scores differ by less than their ids do in millionths."""
    at = dt.datetime(2024, 1, 1, 0, 0, 5)
    events = spark.createDataFrame([(100, at, 7, "click", 100.0, '{"k": 1}'), (6_000_100, at + dt.timedelta(seconds=1), 7, "click", 100.004, '{"k": 2}')], EVENTS)
    got, want = both(spark, folder(spark, f"{tmp_path}/d", events), "policy_ab_report")
    assert got == want == [("0/2024-01-01", 1, 0)]


def test_estimates_of_large_folders(spark, tmp_path):
    """A folder of more stems than a sketch counts exactly."""
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3 * 86_400)
    events = spark.range(9_000).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 5}').alias("props"))
    got, want = both(spark, folder(spark, f"{tmp_path}/d", events), "session_estimate_sketch")
    assert got == want == [(0, 4_500), (1, 4_500)]


def test_kept_tables_have_few_folders(spark, tmp_path):
    """Folders don't grow in number with sessions; a version written in parts keeps them all; sessions that are
    null or empty are sessions of their own."""
    schema = "photo_id long, label string, session_id string"
    kept = spark.range(3_000).select(F.col("id").alias("photo_id"), F.lit("x").alias("label"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"))
    maintenance.save_version(kept, f"{tmp_path}/v", 1)
    maintenance.upsert_sessions(kept.withColumn("seq", F.lit(1)), f"{tmp_path}/t", ["photo_id"], "seq")
    for at in ("v", "t"):
        assert len({d for d, _, names in os.walk(f"{tmp_path}/{at}") if any(n.endswith(".parquet") for n in names)}) <= maintenance.BUCKETS
    part = lambda lo, hi: kept.where((F.col("photo_id") >= lo) & (F.col("photo_id") < hi)).withColumn("label", F.lit("y"))
    for p in (part(0, 500), part(500, 900), part(0, 500), spark.createDataFrame([(-1, "z", None), (-2, "z", "")], schema)):
        maintenance.save_version(p, f"{tmp_path}/v", 2)
    seen = lambda n: {tuple(r) for r in maintenance.as_of(spark, f"{tmp_path}/v", schema, n).groupBy("label").count().collect()}
    assert seen(1) == {("x", 3_000)} and seen(2) == {("x", 2_100), ("y", 900), ("z", 2)}
    assert maintenance.restore_version(spark, f"{tmp_path}/v", schema, 2) == 3 and seen(3) == {("x", 3_000)}


def test_examples_lie_in_few_folders(spark, tmp_path):
    """Batches of wide and narrow spans of ids; an event that any earlier one holds isn't written again."""
    duels = lambda ids: ids.select(F.col("id").alias("event_id"), F.col("id").alias("winner"), (F.col("id") + 1).alias("loser"))
    for n, ids in enumerate((spark.range(0, 50_000), spark.range(20_000, 20_300), spark.range(49_950, 50_100), spark.range(0, 100_000, 7), spark.range(99_990, 100_010))):
        for _ in range(2 if n in (1, 3) else 1):
            streams.put_examples(duels(ids), n, f"{tmp_path}/t", 100)
    got = spark.read.schema(streams.EXAMPLES).parquet(f"{tmp_path}/t")
    want = {*range(50_100), *range(0, 100_000, 7), *range(99_990, 100_010)}
    assert got.count() == 2 * len(want) and {r[0] for r in got.select("event_id").distinct().collect()} == want
    assert all(r["count"] <= streams.FOLDERS for r in got.select("bucket", "batch").distinct().groupBy("batch").count().collect())


def test_decisions_take_more_tasks_not_larger_ones(spark):
    """Sessions are dealt to parts by the number of photos."""
    d = spark.range(1_000).select(F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("session_id"))
    assert by_session(d, 4 * TASK_ROWS) is d
    parts = by_session(d, 60 * TASK_ROWS - 1)
    assert parts.rdd.getNumPartitions() == 60 and max(parts.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 100


def test_streams_have_few_batches(spark, tmp_path):
    """A stream's batches don't grow in number with the files of its goes."""
    df = spark.range(4_000).withColumn("ts", F.timestamp_seconds("id")).repartition(40)
    stream = cut(df, F.col("id") % 5, f"{tmp_path}/in", 5)
    seen = []
    stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 4_000 and len(seen) <= 6


def test_story_vectors_are_normed_once(spark):
    """A vector's norm is not summed again for each of its numbers."""
    photos = registry_more.story_photos(spark, SF)
    plan = photos._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sqrt(aggregate(" in plan and "/ sqrt(" not in plan
    assert photos.where(F.abs(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) - 1) > 1e-9).count() == 0


def test_models_stop_when_they_are_found(spark, monkeypatch):
    """Newton steps end by themselves: what the biases share, which no probability sees, isn't a move."""
    pairs = registry_learn.preference_pairs(spark, SF)
    passes = []
    monkeypatch.setattr(models, "_summed", lambda *a, f=models._summed: passes.append(1) or f(*a))
    sets = {**registry_learn.FEATURES, "c": registry_learn.FEATURES["a"] + registry_learn.FEATURES["b"]}
    got = {r.features: r for r in models.pairwise_eval(pairs, sets).collect()}
    assert set(got) == set(sets) and {r.pairs for r in got.values()} == {pairs.count()} and len(passes) <= 10


def test_rows_stand_once_in_a_plan_without_long_groups(spark):
    """Rows beside their group's figures: one join, unless a group is long; the same rows either way."""
    for most in (3, neardup.LONG + 1):
        rows = spark.range(most + 20).select(F.when(F.col("id") < most, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
        got = neardup.beside(rows, rows.groupBy("k").agg(F.count("*").alias("holders")).where("k < 1010"), "k")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("Union" in plan) == (most > neardup.LONG)
        want = {i: most if i < most else 1 for i in range(most + 20) if i < most or i < 1010}
        assert {r.id: r.holders for r in got.collect()} == want and got.columns == ["k", "id", "holders"]


GATE_NAMES = ("flash_misfire", "closed_eyes", "looking_away", "vip_no_smile", "soft_face")


def gated(burst, faces, alike):
    """The photos of a burst that the gates leave and why others go, one gate after the other."""
    left, why, lead, every, sharp = list(burst), {}, {}, {}, {}
    if len(left) < 2:
        return left, why
    for p in burst:
        own = faces.get(p.photo_id, [])
        most = max((f.w * f.w for f in own), default=1)
        big = [alike or round(f.w * f.w / most, 3) >= 0.35 for f in own]
        every[p] = [f for f in own if f.valid]
        lead[p] = [f for f, b in zip(own, big, strict=True) if f.valid and b] or every[p]
        sharp[p] = min((f.sharpness for f, b in zip(own, big, strict=True) if b), default=None)
    eyes = lambda who: lambda p: not any(f.ear < 0.18 or f.blink > 0.5 for f in who[p])
    gaze = lambda who: lambda p: not any(f.gaze_out > 0.35 or abs(f.yaw) > 0.5 for f in who[p])
    light = statistics.median(p.lum for p in burst)
    stages = [("flash_misfire", lambda p: light < 0.09 or p.lum >= light * 0.4), ("closed_eyes", eyes(lead)), ("closed_eyes", eyes(every)), ("looking_away", gaze(lead)), ("looking_away", gaze(every)),
              ("vip_no_smile", lambda p: any(f.smile_score >= 0.35 for f in lead[p])), ("soft_face", lambda p: sharp[p] is None or sharp[p] >= middle * 0.5)]
    for name, passes in stages:
        middle = statistics.median([sharp[p] for p in left if sharp[p] is not None] or [0.0])
        good = [p for p in left if passes(p)]
        if good:
            why |= {p: name for p in left if p not in good}
            left = good
    return left, why


def test_policies_are_gates_and_scores(spark):
    """winners among the photos that each policy keeps, bursts of which one keeps more, reasons side by side."""
    sf, faces, bursts, want, rest = "/root/testdata/sf0.01", {}, {}, {}, {}
    for p in view(spark, sf, "v_judged").collect():
        bursts.setdefault((p.session_id, p.burst), []).append(p)
    for f in view(spark, sf, "v_gate_faces").collect():
        faces.setdefault(f.photo_id, []).append(f)
    for (s, _), burst in bursts.items():
        (a, why_a), (b, why_b) = gated(burst, faces, True), gated(burst, faces, False)
        best = lambda left, by: min(left, key=lambda p: (-p[by], p.photo_id))
        n, m, r = want.setdefault(s, [0, 0]), rest.setdefault(s, {"more_a": 0, "more_b": 0}), [*why_a.values()]
        n[0] += 1
        n[1] += best(a, "score") != best(b, "blur_score")
        m["more_a"] += len(a) > len(b)
        m["more_b"] += len(b) > len(a)
        for g in GATE_NAMES:
            m[f"{g}_a"] = m.get(f"{g}_a", 0) + r.count(g)
            m[f"{g}_b"] = m.get(f"{g}_b", 0) + [*why_b.values()].count(g)
    report, gates = (registry.queries()[q](spark, sf).collect() for q in ("policy_ab_report", "policy_ab_gates"))
    assert {r.session_id: [r.bursts, r.different] for r in report} == want
    assert {r.session_id: {k: v for k, v in r.asDict().items() if k != "session_id"} for r in gates} == rest
    assert any(m["closed_eyes_a"] != m["closed_eyes_b"] for m in rest.values()) and any(m["more_a"] for m in rest.values()) and any(n for _, n in want.values())


def test_policies_lose_no_burst(spark):
    """Bursts without a session count, a photo without a score comes last, no winner differs from any."""
    rows = [(None, 1, 1, None, 2.0, True, True, None, None), (None, 1, 2, 1.0, None, True, True, None, None), ("s", 1, 3, 5.0, 5.0, True, False, None, "soft_face"), ("s", 1, 4, 5.0, 5.0, True, True, None, None), ("s", 2, 5, 1.0, 1.0, True, False, None, "closed_eyes")]
    photos = spark.createDataFrame(rows, "session_id string, burst long, photo_id long, score_a double, score_b double, alive_a boolean, alive_b boolean, reason_a string, reason_b string")
    got = {r.session_id: r.asDict() for r in aggs.policy_ab_report(photos).collect()}
    assert {s: (r["bursts"], r["different"], r["more_a"], r["more_b"], r["closed_eyes_b"], r["soft_face_a"], r["soft_face_b"]) for s, r in got.items()} == {None: (1, 1, 0, 0, 0, 0, 0), "s": (2, 2, 2, 0, 1, 0, 1)}
