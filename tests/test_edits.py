"""Retouch, crop and metadata rules, reports and reminders on small cases."""

import datetime

from pyspark.sql import functions as F

from fotolith.operators import edits, joins, reports
from fotolith.streaming import streams


def test_faces_in_context(spark):
    schema = "id int, left_state string, right_state string, left_ear double, right_ear double, kissing boolean, head_pitch double, smile_score double, mouth_open double, sharpness double"
    rows = [(1, "open", "glasses", .3, .3, False, 0., 0., 0., 12.), (2, "mid_blink", "open", .3, .3, False, 0., 0., 0., 5.), (3, "closed", "closed", 0., 0., True, 25., 0., 0., 9.5), (4, "closed", "open", 0., 0., False, 20., 0., 0., 2.5),
            (5, "partially_open", "partially_open", .6, .25, False, 0., .75, .5, 1.5), (6, None, "open", None, .3, False, None, None, None, 0.)]
    got = {r.id: r for r in edits.evaluate_faces(spark.createDataFrame(rows, schema)).collect()}
    assert [(got[i].raw_eye, got[i].eye, got[i].closed_ok, got[i].focus_label) for i in range(1, 7)] == [
        (1.0, 1.0, False, "Perfect Focus"), (-0.5, -0.5, False, "Soft Focus"), (0.0, 0.85, True, "Perfect Focus"), (0.0, 0.8, True, "Very Soft"), (0.5, 0.85, True, "Poor Focus"), (0.0, 0.0, False, "Out of Focus")]
    assert got[1].quality == 10 and got[2].quality == 3 and got[2].mid_blink


def test_crops_and_scores_without_faces(spark):
    p = spark.createDataFrame([(1, 6000, 4000, 0.0), (2, 4000, 6000, 10.0)], "photo_id int, width int, height int, tilt double")
    none = spark.createDataFrame([], "photo_id int, xmin double, xmax double, ymin double")
    got = {r.photo_id: r for r in edits.inscribed_crop(p, none).collect()}
    assert (got[1].left, got[1].top, got[1].right, got[1].bottom) == (0, 0, 1, 1)
    assert abs(got[2].left + got[2].right - 1) < 1e-12 and 0.79 < got[2].right - got[2].left < 0.81
    head = spark.createDataFrame([(1, 0.4, 0.5, 0.02), (2, 0.9, 1.0, 0.5)], none.schema)
    for r in edits.inscribed_crop(p, head).collect():
        assert 0 <= r.left < r.right <= 1 and 0 <= r.top < r.bottom <= 1
    s = spark.createDataFrame([(1, 250.0, 0.5)], "photo_id int, sharpness double, expo double")
    faces = spark.createDataFrame([], "photo_id int, w int, h int, eye_sharpness double, ear double, smile_score double")
    assert edits.area_weighted_score(s, faces, {"sharp": 0.5, "smile": 0.5}).first().score == 0.5
    assert edits.area_weighted_score(s, faces, {"smile": 1.0}).first().score == 0.0
    assert edits.area_weighted_score(s, faces, {}).first().score == 0.0


def test_metadata_keywords_keep_order(spark):
    b = spark.createDataFrame([(1, 2025, " A ", None, "x", "", "Ana", "Quito", "ana, B,b ,"), (2, 2025, "A", "{client}", None, None, None, None, None)], "id int, year int, creator string, notice string, event_type string, age string, client string, city string, tags string")
    t = spark.createDataFrame([("x", "Feast", ["Feast", "b"], "Adult")], "event_type string, label string, base_tags array<string>, default_age string")
    one, two = edits.metadata_payload(b, t, "Ecuador", ["Quito"]).orderBy("id").collect()
    assert one.keywords == ["Feast", "b", "Adult", "Ana", "Quito"] and one.copyright == "© 2025 A" and one.country == "Ecuador" and one.title == "Ana"
    assert two.keywords == [] and two.copyright == "" and two.title == "" and two.country == ""


def test_client_selection_adds_only(spark):
    snap = spark.createDataFrame([(1, "A", "highlighted", 5), (2, "b", "duplicates", 1)], "photo_id int, stem string, label string, stars int")
    names = spark.createDataFrame([("B",), ("c",), ("nope",), ("b",)], "stem string")
    files = spark.createDataFrame([(2, "b"), (3, "C"), (4, "d")], "photo_id int, stem string")
    got = joins.import_client_selection(snap, names, files)
    assert {r.photo_id: (r.label, r.stars, r.flag) for r in got.collect()} == {1: ("highlighted", 5, None), 2: ("selected", 4, "pick"), 3: ("selected", 4, "pick")}
    assert tuple(joins.client_selection_report(names, got).first()) == (2, 1)


def test_reports_of_no_rows(spark):
    none = spark.createDataFrame([], "kind string, install long, os string, gpu string, override_type string, blur double, faces int, amount double, preset string")
    assert reports.telemetry_summary(none).first().sessions == 0 and reports.telemetry_top(none).count() == 0
    assert reports.histograms(spark.createDataFrame([(None,)], "x int"), ["x"]).count() == 0


def test_reminders_of_tables_and_streams(spark, tmp_path):
    h = lambda n: datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=n)
    rows = [(1, 1, h(0), "snooze", 1), (2, 1, h(1), "export", 0), (3, 1, h(2), "snooze", 3), (4, 2, h(2), "export", 0), (5, 2, h(3), "sync", 0), (6, 3, h(3), "export", 0), (7, 3, h(3), "dismiss", 0), (8, 4, h(4), "sync", 0)]
    e = spark.createDataFrame(rows, "event_id long, directory long, ts timestamp, action string, hours long")
    table = streams.reminders(e.withColumn("at_us", F.unix_micros("ts")))
    at = lambda n: int(h(n).replace(tzinfo=datetime.UTC).timestamp() * 1e6)
    assert {tuple(r) for r in table.collect()} == {(1, at(1), at(5), None, False), (2, at(2), at(11), at(3), False), (3, at(3), at(3), None, True)}
    path = str(tmp_path / "in")
    for part in (e, spark.createDataFrame([(9, 9, h(20), "view", 0)], e.schema), spark.createDataFrame([(10, 9, h(21), "view", 0)], e.schema)):
        part.coalesce(1).write.mode("append").parquet(path)
        q = streams.reminder_stream(spark.readStream.schema(e.schema).parquet(path)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        q.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.directory, r.remind_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [(1, h(5)), (2, h(11))]
