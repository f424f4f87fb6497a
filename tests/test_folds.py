"""Folds, taste and sources against plain loops; decisions on small cases."""

import json

import numpy as np

from fotolith import registry, registry_more  # noqa: F401
from fotolith.fixtures import view
from fotolith.operators import learn, ranking, sessions
from fotolith.plans.decide import decide
from fotolith.sources import tables

SF = "/root/testdata/sf0.001"


def test_identities_by_a_plain_loop(spark):
    faces = registry.face_vectors(spark, SF)
    got = {(r.photo_id, r.face_index): r.identity_id for r in sessions.assign_identities(faces).collect()}
    centres, want = {}, {}
    for r in sorted(faces.collect(), key=lambda r: (r.photo_id, r.face_index)):
        x = np.array(r.vec) / np.linalg.norm(r.vec)
        own = centres.setdefault(r.session_id, [])
        d = [1 - c @ x for c in own]
        if d and min(d) < 0.38:
            want[r.photo_id, r.face_index] = int(np.argmin(d))
        else:
            own.append(x)
            want[r.photo_id, r.face_index] = len(own) - 1
    assert got == want and len(set(want.values())) > 3


def test_leaders_by_a_plain_loop(spark):
    p = view(spark, SF, "v_hashed")
    got = {r.photo_id: r.cluster for r in sessions.leader_clusters(p).collect()}
    rows = {}
    for r in p.collect():
        rows.setdefault(r.session_id, []).append(r)
    want = {}
    for own in rows.values():
        left, n = sorted(own, key=lambda r: (r.t_us, r.photo_id)), 0
        while left:
            near = [r for r in left if (r.phash ^ left[0].phash).bit_count() <= 10]
            want |= {r.photo_id: n for r in near}
            left, n = [r for r in left if r not in near], n + 1
    assert got == want and len(set(want.values())) > 3


def test_taste_is_the_ridge_of_its_evidence(spark):
    """The posterior from sums of rows is that of the rows themselves, and no evidence step moves it."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 4)) + [0, 2, 0, 0]
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.5, 200) > 1, 1, -1)
    m = learn.taste_fit(spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "vec array<double>, y int").repartition(6), rounds=200)
    xc, yc = x - x.mean(0), y - y.mean()
    lam = np.linalg.inv(m.cov) - xc.T @ xc / m.noise
    assert np.allclose(lam, np.diag(np.diag(lam)), atol=1e-6) and np.ptp(np.diag(lam)) < 1e-6
    assert np.allclose(m.mean, np.linalg.solve(xc.T @ xc + lam[0, 0] * m.noise * np.eye(4), xc.T @ yc), atol=1e-6)
    got = {tuple(r.vec): r.taste for r in learn.taste_score(spark.createDataFrame([(x[i].tolist(),) for i in range(20)] + [(None,)], "vec array<double>"), m).where("vec is not null").collect()}
    for i in range(20):
        p, s = x[i] @ m.mean + m.bias, np.sqrt(x[i] @ m.cov @ x[i] + m.noise)
        assert abs(got[tuple(x[i])] - (0.5 + (np.clip((p + 1) / 2, 0, 1) - 0.5) * np.exp(-s))) < 1e-9


def test_listing_and_telemetry_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/1.JPG", "a/b/2.cr2", "a/.hidden.jpg", "a/notes.txt", "a/b/3.jpeg", "a/noext"):
        (tmp_path / name).write_bytes(b"x")
    got = tables.list_photos(spark, f"{tmp_path}/a")
    assert [r.path.rsplit("/", 1)[1] for r in got.collect()] == ["1.JPG", "2.cr2", "3.jpeg"] and "content" not in got.columns
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps({"event_id": 1, "kind": "a", "extra": 2}), "{broken", json.dumps({"event_id": 3})]))
    rows = {(r.event_id, r.kind) for r in tables.load_telemetry(spark, f"{tmp_path}/t.jsonl", "event_id long, kind string").collect()}
    assert rows == {(1, "a"), (None, None), (3, None)}


def judged(spark, photos, people=()):
    """Decisions on photos given as (id, seconds, dict of what differs from a plain sharp shot)."""
    plain = {"session_id": "s", "scene_type": "portrait", "width": 6000, "height": 4000, "blur_score": 400.0, "aesthetic_score": 0.5, "lum": 0.2, "clip": 0.0, "blur_flag": False, "sharp_anywhere": 500.0, "error": False}
    face = {"valid_faces": 1, "closed": 0, "away": 0, "smiling": 0, "max_yaw": 30.0, "gaze": 0.1, "vip": 0}
    rows = [{**plain, "photo_id": i, "t_us": int(s * 1e6), **{k: v for k, v in more.items() if k in plain}} for i, s, more in photos]
    counts = [{**face, "photo_id": i, **{k: v for k, v in more.items() if k in face}} for i, _, more in photos]
    kinds = "photo_id long, session_id string, scene_type string, t_us long, width int, height int, blur_score double, aesthetic_score double, lum double, clip double, blur_flag boolean, sharp_anywhere double, error boolean"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)
    seen = "photo_id long, valid_faces int, closed int, away int, smiling int, max_yaw double, gaze double, vip int"
    ex = spark.createDataFrame([tuple(r[c.split()[0]] for c in seen.split(", ")) for r in counts], seen)
    faces = spark.createDataFrame([(i, "s", k, 0.3, 0.1, 0.1, 0.1, 0.6, 100.0, 50, True, who) for k, (i, who) in enumerate(people)], "photo_id long, session_id string, face_index int, ear double, blink double, gaze_out double, yaw double, smile_score double, sharpness double, w int, valid boolean, identity_id long")
    return {r.photo_id: r for r in decide(df, faces, ex).collect()}


def test_closed_eyes_are_relative_to_the_winner(spark):
    """More bad faces than the winner is a fault; as many is none, however many they are."""
    got = judged(spark, [(1, 0, {"closed": 1, "blur_score": 500.0}), (2, 1, {"closed": 1, "blur_score": 300.0}), (3, 2, {"closed": 2, "blur_score": 250.0}), (4, 3, {"away": 2, "blur_score": 200.0}), (5, 60, {"closed": 3})])
    assert [got[i].label for i in (2, 3, 4)] == ["duplicates", "closed_eyes", "closed_eyes"]
    assert got[1].label in ("selected", "highlighted") and got[5].label in ("selected", "highlighted")


def test_labels_of_a_session(spark):
    """Blur, errors, the other orientation, one highlight of few, and people whom no chosen photo shows."""
    photos = [(1, 0, {"blur_score": 500.0, "aesthetic_score": 0.9}), (2, 1, {"blur_score": 450.0, "height": 9000}), (3, 2, {"blur_score": 440.0}), (4, 60, {"blur_flag": True, "blur_score": 20.0, "sharp_anywhere": 40.0}), (5, 120, {"error": True}), (6, 180, {"lum": 0.9, "clip": 0.9}), (7, 3, {"blur_score": 10.0}), (8, 3.5, {"blur_score": 12.0})]
    got = judged(spark, photos, [(7, 1), (8, 1), (3, 1), (1, 2), (2, 2), (3, 2)])
    assert [got[i].label for i in (1, 4, 5, 6)] == ["highlighted", "blurry", None, "blurry"]
    assert got[2].label in ("selected", "alternative") and got[3].label == "recommended" and got[8].label == "duplicates"


def test_taste_breaks_a_tie(spark):
    schema = "session_id string, burst long, photo_id long, alive boolean, score double, closed int, smiling int, away int, blur_score double, aesthetic_score double, taste double"
    rows = [("s", 1, 1, True, 0.81, 0, 0, 0, 100.0, 0.5, 0.1), ("s", 1, 2, True, 0.80, 0, 0, 0, 100.0, 0.5, 0.9), ("s", 1, 3, False, 0.99, 0, 0, 0, 100.0, 0.5, 0.9)]
    df = spark.createDataFrame(rows, schema)
    assert ranking.burst_winners(df).first().photo_id == 2 and ranking.burst_winners(df.drop("taste")).first().photo_id == 1
    assert {(r.photo_id, r.rep, r.decided_by) for r in ranking.mark_winners(df).collect()} == {(i, 2, "elo") for i in (1, 2, 3)}


def test_windows_say_what_the_joins_say(spark):
    """Winners as columns are those of the joined form."""
    h = registry_more._heroes(spark, SF)
    a = {(r.session_id, r.burst): (r.photo_id, r.margin, r.decided_by) for r in ranking.burst_winners(h).collect()}
    b = {(r.session_id, r.burst): (r.rep, r.margin, r.decided_by) for r in ranking.mark_winners(h).select("session_id", "burst", "rep", "margin", "decided_by").distinct().collect()}
    assert a == b
    labels = {r.label for r in decide(*registry_more._to_decide(spark, SF)).collect()}
    assert labels >= {None, "blurry", "closed_eyes", "highlighted", "selected", "duplicates"}
