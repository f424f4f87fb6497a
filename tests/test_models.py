"""Learned models against numpy, quantiles against sorted lists, packets and payloads on small cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.operators import joins, learn, models, quantiles
from fotolith.sources import packets


def newton(x, y, classes, weight, penalty=1.0):
    """Softmax regression by plain gradient steps with line search, on standardised features."""
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    t = (y[:, None] == np.array(classes)[None]).astype(float)
    s = t @ weight
    w = np.zeros((len(classes), z.shape[1]))
    free = np.ones_like(w)
    free[:, -1] = 0

    def loss(w):
        a = z @ w.T
        a -= a.max(1, keepdims=True)
        return -(s * ((a * t).sum(1) - np.log(np.exp(a).sum(1)))).sum() + penalty / 2 * (w * w * free).sum()

    step = 1.0 / len(x)
    for _ in range(4000):
        a = z @ w.T
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - t) * s[:, None]).T @ z + penalty * w * free
        while loss(w - step * g) > loss(w) - step / 2 * (g * g).sum() and step > 1e-12:
            step /= 2
        w = w - step * g
        step *= 1.5
    a = z @ w.T
    p = np.exp(a - a.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_is_the_plain_fit(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(0, 1, (150, 4)) * [1, 10, 0.1, 1] + [0, 5, 0, 0]
    x[:, 3] = 7.0  # a feature that tells nothing
    y = np.array([str(int(v)) for v in np.clip(np.digitize(x[:, 0] + rng.normal(0, 0.7, 150), [0.8, 1.5][:classes - 1]), 0, classes - 1)])
    rows = [("k", i % 3, str(y[i]), x[i].tolist()) for i in range(150)]
    got = models.fit_logistic(spark.createDataFrame(rows, "key string, fold int, y string, x array<double>").repartition(5), 3, balanced=True)
    assert set(got) == {("k", -1), ("k", 0), ("k", 1), ("k", 2)}
    for held in (-1, 1):
        use = np.array([i % 3 != held for i in range(150)])
        own = sorted(set(y[use]))
        n = np.array([(y[use] == c).sum() for c in own])
        want = newton(x[use], y[use], own, use.sum() / (len(own) * n))
        assert np.abs(got["k", held].probabilities(x[use]) - want).max() < 2e-3


def test_face_classifier(spark):
    rng = np.random.default_rng(0)
    vec = rng.normal(0, 1, (300, 3))
    faces = spark.createDataFrame([(i, vec[i].tolist() if i % 40 else None) for i in range(300)], "face_id long, vec array<double>")
    labels = [(i, "eyes", "closed" if vec[i, 0] > 0 else "open") for i in range(200)] + [(i, "subject", "statue") for i in range(30)] + [(i, "rare", "x" if i < 10 else "y") for i in range(200)] + [(9999, "eyes", "open"), (5, "eyes", None)]
    said, report = models.face_classifier(spark.createDataFrame(labels, "face_id long, attribute string, value string"), faces)
    got = {r.face_id: r for r in said.collect()}
    assert {c for c in said.columns if c.startswith("said")} == {"said_eyes"}  # the others have too few of a class
    assert np.mean([(got[i].said_eyes == "closed") == (vec[i, 0] > 0) for i in range(300) if i % 40]) > 0.95
    assert got[40].said_eyes is None and got[40].sure_eyes is None and all(0.5 <= got[i].sure_eyes <= 1 for i in range(300) if i % 40)
    one = report.collect()
    assert [(r.attribute, r.examples) for r in one] == [("eyes", 195)] and one[0].accuracy > 0.9
    none, empty = models.face_classifier(spark.createDataFrame([], "face_id long, attribute string, value string"), faces)
    assert none.columns == faces.columns and empty.count() == 0


def test_group_folds_are_level(spark):
    """As dealing one group after the other into the emptiest fold, whatever the sizes."""
    rng = random.Random(4)
    for sizes in ([40, 1, 1, 1, 1, 1, 1, 1], [rng.choice([1, 1, 1, 2, 3, 9]) for _ in range(150)], [5, 4, 3], [1] * 12):
        load, want = [0] * 4, {}
        for g, n in sorted(enumerate(sizes), key=lambda x: (-x[1], f"g{x[0]:03d}")):
            f = min(range(4), key=lambda i: (load[i], i))
            want[f"g{g:03d}"] = f
            load[f] += n
        rows = spark.createDataFrame([(f"g{g:03d}",) for g, n in enumerate(sizes) for _ in range(n)], "g string")
        got = {r.g: r.fold for r in models.group_folds(rows, "g", 4).collect()}
        own = [sum(n for g, n in enumerate(sizes) if got[f"g{g:03d}"] == f) for f in range(4)]
        assert len(got) == len(sizes) and sorted(own) == sorted(load)
        assert got == want


def test_pairs_are_told_by_what_they_differ_in(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(400):
        w, l = rng.normal(0.7, 1), rng.normal(-0.7, 1)
        data.append((f"b{i // 4}", i, i + 1000, float(w), float(l), float(rng.normal()), None))
    pairs = spark.createDataFrame(data, "burst string, winner long, loser long, w_good double, l_good double, w_noise double, l_noise double")
    got = {r.features: r for r in models.pairwise_eval(pairs, {"good": ["good"], "noise": ["noise"], "both": ["good", "noise"]}).collect()}
    right = np.mean([d[3] > d[4] for d in data])
    assert abs(got["good"]["mean"] - right) < 0.03 and got["both"]["mean"] > 0.75 and abs(got["noise"]["mean"] - 0.5) < 0.1
    assert got["good"].pairs == 400 and got["good"].groups == 100 and got["good"].folds == 5 and got["good"].spread >= 0
    assert models.pairwise_eval(pairs.where("burst = 'b0'"), {"good": ["good"]}).count() == 0


def test_scenes_of_ten_starts(spark):
    rng = np.random.default_rng(1)
    at = rng.normal(0, 10, (6, 5))
    x = np.concatenate([a + rng.normal(0, 0.5, (40, 5)) for a in at])
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(4)
    got, centres = learn.discover_scenes(vecs, 6)
    rows = {r.vec_id: r for r in got.collect()}
    assert set(rows) == set(range(240)) and all(len({rows[i].scene for i in range(g * 40, g * 40 + 40)}) == 1 for g in range(6))
    c = {r.scene: np.array(r.centroid) for r in centres.collect()}
    for s, centre in c.items():
        own = [i for i in rows if rows[i].scene == s]
        assert np.allclose(centre, x[own].mean(0)) and [i for i in own if rows[i].medoid] == [min(own, key=lambda i: (((x[i] - centre) ** 2).sum(), i))]
    data = vecs.where("embedding is not null").select("vec_id", F.col("embedding").alias("vec"))
    costs = [learn.scene_centroids(data, 6, seed, 1)[1] for seed in range(3)]
    assert learn.scene_centroids(data, 6, 0, 3)[1] <= min(costs) + 1e-6
    near = {r.vec_id: r.scene for r in joins.nearest_scene(vecs.where("embedding is not null"), centres.select(F.col("scene").cast("long").alias("scene"), "centroid")).collect()}
    assert near == {i: rows[i].scene for i in rows}
    assert learn.discover_scenes(vecs.limit(0))[0].count() == 0


@pytest.mark.parametrize("index", [False, True])
def test_quantiles_of_few_hot_groups(spark, index):
    rng = random.Random(2)
    data = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, float(rng.randrange(9)), rng.random()])) for _ in range(700)] + [("only", 3.5), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(6)
    qs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93}
    for by in (["g"], []):
        got = {(r["g"] if by else 0): r for r in quantiles.exact_quantiles(df, by, {n: (F.col("x"), q) for n, q in qs.items()}, index).collect()}
        for g in {d[0] for d in data} if by else {0}:
            own = sorted(x for k, x in data if x is not None and (not by or k == g))
            if not own:
                assert g not in got
                continue
            for n, q in qs.items():
                assert abs(got[g][n] - (own[int(len(own) * q)] if index else np.quantile(own, q))) < 1e-12
    assert [r.q5 for r in quantiles.exact_quantiles(df.limit(0), [], {"q5": (F.col("x"), 0.5)}).collect()] in ([], [None])


def test_means_do_not_depend_on_order(spark):
    data = [((i * 37 % 401) / 40.0 - 5,) for i in range(10_000)]
    df = spark.createDataFrame(data, "x double")
    got = {df.repartition(n).agg(quantiles.mean(F.abs("x")).alias("m")).first()[0] for n in (1, 3, 16)}
    assert len(got) == 1 and abs(got.pop() - np.mean([abs(x) for x, in data])) < 1e-9


def test_ranks_over_ranges(spark):
    data = [(i % 3 if i % 7 else None, (i * 31) % 200, i) for i in range(200)]
    got = quantiles.ranks(spark.createDataFrame(data, "g int, o int, i int").repartition(5), ["g"], ["o"], "place").collect()
    for g in (None, 0, 1, 2):
        own = sorted((d for d in data if d[0] == g), key=lambda d: d[1])
        assert {r.i: r.place for r in got if r.g == g} == {d[2]: k for k, d in enumerate(own)}


def test_packets(spark):
    head = '<?xpacket begin="" id="x"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r" xmlns:xmp="p" xmlns:crs="c">'
    tail = "</rdf:RDF></x:xmpmeta>\n<?xpacket end='w'?>"
    d = lambda attrs="", body="": f"<rdf:Description{attrs}>{body}</rdf:Description>"
    cases = {
        1: (head + d(' xmp:Rating="3" xmp:Label="Blue" crs:Exposure2012="0.5" crs:CropLeft="0.1"') + tail, (3, "Blue", {"Exposure2012": 0.5}, {"CropLeft": 0.1})),
        2: (head + d(' xmp:Rating="3"', "<xmp:Rating> 5 </xmp:Rating><xmp:Label>Red</xmp:Label>") + tail, (5, "Red", {}, {})),
        3: (head + d(' xmp:Rating="x" crs:Tint="warm"') + d("", "<crs:Tint>4</crs:Tint>") + d("", "<crs:Tint>9</crs:Tint>") + tail, (0, "", {"Tint": 4.0}, {})),
        4: (head + d(' crs:Tint="1"', "<crs:Tint>2</crs:Tint>") + tail, (0, "", {"Tint": 1.0}, {})),
        5: (head + d() + tail, None), 6: (None, None), 7: ("", None), 8: ("no packet", None), 9: (head + "<rdf:Description>" + tail, None),
        10: ('<rdf:RDF xmlns:rdf="r" xmlns:xmp="p">' + d(' xmp:Rating="-1"') + "</rdf:RDF>", (-1, "", {}, {})),
    }
    got = {r.id: r for r in packets.sidecar_packets(spark.createDataFrame([(i, p) for i, (p, _) in cases.items()], "id int, packet string")).collect()}
    for i, (_, want) in cases.items():
        r = got[i]
        assert (None if r.rating is None else (r.rating, r.label, r.develop, r.crop)) == want, i


def test_payloads(spark):
    data = [(1, 7, "session_start", json.dumps({"os": "mac", "gpu": 5})), (2, 7, "session_start", "{"), (3, 7, "new_kind", "{}"), (4, 7, "duel_resolved", json.dumps({"user_time_ms": "soon"})), (5, 8, "duel_resolved", json.dumps({"user_time_ms": 12})), (6, 8, "user_override", json.dumps({"features_at_moment": {"blur": 1.5, "face_count": 2}})), (7, 8, "user_override", None), (8, 8, "user_override", "[1]")]
    got = {r.event_id: r for r in packets.telemetry_payloads(spark.createDataFrame(data, "event_id long, install long, kind string, payload string")).collect()}
    assert [got[i].state for i in range(1, 9)] == ["read", "broken", "unknown", "read", "read", "read", "broken", "read"]
    assert got[1].os == "mac" and got[4].amount is None and got[5].amount == 12 and (got[6].blur, got[6].faces) == (1.5, 2) and got[8].blur is None


def test_sketches_unite(spark):
    files = spark.range(60_000).select((F.col("id") % 3).alias("folder"), (F.col("id") % 7).alias("day"), (F.col("id") % 15_000).cast("string").alias("stem"))
    sketches = packets.path_sketches(files, ["folder", "day"], F.col("stem"))
    for r in packets.united_count(sketches, ["folder"]).collect():
        assert abs(r.n - 5_000) < 5 * 0.0163 * 5_000
