"""Faces in context, blur verdicts, crops, retouch proposals and batch metadata: one photo or face a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import blur_diagnosis, half_even

#: Focus bands (a label holds above its bound) and the score of each state of an eye.
FOCUS = ((9.0, "Perfect Focus"), (7.0, "Great Focus"), (5.0, "Good Focus"), (3.0, "Soft Focus"), (2.0, "Very Soft"), (1.0, "Poor Focus"))
EYES = {"open": 1.0, "glasses": 1.0, "covered": 0.5, "mid_blink": -0.5}


def _between(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def eye_score(state: Column, ear: Column) -> Column:
    """A closed eye (or an unknown state) scores 0; one that is partly open by how far."""
    known = F.create_map(*[F.lit(x) for pair in EYES.items() for x in pair])
    partly = F.when(ear >= 0.6, 0.75).when(ear >= 0.25, 0.5).otherwise(0.2)
    return F.when(state == "partially_open", partly).otherwise(F.coalesce(known[state], F.lit(0.0)))


def evaluate_faces(faces: DataFrame) -> DataFrame:
    """Eye score, focus band and quality of each face. A kiss, a head bent down and a laugh excuse closed
    eyes, in this order; a blink of either eye counts for both."""
    c = F.col
    blink = F.coalesce(c("left_state") == "mid_blink", F.lit(False)) | F.coalesce(c("right_state") == "mid_blink", F.lit(False))
    raw = F.when(blink, -0.5).otherwise(F.least(eye_score(c("left_state"), c("left_ear")), eye_score(c("right_state"), c("right_ear"))))
    laugh = (c("smile_score") >= 0.75) & (c("mouth_open") >= 0.5)
    floor = F.when(c("kissing"), 0.85).when(c("head_pitch") >= 20, 0.80).when(laugh, 0.85)
    f = faces.withColumns({"raw_eye": raw, "mid_blink": blink, "_floor": floor, "focus": _between(c("sharpness"), 0.0, 10.0)})
    band = F.lit("Out of Focus")
    for bound, label in reversed(FOCUS):
        band = F.when(c("focus") > bound, label).otherwise(band)
    f = f.withColumns({"eye": F.greatest("raw_eye", "_floor"), "closed_ok": c("_floor").isNotNull(), "focus_label": band})
    eyes = F.greatest(F.lit(0.0), (c("eye") + 0.5) / 1.5) * 10
    return f.withColumn("quality", c("focus") * 0.6 + eyes * 0.4).drop("_floor")


def log_sharpness(variance: Column) -> Column:
    """Variance of the Laplacian on a scale from 0 to 10; 2,500 and more is 10."""
    score = (F.log10(F.greatest(F.lit(10.0), variance)) - 1.0) / (F.log10(F.lit(2500.0)) - 1.0) * 10.0
    return F.when(variance <= 5, 0.5).otherwise(_between(score, 0.0, 10.0))


def blur_report(photos: DataFrame) -> DataFrame:
    """Verdict of ``subject`` and ``ground`` variances and the ``dispersion`` of edge directions, and what may be
    sharpened: the subject only where the ground is soft on purpose, nothing where the subject is soft."""
    c = F.col
    p = photos.withColumns({"subject_score": log_sharpness(c("subject")), "ground_score": log_sharpness(c("ground")), "coherence": _between(1 - c("dispersion"), 0.0, 1.0)})
    p = p.withColumn("verdict", blur_diagnosis(c("subject_score"), c("ground_score"), c("coherence")))
    scope = F.when(c("verdict") == "bokeh", "subject").when(c("verdict") == "sharp", "all").otherwise("none")
    return p.withColumns({"acceptable": c("verdict").isin("bokeh", "sharp"), "sharpen": scope, **{x: half_even(c(x), 2) for x in ("subject_score", "ground_score", "coherence")}})


def inscribed_crop(photos: DataFrame, faces: DataFrame, aspect: float | None = None, headroom: float = 0.04) -> DataFrame:
    """Largest crop without empty corners after a turn by ``tilt`` degrees, drawn to the photo's faces: their
    top at 15 % of the crop's height, never nearer to its edge than ``headroom``, inside the frame."""
    c = F.col
    box = faces.groupBy("photo_id").agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"))
    ratio = c("width") / c("height")
    turn = F.radians(F.abs("tilt"))
    scale = F.when(turn < 1e-5, 1.0).otherwise(1 / F.greatest(F.lit(1e-5), F.greatest(ratio, 1 / ratio) * F.sin(turn) + F.cos(turn)))
    p = photos.join(box, "photo_id", "left").withColumn("cw", _between(scale, 0.1, 1.0))
    p = p.withColumn("ch", _between(c("cw") * (ratio / F.lit(aspect) if aspect else F.lit(1.0)), 0.1, 1.0))
    want = c("y0") + c("ch") * 0.35
    top = c("y0") - headroom
    y = F.when(want - c("ch") / 2 > top, top + c("ch") / 2).otherwise(want)
    inside = lambda at, size: F.greatest(size / 2, F.least(1 - size / 2, at))
    p = p.withColumns({"cx": inside(F.coalesce((c("x0") + c("x1")) / 2, F.lit(0.5)), c("cw")), "cy": inside(F.coalesce(y, F.lit(0.5)), c("ch"))})
    edge = {"left": c("cx") - c("cw") / 2, "right": c("cx") + c("cw") / 2, "top": c("cy") - c("ch") / 2, "bottom": c("cy") + c("ch") / 2}
    return p.withColumns({k: _between(v, 0.0, 1.0) for k, v in edge.items()}).drop("x0", "x1", "y0", "cw", "ch", "cx", "cy")


def relight_faces(faces: DataFrame, intensity: float = 0.5) -> DataFrame:
    """An ellipse over each face, in shares of the photo's size, and what to lift inside it."""
    c = F.col
    i = F.lit(max(0.1, min(1.0, float(intensity))))
    four = lambda x: half_even(x, 4)
    f = faces.where((c("width") > 0) & (c("height") > 0))
    return f.withColumns({"center_x": four((c("x") + c("w") / 2) / c("width")), "center_y": four((c("y") + c("h") / 2) / c("height")), "radius_x": four(c("w") * 0.9 / c("width")), "radius_y": four(c("h") * 1.1 / c("height")),
                          "exposure_boost": half_even(F.lit(0.4) * i, 2), "highlights_boost": F.bround(F.lit(15.0) * i).cast("int"), "shadows_lift": F.bround(F.lit(25.0) * i).cast("int")})


def skin_sliders(has_skin: Column, smoothness: Column) -> dict[str, Column]:
    s = _between(smoothness, 0.1, 1.0)
    on = lambda x: F.when(has_skin, x).otherwise(F.lit(0.0))
    return {"smoothness": on(half_even(s, 2)), "clarity": on(F.bround(s * -35)).cast("int"), "texture": on(F.bround(s * -20)).cast("int"), "luminance": on(F.bround(s * 8)).cast("int")}


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def metadata_payload(batches: DataFrame, taxonomy: DataFrame, country: str, cities: list[str]) -> DataFrame:
    """Copyright line from its template, title, country and keywords of each batch. Keywords come in order:
    the event's own, its usual age where none is given, the age, client, city and free tags; of those that
    differ in case only the first stays. ``taxonomy`` is a dimension with a row for each event type."""
    c = F.col
    b = batches.join(taxonomy, "event_type", "left").withColumns({"_client": _strip(c("client")), "_age": _strip(c("age")), "_city": _strip(c("city")), "_by": _strip(c("creator"))})
    notice = _strip(F.coalesce("notice", F.lit("© {year} {creator}")))
    for mark, by in (("{year}", c("year").cast("string")), ("{creator}", c("_by")), ("{client}", c("_client"))):
        notice = F.replace(notice, F.lit(mark), by)
    aged = F.lower("_age")
    age = F.when(c("_age") == "", "").when(aged.endswith("años") | aged.endswith("año"), c("_age")).otherwise(F.concat("_age", F.lit(" Años")))
    usual = F.when(F.coalesce("age", F.lit("")) == "", F.coalesce("default_age", F.lit(""))).otherwise("")
    every = F.concat(F.coalesce("base_tags", F.array().cast("array<string>")), F.array(usual, age, c("_client"), c("_city")), F.split(F.coalesce("tags", F.lit("")), ","))
    b = b.withColumn("_tags", F.filter(F.transform(every, _strip), lambda t: t != ""))
    low = F.transform("_tags", F.lower)
    keywords = F.filter("_tags", lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    title = F.when(c("_client") != "", c("_client")).otherwise(F.coalesce("label", F.lit("")))
    return b.withColumns({"copyright": notice, "title": title, "country": F.when(c("_city").isin(cities), country).otherwise(""), "keywords": keywords}).drop("_client", "_age", "_city", "_by", "_tags", "base_tags", "default_age", "label")


def area_weighted_score(photos: DataFrame, faces: DataFrame, weights: dict[str, float], sharp_ref: float = 500.0) -> DataFrame:
    """Weighted mean of the terms with a weight; those of faces, where there are any, by the faces' areas."""
    c = F.col
    near = lambda x: F.least(F.lit(1.0), x / F.lit(sharp_ref))
    area = F.greatest(F.lit(1.0), c("w").cast("double") * c("h"))
    mean = lambda x: F.sum(x * area) / F.sum(area)
    f = faces.groupBy("photo_id").agg(mean(near(c("eye_sharpness"))).alias("eye_sharp"), mean(c("ear")).alias("eyes_open"), mean(c("smile_score")).alias("smile"), F.count("*").alias("face_n"))
    p = photos.join(f, "photo_id", "left").withColumn("sharp", near(c("sharpness")))
    used = {k: w for k, w in weights.items() if w > 0}
    if not used:
        return p.withColumn("score", F.lit(0.0))
    at_hand = {k: (c("face_n").isNotNull() if k in ("eye_sharp", "eyes_open", "smile") else F.lit(True)) for k in used}
    add = lambda terms: sum(terms[1:], terms[0])
    total = add([F.when(at_hand[k], c(k) * w).otherwise(0.0) for k, w in used.items()])
    return p.withColumn("score", F.coalesce(F.try_divide(total, add([F.when(at_hand[k], F.lit(w)).otherwise(0.0) for k, w in used.items()])), F.lit(0.0)))


def decide_groups(scored: DataFrame, blur: float = 60.0, salient: float = 90.0, keeper: float = 0.45, highlight: float = 0.75, stars: int = 3) -> DataFrame:
    """The best of each group stays unless it is blurry; a photo on its own needs a score, or to be a sharp,
    well exposed detail, else it gets no label."""
    c = F.col
    w = Window.partitionBy("session_id", "burst")
    blurry = (c("sharpness") < blur) & (c("salient_sharpness") < salient)
    s = scored.withColumns({"_r": F.row_number().over(w.orderBy(c("score").desc(), "photo_id")), "_n": F.count("*").over(w)})
    solo = (c("score") >= keeper) | (c("face_n").isNull() & (c("expo") >= 0.5) & ~blurry)
    label = F.when(blurry | (c("_r") > 1), "reject").when((c("_n") == 1) & ~solo, F.lit(None)).when(c("score") >= highlight, "highlight").otherwise("keeper")
    s = s.withColumn("label", label)
    return s.withColumn("stars", F.when(c("label").isin("highlight", "keeper"), stars).otherwise(0)).drop("_r", "_n")


def refine_face_counts(faces: DataFrame) -> DataFrame:
    """Counts of each photo by learned verdicts where there are any (``said_*`` isn't null), else by geometry.
    What isn't a person doesn't count; behind dark glasses neither eyes nor gaze do."""
    c = F.col
    closed = F.coalesce(c("said_eyes") == "closed", c("eyes_closed"))
    away = F.coalesce(c("said_gaze") == "away", c("looks_away"))
    smiles = F.coalesce(c("said_mouth") == "smile", c("smiling"))
    f = faces.where(c("valid") & (F.coalesce(c("said_subject"), F.lit("person")) == "person"))
    seen = F.coalesce(c("said_glasses"), F.lit("none")) != "dark"
    got = f.groupBy("photo_id").agg(F.count("*").alias("valid_faces"), F.count_if(seen & closed).alias("closed"), F.count_if(seen & away).alias("away"), F.count_if(smiles).alias("smiling"))
    every = faces.select("photo_id").distinct().join(got, "photo_id", "left").na.fill(0)
    return every.withColumn("any_closed", c("closed") > 0)
