"""Reports and learned tables: conditional aggregates in one pass, partially aggregated before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, mean, with_quantiles
from .rules import half_even
from .windows import REASONS


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.col(col).cast("string") != "")).groupBy(col).agg(F.count("*").alias("n"))


def bootstrap_summary(history: DataFrame) -> DataFrame:
    c = F.col
    return history.agg(F.count("*").alias("total"), *[F.count_if(c("label") == x).alias(x) for x in ("positive", "negative", "ignore", "unreviewed")], F.count_if(c("real_crop")).alias("with_crop"), F.count_if(c("extreme")).alias("extreme"))


def learn_recipes(history: DataFrame, fields: tuple[str, ...] = ("exposure", "contrast", "vibrance"), min_n: int = 15) -> DataFrame:
    """Median of each develop field per scene, over positive rows without extreme settings; scenes and
    fields with under ``min_n`` values are left out."""
    long = history.where((F.col("label") == "positive") & ~F.col("extreme") & F.col("scene").isNotNull()).select("scene", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("r")).select("scene", "r.field", "r.value")
    own = long.where("value is not null")
    mid = exact_quantiles(own, ["scene", "field"], {"m": (F.col("value"), 0.5)})
    counts = own.groupBy("scene", "field").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    return with_quantiles(counts, mid, ["scene", "field"]).select("scene", "field", half_even(F.col("m"), 3).alias("median"), "n")


def learn_crop_style(history: DataFrame, min_n: int = 15) -> DataFrame:
    real = history.where((F.col("label") == "positive") & F.col("real_crop"))
    mid = exact_quantiles(real, ["scene"], {f"m_{c}": (F.col(c), 0.5) for c in ("area", "dx", "dy", "angle")})
    counts = real.groupBy("scene").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    return with_quantiles(counts, mid, ["scene"]).select("scene", *[half_even(F.col(f"m_{c}"), 4).alias(f"m_{c}") for c in ("area", "dx", "dy", "angle")], "n")


def project_dashboard(files: DataFrame) -> DataFrame:
    """Files collapsed by stem, a selected member first; totals of each project."""
    rank = F.when(F.col("label").isin("selected", "highlighted"), 0).otherwise(1)
    one = files.groupBy("folder_id", F.lower("stem_path").alias("stem")).agg(F.min_by("label", F.struct(rank, "photo_id")).alias("label"))
    return one.groupBy("folder_id").agg(F.count("*").alias("total"), F.count_if(F.col("label").isin("selected", "highlighted")).alias("selected")).withColumn("discarded", F.col("total") - F.col("selected"))


def retention_estimate(sessions: DataFrame, theory: float = 0.35, last_n: int = 10, total: int = 1000) -> DataFrame:
    """Kept share of an event type from its newest sessions, shrunk to the theory while they are few."""
    new = Window.partitionBy("event_type").orderBy(F.col("created").desc(), F.col("month").desc())
    s = sessions.withColumn("r", F.row_number().over(new)).where(F.col("r") <= last_n).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("kept").alias("kept"), F.sum("total").alias("total"))
    a = F.least(F.lit(0.8), F.lit(0.2) * F.col("n"))
    rate = (1 - a) * F.lit(theory) + a * F.col("kept") / F.col("total")
    clamp = lambda c: F.greatest(F.lit(0.05), F.least(F.lit(0.95), c))
    count = lambda c: F.greatest(F.lit(1.0), F.bround(c * total)).cast("long")
    return s.select("event_type", "n", F.round(rate, 6).alias("rate"), count(clamp(rate - 0.04)).alias("low"), count(clamp(rate + 0.04)).alias("high"))


def label_agreement(labels: DataFrame) -> DataFrame:
    known = labels.where("predicted is not null")
    return known.groupBy("attribute").agg(F.count("*").alias("total"), F.count_if(F.col("value") == F.col("predicted")).alias("hits")).withColumn("precision", F.when(F.col("total") > 0, half_even(F.col("hits") / F.col("total"), 3)))


def rank_vip(identities: DataFrame, top_n: int = 3, key: str = "session_id") -> DataFrame:
    """People in most photos of a session; ties go to the first seen."""
    seen = identities.groupBy(key, "identity_id").agg(F.countDistinct("photo_id").alias("photos"), F.min("photo_id").alias("first_photo"))
    w = Window.partitionBy(key).orderBy(F.col("photos").desc(), "first_photo", "identity_id")
    return seen.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_n)


def vip_smile_relaxed(faces: DataFrame, vips: DataFrame, floor: float = 0.20) -> DataFrame:
    own = faces.join(vips.select("session_id", "identity_id"), ["session_id", "identity_id"], "left_semi").groupBy("session_id", "photo_id").agg(F.max((F.col("smile_score") >= 0.5).cast("int")).alias("smiling"))
    return own.groupBy("session_id").agg(F.avg("smiling").alias("s")).select("session_id", F.round("s", 6).alias("share"), (F.col("s") < floor).alias("relaxed"))


def chapter_pacing(df: DataFrame, lo: float = 0.7, hi: float = 1.4) -> DataFrame:
    """Scores scaled by how a chapter's median stands to the session's, within bounds."""
    chapter = df.groupBy("session_id", "chapter").agg(F.median("score").alias("cm"))
    session = df.groupBy("session_id").agg(F.median("score").alias("gm"))
    f = F.when((F.col("cm") <= 0.05) | (F.col("gm") <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("gm") / F.col("cm"))))
    return df.join(chapter, ["session_id", "chapter"]).join(session, "session_id").withColumn("norm_score", F.col("score") * f).drop("cm", "gm")


def classification_metrics(df: DataFrame, pred: str, truth: str) -> DataFrame:
    p, t = F.col(pred), F.col(truth)
    c = df.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    pct = lambda a, b: F.when(b > 0, F.round(a * F.lit(100.0) / b, 6)).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", pct(tp, tp + fp).alias("precision"), pct(tp, tp + fn).alias("recall"), pct(2 * tp, 2 * tp + fp + fn).alias("f1"), pct(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def margin_buckets(pairs: DataFrame, cuts: tuple[float, ...] = (0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 1.01)) -> DataFrame:
    b = F.lit(None).cast("double")
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        b = F.when((F.col("margin") >= lo) & (F.col("margin") < hi), F.lit(float(lo))).otherwise(b)
    return pairs.withColumn("bucket", b).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("accuracy"))


def margin_cumulative(pairs: DataFrame, cuts: tuple[float, ...] = (0.02, 0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """For each cut the pairs whose margin is below it: how many, their share of all, and how often the score was
    right about them (0 where there are none)."""
    c = F.col
    below = [F.struct(F.lit(x).alias("below"), F.count_if(c("margin") < x).alias("n"), F.count_if((c("margin") < x) & c("hit")).alias("hits")) for x in cuts]
    one = pairs.agg(F.count("*").alias("all"), F.array(*below).alias("b")).select("all", F.explode("b").alias("b")).select("all", "b.*")
    return one.select("below", "n", F.coalesce(F.try_divide("n", "all"), F.lit(0.0)).alias("share"), F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("accuracy"))


def gear_stats(history: DataFrame) -> DataFrame:
    """Per camera: shots, distinct lenses, means of focal length, stop and sensitivity, and by sorted index the
    usual range of focal lengths and the quartiles of sensitivity. Zeros count as missing."""
    c = F.col
    known = lambda x: F.when(c(x) != 0, c(x))
    wanted = {"focal_low": (known("focal"), 0.25), "focal_high": (known("focal"), 0.75), "iso_q1": (known("iso"), 0.25), "iso_q2": (known("iso"), 0.5), "iso_q3": (known("iso"), 0.75)}
    g = history.groupBy("camera").agg(F.count("*").alias("shots"), F.countDistinct("lens").alias("lenses"), *[mean(known(x)).alias(x) for x in ("focal", "fstop", "iso")])
    return with_quantiles(g, exact_quantiles(history, ["camera"], wanted, index=True), ["camera"])


def gear_top(history: DataFrame, n: int = 4) -> DataFrame:
    """``figure, value, n``: the commonest cameras and lenses of all shots; ties by name."""
    tops = []
    for what in ("camera", "lens"):
        tops.append(history.where(F.col(what) != "").groupBy(F.col(what).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n).select(F.lit(what).alias("figure"), "value", "n"))
    return tops[0].unionByName(tops[1])


def face_rollup(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Per photo over valid faces; photos without faces get the defaults."""
    f = faces.where("valid").groupBy("photo_id").agg(F.min("ear").alias("ear"), F.max("blink").alias("blink"), F.max("gaze_out").alias("gaze_out"), F.max(F.abs("yaw")).alias("yaw"), F.avg("smile_score").alias("smile"), F.max((F.col("smile_score") >= 0.5).cast("int")).alias("any_smile"))
    d = {"ear": 1.0, "blink": 0.0, "gaze_out": 0.0, "yaw": 0.0, "smile": 0.0}
    return photos.join(f, "photo_id", "left").select("photo_id", *[F.round(F.coalesce(c, F.lit(v)), 6).alias(c) for c, v in d.items()], (F.coalesce("any_smile", F.lit(0)) > 0).alias("any_smile"))


def weighted_median_tilt(segments: DataFrame, max_tilt: float = 6.0, deadband: float = 0.2, within: float = 1.5) -> DataFrame:
    """Weighted median of near-level line angles per group, refined to the weighted mean of its inliers."""
    near = segments.where(F.abs("angle") <= max_tilt)
    w = Window.partitionBy("grp").orderBy("angle", "weight").rowsBetween(Window.unboundedPreceding, 0)
    run = near.withColumn("run", F.sum("weight").over(w)).withColumn("all", F.sum("weight").over(Window.partitionBy("grp")))
    mid = run.where(F.col("run") * 2 >= F.col("all")).groupBy("grp").agg(F.min("angle").alias("median"))
    inl = near.join(mid, "grp").where(F.abs(F.col("angle") - F.col("median")) <= within).groupBy("grp", "median").agg((F.sum(F.col("angle") * F.col("weight")) / F.sum("weight")).alias("tilt"))
    return inl.select("grp", F.round("median", 6).alias("median"), F.round(F.when(F.abs("tilt") < deadband, F.lit(0.0)).otherwise(F.col("tilt")), 6).alias("tilt"))


def telemetry_report(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("session").alias("sessions"), F.countDistinct("install").alias("installs"), F.count_if(F.col("kind") == "override").alias("overrides"), F.round(F.avg(F.when(F.col("kind") == "duel", F.col("duration"))), 6).alias("duel_seconds"), F.round(F.max("duration"), 6).alias("longest"))


def burst_faces_by_person(faces: DataFrame, members: DataFrame) -> DataFrame:
    return faces.join(members.select("photo_id", "burst"), "photo_id").groupBy("session_id", "burst", "identity_id").agg(F.count("*").alias("crops"), F.countDistinct("photo_id").alias("photos"))


def class_readiness(labels: DataFrame, min_n: int = 60, min_class: int = 15) -> DataFrame:
    c = labels.groupBy("attribute", "value").agg(F.count("*").alias("n")).groupBy("attribute").agg(F.sum("n").alias("labels"), F.count("*").alias("classes"), F.min("n").alias("smallest"))
    return c.withColumn("ready", (F.col("labels") >= min_n) & (F.col("classes") >= 2) & (F.col("smallest") >= min_class))


def harmonise_cluster(df: DataFrame) -> DataFrame:
    """Every member of a burst of two or more takes the burst's median exposure and white balance."""
    mid = lambda c, n: half_even(F.median(c), n)
    g = df.groupBy("session_id", "burst").agg(mid("exposure", 2).alias("exposure"), mid("wb_temp", 1).alias("temp"), mid("wb_tint", 1).alias("tint"), F.count("*").alias("n")).where("n > 1").drop("n")
    return df.select("photo_id", "session_id", "burst").join(g, ["session_id", "burst"])


def run_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(F.col("label") == "selected").alias("selected"), F.count_if(F.col("label") == "alternative").alias("alternatives"))


def session_sharpness_floor(df: DataFrame, q: float = 0.85, frac: float = 0.20) -> DataFrame:
    p = df.groupBy("session_id").agg(F.greatest(F.lit(10.0), F.percentile("blur_score", q)).alias("p"))
    return p.select("session_id", F.round("p", 6).alias("sharp"), F.round(F.col("p") * frac, 6).alias("reject_below"))


def choice_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("rating", "pick").agg(F.count("*").alias("n"))


def session_estimate_count(files: DataFrame) -> DataFrame:
    return files.where(F.lower("ext").isin("jpg", "cr2")).groupBy("folder_id").agg(F.countDistinct(F.lower("stem_path")).alias("n"))


def selection_summary(decisions: DataFrame) -> DataFrame:
    c = decisions.groupBy("session_id", "label").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("session_id")), 6))


def policy_ab_report(photos: DataFrame) -> DataFrame:
    """Two policies of gates and scores over the same bursts, by session: bursts; those with ``different`` winners
    among the photos that each policy keeps; those of which the one keeps more than the other (``more_a``,
    ``more_b``); and photos dropped for each reason, side by side (``closed_eyes_a``, ``closed_eyes_b`` ...).

    ``photos`` has ``alive_x``, ``reason_x`` (see :func:`.windows.policy_gates`) and ``score_x`` of policies a and b."""
    c = F.col
    best = lambda x: F.max_by("photo_id", F.when(c(f"alive_{x}"), F.struct(f"score_{x}", -c("photo_id")))).alias(f"won_{x}")
    why = {f"{r}_{x}": c(f"reason_{x}") == r for r in REASONS for x in "ab"}
    bursts = photos.groupBy("session_id", "burst").agg(best("a"), best("b"), *[F.count_if(f"alive_{x}").alias(f"kept_{x}") for x in "ab"], *[F.count_if(w).alias(k) for k, w in why.items()])
    more = [F.count_if(c(f"kept_{x}") > c(f"kept_{y}")).alias(f"more_{x}") for x, y in ("ab", "ba")]
    return bursts.groupBy("session_id").agg(F.count("*").alias("bursts"), F.count_if(~c("won_a").eqNullSafe(c("won_b"))).alias("different"), *more, *[F.sum(k).alias(k) for k in why])


def crop_iou_report(df: DataFrame) -> DataFrame:
    """Overlap of a proposed crop (a tenth off each side) and of the full frame with the real crop."""
    c = F.col
    real = (c("crop_right") - c("crop_left")) * (c("crop_bottom") - c("crop_top"))
    ix = F.greatest(F.lit(0.0), F.least(c("crop_right"), F.lit(0.9)) - F.greatest(c("crop_left"), F.lit(0.1)))
    iy = F.greatest(F.lit(0.0), F.least(c("crop_bottom"), F.lit(0.9)) - F.greatest(c("crop_top"), F.lit(0.1)))
    iou = ix * iy / (real + F.lit(0.64) - ix * iy)
    g = df.groupBy("scene").agg(F.count("*").alias("n"), mean(iou).alias("proposed"), mean(real).alias("full_frame"))
    return with_quantiles(g, exact_quantiles(df, ["scene"], {"median_proposed": (iou, 0.5)}), ["scene"])


def exposure_rule_report(df: DataFrame, bias: float = 0.3) -> DataFrame:
    e = F.col("exposure")
    return df.groupBy("scene").agg(F.count("*").alias("n"), mean(F.abs(e)).alias("mae_none"), mean(F.abs(e - F.lit(bias))).alias("mae_bias"))


def straighten_report(df: DataFrame) -> DataFrame:
    """Mean and median error of leaving the angle, and of both sign conventions of a proposed one."""
    a, p = F.col("crop_angle"), F.col("proposed")
    over = F.when((F.abs(a) < 0.1) & (F.abs(p) > 1), 1.0).otherwise(0.0)
    g = df.agg(F.count("*").alias("n"), mean(F.abs(a)).alias("mae_none"), mean(F.abs(a - p)).alias("mae_same"), mean(F.abs(a + p)).alias("mae_flipped"), mean(over).alias("false_corrections"))
    return with_quantiles(g, exact_quantiles(df, [], {"median_same": (F.abs(a - p), 0.5)}), [])


def analysis_audit(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id").agg(F.count("*").alias("photos"), F.count_if(F.col("blur_score").isNull()).alias("no_blur"), F.count_if(F.col("face_count") == 0).alias("no_faces"), F.round(F.avg(F.col("face_count").cast("double")), 6).alias("mean_faces"))


def learning_summary(history: DataFrame) -> DataFrame:
    return history.agg(F.count_if(F.col("label") == "positive").alias("positives"), F.count_if(F.col("label") == "negative").alias("negatives"), F.countDistinct("scene").alias("scenes"), F.round(F.avg(F.when(F.col("real_crop"), F.col("area") * 100)), 6).alias("mean_retained"))


def vip_subjects(faces: DataFrame, names: DataFrame, top_n: int = 5) -> DataFrame:
    """The people seen in most photos of each session, their first photo, and a saved or made-up name."""
    top = rank_vip(faces, top_n=top_n).drop("rank")
    name = F.coalesce("name", F.concat(F.lit("person "), F.col("identity_id").cast("string")))
    return top.join(names, ["session_id", "identity_id"], "left").select("session_id", "identity_id", "photos", "first_photo", name.alias("name"))


def verdict_report(verdicts: DataFrame, judged: DataFrame) -> DataFrame:
    """Of pairs that weren't judged before: hits, misses, those without a verdict and the accuracy, by the
    loser's label and over all."""
    c = F.col
    a = verdicts.join(judged, "photo_id", "left_anti").groupingSets([["label"], []], "label").agg(F.count("*").alias("pairs"), F.count_if(c("hit")).alias("hits"), F.count_if(~c("hit")).alias("misses"), F.count_if(c("hit").isNull()).alias("silent"))
    return a.select(F.coalesce("label", F.lit("all")).alias("label"), "pairs", "hits", "misses", "silent", F.round(F.try_divide(c("hits"), c("hits") + c("misses")), 6).alias("accuracy"))
