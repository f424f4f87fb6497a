"""Row rules: one photo's columns in, one column or frame out. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_even(c: Column, n: int = 0) -> Column:
    """``c`` rounded to ``n`` places as ``round`` does it to doubles: halves of the scaled value go to even, and
    0.575, which lies just under the half, gives 0.57. (``bround`` takes the shortest decimal's digits.)"""
    scale = F.lit(float(10**n))
    return F.bround(c * scale) / scale


def parse_capture_time(c: Column) -> Column:
    """The colon form of EXIF dates, then the dashed form; anything else is missing."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))


def cold_score(blur: Column, aesthetic: Column, ref: float = 500.0) -> Column:
    return F.lit(0.6) * F.least(F.lit(1.0), blur / F.lit(ref)) + F.lit(0.4) * aesthetic


def classify_history(rating: Column, pick: Column) -> Column:
    """Order matters: a reject flag, then rejects of the rating scale, then keepers."""
    return F.when(pick == -1, "negative").when(rating >= 4, "ignore").when(rating >= 2, "positive").when(rating == 1, "negative").otherwise("unreviewed")


def is_extreme_develop(exposure: Column, ev: float = 1.0) -> Column:
    return F.abs(F.coalesce(exposure, F.lit(0.0))) > ev


def blur_verdict(score: Column, iso: Column, cpbd: Column, thr: float = 80.0) -> Column:
    """The threshold rises with sensitivity above ISO 800; a sharp edge spread rescues."""
    t = F.when(iso > 800, F.lit(thr) * (1 + F.lit(0.15) * F.log2(iso / F.lit(800.0)))).otherwise(F.lit(thr))
    return F.when(score >= t, "sharp").when(cpbd >= 0.25, "rescued").otherwise("blurry")


def _smoothstep(x: Column, lo: float, hi: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(lo)) / F.lit(hi - lo)))
    return t * t * (3 - 2 * t)


def tonal_rescue(hi: Column, sh: Column, t_hi: float = 0.05, t_sh: float = 0.10) -> dict[str, Column]:
    """Highlights and shadows by the clipped shares, whites and blacks as parts of them; half-even integers."""
    high = F.when(hi > t_hi, F.bround(F.lit(-80.0) * _smoothstep(hi, t_hi, 0.20))).otherwise(F.lit(0.0))
    low = F.when(sh > t_sh, F.bround(F.lit(70.0) * _smoothstep(sh, t_sh, 0.35))).otherwise(F.lit(0.0))
    return {"highlights": high, "whites": F.bround(F.lit(0.4) * high), "shadows": low, "blacks": F.bround(F.lit(0.3) * low)}


def crop_descriptors(df: DataFrame) -> DataFrame:
    """Area, offsets of the centre and angle of a crop, to 4 places."""
    w, h = F.col("crop_right") - F.col("crop_left"), F.col("crop_bottom") - F.col("crop_top")
    four = lambda c: half_even(c, 4)
    return df.withColumns({"area": four(w * h), "dx": four((F.col("crop_left") + F.col("crop_right")) / 2 - F.lit(0.5)), "dy": four((F.col("crop_top") + F.col("crop_bottom")) / 2 - F.lit(0.5)), "angle": four(F.col("crop_angle"))})


def is_real_crop(df: DataFrame, area: float = 0.98) -> DataFrame:
    return df.withColumn("real_crop", (F.col("area") < area) | (F.abs("angle") > 0.1))


def exposure_value(lum: Column) -> Column:
    return F.log2(F.greatest(lum, F.lit(1e-4)) / F.lit(0.18))


def trash_flag(blur_flag: Column, blur: Column, sharp_anywhere: Column, lum: Column, clip: Column, reason: Column, thr: float = 80.0) -> Column:
    ev = exposure_value(lum)
    extreme = ((ev > 2) & (clip > 0.85)) | (ev < -4.5)
    return (blur_flag & (blur < thr * 0.35) & (sharp_anywhere < thr)) | extreme | F.coalesce(reason == "flash_misfire", F.lit(False))


def derive_exposure(lum: Column, limit: float = 1.2) -> Column:
    """Stops that bring a luminance to mid-grey, for photos without a stored develop."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), half_even(F.log2(F.lit(0.18) / lum), 2)))


def exposure_caption(aperture: Column, shutter: Column, focal: Column) -> Column:
    speed = F.when(shutter < 1, F.concat(F.lit("1/"), F.bround(1 / shutter).cast("int").cast("string"), F.lit("s"))).otherwise(F.concat(shutter.cast("int").cast("string"), F.lit("s")))
    return F.concat_ws(" ", F.concat(F.lit("f/"), aperture.cast("string")), speed, F.concat(focal.cast("int").cast("string"), F.lit("mm")))


def anonymise_path(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def face_attributes(faces: DataFrame, out: float = 28.0) -> DataFrame:
    yaw = F.abs("yaw")
    return faces.withColumns({"looks_away": yaw > out, "gaze_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - yaw / F.lit(40.0)))})


def vip_weights(faces: DataFrame, vip_ids: list[int] | None = None, floor: float = 0.35) -> DataFrame:
    """Known people: 4 for VIPs and 0.5 for others. Else by area in the photo's largest face."""
    if vip_ids:
        return faces.withColumn("weight", F.when(F.col("identity_id").isin(vip_ids), F.lit(4.0)).otherwise(F.lit(0.5)))
    area = (F.col("w") * F.col("w")).cast("double")
    share = area / F.max(area).over(Window.partitionBy("photo_id"))
    return faces.withColumn("weight", F.when(share >= floor, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), half_even(share, 3))))


def region_normalise(faces: DataFrame) -> DataFrame:
    """Face boxes as fractions of the photo's own size: centre and extent."""
    return faces.withColumns({"cx": (F.col("x") + F.col("w") / 2) / F.col("width"), "cy": (F.col("y") + F.col("w") / 2) / F.col("height"), "fw": F.col("w") / F.col("width"), "fh": F.col("w") / F.col("height")})


def second_pass_rules(photos: DataFrame, faces: DataFrame, cap: float = 0.30) -> DataFrame:
    """Photos worth a second look by four rules; above ``cap`` of a session only those with most hits."""
    per = faces.groupBy("photo_id").agg(F.min("w").alias("least_w"), F.avg("confidence").alias("confidence"))
    p = photos.join(per, "photo_id", "left")
    none = F.col("face_count") == 0
    rules = [none.cast("int") * 3, (F.col("face_count") >= 8).cast("int"), F.coalesce((F.col("least_w") < 40).cast("int"), F.lit(0)), F.coalesce((F.col("confidence") < 0.75).cast("int"), F.lit(0))]
    p = p.withColumn("hits", sum(rules[1:], rules[0])).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    flagged = p.where("hits > 0")
    room = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(cap)))
    by = Window.partitionBy("session_id").orderBy(F.col("hits").desc(), "photo_id")
    return flagged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= room).select("photo_id", "session_id", F.col("hits").cast("long").alias("hits"))


def final_label(error: Column, trash: Column, closed: Column, highlighted: Column, selected: Column, alternative: Column) -> Column:
    return (F.when(error, F.lit(None).cast("string")).when(trash, "blurry").when(closed & ~(selected | alternative), "closed_eyes").when(highlighted, "highlighted")
            .when(selected, "selected").when(alternative, "alternative").otherwise("duplicates"))


def client_preview_scope(snapshot: DataFrame, mode: str = "all") -> DataFrame:
    return snapshot if mode == "all" else snapshot.where(F.col("label").isin("selected", "highlighted"))


def blur_diagnosis(face: Column, background: Column, coherence: Column, thr: float = 4.5, bokeh: float = 1.8, aligned: float = 0.6) -> Column:
    """Sharp subject against a soft ground is bokeh; else streaks of one direction are motion."""
    return F.when((face >= thr) & (face >= bokeh * background), "bokeh").when(face >= thr, "sharp").when(coherence >= aligned, "motion").otherwise("missed_focus")


def grid_facets(df: DataFrame) -> DataFrame:
    """One pass over decisions with their margins: how many photos each of the grid's seven facets shows."""
    c = F.col
    return df.agg(F.count("*").alias("all_photos"), F.count_if(c("label").isin("selected", "highlighted")).alias("recommended"), F.count_if(c("label") == "duplicates").alias("repeated"),
                  F.count_if(c("label").isin("closed_eyes", "blurry")).alias("discards"), F.count_if(c("margin") < 0.05).alias("doubtful"), F.count_if("black_white").alias("black_white"),
                  F.count_if(c("label") == "alternative").alias("alternatives"))


def hero_bonus(score: Column, vip: Column, mates: Column, faces: Column, max_yaw: Column, gaze: Column, closed: Column, away: Column, smiling: Column) -> Column:
    """Score with its bonuses, each step capped at 1: people of the event's centre, then in bursts of two or
    more with faces eye contact, and for these people eye contact and a smile."""
    one = F.lit(1.0)
    plus = lambda c, when, x: F.when(when, F.least(one, c + F.lit(x))).otherwise(c)
    s = F.when(vip, F.least(one, score * F.lit(1.2))).otherwise(score)
    shot = (mates >= 2) & (faces > 0)
    open_ = (closed == 0) & (away == 0)
    s = plus(s, shot & ((max_yaw < 15.0) | (gaze >= 0.75)) & open_, 0.35)
    s = plus(s, shot & vip & open_, 0.15)
    return plus(s, shot & vip & open_ & (smiling > 0), 0.15)
