"""Develop settings: recipes of scenes, white balance and exposure by light session, edits by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import half_even

#: Develop fields that make a style, and those that a look may set (fixed values).
STYLE = ("Contrast2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "Clarity2012", "Vibrance", "Saturation", "Dehaze")
LOOK = STYLE[:-1]
BASE = ("Exposure2012", "IncrementalTemperature", "IncrementalTint")
CROP = ("HasCrop", "CropLeft", "CropTop", "CropRight", "CropBottom", "CropAngle")
#: Limits of exposure and white balance (fixed values).
MID, MAX_EV, BAND, STEP, HEADROOM, CLIPPED, MAX_WB, DETAIL = 0.18, 1.5, 0.7, 0.05, 0.5, 0.03, 15.0, 10.0
SKIN, VOTES, PEOPLE = (0.05, 0.45), 5, 3


def _only(m: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(*names) & v.isNotNull())


def lut_adjustments(custom: Column, learned: Column, fallback: Column, neutral: Column, strength: Column) -> Column:
    """The first of these looks that has fields, scaled by ``strength`` (0 to 1.5), rounded to two places,
    without what is 0 then. Each is a map of develop fields."""
    picked = lambda m: F.when(F.size(_only(m, LOOK)) > 0, _only(m, LOOK))
    look = F.coalesce(F.when(custom.isNotNull(), _only(custom, LOOK)), picked(learned), F.when(fallback.isNotNull(), _only(fallback, LOOK)), _only(neutral, LOOK))
    by = F.least(F.lit(1.5), F.greatest(F.lit(0.0), strength))
    return F.map_filter(F.transform_values(look, lambda k, v: half_even(v * by, 2)), lambda k, v: v != 0)


def recipe_for_scene(photos: DataFrame, learned: DataFrame, defaults: DataFrame, plain: Column) -> DataFrame:
    """``recipe`` of each photo: what was learned of its scene, of the scene nearest to its vector
    (``near_scene``), the default of that scene, the default of its own, else ``plain``. Both tables hold
    ``scene, recipe`` and a row for each scene; Spark chooses how to join them."""
    d = photos
    for name, table, key in (("own", learned, "scene"), ("near", learned, "near_scene"), ("near_default", defaults, "near_scene"), ("own_default", defaults, "scene")):
        d = d.join(table.select(F.col("scene").alias(key), F.col("recipe").alias(f"_{name}")), key, "left")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return d.withColumn("recipe", F.coalesce(some("_own"), some("_near"), F.col("_near_default"), F.col("_own_default"), plain)).drop("_own", "_near", "_near_default", "_own_default")


def blend_develop(recipe: Column, base: Column, rescue: Column) -> Column:
    """A photo's develop: style fields of the recipe, then exposure and white balance of the base, then the
    rescue over both."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    recipe, base, rescue = (F.coalesce(m, none) for m in (recipe, base, rescue))
    under = lambda m, names: F.map_filter(_only(m, names), lambda k, v: ~F.map_contains_key(rescue, k))
    return F.map_concat(under(recipe, STYLE), under(base, BASE), rescue)


def add_rescue(develop: Column, rescue: Column) -> Column:
    """The rescue added to what the develop has already, as whole numbers of at most 100 either way; other
    fields stay."""
    none = F.lit(None).cast("double")
    whole = lambda v: F.greatest(F.lit(-100.0), F.least(F.lit(100.0), half_even(v)))
    return F.map_zip_with(develop, rescue, lambda k, a, b: F.when(b.isNull(), a).otherwise(F.coalesce(whole(F.coalesce(a, F.lit(0.0)) + b), none)))


def upper_median(c: Column) -> Column:
    """The middle of a group's values, the higher of two; null without values. A group is one light session."""
    own = F.sort_array(F.collect_list(c))
    return F.try_element_at(own, (F.floor(F.size(own) / 2) + 1).cast("int"))


def pre_edit_values(photos: DataFrame, bias: float = 0.28, preset: tuple[float, float] = (0.0, 0.0), deadband: float = 0.0, auto_wb: bool = True) -> DataFrame:
    """``exposure, temp, tint`` of each photo by its light session.

    White balance: the upper medians of the session's votes, of people if there are three of those; a
    session of under five votes takes over that of the session before it, which may have taken it over
    itself, and those at the front the first one's that has enough; if none has, its own votes or 0. A
    detail whose own vote is over 10 off keeps it. Exposure: towards the session's skin or mid-grey,
    near the session's median, with the bias, not above the cap, not up where highlights clip.
    """
    c, clip = F.col, lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    keys = ["session_id", "light_session"]
    voted = c("wb_temp").isNotNull() & c("wb_tint").isNotNull()
    person = voted & c("has_people")
    s = photos.groupBy(*keys).agg(F.count_if(person).alias("people"), F.count_if(voted).alias("votes"), *[upper_median(F.when(w, c(x))).alias(f"{n}_{x}") for n, w in (("p", person), ("a", voted)) for x in ("wb_temp", "wb_tint")],
                                  upper_median(c("skin_lum")).alias("skin"))
    by_people = c("people") >= PEOPLE
    enough = F.when(by_people, c("people")).otherwise(c("votes")) >= VOTES
    own = F.when(enough, F.struct(*[F.when(by_people, c(f"p_{x}")).otherwise(c(f"a_{x}")).alias(x) for x in ("wb_temp", "wb_tint")]))
    w = Window.partitionBy("session_id").orderBy("light_session")
    front = F.first(F.struct(*[F.coalesce(f"a_{x}", F.lit(0.0)).alias(x) for x in ("wb_temp", "wb_tint")])).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("own", own)
    s = s.withColumn("wb", F.coalesce(F.last("own", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("own", True).over(w.rowsBetween(0, Window.unboundedFollowing)), front))
    s = s.select(*keys, "wb", clip(c("skin"), *SKIN).alias("skin_target"))
    raw = F.when(c("skin_lum").isNotNull() & c("skin_target").isNotNull(), F.log2(c("skin_target") / F.greatest(c("skin_lum"), F.lit(1e-4)))).otherwise(F.log2(F.lit(MID) / F.greatest(c("global_lum"), F.lit(1e-4))))
    d = photos.join(s, keys).withColumn("stops", clip(raw, -MAX_EV, MAX_EV))
    d = d.join(d.groupBy(*keys).agg(upper_median(c("stops")).alias("mid")), keys)
    off = lambda x: F.abs(c(f"wb_{x}") - c(f"wb.wb_{x}")) > DETAIL
    alone = ~c("has_people") & voted & (off("temp") | off("tint"))
    wb = lambda x, p: half_even(clip((F.when(alone, c(f"wb_{x}")).otherwise(c(f"wb.wb_{x}")) if auto_wb else F.lit(0.0)) + F.lit(p), -MAX_WB, MAX_WB), 1)
    e = F.greatest(c("mid") - F.lit(BAND), F.least(c("mid") + F.lit(BAND), c("stops"))) + F.lit(bias)
    after = F.log2(F.greatest(c("global_lum"), F.lit(1e-4)) / F.lit(MID)) + e
    e = F.when(after > bias + HEADROOM, e - (after - F.lit(bias + HEADROOM))).otherwise(e)
    e = F.when((c("clip_frac") > CLIPPED) & (e > 0), F.lit(0.0)).otherwise(e)
    e = clip(F.when(F.abs(e) < deadband, F.lit(0.0)).otherwise(e), -MAX_EV, MAX_EV)
    return d.select("photo_id", *keys, (half_even(half_even(e / F.lit(STEP)) * F.lit(STEP), 2) + F.lit(0.0)).alias("exposure"), (wb("temp", preset[0]) + F.lit(0.0)).alias("temp"), (wb("tint", preset[1]) + F.lit(0.0)).alias("tint"))


def has_manual_edits(packet: Column, toolkit: str = "fotolith 1.0") -> Column:
    """Whether a sidecar holds edits by hand: not one that this engine wrote, with settings declared, a develop
    or crop field, or a history, tone curve or mask. No packet: no edits."""
    fields = "|".join((*STYLE, *BASE, *CROP))
    edited = (packet.rlike(r"""(?i)HasSettings\s*=\s*["']\s*true""") | packet.rlike(r"(?i)HasSettings>\s*true") | packet.rlike(rf"crs:(?:{fields})(?:\s*=|\s*>|\s*/>)")
              | packet.rlike(r"<crs:(?:History|ToneCurvePV2012|MaskGroupBasedCorrections)\b"))
    return F.coalesce(~F.coalesce(packet.rlike(rf"""xmptk\s*=\s*["']{toolkit}["']"""), F.lit(False)) & edited, F.lit(False))


def protect_manual_edits(decisions: DataFrame, sidecars: DataFrame, toolkit: str = "fotolith 1.0") -> DataFrame:
    """Photos edited by hand keep their develop and crop: ours become null, only label and stars are written.
    RAW files don't get the two incremental white-balance fields."""
    mine = sidecars.groupBy("photo_id").agg(F.max(has_manual_edits(F.col("packet"), toolkit)).alias("manual"))
    d = decisions.join(mine, "photo_id", "left").withColumn("manual", F.coalesce("manual", F.lit(False)))
    kept = F.when(F.col("is_raw"), F.map_filter("develop", lambda k, v: ~k.isin(*BASE[1:]))).otherwise(F.col("develop"))
    return d.withColumns({"develop": F.when(~F.col("manual"), kept), "crop": F.when(~F.col("manual"), F.col("crop"))})


def sync_corrections(members: DataFrame) -> DataFrame:
    """What came back of an export: a row for each photo (a RAW and its JPEG are one) with ``baseline``, the
    corrected ``stars`` and ``sign`` (null where nothing changed), and whether it is a ``keeper``.

    Needs ``folder, stem, photo_id, is_raw, label_stars, synced_stars, stars, edited`` (stars null:
    no sidecar). The JPEG, else the first file, stands for the photo; the baseline is what was synced
    last, else the label's stars; the first member with other stars corrects it. A keeper has two
    stars and a develop or crop.
    """
    c = F.col
    at = F.struct("is_raw", "photo_id")
    g = members.groupBy(F.lower("folder").alias("folder"), F.lower("stem").alias("stem")).agg(
        F.min_by(F.struct("photo_id", F.coalesce("synced_stars", "label_stars", F.lit(0)).alias("baseline")), at).alias("first"),
        F.array_sort(F.collect_list(F.when(c("stars").isNotNull(), F.struct("is_raw", "photo_id", "stars", "edited")))).alias("files"))
    base = c("first.baseline")
    changed = F.try_element_at(F.filter("files", lambda f: f["stars"] != base), F.lit(1))
    edited = F.coalesce(F.try_element_at(F.filter("files", lambda f: f["edited"]), F.lit(1)), F.try_element_at("files", F.lit(1)))
    d = g.select("folder", "stem", c("first.photo_id").alias("photo_id"), base.alias("baseline"), changed.alias("changed"), edited.alias("edited"))
    sign = F.when(c("changed").isNotNull(), F.when(c("changed.stars") > c("baseline"), 1).otherwise(-1))
    keeper = F.coalesce(c("edited.edited") & (c("edited.stars") >= 2), F.lit(False))
    return d.select("folder", "stem", "photo_id", "baseline", c("changed.stars").alias("stars"), sign.alias("sign"), keeper.alias("keeper"))


def catalog_vs_sidecar(catalog: DataFrame, sidecars: DataFrame, examples: int = 5) -> DataFrame:
    """How many catalog rows with a file were reviewed, how many have other stars than the file (no sidecar:
    0), and the first ``examples`` of these by path."""
    j = catalog.join(sidecars.select("path", F.col("stars").alias("file_stars")), "path", "left").withColumn("file_stars", F.coalesce("file_stars", F.lit(0)))
    differs = F.col("rating") != F.col("file_stars")
    first = j.where(differs).orderBy("path").limit(examples).agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return j.agg(F.count("*").alias("reviewed"), F.count_if(differs).alias("pending")).join(first)  # two aggregates of one row each
