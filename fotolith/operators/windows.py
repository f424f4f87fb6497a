"""Session windows: bursts, chapters, ranks and quotas. One shuffle by session carries a whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import half_even, vip_weights

ORDER = ("t_us", "photo_id")


def adaptive_gap(photos: DataFrame, gap: float = 5.0, eps: float = 12.0) -> DataFrame:
    """Gap and distance limits of each session by its median step under a minute, if over 10 are timed."""
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    d = photos.withColumn("step", (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(1e6))
    s = d.groupBy("session_id").agg(F.count("t_us").alias("n"), F.median(F.when(F.col("step") < 60, F.col("step"))).alias("m"))
    dense, sparse = (F.col("n") > 10) & (F.col("m") < 1.5), (F.col("n") > 10) & (F.col("m") > 4)
    g, e = F.lit(float(gap)), F.lit(float(eps))
    return s.select("session_id", F.when(dense, F.least(g, F.lit(2.0))).when(sparse, F.greatest(g, F.lit(6.0))).otherwise(g).alias("gap"), F.when(dense, F.least(e, F.lit(10.0))).when(sparse, F.greatest(e, F.lit(14.0))).otherwise(e).alias("eps"))


def gap_bursts(photos: DataFrame, gap: float = 2.0, sim: float | None = None) -> DataFrame:
    """A new burst where the time since the photo before exceeds ``gap`` seconds, or, with ``sim``, where the
    cosine of ``vec`` to that photo's is below it and both have one."""
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    cut = F.coalesce((F.col("t_us") - F.lag("t_us").over(w)) > int(gap * 1e6), F.lit(True))
    if sim is not None:
        cut = cut | F.coalesce(cosine(F.col("vec"), F.lag("vec").over(w)) < F.lit(sim), F.lit(False))
    return photos.withColumn("_cut", cut.cast("int")).withColumn("burst", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def history_bursts(photos: DataFrame, gap: float = 30.0, sim: float = 0.90) -> DataFrame:
    """Bursts of a folder's past photos, those without a vector left out: the same one as the photo before
    (untimed last) if at most ``gap`` seconds lie between, where both are timed, and their vectors'
    product is at least ``sim``."""
    w = Window.partitionBy("folder_id").orderBy(F.col("t_us").asc_nulls_last(), "photo_id")
    dot = F.aggregate(F.zip_with("vec", F.lag("vec").over(w), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    apart = F.coalesce(F.abs(F.col("t_us") - F.lag("t_us").over(w)) > int(gap * 1e6), F.lit(False))
    cut = F.lag("photo_id").over(w).isNull() | apart | (dot < F.lit(sim))
    d = photos.where("vec is not null").withColumn("_cut", cut.cast("int"))
    return d.withColumn("burst", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def scope_union(history: DataFrame, gap: float = 30.0) -> DataFrame:
    """Photos of reviewed bursts, those that hold a positive, by label: positives, negatives and unreviewed.
    Bursts are a folder's photos at most ``gap`` seconds apart; an untimed photo is one of its own."""
    w = Window.partitionBy("folder_id").orderBy(F.col("t_us").asc_nulls_last(), "photo_id")
    cut = (~F.coalesce(F.col("t_us") - F.lag("t_us").over(w) <= int(gap * 1e6), F.lit(False))).cast("int")
    d = history.withColumn("_cut", cut).withColumn("_burst", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_kept", F.max((F.col("label") == "positive").cast("int")).over(Window.partitionBy("folder_id", "_burst")))
    return d.where((F.col("_kept") == 1) & F.col("label").isin("positive", "negative", "unreviewed")).drop("_cut", "_burst", "_kept")


def chronological(photos: DataFrame) -> DataFrame:
    """Each photo's place in its session by capture time, those without one first, and in the order of
    development, in which they come last."""
    s = Window.partitionBy("session_id")
    place = lambda t: F.row_number().over(s.orderBy(t, "photo_id")).cast("long")
    return photos.withColumns({"place": place(F.col("t_us").asc_nulls_first()), "develop_place": place(F.col("t_us").asc_nulls_last())})


def chapters_by_gap(photos: DataFrame, minutes: float = 15) -> DataFrame:
    """Detail photos are b-roll and don't move the clock; others open a chapter after a pause. Untimed
    photos stay in the chapter that is open."""
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    main = F.col("scene_type") != "detail"
    before = F.last(F.when(main, F.col("t_us")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(main & F.col("t_us").isNotNull() & (before.isNull() | (F.col("t_us") - before > int(minutes * 60e6))), 1).otherwise(0)
    n = F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return photos.withColumn("_cut", cut).withColumn("chapter", F.when(main, F.greatest(n, F.lit(1)).cast("long")).otherwise(F.lit(0))).drop("_cut")


def base_representative(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id", "burst").orderBy((F.lit(0.6) * F.col("blur_score") + F.lit(40.0) * F.col("aesthetic_score")).desc(), "photo_id")
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def winner_and_margin(df: DataFrame) -> DataFrame:
    """Best photo of each burst and how far it leads, 1 where it is alone."""
    w = Window.partitionBy("session_id", "burst").orderBy(F.col("score").desc(), "photo_id")
    r = df.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("r = 1")
    return r.withColumn("margin", F.when(F.col("next").isNull(), F.lit(1.0)).otherwise(half_even(F.col("score") - F.col("next"), 4))).drop("r", "next")


#: Least scores of an alternate by how much of a burst is to be delivered (fixed values).
ALTERNATE_LEVELS = {"few": 0.55, "normal": 0.42, "more": 0.30}


def orientation_alternates(df: DataFrame, level: str = "normal") -> DataFrame:
    """Of each burst the best selectable photo, the best selectable one of the other orientation if it scores
    enough for the ``level``, and at "more" also the next one of the winner's orientation if it scores
    1.15 times that. ``selectable`` rows come first (a column; all, where there is none); a burst without
    any still has its best photo."""
    threshold = ALTERNATE_LEVELS[level]
    can = F.col("selectable") if "selectable" in df.columns else F.lit(True)
    d = df.withColumns({"tall": F.col("height") > F.col("width"), "can": can})
    w = Window.partitionBy("session_id", "burst").orderBy(F.col("can").desc(), F.col("score").desc(), "photo_id")
    d = d.withColumn("r", F.row_number().over(w)).withColumn("top_tall", F.first("tall").over(w))
    o = Window.partitionBy("session_id", "burst", "tall").orderBy(F.col("can").desc(), F.col("score").desc(), "photo_id")
    d = d.withColumn("o", F.row_number().over(o))
    enough = lambda x: F.col("can") & (F.col("score") >= F.lit(x))
    role = F.when(F.col("r") == 1, "winner").when((F.col("tall") != F.col("top_tall")) & (F.col("o") == 1) & enough(threshold), "alternate")
    if level == "more":
        role = F.when((F.col("tall") == F.col("top_tall")) & (F.col("o") == 2) & enough(threshold * 1.15), "alternate").otherwise(role)
    return d.withColumn("role", role).where("role is not null").drop("r", "o", "top_tall", "tall", "can")


def highlights(df: DataFrame, frac: float = 0.10) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("session_id"))
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("score").desc(), "photo_id"))
    return df.withColumn("r", r).withColumn("n", n).where(F.col("r") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * F.lit(frac)))).drop("r", "n")


def trim_to_target(df: DataFrame, target: float = 0.35, tolerance: float = 0.05) -> DataFrame:
    """Demote the worst unprotected non-winners of bursts with two or more selected, down to the target.

    Needs ``selected``, ``protected``, ``winner``; the demoted rows come out."""
    s, b = Window.partitionBy("session_id"), Window.partitionBy("session_id", "burst")
    sel = F.col("selected").cast("int")
    d = df.withColumns({"n": F.count("*").over(s), "chosen": F.sum(sel).over(s), "mates": F.sum(sel).over(b)}).withColumn("goal", F.bround(F.col("n") * F.lit(target)))
    can = d.where("selected and not winner and not protected and mates >= 2").where(F.col("chosen") > F.bround(F.col("goal") * F.lit(1 + tolerance)))
    r = F.row_number().over(s.orderBy("score", F.col("photo_id").desc()))
    return can.withColumn("r", r).where(F.col("r") <= F.col("chosen") - F.col("goal")).select("photo_id", "session_id")


def prune_burst(df: DataFrame) -> DataFrame:
    """One winner (two in bursts of 8 or more whose second scores .75), then one or two alternates."""
    w = Window.partitionBy("session_id", "burst")
    d = df.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("score").desc(), "photo_id")))
    wins = F.when((F.col("n") >= 8) & (F.max(F.when(F.col("r") == 2, F.col("score"))).over(w) >= 0.75), 2).otherwise(1)
    alts = F.when(F.col("n") >= 4, 2).when(F.col("n") >= 2, 1).otherwise(0)
    return d.withColumn("w", wins).withColumn("role", F.when(F.col("r") <= F.col("w"), "winner").when(F.col("r") <= F.col("w") + alts, "alternate").otherwise("rejected")).drop("n", "r", "w")


def lab_classes(df: DataFrame, alt: float = 0.90, eye: float = 0.5) -> DataFrame:
    w = Window.partitionBy("session_id", "burst")
    d = df.withColumn("best", F.max("score").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("score").desc(), "photo_id")))
    c = F.when((F.col("focus") < 3) | (F.col("eye") < 0), "rejected").when(F.col("r") == 1, "top_pick").when((F.col("score") >= F.col("best") * alt) & (F.col("eye") >= eye), "alternate").otherwise("duplicate")
    return d.withColumn("lab_class", c).drop("best", "r")


def quota_fill(df: DataFrame, frac: float = 0.35, heroes: int = 55) -> DataFrame:
    """Winners first, then alternates (those of another orientation than the burst's winner before others),
    then the rest by score, to a share of each session; the first are heroes."""
    s = Window.partitionBy("session_id")
    tier = F.when(F.col("role") == "winner", 0).when(F.col("role") == "alternate", 1).otherwise(2)
    tall = F.col("height") > F.col("width")
    won = F.max(F.when(F.col("role") == "winner", F.struct("score", (-F.col("photo_id")).alias("id"), tall.alias("tall")))).over(Window.partitionBy("session_id", "burst"))
    d = df.withColumn("other", (F.col("role") == "alternate") & F.coalesce(won["tall"] != tall, F.lit(False)))
    d = d.withColumn("r", F.row_number().over(s.orderBy(tier, F.col("other").desc(), F.col("score").desc(), "photo_id"))).withColumn("n", F.count("*").over(s))
    return d.where(F.col("r") <= F.floor(F.col("n") * F.lit(frac))).withColumn("hero", F.col("r") <= heroes).drop("n", "other").withColumn("r", F.col("r").cast("long"))


def chapter_medoid(members: DataFrame) -> DataFrame:
    """The photo in the middle of each chapter in time order, with the chapter's span and size."""
    w = Window.partitionBy("session_id", "chapter")
    d = members.withColumn("r", F.row_number().over(w.orderBy(*ORDER))).withColumn("n", F.count("*").over(w))
    d = d.withColumn("start_us", F.min("t_us").over(w)).withColumn("end_us", F.max("t_us").over(w))
    return d.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("session_id", "chapter", "photo_id", "start_us", "end_us", "n")


def even_stride_sample(df: DataFrame, n: int = 30) -> DataFrame:
    """``n`` rows of each session spread evenly over its ranks (all of a smaller session)."""
    s = Window.partitionBy("session_id")
    d = df.withColumn("i", F.row_number().over(s.orderBy(F.col("score").desc(), "photo_id")) - 1).withColumn("m", F.count("*").over(s))
    first = F.ceil(F.col("i") * n / F.col("m"))
    return d.where((first < n) & (F.floor(first * F.col("m") / n) == F.col("i"))).drop("m").withColumn("i", F.col("i").cast("long"))


def last_n_sessions(df: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.col("created").desc(), F.col("month").desc())
    return df.withColumn("r", F.row_number().over(w).cast("long")).where(F.col("r") <= n)


def duel_queue(df: DataFrame) -> DataFrame:
    """Bursts of two or more: the representative first, then by score."""
    w = Window.partitionBy("session_id", "burst")
    d = df.withColumn("n", F.count("*").over(w)).where("n > 1")
    rep = F.row_number().over(w.orderBy((F.lit(0.6) * F.col("blur_score") + F.lit(40.0) * F.col("aesthetic_score")).desc(), "photo_id"))
    d = d.withColumn("rep", rep == 1)
    return d.withColumn("place", F.row_number().over(w.orderBy(F.col("rep").desc(), F.col("score").desc(), "photo_id")).cast("long"))


def chapter_breaks(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    was = F.lag("chapter").over(w)
    return df.withColumn("header", was.isNull() | (was != F.col("chapter")))


def calibration_queue(faces: DataFrame, labels: DataFrame, limit: int = 50, min_px: int = 40) -> DataFrame:
    return faces.where((F.col("w") >= min_px) & F.col("valid")).join(labels.select("photo_id").distinct(), "photo_id", "left_anti").orderBy(F.col("confidence"), "photo_id", "face_index").limit(limit)


def pending_reminders(state: DataFrame, now: str) -> DataFrame:
    return state.where((F.col("total") > 0) & (F.col("created") <= F.lit(now).cast("date"))).orderBy(F.col("created").desc())


def library_listing(projects: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lower("directory")).orderBy(F.col("last_access").desc(), "directory")
    return projects.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy(F.col("last_access").desc())


def folder_finalists(df: DataFrame, n: int = 3) -> DataFrame:
    """Top photos of each folder among those with open eyes; of all, where fewer than two have."""
    f = Window.partitionBy("folder_id")
    d = df.withColumn("open", F.sum((~F.col("closed")).cast("int")).over(f)).where((F.col("open") < 2) | ~F.col("closed"))
    w = f.orderBy(F.col("aesthetic_score").desc(), "photo_id")
    return d.withColumn("r", F.row_number().over(w).cast("long")).where(F.col("r") <= n).drop("open")


#: What gates say of the photos that they drop.
REASONS = ("flash_misfire", "closed_eyes", "looking_away", "vip_no_smile", "soft_face")
#: Limits of the gates (fixed values).
EAR_CLOSED, BLINK_CLOSED, GAZE_OUT, YAW_OUT, SMILING, SOFT, VIP_SHARE = 0.18, 0.5, 0.35, 0.5, 0.35, 0.5, 0.35


def gate_figures(faces: DataFrame, vip_ids: list[int] | None = None, alike: bool = False) -> DataFrame:
    """What the gates read of each photo's valid faces: extremes of all and of its leading faces (known ones,
    else those of a share of the largest face; all, if none leads or with ``alike``), and the least sharp
    leading face."""
    photo = Window.partitionBy("photo_id")
    f = (faces.withColumn("weight", F.lit(1.0)) if alike else vip_weights(faces, vip_ids)).withColumn("_top", F.max(F.when(F.col("valid"), F.col("weight"))).over(photo))
    lead = F.col("valid") & F.when(F.col("_top") >= 3, F.col("weight") >= 3).otherwise(F.col("weight") >= VIP_SHARE)
    f = f.withColumn("_lead", lead).withColumn("_lead", F.col("valid") & (F.col("_lead") | ~F.max("_lead").over(photo)))
    of = lambda who, c: F.when(F.col(who), c)
    figures = []
    for name, who in (("vip", "_lead"), ("all", "valid")):
        figures += [F.min(of(who, F.col("ear"))).alias(f"{name}_ear"), F.max(of(who, F.col("blink"))).alias(f"{name}_blink"), F.max(of(who, F.col("gaze_out"))).alias(f"{name}_gaze"), F.max(of(who, F.abs("yaw"))).alias(f"{name}_yaw")]
    sharp = F.coalesce(F.min(F.when(F.col("weight") >= VIP_SHARE, F.col("sharpness"))), F.min("sharpness"))
    smile = F.max(of("_lead", F.col("smile_score")))
    return f.groupBy("photo_id").agg(*figures, smile.alias("vip_smile"), sharp.alias("face_sharp"), F.array_sort(F.collect_set(of("valid", F.col("identity_id")))).alias("people"))


def technical_gates(photos: DataFrame, faces: DataFrame, vip_ids: list[int] | None = None, relaxed: bool = False) -> DataFrame:
    """Staged gates inside bursts of two or more. A stage drops those that fail only where some photo
    still in passes and some fails; the first reason stays. Each stage rewrites ``alive`` over the
    same window, so one exchange by session and burst carries them all.

    Stages: flash misfire (against the burst's median light), eyes of the leading faces, of all, gaze of
    the leading faces, of all, a leading face that smiles (not where ``relaxed``), soft faces (against
    the median of those still in).
    """
    return apply_gates(photos.join(gate_figures(faces, vip_ids), "photo_id", "left"), relaxed).select("photo_id", "session_id", "burst", "alive", "reason")


def apply_gates(photos: DataFrame, relaxed: bool = False) -> DataFrame:
    """Photos that have :func:`gate_figures` with ``n`` (photos of the burst), ``alive`` and ``reason``; see
    :func:`technical_gates`."""
    w = Window.partitionBy("session_id", "burst")
    d = photos.withColumn("n", F.count("*").over(w)).withColumns({"alive": F.lit(True), "reason": F.lit(None).cast("string")})
    c = F.col
    mid = F.median("lum").over(w)
    soft = F.median(F.when(c("alive"), c("face_sharp"))).over(w)
    eyes = lambda who: ~((c(f"{who}_ear") < EAR_CLOSED) | (c(f"{who}_blink") > BLINK_CLOSED))
    gaze = lambda who: ~((c(f"{who}_gaze") > GAZE_OUT) | (c(f"{who}_yaw") > YAW_OUT))
    stages = [("flash_misfire", ~((mid >= 0.09) & (c("lum") < mid * 0.4))), ("closed_eyes", eyes("vip")), ("closed_eyes", eyes("all")), ("looking_away", gaze("vip")), ("looking_away", gaze("all"))]
    if not relaxed:  # without faces nobody smiles
        stages.append(("vip_no_smile", F.coalesce(c("vip_smile"), F.lit(0.0)) >= SMILING))
    for name, passes in [*stages, ("soft_face", c("face_sharp") >= soft * SOFT)]:
        d = d.withColumn("ok", F.coalesce(passes, F.lit(True)))
        good = F.count_if(c("alive") & c("ok")).over(w)
        bad = F.count_if(c("alive") & ~c("ok")).over(w)
        d = d.withColumn("drop", (c("n") > 1) & (good > 0) & (bad > 0) & c("alive") & ~c("ok"))
        d = d.withColumns({"reason": F.when(c("drop"), F.lit(name)).otherwise(c("reason")), "alive": c("alive") & ~c("drop")})
    return d.drop("ok", "drop")


def policy_gates(photos: DataFrame, faces: DataFrame, policies: dict[str, dict], gap: float = 2.0) -> DataFrame:
    """Photos in bursts, and for each policy x ``alive_x`` and ``reason_x``: what its gates say. A policy is
    given by its options of :func:`gate_figures`. Photos meet the figures of all policies by photo_id; then
    they move once, by session."""
    met = photos
    for x, given in policies.items():
        figures = gate_figures(faces, **given).drop("people")
        names = [c for c in figures.columns if c != "photo_id"]
        met = met.join(figures.select("photo_id", F.struct(*names).alias(f"_{x}")), "photo_id", "left")
    d = gap_bursts(met, gap)
    for x in policies:
        d = apply_gates(d.select("*", f"_{x}.*")).drop("n", f"_{x}", *names).withColumnsRenamed({"alive": f"alive_{x}", "reason": f"reason_{x}"})
    return d
