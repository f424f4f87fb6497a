"""Dashboards, tilt, learning and review summaries in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import mean
from .rules import half_even

_CHOSEN = ("selected", "highlighted")


def dashboard(files: DataFrame, syncs: DataFrame) -> DataFrame:
    """One row for each project: files collapsed by stem, a chosen member before others, then counts by label, the
    usual number of bursts (18 % of the photos, one at least), how many photos were synced and when last.

    ``files`` has ``folder_id, stem_path, photo_id, label``, ``syncs`` ``folder_id, photo_id, synced_us``.
    """
    c = F.col
    rank = F.when(c("label").isin(*_CHOSEN), 0).otherwise(1)
    one = files.groupBy("folder_id", F.lower("stem_path").alias("stem")).agg(F.min_by("label", F.struct(rank, "photo_id")).alias("label"))
    of = lambda *labels: F.count_if(c("label").isin(*labels))
    g = one.groupBy("folder_id").agg(F.count("*").alias("total"), of(*_CHOSEN).alias("selected"), of("highlighted").alias("highlighted"), of("duplicates").alias("duplicates"), of("blurry").alias("blurry"), of("closed_eyes").alias("closed_eyes"))
    s = syncs.groupBy("folder_id").agg(F.countDistinct("photo_id").alias("synced"), F.max("synced_us").alias("last_synced_us"))
    g = g.join(s, "folder_id", "left").withColumns({"synced": F.coalesce("synced", F.lit(0)), "discarded": c("total") - c("selected")})
    return g.withColumn("bursts", F.greatest(F.lit(1), F.bround(c("total") * 0.18)).cast("long"))


def due_reminders(exports: DataFrame, now_us: int) -> DataFrame:
    """Exported folders to remind of: with photos, not dismissed, and not put off beyond now (a folder that was never
    put off is due from its export on); newest export first."""
    c = F.col
    due = exports.where((c("photos") > 0) & ~F.coalesce(c("dismissed"), F.lit(False)) & (F.coalesce("remind_after", "exported_at", F.lit(0)) <= now_us))
    return due.orderBy(c("exported_at").desc_nulls_last(), "directory")


def tilt(segments: DataFrame, max_tilt: float = 6.0, deadband: float = 0.2, within: float = 1.5, least: float = 20.0) -> DataFrame:
    """``grp, horizontal, vertical, tilt, confidence, needed`` from line segments (``grp, angle, weight``: degrees, length).

    Segments of ``least`` length near 0 or +-90 degrees count, by how far they are off their axis; the weighted
    median, then the weighted mean of what is ``within`` of it; under the ``deadband`` the tilt is 0. The
    confidence is the share of length within one degree of it, less where that length is under 200. A
    group without such segments has zeros. Groups of any size are spread by their distinct angles' windows.
    """
    c = F.col
    a = F.when(c("angle") > 90, c("angle") - 180).when(c("angle") < -90, c("angle") + 180).otherwise(c("angle"))
    flat = F.abs("a") <= max_tilt
    upright = ~flat & (F.abs(F.abs("a") - 90) <= max_tilt)
    off = F.when(flat, c("a")).when(upright, F.when(c("a") > 0, c("a") - 90).otherwise(c("a") + 90))
    s = segments.withColumn("a", a).withColumns({"off": F.when(c("weight") >= least, off), "flat": flat & (c("weight") >= least), "upright": upright & (c("weight") >= least)})
    group = Window.partitionBy("grp")
    near = s.where("off is not null").withColumns({"run": F.sum("weight").over(group.orderBy("off", "weight").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("weight").over(group)})
    near = near.withColumn("median", F.min(F.when(c("run") * 2 >= c("all"), c("off"))).over(group))
    inside = F.when(F.abs(c("off") - c("median")) <= within, c("weight"))
    near = near.withColumn("best", F.sum(inside * c("off")).over(group) / F.sum(inside).over(group))
    g = near.groupBy("grp").agg(F.first("best").alias("best"), F.count_if("flat").alias("horizontal"), F.count_if("upright").alias("vertical"), F.sum(F.when(F.abs(c("off") - c("best")) <= 1.0, c("weight"))).alias("held"), F.first("all").alias("all"))
    held = F.coalesce("held", F.lit(0.0))
    sure = F.least(F.lit(1.0), held / F.greatest(F.lit(1.0), c("all")) * F.least(F.lit(1.0), held / 200))
    g = g.select("grp", "horizontal", "vertical", F.when(F.abs("best") >= deadband, half_even(c("best"), 4)).otherwise(F.lit(0.0)).alias("tilt"), half_even(sure, 3).alias("confidence"), (F.abs("best") >= deadband).alias("needed"))
    return segments.select("grp").distinct().join(g, "grp", "left").na.fill({"horizontal": 0, "vertical": 0, "tilt": 0.0, "confidence": 0.0, "needed": False})


def learning_overview(history: DataFrame, examples: DataFrame, recipes: DataFrame, crops: DataFrame, syncs: DataFrame) -> DataFrame:
    """One row: what was learned so far, each figure from its own table."""
    parts = [
        history.agg(F.count_if(F.col("label") == "positive").alias("positives"), F.count_if(F.col("label") == "negative").alias("negatives"), F.countDistinct("scene").alias("scenes")),
        examples.agg(F.count("*").alias("examples")),
        recipes.agg(F.countDistinct("scene").alias("recipes")),
        crops.agg(half_even(mean(F.col("m_area")) * 100, 0).cast("long").alias("usual_crop_percent")),
        syncs.agg(F.max("synced_us").alias("last_synced_us")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def burst_face_crops(faces: DataFrame, members: DataFrame) -> DataFrame:
    """The crops of each person of a burst, in the order of photo and face; faces that aren't known stand under their
    index. A burst is a few seconds of one session, so its list is short."""
    c = F.col
    who = F.when(c("identity_id").isNotNull(), F.concat(F.lit("person "), c("identity_id").cast("string"))).otherwise(F.concat(F.lit("face "), c("face_index").cast("string")))
    crop = F.struct("photo_id", "face_index", "x", "y", "w", "h")
    return faces.join(members.select("photo_id", "burst"), "photo_id").groupBy("session_id", "burst", who.alias("who")).agg(F.array_sort(F.collect_list(crop)).alias("crops"))


def review_sample(pairs: DataFrame, judged: DataFrame, n: int) -> DataFrame:
    """The ``n`` pairs (``winner, loser``) to judge next: those not judged yet, in the order of a hash of the pair, so that
    a second call gives the same and a larger ``n`` only adds."""
    left = pairs.join(judged.select("winner", "loser"), ["winner", "loser"], "left_anti")
    return left.withColumn("_h", F.md5(F.concat_ws("|", "winner", "loser"))).orderBy("_h", "winner", "loser").limit(n).drop("_h")


def taste_examples(history: DataFrame, duels: DataFrame, syncs: DataFrame, delivered: DataFrame, fed: DataFrame) -> DataFrame:
    """``photo_id, y, source`` of new examples: history labels, both sides of duels, corrections that came back with a sync
    (stars raised or lowered), delivered photos; each photo and sign once a source, without what was ``fed``."""
    c = F.col
    of = lambda df, id, y, source: df.select(c(id).alias("photo_id"), (y if isinstance(y, Column) else F.lit(y)).cast("int").alias("y"), F.lit(source).alias("source"))
    parts = [
        of(history.where(c("label").isin("positive", "negative")), "photo_id", F.when(c("label") == "positive", 1).otherwise(-1), "history"), of(duels, "winner", 1, "duel"), of(duels, "loser", -1, "duel"),
        of(syncs.where("stars <> was"), "photo_id", F.when(c("stars") > c("was"), 1).otherwise(-1), "sync"), of(delivered, "photo_id", 1, "delivered"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("photo_id is not null").distinct().join(fed.select("photo_id", "source"), ["photo_id", "source"], "left_anti").select("photo_id", "y", "source")


def overlap_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two selections (``photo_id``) overlap: sizes, what both have, and its shares of either and of the union."""
    both = a.select("photo_id").distinct().withColumn("a", F.lit(1)).join(b.select("photo_id").distinct().withColumn("b", F.lit(1)), "photo_id", "full")
    g = both.agg(F.count("a").alias("in_a"), F.count("b").alias("in_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"), F.count("*").alias("in_any"))
    share = lambda of: F.coalesce(F.try_divide("in_both", of), F.lit(0.0))
    return g.select("in_a", "in_b", "in_both", share("in_a").alias("of_a"), share("in_b").alias("of_b"), share("in_any").alias("of_any"))


def filter_by_people(photos: DataFrame, faces: DataFrame, ids: list[int], labels: list[str] | None = None) -> DataFrame:
    """Photos that show one of some people; with ``labels`` only those that were so decided."""
    kept = photos if labels is None else photos.where(F.col("label").isin(labels))
    return kept.join(faces.where(F.col("identity_id").isin(ids)).select("photo_id").distinct(), "photo_id", "left_semi")
