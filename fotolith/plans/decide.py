"""The decision pipeline: photos to labelled decisions, one lineage by session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators import ranking, rules, windows
from ..operators.sessions import kind_of, uncovered

#: How much of a session is to be delivered by level (fixed values).
TARGETS = {"few": 0.25, "normal": 0.35, "more": 0.50}
TOP_SHARE = 0.10
#: Photos a task takes, more only where a session has more: its windows each hold their rows.
TASK_ROWS = 50_000

c = F.col


def _session() -> WindowSpec:
    return Window.partitionBy("session_id")


def _burst() -> WindowSpec:
    return Window.partitionBy("session_id", "burst")


def by_session(d: DataFrame, rows: int) -> DataFrame:
    """``d`` moved by session into as many parts as its ``rows`` need, if they are more than Spark's own number."""
    parts = -(-rows // TASK_ROWS)
    return d.repartition(parts, "session_id") if parts > int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) else d


def paced(d: DataFrame, lo: float = 0.7, hi: float = 1.4) -> DataFrame:
    """``norm``: the score scaled by how the chapter's median stands to the session's, over photos that ``can``."""
    able = F.when(c("can"), c("score"))
    chapter, session = F.median(able).over(Window.partitionBy("session_id", "chapter")), F.median(able).over(_session())
    d = d.withColumns({"_chapter": chapter, "_session": session})
    raw = c("_session").isNull() | c("_chapter").isNull() | (c("_session") <= 0) | (c("_chapter") <= 0.05)
    scale = F.greatest(F.lit(lo), F.least(F.lit(hi), c("_session") / c("_chapter")))
    return d.withColumn("norm", F.when(raw, c("score")).otherwise(c("score") * scale)).drop("_chapter", "_session")


def choose(d: DataFrame, level: str) -> DataFrame:
    """``chosen``: of each burst with a photo that ``can``, its representative (the winner, or else the best of
    those), the best of the other orientation if it is good enough, and at "more" one more of the same."""
    enough = windows.ALTERNATE_LEVELS[level]
    d = d.withColumns({"wide": c("width") >= c("height"), "_rep_can": F.max(c("can") & (c("photo_id") == c("rep"))).over(_burst()),
                       "_r": F.row_number().over(_burst().orderBy(c("can").desc(), c("norm").desc(), "photo_id"))})
    d = d.withColumn("first", c("can") & F.when(c("_rep_can"), c("photo_id") == c("rep")).otherwise(c("_r") == 1))
    d = d.withColumn("_wide", F.max(F.when(c("first"), c("wide"))).over(_burst())).withColumn("_side", F.when(c("can") & ~c("first"), c("wide") == c("_wide")))
    best = F.row_number().over(Window.partitionBy("session_id", "burst", "_side").orderBy(c("norm").desc(), "photo_id")) == 1
    more = ~c("_side") & (c("norm") >= enough)
    if level == "more":
        more = more | c("_side") & (c("norm") >= enough * 1.15)
    d = d.withColumn("_best", best).withColumn("chosen", c("first") | F.coalesce(c("_best") & more, F.lit(False)))
    return d.drop("_rep_can", "_r", "_wide", "_side", "_best", "wide", "first")


def trim(d: DataFrame, target: float, tolerance: float = 0.05) -> DataFrame:
    """``high`` (the top tenth of the chosen), ``demoted``: where a session has too many chosen photos, the worst
    of bursts with two or more, but no burst's best one, no lone photo, no leading person's, none of the top."""
    count = lambda x, w: F.count_if(x).over(w)
    d = d.withColumns({"_n": count(c("chosen"), _session()), "_mates": count(c("chosen"), _burst()), "_all": F.count("*").over(_session())})
    rank = F.row_number().over(_session().orderBy(c("chosen").desc(), c("score").desc(), "photo_id"))
    top = F.row_number().over(_burst().orderBy(c("chosen").desc(), c("score").desc(), "photo_id")) == 1
    d = d.withColumns({"high": c("chosen") & (rank <= F.greatest(F.lit(1.0), F.bround(c("_n") * F.lit(TOP_SHARE)))), "_top": top, "_goal": F.bround(c("_all") * F.lit(target))})
    over = c("_n") > F.bround(c("_goal") * F.lit(1 + tolerance))
    d = d.withColumn("_can_go", over & c("chosen") & (c("_mates") >= 2) & ~c("_top") & ~c("high") & (c("vip") == 0))
    place = F.row_number().over(_session().orderBy(c("_can_go").desc(), "score", "photo_id"))
    return d.withColumn("demoted", c("_can_go") & (place <= c("_n") - c("_goal"))).drop("_n", "_mates", "_all", "_top", "_goal", "_can_go")


def final_labels(d: DataFrame) -> Column:
    """A photo shows closed eyes where more of its faces are bad than of its burst's winner, and it isn't chosen."""
    bad = c("closed") + c("away")
    of_rep = F.max(F.when(c("photo_id") == c("rep"), bad)).over(_burst())
    return rules.final_label(c("error"), c("trash"), bad > of_rep, c("high"), c("chosen") & ~c("demoted"), c("demoted"))


def decide(photos: DataFrame, faces: DataFrame, expressions: DataFrame, gap: float = 4.0, level: str = "normal", coverage: bool = True) -> DataFrame:
    """Bursts, gates, scores with their bonuses, winners, alternates, top tenth, trim, labels, coverage of people.

    ``photos`` has its light as ``lum`` and ``clip``, ``blur_flag`` and ``sharp_anywhere`` (how sharp its sharpest
    part is), ``error``, and may have ``taste``; ``expressions`` the counts of a photo's valid faces
    (valid_faces, closed, away, smiling, max_yaw, gaze, vip).

    Photos meet the figures of their faces by photo_id; then they move once, by session, and all steps are
    windows over it or over its bursts and chapters. A session is a folder's day, so it fits in a task;
    photos are counted before, so that tasks grow in number, not in size.
    The last step, which covers people in the order they are first seen, takes a session's rows as
    one group from where they lie.
    """
    none = {"valid_faces": 0, "closed": 0, "away": 0, "smiling": 0, "max_yaw": 0.0, "gaze": 0.5, "vip": 0}
    met = photos.join(expressions, "photo_id", "left").fillna(none).join(windows.gate_figures(faces), "photo_id", "left")
    met = by_session(met, photos.select("photo_id").count())
    d = windows.apply_gates(windows.chapters_by_gap(windows.gap_bursts(met, gap)))
    d = d.withColumn("score", rules.hero_bonus(rules.cold_score(c("blur_score"), c("aesthetic_score")), c("vip") > 0, c("n"), c("valid_faces"), c("max_yaw"), c("gaze"), c("closed"), c("away"), c("smiling")))
    d = ranking.mark_winners(d)
    d = d.withColumn("trash", rules.trash_flag(c("blur_flag"), c("blur_score"), c("sharp_anywhere"), c("lum"), c("clip"), c("reason"))).withColumn("can", ~c("error") & ~c("trash"))
    d = trim(choose(paced(d), level), TARGETS[level])
    d = d.withColumn("label", final_labels(d)).select("photo_id", "session_id", c("burst").cast("long").alias("burst"), "score", "label", "reason", "decided_by", "margin", "people", (c("chosen") & ~c("demoted")).alias("kept"))
    if coverage:
        kinds = dict(d.dtypes)
        schema = ", ".join(f"{x} {kinds[x]}" for x in ("photo_id", "session_id", "burst", "score", "label", "reason", "decided_by", "margin"))

        def cover(pdf: pd.DataFrame) -> pd.DataFrame:
            seen = pdf[["photo_id", "score", "kept"]].assign(identity_id=pdf["people"]).explode("identity_id").dropna(subset=["identity_id"])
            needed = set(uncovered(seen))
            say = pdf["photo_id"].isin(needed) & ~pdf["label"].isin(["selected", "highlighted"])
            return pdf.assign(label=pdf["label"].mask(say, "recommended")).drop(columns=["people", "kept"])

        d = d.groupBy("session_id").applyInPandas(cover, schema)
    return d.select("photo_id", "session_id", "burst", F.round("score", 6).alias("score"), "label", "reason", "decided_by", "margin")
