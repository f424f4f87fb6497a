"""Chapters of an event by time and look."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pauses in minutes, look changes, and from how many photos or minutes on they count.
PAUSE, STRONG, MILD, LOOKED, SETTLED, MINUTES, MAIN = 5.0, 0.18, 0.12, 5, 10, 3.0, 8


def storyline_segments(photos: DataFrame) -> DataFrame:
    """``photo_id, session_id, segment``: numbered from 1 in each session, 0 for details taken out.

    A pause of over five minutes cuts, by windows. Inside what it leaves, a change of look does: the
    cosine distance to the mean of the last three vectors of the running segment, over .18 from five
    photos on, over .12 from ten photos and three minutes on; this fold runs on one stretch without a
    pause at a time. Details leave segments that have eight others. Untimed photos stay out.
    """
    kind = photos.schema["session_id"].dataType.simpleString()
    w = Window.partitionBy("session_id").orderBy("t_us", "photo_id")
    pause = F.coalesce(F.col("t_us") - F.lag("t_us").over(w) > int(PAUSE * 60e6), F.lit(True)).cast("int")
    d = photos.where("t_us is not null").select("photo_id", "session_id", "t_us", "scene_type", "vec", pause.alias("cut"))
    d = d.withColumn("stretch", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_us", "photo_id"], kind="stable")
        part, size, began = 0, 0, 0
        recent: list[np.ndarray] = []
        out = np.zeros(len(pdf), np.int64)
        for i, (t, v) in enumerate(zip(pdf["t_us"], pdf["vec"], strict=True)):
            x = None if v is None or not len(v) else np.asarray(v, float)
            if size >= LOOKED and x is not None and recent:
                mean = sum(recent) / len(recent)
                norm = sqrt(mean @ mean)
                change = 1 - float(x @ mean) / norm if norm > 0 else 0.0
                if change > STRONG or size >= SETTLED and t - began >= MINUTES * 60e6 and change > MILD:
                    part, size, recent = part + 1, 0, []
            if not size:
                began = t
            size += 1
            if x is not None:
                recent = [*recent[-2:], x]
            out[i] = part
        return pdf.assign(part=out)[["photo_id", "session_id", "t_us", "scene_type", "stretch", "part"]]

    parts = d.groupBy("session_id", "stretch").applyInPandas(fold, f"photo_id long, session_id {kind}, t_us long, scene_type string, stretch long, part long")
    # By session first: the parts of a session then lie where they are counted, and rows move once.
    parts = parts.withColumn("number", F.dense_rank().over(Window.partitionBy("session_id").orderBy("stretch", "part")))
    own = Window.partitionBy("session_id", "stretch", "part")
    main = F.col("scene_type").isNull() | (F.col("scene_type") != "detail")
    broll = ~main & (F.count_if(main).over(own) >= MAIN)
    return parts.withColumn("segment", F.when(broll, F.lit(0)).otherwise(F.col("number")).cast("long")).select("photo_id", "session_id", "segment")


def apply_overrides(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """Move photos to chapters that exist (other overrides are ignored), with the chapter's new size;
    chapters that are left empty are gone. Medoids and times stay as they were."""
    keys = ["session_id", "chapter"]
    known = members.select("session_id", F.col("chapter").alias("target")).distinct()
    home = members.select("photo_id", "session_id")
    moves = overrides.join(home, "photo_id").join(known, ["session_id", "target"], "left_semi").select("photo_id", "target")
    moved = members.join(moves, "photo_id", "left").withColumn("chapter", F.coalesce("target", "chapter")).drop("target")
    return moved.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
