"""Order-dependent operators: folds over one session's rows, each session in its own group.

A session is one folder's shoot of a day, so a group stays small whatever the archive's size.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kind_of(df: DataFrame) -> str:
    return df.schema["session_id"].dataType.simpleString()


def assign_identities(faces: DataFrame, threshold: float = 0.38) -> DataFrame:
    """Faces in order join the nearest identity under the cosine distance, else open one; an identity's
    centre stays its first vector. Faces without a vector get -1."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["photo_id", "face_index"], kind="stable")
        centres = np.zeros((0, 0))
        out = []
        for v in pdf["vec"]:
            if v is None or not len(v):
                out.append(-1)
                continue
            x = np.asarray(v, float)
            x = x / (np.linalg.norm(x) or 1.0)
            d = 1 - centres @ x if len(centres) else np.zeros(0)
            if len(d) and d.min() < threshold:
                out.append(int(d.argmin()))
            else:
                centres = x[None] if not len(centres) else np.vstack([centres, x])
                out.append(len(centres) - 1)
        return pdf.assign(identity_id=np.array(out, np.int64))[["session_id", "photo_id", "face_index", "identity_id"]]

    return faces.select("session_id", "photo_id", "face_index", "vec").groupBy("session_id").applyInPandas(fold, f"session_id {kind_of(faces)}, photo_id long, face_index int, identity_id long")


def light_sessions(photos: DataFrame, run: int = 4, dwb: float = 12.0, dev: float = 1.0) -> DataFrame:
    """Light changes with hysteresis: ``run`` photos in a row that stray from the open session's upper
    medians open a new one; fewer are absorbed."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_us", "photo_id"], kind="stable")
        rows = pdf[["global_lum", "wb_temp", "wb_tint"]].to_numpy(float)
        out = np.zeros(len(rows), np.int64)
        session, stray = 0, []
        members: list[list[float]] = [[], [], []]  # sorted, so that a median costs no sort

        def join(own: tuple) -> None:
            for j in range(3):
                if not np.isnan(own[j]):
                    insort(members[j], own[j])

        for i, r in enumerate(rows):
            ev = np.log2(max(r[0], 1e-4) / 0.18)
            mid = [x[len(x) // 2] if x else None for x in members]
            far = bool(members[0]) and (abs(ev - mid[0]) > dev or any(not np.isnan(r[j]) and mid[j] is not None and abs(r[j] - mid[j]) > dwb for j in (1, 2)))
            own = (ev, r[1], r[2])
            if not far:
                for _, s in stray:
                    join(s)
                join(own)
                stray = []
            else:
                stray.append((i, own))
                if len(stray) >= run:
                    session += 1
                    for j, _ in stray:
                        out[j] = session
                    members, own_run, stray = [[], [], []], stray, []
                    for _, s in own_run:
                        join(s)
                    continue
            out[i] = session
        return pdf.assign(light_session=out)[["session_id", "photo_id", "light_session"]]

    return photos.select("session_id", "photo_id", "t_us", "global_lum", "wb_temp", "wb_tint").groupBy("session_id").applyInPandas(fold, f"session_id {kind_of(photos)}, photo_id long, light_session long")


def resolve_duplicates(photos: DataFrame, pairs: DataFrame, gap: float = 3.0) -> DataFrame:
    """Greedy masters over duplicate pairs in time order (untimed last): a photo already marked can't be a
    master, and a timed one takes none behind the first photo that is over ``gap`` seconds later, so no
    untimed ones either where there is such a photo."""
    order = Window.partitionBy("session_id").orderBy(F.col("t_us").asc_nulls_last(), "photo_id")
    placed = photos.select("photo_id", "t_us", F.row_number().over(order).alias("place"), F.max("t_us").over(Window.partitionBy("session_id")).alias("last"))
    one, two = (placed.select(*[F.col(c).alias(f"{x}_{c}") for c in placed.columns]) for x in "ab")
    both = pairs.join(one, pairs["a"] == one["a_photo_id"]).join(two, pairs["b"] == two["b_photo_id"])
    swap = F.col("a_place") > F.col("b_place")
    pick = lambda c: F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    cut = F.col("t_us").isNotNull() & F.when(swap, F.col("a_t_us")).otherwise(F.col("b_t_us")).isNull() & (pick("last") - F.col("t_us") > int(gap * 1e6))
    both = both.withColumns({"t_us": pick("t_us"), "first": pick("photo_id"), "place": pick("place"), "second": F.when(swap, F.col("a_photo_id")).otherwise(F.col("b_photo_id")), "to": F.greatest("a_place", "b_place")})
    p = both.where(~F.coalesce(cut, F.lit(False))).select("session_id", F.col("first").alias("a"), F.col("second").alias("b"), "place", "to")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        of: dict[int, int] = {}
        for a, b in pdf.sort_values(["place", "to"])[["a", "b"]].to_numpy():
            if a not in of and b not in of:
                of[int(b)] = int(a)
        out = pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]] * len(of), "photo_id": np.array(list(of), np.int64), "master": np.array(list(of.values()), np.int64)})
        return out.astype({"session_id": object})

    return p.groupBy("session_id").applyInPandas(fold, f"session_id {kind_of(p)}, photo_id long, master long")


def leader_clusters(photos: DataFrame, threshold: int = 10, key: str = "session_id") -> DataFrame:
    """In order, a photo without a cluster leads one and takes all later ones within the distance."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_us", "photo_id"])
        h = pdf["phash"].to_numpy(np.int64).view(np.uint64)
        out = np.full(len(h), -1, np.int64)
        n = 0
        for i in range(len(h)):
            if out[i] < 0:
                out[(out < 0) & (np.arange(len(h)) >= i) & (np.bitwise_count(h ^ h[i]) <= threshold)] = n
                n += 1
        return pdf.assign(cluster=out)[["session_id", "photo_id", "cluster"]]

    return photos.select("session_id", "photo_id", "t_us", "phash").groupBy(key).applyInPandas(fold, f"session_id {kind_of(photos)}, photo_id long, cluster long")


def uncovered(seen: pd.DataFrame, min_seen: int = 3) -> list[int]:
    """The photos of one session (``photo_id, identity_id, score, kept``, a row a person) that cover people whom no
    kept one shows; see :func:`coverage_promote`."""
    people = seen.groupby("identity_id")["photo_id"].agg(["count", "min"]).reset_index()
    covered = set(seen.loc[seen["kept"], "identity_id"])
    out = []
    for who in people[people["count"] >= min_seen].sort_values(["min", "identity_id"])["identity_id"]:
        if who not in covered:
            own = seen[seen["identity_id"] == who].sort_values(["score", "photo_id"], ascending=[False, True])
            out.append(int(own["photo_id"].iloc[0]))
            covered |= set(seen.loc[seen["photo_id"] == out[-1], "identity_id"])
    return out


def coverage_promote(identities: DataFrame, selected: DataFrame, scores: DataFrame, min_seen: int = 3) -> DataFrame:
    """People seen in ``min_seen`` photos of whom none is selected, in order of first sight (then id): their best
    photo is promoted and covers whom else it shows."""
    d = identities.select("session_id", "photo_id", "identity_id").distinct().join(scores.select("photo_id", "score"), "photo_id").join(selected.select("photo_id").distinct().selectExpr("photo_id", "true AS chosen"), "photo_id", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = uncovered(pdf.assign(kept=pdf["chosen"].notna()), min_seen)
        return pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]] * len(out), "photo_id": np.array(out, np.int64)}).astype({"session_id": object})

    return d.groupBy("session_id").applyInPandas(fold, f"session_id {kind_of(d)}, photo_id long")
