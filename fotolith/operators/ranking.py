"""Who wins a burst, by what, and what is said of each photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import half_even

#: Fixed values of the tie-break: a game's weight, the start, the widest margin that counts as a tie.
GAME, START, TIE = 32.0, 1500.0, 0.025


def advantage(a: Column, b: Column) -> Column:
    """How far one photo's faces, sharpness, looks and learned taste are ahead of another's."""
    looks = lambda x: F.when(F.coalesce(x["aesthetic_score"], F.lit(0.0)) == 0, F.lit(0.5)).otherwise(x["aesthetic_score"])
    blur = lambda x: F.coalesce(x["blur_score"], F.lit(0.0))
    sharper = (blur(a) - blur(b)) / F.greatest(blur(a), blur(b), F.lit(1.0))
    taste = F.coalesce(a["taste"] - b["taste"], F.lit(0.0))
    return (b["closed"] - a["closed"]) * 1.8 + (a["smiling"] - b["smiling"]) * 1.2 + (b["away"] - a["away"]) * 0.8 + sharper * 1.5 + (looks(a) - looks(b)) * 2.0 + taste * 1.5


#: What the tie-break reads of a photo.
PLAYER = ("photo_id", "score", "closed", "smiling", "away", "blur_score", "aesthetic_score", "taste")


def with_taste(df: DataFrame) -> DataFrame:
    """A null ``taste`` where there is no such column: no side is ahead by it."""
    return df if "taste" in df.columns else df.withColumn("taste", F.lit(None).cast("double"))


def play(d: DataFrame) -> DataFrame:
    """``d`` with ``elo`` and ``elo_id``: the photos ``a``, ``b`` and, if there is one, ``c`` play each other in this
    order, and ratings move after each game. Three games at most, so all of it is one expression a row."""

    def game(x: Column, y: Column, rx: Column, ry: Column) -> Column:
        """What the first gains and the second loses."""
        adv = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), advantage(x, y)))
        return F.lit(GAME) * (1 / (1 + F.exp(-adv)) - 1 / (1 + F.pow(F.lit(10.0), (ry - rx) / 400)))

    start = F.lit(START)
    d = d.withColumn("_g", game(F.col("a"), F.col("b"), start, start))
    d = d.withColumns({"_ea": start + F.col("_g"), "_eb": start - F.col("_g"), "_ec": start})
    third = F.col("c").isNotNull()
    for one, two in (("a", "c"), ("b", "c")):
        g = F.when(third, game(F.col(one), F.col(two), F.col(f"_e{one}"), F.col(f"_e{two}"))).otherwise(F.lit(0.0))
        d = d.withColumn("_g", g).withColumns({f"_e{one}": F.col(f"_e{one}") + F.col("_g"), f"_e{two}": F.col(f"_e{two}") - F.col("_g")})
    best = F.greatest("_ea", "_eb", F.when(third, F.col("_ec")))
    who = F.when(F.col("_ea") == best, F.col("a.photo_id")).when(F.col("_eb") == best, F.col("b.photo_id")).otherwise(F.col("c.photo_id"))
    return d.withColumns({"elo": best, "elo_id": who}).drop("_g", "_ea", "_eb", "_ec")


def elo_tiebreak(candidates: DataFrame, tie: float = TIE) -> DataFrame:
    """``session_id, burst, photo_id, elo`` of the winner of each burst whose best two candidates are at most
    ``tie`` apart: the best three play each other in rank order. A column ``taste`` (a learned affinity), where
    there is one, counts in the games."""
    w = Window.partitionBy("session_id", "burst").orderBy(F.col("score").desc(), "photo_id")
    top = with_taste(candidates).withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("session_id", "burst").agg(F.array_sort(F.collect_list(F.struct("r", *PLAYER))).alias("_top"))
    a, b, c = (F.try_element_at("_top", F.lit(i)) for i in (1, 2, 3))
    tied = top.where(F.size("_top") > 1).where(half_even(a["score"] - b["score"], 4) <= tie)
    return play(tied.withColumns({"a": a, "b": b, "c": c})).select("session_id", "burst", F.col("elo_id").alias("photo_id"), "elo")


def mark_winners(judged: DataFrame, tie: float = TIE, taste: bool = False) -> DataFrame:
    """:func:`burst_winners` as columns: each photo of ``judged`` with its burst's winner ``rep``, ``margin`` and
    ``decided_by``. All of it is windows over (session, burst), so no row moves that lies by session already."""
    c = F.col
    burst = Window.partitionBy("session_id", "burst")
    order = burst.orderBy(c("alive").desc(), c("score").desc(), "photo_id")
    me = F.when(c("alive"), F.struct(*PLAYER))
    d = with_taste(judged).withColumns({"a": me, "b": F.lead(me, 1).over(order), "c": F.lead(me, 2).over(order), "_r": F.row_number().over(order)})
    d = play(d)
    tied = (c("_r") == 1) & c("b").isNotNull() & (half_even(c("a.score") - c("b.score"), 4) <= tie)
    decider = F.when(F.count("*").over(burst) == 1, F.lit(None).cast("string")).when(tied, "elo").when(c("b").isNull(), "gate").otherwise("taste" if taste else "score")
    won = F.struct(F.when(tied, c("elo_id")).otherwise(c("photo_id")).alias("rep"), F.when(c("b").isNull(), F.lit(1.0)).otherwise(half_even(c("a.score") - c("b.score"), 4)).alias("margin"), decider.alias("decided_by"))
    d = d.withColumn("_won", F.when(c("_r") == 1, won)).withColumn("_won", F.max("_won").over(burst))
    return d.select(*judged.columns, "_won.rep", "_won.margin", "_won.decided_by")


def burst_winners(judged: DataFrame, tie: float = TIE, taste: bool = False) -> DataFrame:
    """``session_id, burst, photo_id, margin, decided_by`` of each burst, of its photos that are ``alive``: the
    best by score, or by the tie-break where two are as good; "gate" where all others were dropped. With
    ``taste`` the score is a learned one, and what it decides says so."""
    keys = ["session_id", "burst"]
    judged = with_taste(judged).select(*keys, "alive", *PLAYER)
    size = judged.groupBy(*keys).agg(F.count("*").alias("n"))
    alive = judged.where("alive")
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "photo_id")
    best = alive.withColumns({"r": F.row_number().over(w), "next": F.lead("score").over(w)}).where("r = 1")
    elo = elo_tiebreak(alive, tie).select(*keys, F.col("photo_id").alias("elo_id"))
    margin = F.when(F.col("next").isNull(), F.lit(1.0)).otherwise(half_even(F.col("score") - F.col("next"), 4))
    decider = F.when(F.col("n") == 1, F.lit(None).cast("string")).when(F.col("elo_id").isNotNull(), "elo").when(F.col("next").isNull(), "gate").otherwise("taste" if taste else "score")
    return best.join(elo, keys, "left").join(size, keys).select(*keys, F.coalesce("elo_id", "photo_id").alias("photo_id"), margin.alias("margin"), decider.alias("decided_by"))


def build_reasons(photos: DataFrame, winners: DataFrame) -> DataFrame:
    """``photo_id, reasons``: why each photo won or lost, as codes. Photos that are alone have none.

    Needs ``session_id, burst, reason`` (of the gates), ``duplicate`` and the face counts. Only what was
    measured is said: a loser's gate first, then how it compares with the winner.
    """
    c, keys = F.col, ["session_id", "burst"]
    n = F.count("*").over(Window.partitionBy(*keys))
    rep = photos.select("photo_id", "closed", "away", "blur_score").join(winners, "photo_id").select(*keys, "decided_by", *[c(x).alias(f"rep_{x}") for x in ("photo_id", "closed", "away", "blur_score")])
    d = photos.withColumn("n", n).join(rep, keys)
    said = lambda text, when: F.when(F.coalesce(when, F.lit(False)), text)
    count = lambda word, x: F.concat(F.lit(f"{word}:"), x.cast("string"))
    won = F.array_compact(F.array(F.concat(F.lit("by:"), "decided_by"), said(F.lit("eyes_open"), (c("valid_faces") > 0) & (c("closed") == 0)), said(count("smiling", c("smiling")), (c("valid_faces") > 0) & (c("smiling") > 0))))
    facts = F.array_compact(F.array(
        said(F.lit("duplicate"), c("duplicate")), said(F.concat(F.lit("gate:"), "reason"), c("reason").isNotNull() & (c("reason") != "looking_away")),
        said(count("closed", c("closed")), (c("closed") > c("rep_closed")) & (F.coalesce("reason", F.lit("")) != "closed_eyes")), said(count("away", c("away")), c("away") > c("rep_away"))))
    lost = F.when(F.size(facts) > 0, facts).when(c("blur_score") < c("rep_blur_score"), F.array(F.lit("less_sharp"))).otherwise(F.array(F.lit("scored_less")))
    reasons = F.when(c("n") == 1, F.array().cast("array<string>")).when(c("photo_id") == c("rep_photo_id"), won).otherwise(lost)
    return d.select("photo_id", *keys, reasons.alias("reasons"))
