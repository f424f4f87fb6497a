"""Reports: totals, histograms and comparisons, each one pass of partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, mean, with_quantiles

_SIX = lambda c: F.round(c, 6)


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """``figure, value, n`` of several columns at once; missing values don't count."""
    cells = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null").groupBy("figure", "value").agg(F.count("*").alias("n"))


def choice_totals(df: DataFrame) -> DataFrame:
    c = F.col
    return df.agg(F.count("*").alias("photos"), F.count_if(c("rating") >= 1).alias("starred"), F.count_if(c("pick") == 1).alias("picked"), F.count_if(c("pick") == -1).alias("rejected"),
                  F.count_if((c("pick") == 0) & (c("rating") == 0)).alias("neutral"))


def selection_totals(decisions: DataFrame, by: str = "session_id") -> DataFrame:
    """Chosen, covering, deliverable and discarded photos, and the deliverable share."""
    c = F.col
    g = decisions.groupBy(by).agg(F.count("*").alias("photos"), F.count_if(c("label").isin("selected", "highlighted")).alias("chosen"), F.count_if(c("label") == "recommended").alias("covering"))
    g = g.withColumn("deliverable", c("chosen") + c("covering"))
    return g.withColumns({"discarded": c("photos") - c("deliverable"), "share": _SIX(c("deliverable") / c("photos"))})


def top_values(df: DataFrame, value: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """The ``n`` most frequent values, of each group if ``by`` is given; ties by value."""
    keys = by or []
    c = df.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))
    if not keys:
        return c.orderBy(F.col("n").desc(), "value").limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "value")
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def top_reasons(reasons: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent reasons of each session (``reasons`` is an array)."""
    return top_values(reasons.select("session_id", F.explode("reasons").alias("reason")), F.col("reason"), n, ["session_id"]).withColumnRenamed("value", "reason")


def policy_gates_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """``reason, a, b``: what two policies reject of the same bursts, side by side, and under ``more_survivors``
    the bursts of which the one keeps more than the other."""
    c = F.col
    both = a.withColumn("who", F.lit("a")).unionByName(b.withColumn("who", F.lit("b")))
    side = lambda when: [F.count_if(when & (c("who") == x)).alias(x) for x in "ab"]
    why = both.where("reason is not null").groupBy("reason").agg(*side(F.lit(True)))
    kept = both.groupBy("session_id", "burst").agg(*side(c("alive")))
    more = kept.agg(F.count_if(c("a") > c("b")).alias("x"), F.count_if(c("b") > c("a")).alias("y")).select(F.lit("more_survivors").alias("reason"), c("x").alias("a"), c("y").alias("b"))
    return why.unionByName(more)


def audit_totals(analysis: DataFrame, version: int) -> DataFrame:
    c = F.col
    return analysis.agg(F.count("*").alias("photos"), F.count_if(F.coalesce(c("error"), F.lit("")) != "").alias("errors"), F.count_if(c("blur_score").isNull()).alias("no_blur"), F.count_if(c("version") != version).alias("outdated"),
                        F.count_if(c("face_count") > 0).alias("with_faces"), _SIX(F.avg((c("closed") > 0).cast("double"))).alias("closed_share"))


def run_report(decisions: DataFrame) -> DataFrame:
    """Totals and errors of each session, how it was selected and what coverage of people added."""
    c = F.col
    g = decisions.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if("error").alias("errors"), *[F.count_if(~c("error") & (c("label") == x)).alias(x) for x in ("selected", "highlighted", "alternative")],
                                            F.count_if("demoted").alias("demoted"), F.count_if("promoted").alias("promoted"), F.countDistinct("identity_id").alias("identities"))
    return g.withColumn("success", c("total") - c("errors"))


def iou(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Overlap of two rectangles, given by the names of their left, top, right and bottom."""
    (al, at, ar, ab), (bl, bt, br, bb) = ([F.col(x) for x in r] for r in (a, b))
    inner = F.greatest(F.lit(0.0), F.least(ar, br) - F.greatest(al, bl)) * F.greatest(F.lit(0.0), F.least(ab, bb) - F.greatest(at, bt))
    return F.coalesce(F.try_divide(inner, (ar - al) * (ab - at) + (br - bl) * (bb - bt) - inner), F.lit(0.0))


def crop_agreement(df: DataFrame, whole: float = 0.97, least: float = 0.02) -> DataFrame:
    """Do user and proposal (``p_left`` ... ``p_bottom``, null: none) crop the same photos, and how well: kept
    areas and overlaps over all photos and over those that the user cropped."""
    c = F.col
    sides = ("left", "top", "right", "bottom")
    d = df.withColumns({f"p_{s}": F.coalesce(f"p_{s}", F.lit(0.0 if s in ("left", "top") else 1.0)) for s in sides}).withColumns({f"_{s}": F.lit(0.0 if s in ("left", "top") else 1.0) for s in sides})
    real, prop, full = tuple(f"crop_{s}" for s in sides), tuple(f"p_{s}" for s in sides), tuple(f"_{s}" for s in sides)
    d = d.withColumns({"area": (c("crop_right") - c("crop_left")) * (c("crop_bottom") - c("crop_top")), "iou_p": iou(prop, real), "iou_f": iou(full, real)})
    d = d.withColumns({"user": c("area") < whole, "system": 1 - (c("p_right") - c("p_left")) * (c("p_bottom") - c("p_top")) > least})
    cropped = lambda x: F.when(c("user"), x)
    share = lambda x: mean(x.cast("double"))
    g = d.agg(F.count("*").alias("n"), share(c("user")).alias("user_crops"), share(c("system")).alias("system_crops"), share(c("user") == c("system")).alias("agreement"), share(c("iou_p")).alias("iou_proposed"), share(c("iou_f")).alias("iou_full"),
              share(cropped(c("iou_p"))).alias("iou_proposed_cropped"), share(cropped(c("iou_f"))).alias("iou_full_cropped"))
    area = cropped(c("area"))
    return with_quantiles(g, exact_quantiles(d, [], {"median_area": (area, 0.5), "p10_area": (area, 0.1)}), []).withColumns({x: _SIX(x) for x in ("median_area", "p10_area")})


def straighten_coverage(df: DataFrame, turned: float = 0.05, wrong: float = 1.0) -> DataFrame:
    """Photos that the user turned, and the others: how often the detector speaks (``detected`` isn't null), its
    error with either sign, and the share of what it says of the others that is over ``wrong`` degrees."""
    c = F.col
    err = {"direct": F.abs(c("detected") - c("crop_angle")), "flipped": F.abs(-c("detected") - c("crop_angle"))}
    d = df.withColumn("turned", F.abs("crop_angle") > turned)
    g = d.groupBy("turned").agg(F.count("*").alias("n"), mean(c("detected").isNotNull().cast("double")).alias("coverage"), *[mean(e).alias(f"mae_{k}") for k, e in err.items()], mean((F.abs("detected") > wrong).cast("double")).alias("over"))
    g = with_quantiles(g, exact_quantiles(d, ["turned"], {f"median_{k}": (e, 0.5) for k, e in err.items()}), ["turned"])
    return g.withColumn("false_corrections", F.when(~c("turned"), c("over"))).drop("over")


def exposure_rules(df: DataFrame, bias: float = 0.3, dead: float = 0.05) -> DataFrame:
    """Error of three rules (nothing, a fixed bias, the scene's median) against real corrections, and how often
    each says rightly whether there is one to make."""
    e = F.col("exposure")
    d = df.join(exact_quantiles(df, ["scene"], {"learned": (e, 0.5)}), "scene")
    rules = {"none": F.lit(0.0), "bias": F.lit(bias), "learned": F.col("learned")}
    said = lambda r: ((F.abs(r) > dead) == (F.abs(e) > dead)).cast("double")
    return d.agg(F.count("*").alias("n"), *[mean(F.abs(e - r)).alias(f"mae_{k}") for k, r in rules.items()], *[mean(said(r)).alias(f"right_{k}") for k, r in rules.items()])


def telemetry_summary(events: DataFrame) -> DataFrame:
    """One row: sessions and installs, the usual system, overrides by their kind with what was rejected
    wrongly, duels, times and memory."""
    c = F.col
    of = lambda kind, x: F.when(c("kind") == kind, x)
    lost = (c("kind") == "user_override") & (c("override_type") == "false_negative")
    return events.agg(
        F.count_if(c("kind") == "session_start").alias("sessions"), F.countDistinct(of("session_start", c("install"))).alias("installs"), F.mode(of("session_start", F.coalesce("os", F.lit("unknown"))), True).alias("os"),
        F.count_if(c("kind") == "user_override").alias("overrides"), F.count_if(lost).alias("false_negatives"), F.count_if((c("kind") == "user_override") & (c("override_type") == "false_positive")).alias("false_positives"),
        _SIX(F.avg(F.when(lost, F.coalesce("blur", F.lit(0.0))))).alias("lost_blur"), _SIX(F.avg(F.when(lost, F.coalesce(c("faces").cast("double"), F.lit(0.0))))).alias("lost_faces"), F.count_if(c("kind") == "duel_resolved").alias("duels"),
        _SIX(F.avg(of("duel_resolved", c("amount")))).alias("duel_ms"), _SIX(F.avg(of("ingestion_batch", c("amount")))).alias("ingest_seconds"), _SIX(F.avg(of("clustering_complete", c("amount")))).alias("cluster_seconds"),
        _SIX(F.max(of("performance_snapshot", c("amount")))).alias("ram_mb"))


def telemetry_top(events: DataFrame, n: int = 5) -> DataFrame:
    """The commonest graphics cards of sessions and presets of applied styles."""
    parts = {"gpu": ("session_start", "gpu"), "preset": ("style_applied", "preset")}
    tops = [top_values(events.where(F.col("kind") == kind), F.coalesce(col, F.lit("unknown")), n).select(F.lit(k).alias("figure"), "value", "n") for k, (kind, col) in parts.items()]
    return reduce(DataFrame.unionByName, tops)
