"""Learning from history: scenes and taste; :mod:`.models` has the logistic models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import written


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vec"].to_numpy()).astype(float)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over the rows of a sample."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        d = _distances(sample, np.array(centres)).min(1)
        centres.append(sample[rng.choice(len(sample), p=d / d.sum())] if d.sum() > 0 else sample[rng.integers(len(sample))])
    return np.array(centres)


def scene_centroids(vecs: DataFrame, k: int = 10, seed: int = 0, starts: int = 10, rounds: int = 50, sample: int = 10_000, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """The k-means centres (k x d) of the least cost among ``starts`` runs, and that cost.

    All starts move together: a round is one pass over ``vecs`` (``vec_id, vec``), in which each task sums its
    rows by (start, cluster), and only these sums come to the driver, starts x k x d numbers. Starts are
    drawn by k-means++ from the ``sample`` vectors of smallest hash; the rounds run over all vectors. A cluster
    that lost its members keeps its centre. A run rests when no centre moves by more than ``tolerance``.
    """
    few = vecs.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vec").collect()
    if not few:
        return np.zeros((0, 0)), 0.0
    few = np.array([r[0] for r in few], float)
    k = max(1, min(k, len(few)))
    centres = np.array([first_centres(few, k, seed + i) for i in range(starts)])
    d = centres.shape[2]

    def sums(now: np.ndarray):
        def run(batches: Iterator) -> Iterator:
            total = np.zeros((len(now), k, d + 2))
            for pdf in batches:
                x = _vectors(pdf)
                wide = np.column_stack([x, np.ones(len(x))])
                for s, own in enumerate(now):
                    far = _distances(x, own)
                    who = far.argmin(1)
                    np.add.at(total[s], (who, slice(0, d + 1)), wide)
                    np.add.at(total[s][:, -1], who, far[np.arange(len(x)), who])
            yield pd.DataFrame({"v": [total.ravel().tolist()]})

        cells = vecs.select("vec").mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(len(now) * k * (d + 2))
        out[cells["i"].to_numpy()] = cells["v"].to_numpy()
        return out.reshape(len(now), k, d + 2)

    for _ in range(rounds):
        total = sums(centres)
        n = total[:, :, d]
        new = np.where(n[:, :, None] > 0, total[:, :, :d] / np.maximum(n, 1)[:, :, None], centres)
        moved = np.abs(new - centres).max()
        centres = new
        if moved <= tolerance:
            break
    cost = sums(centres)[:, :, -1].sum(1)
    best = int(cost.argmin())
    return centres[best], float(cost[best])


def assign_scenes(vecs: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vec_id, scene, d``: the nearest centre of each vector (``vec_id, vec``) and the squared distance."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            if len(pdf):
                far = _distances(_vectors(pdf), centres)
                who = far.argmin(1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "scene": who.astype(np.int32), "d": far[np.arange(len(pdf)), who]})

    return vecs.select("vec_id", "vec").mapInPandas(run, "vec_id long, scene int, d double")


def discover_scenes(vecs: DataFrame, k: int = 10, seed: int = 0, starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """``vec_id, scene, medoid`` of all vectors (``vec_id, embedding``), and the centres ``scene, centroid, size``; the middle
    member of a scene is the one nearest to its centre (then the first). Vectors are written once and read
    in each round. Vectors that are null have no scene."""
    spark = vecs.sparkSession
    data = written(vecs.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")))
    centres, _ = scene_centroids(data, k, seed, starts)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, scene int, medoid boolean"), spark.createDataFrame([], "scene int, centroid array<double>, size long")
    got = written(assign_scenes(data, centres))
    mid = got.groupBy("scene").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("m"), F.count("*").alias("size"))
    named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "scene int, centroid array<double>")
    return got.join(mid, "scene").select("vec_id", "scene", (F.col("vec_id") == F.col("m")).alias("medoid")), named.join(mid.select("scene", "size"), "scene", "left").na.fill(0, ["size"])


@dataclass
class TasteModel:
    mean: np.ndarray | None
    cov: np.ndarray | None
    noise: float = 1.0
    bias: float = 0.0


def taste_fit(examples: DataFrame, min_n: int = 50, prior: float = 1e-3, rounds: int = 30) -> TasteModel:
    """Bayesian ridge of ``y`` (+1, -1) on ``vec``. Executors reduce their rows to Gram matrices; only these
    sums of d x d come to the driver, where the evidence steps run."""

    def gram(batches: Iterator) -> Iterator:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.stack(pdf["vec"].to_numpy()).astype(float), np.ones(len(pdf)), pdf["y"].to_numpy(float)])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel().tolist()]})

    parts = examples.where("vec is not null and y is not null").select("vec", "y").mapInPandas(gram, "g array<double>")
    sums = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    if not sums:
        return TasteModel(None, None)
    d = int(np.sqrt(len(sums)))
    g = np.array([r["v"] for r in sums]).reshape(d, d)
    n, sy = g[-2, -2], g[-2, -1]
    if n < min_n or abs(sy) >= n:
        return TasteModel(None, None)
    mu, my = g[:-2, -2] / n, sy / n
    a, b, yy = g[:-2, :-2] - n * np.outer(mu, mu), g[:-2, -1] - n * mu * my, g[-1, -1] - n * my * my
    alpha, lam = n / max(yy, 1e-9), 1.0
    vals = np.linalg.eigvalsh(a)
    for _ in range(rounds):
        cov = np.linalg.inv(lam * np.eye(d - 2) + alpha * a)
        w = alpha * cov @ b
        gamma = float((alpha * vals / (lam + alpha * vals)).sum())
        rss = max(yy - 2 * w @ b + w @ a @ w, 1e-9)
        lam, alpha = (gamma + 2 * prior) / (w @ w + 2 * prior), (n - gamma + 2 * prior) / (rss + 2 * prior)
    return TasteModel(w, cov, 1 / alpha, float(my - mu @ w))


def taste_score(vecs: DataFrame, model: TasteModel) -> DataFrame:
    """0.5 drawn to the prediction as far as the model is sure; 0.5 without a model or a vector."""
    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.full(len(v), 0.5)
        if model.mean is not None:
            at = [i for i, x in enumerate(v) if x is not None]
            if at:
                x = np.stack([v.iloc[i] for i in at]).astype(float)
                m = x @ model.mean + model.bias
                s = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, model.cov, x) + model.noise, 0))
                out[at] = 0.5 + (np.clip((m + 1) / 2, 0, 1) - 0.5) * np.exp(-s)
        return pd.Series(out)

    return vecs.withColumn("taste", score("vec"))


def feed_examples(history: DataFrame, duels: DataFrame) -> DataFrame:
    """+1 and -1 examples of history labels and duels, each photo and sign once."""
    h = history.where(F.col("label").isin("positive", "negative")).select("photo_id", F.when(F.col("label") == "positive", 1).otherwise(-1).alias("y"))
    return h.union(duels.select(F.col("winner").alias("photo_id"), F.lit(1).alias("y"))).union(duels.select(F.col("loser").alias("photo_id"), F.lit(-1).alias("y"))).distinct()
