"""Quality score by a sparse rule ensemble: tree paths as rules, lasso logistic weights, Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_rules import RATIOS, statistics, with_ratios


@dataclass
class Rule:
    """A conjunction of (feature number, is at most, threshold) with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def matrix(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, low, v in self.terms:
            out &= (x[:, f] <= v) if low else (x[:, f] > v)
        return out

    def column(self, names: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for f, low, v in self.terms:
            out = out & ((F.col(names[f]) <= F.lit(v)) if low else (F.col(names[f]) > F.lit(v)))
        return out


def grow_paths(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """A regression tree on ``y``, split by variance: the terms of each node below the root, and its fit."""
    paths, fit = [], np.zeros(len(y))

    def node(at: np.ndarray, terms: tuple, left: int) -> None:
        fit[at] = y[at].mean() if len(at) else 0.0
        if terms:
            paths.append(terms)
        if not left or len(at) < 2 * least:
            return
        best = (1e-9, None)
        own, total = y[at], y[at].sum()
        for f in rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False):
            if not len(cuts[f]):
                continue
            slot = np.searchsorted(cuts[f], x[at, f], side="left")
            n = np.cumsum(np.bincount(slot, minlength=len(cuts[f]) + 1))[:-1]
            s = np.cumsum(np.bincount(slot, weights=own, minlength=len(cuts[f]) + 1))[:-1]
            ok = (n >= least) & (len(at) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(at) - n, 1) - total**2 / len(at), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (int(f), float(cuts[f][k])))
        if best[1]:
            f, v = best[1]
            low = x[at, f] <= v
            node(at[low], (*terms, (f, True, v)), left - 1)
            node(at[~low], (*terms, (f, False, v)), left - 1)

    node(np.arange(len(y)), (), depth)
    return paths, fit


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic fit, by accelerated proximal gradient steps on
    standardised columns; the intercept isn't penalised."""
    mean, sd = r.mean(0), r.std(0) + 1e-9
    z = (r - mean) / sd
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = c - rate * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w / sd, b - float((w / sd) @ mean)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 3) -> tuple[list[Rule], float]:
    """Boosted trees on random halves give paths; the lasso keeps few of them. (rules, intercept).

    Without rows of both labels there are no rules and the intercept is the share of label 1, smoothed.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 4 or y.min() == y.max():
        return [], float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 60))) for f in range(x.shape[1])]
    least = max(2, len(y) // 400)
    score, found = np.zeros(len(y)), {}
    for _ in range(trees):
        at = rng.permutation(len(y))[:max(4, len(y) // 2)]
        p = 1 / (1 + np.exp(-score))
        paths, _ = grow_paths(x[at], (y - p)[at], cuts, rng, depth, least)
        # The tree's own leaves give the boosting step.
        leaves = [q for q in paths if not any(o != q and o[:len(q)] == q for o in paths)]
        for q in leaves:
            m = Rule(q).matrix(x)
            score[m] += 0.3 * np.clip((y - p)[m].sum() / max((p * (1 - p))[m].sum(), 1e-3), -4, 4)
        found.update(dict.fromkeys(paths))
    rules = [Rule(q) for q in found]
    r = np.stack([q.matrix(x) for q in rules], 1).astype(float)
    keep = np.unique(r, axis=1, return_index=True)[1]  # rules that fire on the same rows count once
    rules, r = [rules[i] for i in keep], r[:, keep]
    w, b = lasso_logistic(r, y, penalty)
    for q, v in zip(rules, w, strict=True):
        q.weight = float(v)
    return [q for q in rules if abs(q.weight) > 1e-6], b


def score_column(rules: list[Rule], intercept: float, names: tuple[str, ...] = RATIOS) -> Column:
    """The ensemble as one Spark expression in 0..1: plain comparisons inside whole-stage codegen."""
    z = F.lit(intercept)
    for q in rules:
        z = z + F.when(q.column(names), F.lit(q.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, folds: int = 5, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``, the statistics, for every row.

    Learns ``labels.quality`` from rows whose crc32(doc_id as text) mod ``folds`` isn't 0: at most
    ``sample`` of them, those of smallest hash. Only statistics of the text are inputs. Null texts
    count as empty; null doc_ids are not held out and never learned from; a doc_id with several
    labels takes the smallest.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    stats = written(with_ratios(statistics(docs)).withColumn("held_out", F.col("doc_id").isNotNull() & (fold == 0)), "rule-statistics")
    own = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = stats.where(~F.col("held_out")).join(own, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *RATIOS).limit(sample).select("quality", *RATIOS).collect()
    data = np.array(picked, float).reshape(-1, 1 + len(RATIOS))
    rules, b = fit_rules(data[:, 1:], data[:, 0])
    return stats.withColumn("score", score_column(rules, b)).withColumn("predicted", (F.col("score") >= cut).cast("int"))
