"""Many small logistic models at once: executors reduce rows to sums, the driver takes Newton steps on these."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import written
from .quantiles import ranks

#: Examples in all and of each class that a model needs.
MIN_EXAMPLES, MIN_CLASS = 60, 15


@dataclass
class Logistic:
    """Softmax regression on standardised features; ``weights`` are (classes, features + 1), the last the bias."""

    classes: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:, :-1].T + self.weights[:, -1]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"model": [pdf["model"].iloc[0]], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})


def _summed(df: DataFrame, parts, fan: int = 32) -> dict[str, np.ndarray]:
    """Sum of the vectors that ``parts`` gives for each model of a batch (pairs of a name and a vector): added in each
    task, then over ``fan`` groups of tasks, then over these. Only the sums come back."""

    def run(batches: Iterator) -> Iterator:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, v in parts(pdf):
                held[name] = held[name] + v if name in held else v
        if held:
            yield pd.DataFrame({"model": list(held), "v": [v.tobytes() for v in held.values()]})

    kind = "model string, v binary"
    some = df.mapInPandas(run, kind).withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(fan)))
    all_ = some.groupBy("model", "fan").applyInPandas(_added, kind).groupBy("model").applyInPandas(_added, kind)
    return {r["model"]: np.frombuffer(r["v"]) for r in all_.collect()}


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])


def fit_logistic(examples: DataFrame, folds: int, balanced: bool, penalty: float = 1.0, rounds: int = 25, tolerance: float = 1e-8) -> dict[tuple[str, int], Logistic]:
    """A model of each ``key`` on all rows (held-out fold -1) and without each fold of ``folds``.

    ``examples`` has ``key`` (which model), ``fold``, ``y`` (class, a string) and ``x`` (an array of numbers, of one
    length a key, none null). Features are standardised on a model's own rows; with ``balanced`` each
    class weighs the same; ``penalty`` is that of the squared weights, the bias goes free. Every round is one
    pass for all models, of whose gradients and second derivatives the sums come to the driver: their size
    is that of the models, not of the rows. Keys with one class have no model.
    """
    # Dealt evenly: what comes from a join of light rows may lie in few tasks.
    parts = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = written(examples.select("key", F.col("fold").cast("int").alias("fold"), F.col("y").cast("string").alias("y"), F.col("x").cast("array<double>").alias("x")).repartition(parts))
    counts: dict[str, dict[int, dict[str, int]]] = {}
    for r in data.groupBy("key", "fold", "y").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["key"], {}).setdefault(r["fold"], {})[r["y"]] = r["n"]

    def moments(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
        for (key, fold), own in pdf.groupby(["key", "fold"]):
            yield json.dumps([key, int(fold)]), _moments(np.stack(own["x"]))

    by_fold = {tuple(json.loads(k)): v for k, v in _summed(data, moments).items()}
    models: dict[tuple[str, int], Logistic] = {}
    sizes: dict[tuple[str, int], np.ndarray] = {}
    for key, own in counts.items():
        for held in (-1, *range(folds)) if folds > 1 else (-1,):
            used = [f for f in own if f != held]
            n = {}
            for f in used:
                for y, k in own[f].items():
                    n[y] = n.get(y, 0) + k
            if len(n) < 2:
                continue
            m = sum(by_fold[key, f] for f in used)
            d = (len(m) - 1) // 2
            mean, var = m[1:d + 1] / m[0], np.maximum(m[d + 1:] / m[0] - (m[1:d + 1] / m[0]) ** 2, 0)
            classes = sorted(n)
            models[key, held] = Logistic(classes, mean, np.where(var > 1e-18, np.sqrt(var), 1.0), np.zeros((len(classes), d + 1)))
            total = sum(n.values())
            sizes[key, held] = np.array([total / (len(classes) * n[y]) if balanced else 1.0 for y in classes])
    todo = set(models)

    def slopes(now: dict[tuple[str, int], Logistic]):
        def parts(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
            for (key, fold), own in pdf.groupby(["key", "fold"]):
                x, y = np.stack(own["x"]), own["y"].to_numpy()
                for (k, held), m in now.items():
                    if k != key or held == fold:
                        continue
                    p = m.probabilities(x)
                    t = (y[:, None] == np.array(m.classes)[None]).astype(float)
                    w = t @ sizes[k, held]
                    z = np.column_stack([(x - m.mean) / m.scale, np.ones(len(x))])
                    kk, d = m.weights.shape
                    h = np.zeros((kk, d, kk, d))
                    for a in range(kk):
                        for b in range(a, kk):
                            h[a, :, b] = h[b, :, a] = (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
                    yield json.dumps([k, held]), np.concatenate([(((p - t) * w[:, None]).T @ z).ravel(), h.ravel()])

        return parts

    for _ in range(rounds):
        if not todo:
            break
        sums = {tuple(json.loads(k)): v for k, v in _summed(data, slopes({k: models[k] for k in todo})).items()}
        for k in sorted(todo):
            m = models[k]
            kk, d = m.weights.shape
            v = sums[k]
            free = np.ones((kk, d))
            free[:, -1] = 0
            g = v[:kk * d].reshape(kk, d) + penalty * m.weights * free
            h = v[kk * d:].reshape(kk * d, kk * d) + np.diag(penalty * free.ravel() + 1e-9)
            move = np.linalg.lstsq(h, g.ravel(), rcond=None)[0].reshape(kk, d)
            move[:, -1] -= move[:, -1].mean()  # a shift of all biases changes no probability; its rounding errors never end
            longest = np.abs(move).max()
            m.weights = m.weights - move * min(1.0, 4.0 / max(longest, 1e-300))  # a first step too far is cut short
            if longest < tolerance:
                todo.discard(k)
    return models


def predict_logistic(rows: DataFrame, models: dict[str, Logistic], x: str = "x") -> DataFrame:
    """``rows`` with ``said_<key>`` and ``sure_<key>`` (its probability) for each model; null without a vector."""
    names = sorted(models)
    extra = "".join(f", said_{k} string, sure_{k} double" for k in names)

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            have = pdf[x].map(lambda v: v is not None).to_numpy(bool)
            vectors = np.stack(pdf.loc[have, x]).astype(float) if have.any() else None
            for k in names:
                said, sure = np.full(len(pdf), None, object), np.full(len(pdf), np.nan)
                if vectors is not None:
                    p = models[k].probabilities(vectors)
                    said[have], sure[have] = np.array(models[k].classes, object)[p.argmax(1)], p.max(1)
                pdf[f"said_{k}"], pdf[f"sure_{k}"] = said, pd.array(sure, "Float64").astype(object)
                pdf.loc[~have, f"sure_{k}"] = None
            yield pdf

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + extra)


def ready(labels: DataFrame) -> dict[str, int]:
    """Attributes (``attribute, value``) with enough examples in all and of each class, and into how many folds
    they can be cut: five, or as many as the smallest class has rows. One row an attribute comes back."""
    n = labels.groupBy("attribute", "value").agg(F.count("*").alias("n")).groupBy("attribute").agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.min("n").alias("least"))
    return {r["attribute"]: min(5, r["least"]) for r in n.where((F.col("n") >= MIN_EXAMPLES) & (F.col("classes") >= 2) & (F.col("least") >= MIN_CLASS)).collect()}


def face_classifier(labels: DataFrame, faces: DataFrame, id: str = "face_id", vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Verdicts on faces by models learned from labels, and each model's report.

    ``labels`` has ``id, attribute, value``, ``faces`` ``id`` and the vector ``vec``. An attribute with too few labels
    has no model, and its faces no verdict, so geometry decides. The verdicts are ``faces`` with
    ``said_<attribute>`` and ``sure_<attribute>``; the report ``attribute, examples, accuracy``: the mean accuracy
    on folds that a model has not seen, to three places. A face counts once a fold by its id; labels of faces
    that aren't there, or without a value or vector, don't count.
    """
    own = labels.where("value is not null").join(faces.where(F.col(vec).isNotNull()).select(id, F.col(vec).alias("x")), id)
    can = ready(own)
    spark = faces.sparkSession
    if not can:
        return faces, spark.createDataFrame([], "attribute string, examples long, accuracy double")
    folds = max(can.values())
    examples = own.where(F.col("attribute").isin(list(can))).select(F.col("attribute").alias("key"), F.pmod(F.xxhash64("attribute", id), F.lit(folds)).alias("fold"), F.col("value").cast("string").alias("y"), "x")
    models = fit_logistic(examples, folds, balanced=True)
    return predict_logistic(faces, {k: m for (k, held), m in models.items() if held < 0}, vec), _accuracy(examples, models).select(F.col("key").alias("attribute"), F.col("n").alias("examples"), F.round("mean", 3).alias("accuracy"))


def _accuracy(examples: DataFrame, models: dict[tuple[str, int], Logistic]) -> DataFrame:
    """``key, n, folds, mean, spread`` of accuracies on the held-out folds."""

    def judge(batches: Iterator) -> Iterator:
        for pdf in batches:
            for (key, fold), own in pdf.groupby(["key", "fold"]):
                if (key, int(fold)) in models:
                    m = models[key, int(fold)]
                    said = np.array(m.classes, object)[m.probabilities(np.stack(own["x"]).astype(float)).argmax(1)]
                    yield pd.DataFrame({"key": [key], "fold": [int(fold)], "n": [len(own)], "hits": [int((said == own["y"].to_numpy()).sum())]})

    told = examples.select("key", F.col("fold").cast("int").alias("fold"), F.col("y").cast("string").alias("y"), F.col("x").cast("array<double>").alias("x")).mapInPandas(judge, "key string, fold int, n long, hits long")
    by_fold = told.groupBy("key", "fold").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"))
    return by_fold.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("folds"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("spread"))


def deal(sizes: list[tuple[int, int]], folds: int) -> dict[int, tuple[list[int], list[int]]]:
    """Groups into folds, the largest first, each into the emptiest fold (then the first). ``sizes`` has how many
    groups there are of each size; the answer, for each size, the folds of the first groups of that size and
    then those that come in turn: once the folds are level to one group, all others go round."""
    load = [0] * folds
    out = {}
    for size, groups in sorted(sizes, reverse=True):
        first, left = [], groups
        while left and max(load) - min(load) >= size:
            f = min(range(folds), key=lambda i: (load[i], i))
            load[f] += size
            first.append(f)
            left -= 1
        turn = sorted(range(folds), key=lambda i: (load[i], i))
        for i, f in enumerate(turn):
            load[f] += size * (left // folds + (i < left % folds))
        out[size] = (first, turn)
    return out


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``group, rows, fold``: whole groups in folds of like size. How many groups there are of each size comes to the
    driver (different sizes are few: n rows have under sqrt(2 n)); a group's place among those of its size,
    by name, is a rank over ranges of all groups."""
    counts = written(rows.groupBy(group).agg(F.count("*").alias("rows")))
    sizes = [(r["rows"], r["n"]) for r in counts.groupBy("rows").agg(F.count("*").alias("n")).collect()]
    plan = deal(sizes, folds)
    first = [(s, i, f) for s, (own, _) in plan.items() for i, f in enumerate(own)]
    turns = [(s, len(own), turn) for s, (own, turn) in plan.items()]
    spark = rows.sparkSession
    ranked = ranks(counts, ["rows"], [group], "place")
    d = ranked.join(spark.createDataFrame(turns, "rows long, head long, turn array<int>"), "rows").join(spark.createDataFrame(first, "rows long, place long, own int"), ["rows", "place"], "left")
    return d.select(group, "rows", F.coalesce("own", F.element_at("turn", (F.pmod(F.col("place") - F.col("head"), F.lit(folds)) + 1).cast("int"))).alias("fold"))


def pairwise_eval(pairs: DataFrame, sets: dict[str, list[str]], group: str = "burst", folds: int = 5) -> DataFrame:
    """``features, pairs, groups, folds, mean, spread``: how well a logistic model on differences of features tells a
    pair's winner, for each set of features, over whole groups that it has not seen.

    ``pairs`` has ``winner``, ``loser`` and for each feature ``w_<feature>`` and ``l_<feature>``; a missing one counts 0. Which of
    the two stands first is drawn by a hash, so that the model can't learn the order. ``spread`` is the
    standard deviation over folds. With fewer groups than ``folds`` there are as many folds as groups.
    """
    flip = F.pmod(F.xxhash64("winner", "loser"), F.lit(2)) == 1
    names = sorted({f for own in sets.values() for f in own})
    diff: dict[str, Column] = {f: (F.when(flip, 1.0).otherwise(-1.0)) * (F.coalesce(F.col(f"w_{f}").cast("double"), F.lit(0.0)) - F.coalesce(F.col(f"l_{f}").cast("double"), F.lit(0.0))) for f in names}
    # Written, since groups, folds and examples each read them.
    d = written(pairs.select(group, flip.cast("int").cast("string").alias("y"), *[c.alias(f"d_{f}") for f, c in diff.items()]))
    n_groups = d.select(group).distinct().count()
    folds = min(folds, n_groups)
    if folds < 2:
        return pairs.sparkSession.createDataFrame([], "features string, pairs long, groups long, folds long, mean double, spread double")
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.array(*[f"d_{f}" for f in own]).alias("x")) for k, own in sets.items()])
    dealt = d.join(group_folds(d, group, folds).select(group, "fold"), group)
    examples = dealt.select("fold", "y", F.explode(cells).alias("s")).select("s.key", "fold", "y", "s.x")
    models = fit_logistic(examples, folds, balanced=False)
    return _accuracy(examples, models).select(F.col("key").alias("features"), F.col("n").alias("pairs"), F.lit(n_groups).cast("long").alias("groups"), "folds", "mean", "spread")
