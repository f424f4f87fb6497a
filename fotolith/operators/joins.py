"""Similarity, nearest and lookup joins. Range and Hamming joins are rewritten as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def burst_edges(photos: DataFrame, eps: float = 12.0, gap: float = 5.0, sure: float = 1.5) -> DataFrame:
    """Pairs of one session and scene at most 2 * gap seconds apart that look alike.

    Time is cut into buckets of the reach; each photo meets those of its own and the next bucket by
    an equi-join, so no pair further apart is formed. A pair is an edge if it shares a burst id, is
    at most ``sure`` seconds apart, or its hash distance and its time distance stay under ``eps``.
    """
    reach = int(2 * gap * 1e6)
    cols = ["photo_id", "session_id", "scene_type", "t_us", "phash", "face_count", "burst_id"]
    p = photos.select(*cols).withColumn("bucket", F.floor(F.col("t_us") / reach))
    a = p.select(*[F.col(c).alias(f"a_{c}") for c in cols], F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = p.select(*[F.col(c).alias(f"b_{c}") for c in cols], "bucket")
    dt = F.col("b_t_us") - F.col("a_t_us")
    pair = a.join(b, (F.col("a_session_id") == F.col("b_session_id")) & (F.col("a_scene_type") == F.col("b_scene_type")) & (a["bucket"] == b["bucket"])
                  & ((dt > 0) | ((dt == 0) & (F.col("a_photo_id") < F.col("b_photo_id")))) & (dt <= reach) & (F.col("a_face_count") == F.col("b_face_count")))
    d = hamming(F.col("a_phash"), F.col("b_phash"))
    edge = F.coalesce(F.col("a_burst_id") == F.col("b_burst_id"), F.lit(False)) | (dt <= int(sure * 1e6)) | (d + dt / F.lit(gap * 1e6) * F.lit(eps / 2) <= eps)
    return pair.where(edge).select(F.col("a_session_id").alias("session_id"), F.col("a_photo_id").alias("a"), F.col("b_photo_id").alias("b"), d.cast("long").alias("hamming"))


def untimed_edges(photos: DataFrame, eps: int = 12) -> DataFrame:
    """Photos without a time against those of their session, scene and face count, by hash distance alone.

    Of eps + 1 bands of the hash one at least is equal in a pair, so pairs come from an equi-join.
    """
    keys = ["session_id", "scene_type", "face_count"]
    ends = [64 * i // (eps + 1) for i in range(eps + 2)]
    band = lambda i: F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("phash", ends[i]).bitwiseAND(F.lit((1 << (ends[i + 1] - ends[i])) - 1)).alias("v"))
    p = photos.select("photo_id", *keys, "t_us", "phash", F.explode(F.array(*[band(i) for i in range(eps + 1)])).alias("band"))
    a = p.where("t_us is null").select(*keys, "band", F.col("photo_id").alias("a"), F.col("phash").alias("ha"))
    b = p.select(*keys, "band", F.col("photo_id").alias("b"), F.col("phash").alias("hb"), "t_us")
    near = hamming(F.col("ha"), F.col("hb")) <= eps
    once = F.col("t_us").isNotNull() | (F.col("a") < F.col("b"))
    return a.join(b, [*keys, "band"]).where(near & once & (F.col("a") != F.col("b"))).select("session_id", "a", "b").distinct()


def exact_duplicate_pairs(photos: DataFrame, max_hamming: int = 2, gap: float = 3.0) -> DataFrame:
    """Pairs within ``max_hamming`` bits: of max_hamming + 1 bands of the hash one at least is equal, so
    pairs come from an equi-join on bands and time; the time gap counts only where both are timed."""
    n = max_hamming + 1
    width = -(-64 // n)
    band = lambda i: F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("phash", i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v"))
    p = photos.select("photo_id", "session_id", "t_us", "phash", F.explode(F.array(*[band(i) for i in range(n)])).alias("band"))
    reach = int(gap * 1e6)
    cols = ("photo_id", "t_us", "phash")
    side = lambda d, x, *more: d.select("session_id", "band", *[F.col(c).alias(f"{x}_{c}") for c in cols], *more)
    near = hamming(F.col("a_phash"), F.col("b_phash")) <= max_hamming
    # Timed photos meet those of their own and the next interval of ``gap`` only, so a long run of like shots isn't paired up.
    timed, bucket = p.where("t_us is not null"), F.floor(F.col("t_us") / reach)
    soon = side(timed, "a", F.explode(F.array(bucket, bucket + 1)).alias("bucket")).join(side(timed, "b", bucket.alias("bucket")), ["session_id", "band", "bucket"])
    dt = F.col("b_t_us") - F.col("a_t_us")
    soon = soon.where(((dt > 0) | (dt == 0) & (F.col("a_photo_id") < F.col("b_photo_id"))) & (dt <= reach))
    # Untimed photos are few; they meet all of their band.
    free = side(p.where("t_us is null"), "a").join(side(p, "b"), ["session_id", "band"]).where("a_photo_id <> b_photo_id")
    pairs = soon.select("session_id", *[f"{x}_{c}" for x in "ab" for c in cols]).unionByName(free.select("session_id", *[f"{x}_{c}" for x in "ab" for c in cols])).where(near)
    return pairs.select("session_id", F.least("a_photo_id", "b_photo_id").alias("a"), F.greatest("a_photo_id", "b_photo_id").alias("b")).distinct()


def burst_pairs(bursts: DataFrame, max_losers: int = 3) -> DataFrame:
    """Each positive of a burst against its first losers in time order."""
    keys = ["session_id", "burst"]
    w = Window.partitionBy(*keys).orderBy("t_us", "photo_id")
    losers = bursts.where(F.col("label").isin("negative", "unreviewed")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_losers)
    return bursts.where("label = 'positive'").select(*keys, F.col("photo_id").alias("winner")).join(losers.select(*keys, F.col("photo_id").alias("loser")), keys)


def filter_by_paths(df: DataFrame, paths: DataFrame) -> DataFrame:
    return df.join(paths.select("path").distinct(), "path", "left_semi")


def filter_by_identity(photos: DataFrame, faces: DataFrame, ids: list[int]) -> DataFrame:
    return photos.join(faces.where(F.col("identity_id").isin(ids)).select("photo_id").distinct(), "photo_id", "left_semi")


def import_client_selection(snapshot: DataFrame, names: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """The client's picks become selected, with four stars, red and flagged; nothing is demoted. Names without
    a photo in the snapshot are sought in the full ``listing`` of files. ``promoted`` tells the rows hit."""
    wanted = names.select(F.lower("stem").alias("_s")).distinct()
    snapshot = snapshot.withColumn("_s", F.lower("stem"))
    j = snapshot.join(wanted.withColumn("promoted", F.lit(True)), "_s", "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))
    if listing is not None:
        rest = listing.withColumn("_s", F.lower("stem")).join(wanted, "_s", "left_semi").join(snapshot.select("_s").distinct(), "_s", "left_anti")
        j = j.unionByName(rest.withColumn("promoted", F.lit(True)), allowMissingColumns=True)
    new = {"label": "selected", "stars": 4, "color": "Red", "flag": "pick"}
    return j.withColumns({k: F.when(F.col("promoted"), v).otherwise(F.col(k) if k in j.columns else F.lit(None)) for k, v in new.items()}).drop("_s")


def client_selection_report(names: DataFrame, result: DataFrame) -> DataFrame:
    """How many photos were promoted and how many of the client's names match none."""
    found = result.where("promoted").select(F.lower("stem").alias("stem")).distinct()
    missing = names.select(F.lower("stem").alias("stem")).distinct().join(found, "stem", "left_anti").agg(F.count("*").alias("not_found"))
    return result.agg(F.count_if("promoted").alias("updated")).join(missing)


def bounded(few: DataFrame, most: int) -> DataFrame:
    """``few``, after a check that it has no more than ``most`` rows: it is to be one broadcast row."""
    if few.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: too many for one broadcast row")
    return few


def nearest_city(photos: DataFrame, cities: DataFrame, max_km: float = 35.0, most: int = 5_000) -> DataFrame:
    """Great-circle nearest of a list of cities, at most ``max_km`` away.

    The list is a dimension of tens of rows, ``most`` at most (more is an error); it is held as one array in a
    single row.
    """
    cities = bounded(cities, most)
    row = cities.agg(F.array_sort(F.collect_list(F.struct("city", "city_lat", "city_lon"))).alias("cities"))
    rad = F.radians

    def km(c: Column) -> Column:
        h = F.pow(F.sin((rad(c["city_lat"]) - rad("lat")) / 2), 2) + F.cos(rad("lat")) * F.cos(rad(c["city_lat"])) * F.pow(F.sin((rad(c["city_lon"]) - rad("lon")) / 2), 2)
        return F.lit(6371.0 * 2) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    best = F.array_min(F.transform("cities", lambda c: F.struct(km(c).alias("km"), c["city"].alias("city"))))
    return photos.join(F.broadcast(row)).withColumn("best", best).where(F.col("best.km") <= max_km).select("photo_id", F.col("best.city").alias("city"), F.col("best.km").alias("km"))


def knn(queries: DataFrame, vecs: DataFrame, k: int = 50, block: int = 2048, parts: int | None = None) -> DataFrame:
    """Exact top-k by inner product of a stated query set against all vectors.

    Queries are cut into blocks of about ``block`` and vectors into ``parts`` (the session's shuffle
    partitions) by hash; each pair of a block and a part is one group, whose scores are one matrix
    product and of which only k rows for each query come out. So what is shuffled is each vector once
    a block, and queries x parts x k candidates.
    """
    n = parts or int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // block))
    q = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    v = vecs.select(F.col("vec_id").alias("of"), F.col("embedding").alias("vec"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("part"))
    q, v = (d.withColumn("block", F.col("block").cast("int")) for d in (q, v))

    def best(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64", "score": "float64"})
        right = right.sort_values("of")
        ids, rows, one = right["of"].to_numpy(), right["vec"].to_numpy(), np.stack(left["embedding"]).astype(float)
        top, who = np.full((len(one), 0), -np.inf), np.zeros((len(one), 0), np.int64)
        for lo in range(0, len(ids), 4096):  # a bounded stretch of scores at a time
            scores = np.concatenate([top, one @ np.stack(rows[lo:lo + 4096]).astype(float).T], 1)
            names = np.concatenate([who, np.broadcast_to(ids[lo:lo + 4096], (len(one), len(ids[lo:lo + 4096])))], 1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            top, who = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        return pd.DataFrame({"query": np.repeat(left["vec_id"].to_numpy(), top.shape[1]), "vec_id": who.ravel(), "score": top.ravel()})

    some = q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInPandas(best, "query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "vec_id")).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "vec_id", "rank", "score")


def nearest_scene(vecs: DataFrame, centroids: DataFrame, most: int = 1_000) -> DataFrame:
    """The centroid of least Euclidean distance; the centroids, ``most`` at most (more is an error), are one array row."""
    centroids = bounded(centroids, most)
    few = centroids.agg(F.array_sort(F.collect_list(F.struct("scene", "centroid"))).alias("cs"))
    d = lambda c: F.aggregate(F.zip_with(c["centroid"], F.col("embedding"), lambda x, y: F.pow(x - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("cs", lambda c: F.struct(F.round(d(c), 9).alias("d"), c["scene"].alias("scene"))))
    return vecs.join(F.broadcast(few)).select("vec_id", best["scene"].alias("scene"))


def unfed_labeled(history: DataFrame, fed: DataFrame, limit: int | None = None) -> DataFrame:
    """Labelled history that no model has seen yet, the first ``limit`` by photo_id if one is given."""
    rest = history.where(F.col("label").isin("positive", "negative")).join(fed.select("photo_id"), "photo_id", "left_anti")
    return rest.orderBy("photo_id").limit(limit) if limit else rest


def mark_fed(fed: DataFrame, used: DataFrame) -> DataFrame:
    """What a model has seen after it took ``used``, each photo once."""
    return fed.select("photo_id").union(used.select("photo_id")).distinct()


def compare_selections(df: DataFrame, old: str, new: str) -> DataFrame:
    """agree, rescued (only the new pick) or purged (only the old one), with counts and shares."""
    a, b = F.col(old), F.col(new)
    verdict = F.when(a == b, "agree").when(b, "rescued").otherwise("purged")
    return df.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def nearest_with_votes(df: DataFrame, value: str, index: str, group: str) -> DataFrame:
    """Rows without ``value`` take that of the nearest row by index in the group that has its own; the
    earlier wins ties. (The chained variant, in which inherited values pass on, is sequential.)"""
    back = Window.partitionBy(group).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(group).orderBy(index).rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    p, n = F.last(own, True).over(back), F.first(own, True).over(ahead)
    take = F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).when(F.col(index) - p["i"] <= n["i"] - F.col(index), p["v"]).otherwise(n["v"])
    return df.withColumn(f"{value}_filled", take)


def merge_labels(snapshot: DataFrame, new: DataFrame) -> DataFrame:
    return snapshot.join(new.select("photo_id", F.col("label").alias("new_label")), "photo_id", "full").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def duel_rewrite(duels: DataFrame, files: DataFrame, develops: DataFrame) -> DataFrame:
    """Winner and loser of each duel with their RAW and JPEG siblings, labelled selected and duplicates. The
    winner without a develop of its own takes the loser's."""
    own = develops.select("photo_id", "develop")
    d = duels.join(own.select(F.col("photo_id").alias("winner"), F.col("develop").alias("won")), "winner", "left").join(own.select(F.col("photo_id").alias("loser"), F.col("develop").alias("lost")), "loser", "left")
    sides = F.array(F.struct(F.col("winner").alias("photo_id"), F.lit("selected").alias("label"), F.coalesce("won", "lost").alias("develop")), F.struct(F.col("loser").alias("photo_id"), F.lit("duplicates").alias("label"), F.col("lost").alias("develop")))
    both = d.select(F.explode(sides).alias("s")).select("s.*")
    stems = both.join(files.select("photo_id", "stem_path"), "photo_id").select("stem_path", "label", "develop")
    return stems.join(files.select("photo_id", "stem_path"), "stem_path").select("photo_id", "label", "develop").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``photo_id, cluster``: the smallest photo_id that is linked, over any number of links.

    Large-star and small-star steps on the edge table, each of which at least halves the distance to
    the smallest node whatever the order of ids on a path, until nothing changes (an error after
    ``rounds`` rounds); each round is checkpointed in the shared folder.
    """
    from ..functions.session import written

    ids = vertices.select("photo_id").distinct()
    known = edges.select("a", "b").join(ids.select(F.col("photo_id").alias("a")), "a", "left_semi").join(ids.select(F.col("photo_id").alias("b")), "b", "left_semi")
    e = written(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        two = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = two.join(low, "u").select(F.greatest("u", "v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(small)
        # Done when each node has one smaller neighbour that has none itself: a forest of stars.
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return vertices.select("photo_id").join(e.select(F.col("u").alias("photo_id"), F.col("v").alias("cluster")), "photo_id", "left").select("photo_id", F.coalesce("cluster", "photo_id").alias("cluster"))
