"""Sharding by global byte-size prefix sums, in DataFrame operations only.

Rows are range-partitioned on the order columns; each partition's total is summed, the totals are
summed over partitions, and a running sum inside each partition is added to its offset. Equal cuts
of the grand total then give contiguous, balanced shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written


def global_prefix_sums(df: DataFrame, order: list[str], values: dict[str, str], groups: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add for each ``name: column`` of ``values`` the sum of ``column`` over all rows that come before,
    in ``order`` (nulls first), within each value of ``groups`` (all rows together if empty).

    The rows are range-partitioned on groups and order, so a hot group is spread over many
    partitions. The partition id is written with the rows: sampled range bounds may differ when a
    plan runs again. No partition sees more than its own rows; the sum over partitions runs on one
    row for each partition and group met in it. Helper columns have names of their own.
    """
    groups = groups or []
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pid, total, local, offset, group = fresh("pid", "total", "local", "offset", "group")
    at = {k: i for i, k in enumerate(values)}
    rows = written(df.repartitionByRange(n, *groups, *order).withColumn(pid, F.spark_partition_id()), "prefix")
    totals = rows.groupBy(pid, *groups).agg(*[F.sum(c).alias(f"{total}_{at[k]}") for k, c in values.items()])
    before = Window.partitionBy(*groups).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(pid, *[F.col(g).alias(f"{group}_{i}") for i, g in enumerate(groups)], *[F.coalesce(F.sum(f"{total}_{at[k]}").over(before), F.lit(0)).alias(f"{offset}_{at[k]}") for k in values])
    same = F.col(f"r.{pid}") == F.col(f"o.{pid}")
    for i, g in enumerate(groups):
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{group}_{i}"))
    inside = Window.partitionBy(pid, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{local}_{at[k]}") for k, c in values.items()])
    joined = own.alias("r").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns if c not in values], *[(F.col(f"{local}_{at[k]}") + F.col(f"{offset}_{at[k]}")).alias(k) for k in values])


def shard_by_bytes(df: DataFrame, size: str, order: list[str], group: str | None = None, shards: int = 16) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard) to light rows.

    A row belongs to the shard in which its first byte falls. With ``group``, which must be the
    first order column, a cut that would part a group which fits in a shard moves to the nearer end
    of that group (the front, if both are as near); only a group of more bytes than an even shard
    is cut, since no shard could hold it.

    Defined cases: null sizes count 0; an empty table gives an empty result; equal rows are
    neighbours in any order, and so are rows whose group is null; other columns pass through,
    whatever their names, but for ``shard`` and ``slot``, which are replaced. One very long row is
    a shard of its own, and shards that it covers stay empty.
    """
    long, start, rank, first, shard_of, key = fresh("size", "start", "rank", "first", "shard", "group")
    one = fresh("one")[0]
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    base = df.withColumn(long, F.coalesce(F.col(size).cast("long"), F.lit(0))).withColumn(one, F.lit(1).cast("long"))
    rows = written(global_prefix_sums(base, order, {start: long, rank: one}), "shards")
    end = F.col(start) + F.col(long)
    total = rows.agg(F.sum(long)).first()[0] or 0
    targets = [-(-total * k // shards) for k in range(1, shards)]
    cuts = list(targets)
    if group and total:
        # Of each cut, the one row it falls in: at most shards - 1 groups come back.
        inside = F.array(*[F.lit(t).cast("long") for t in targets])
        hit = F.exists(inside, lambda t: (t > F.col(start)) & (t <= end))
        parted = rows.where(hit).select(F.col(group).alias(key)).distinct()
        spans = rows.join(F.broadcast(parted), F.col(group).eqNullSafe(F.col(key))).groupBy(key).agg(F.min(start).alias("a"), F.max(end).alias("b"))
        for r in spans.collect():
            for k, t in enumerate(targets):
                if r["a"] < t < r["b"] and (r["b"] - r["a"]) * shards <= total:
                    cuts[k] = r["a"] if t - r["a"] <= r["b"] - t else r["b"]
    shard: Column = F.lit(0)
    for t in cuts:
        shard = shard + (F.col(start) >= F.lit(t)).cast("int")
    placed = rows.withColumn(shard_of, shard.cast("int"))
    firsts = placed.groupBy(F.col(shard_of).alias(key)).agg(F.min(rank).alias(first))
    return (placed.join(F.broadcast(firsts), F.col(shard_of) == F.col(key))  # one row for each shard
            .select(*keep, F.col(shard_of).alias("shard"), (F.col(rank) - F.col(first)).alias("slot")))
