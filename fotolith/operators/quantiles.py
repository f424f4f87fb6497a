"""Exact quantiles and means that stay distributed, however few the groups are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import written


def mean(x: Column) -> Column:
    """The mean to nine places of each value, summed as whole numbers: no order of summation changes a bit."""
    return F.sum(F.round(x * F.lit(1e9)).cast("decimal(20,0)")).cast("double") / (F.count(x) * F.lit(1e9))


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def exact_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], index: bool = False) -> DataFrame:
    """One row for each group of ``by`` with a column for each name of ``wanted``: its quantile (0 to 1) of the
    column's non-null values, between two of them by weight, or with ``index`` the value at floor(n * q).

    No task holds the values of a group: equal values are counted first, the counts are dealt by ranges
    of (group, field, value), and totals of the ranges tell how many values lie before each; the rows
    that hold the wanted ranks are then at most two for each quantile. A field without values is null;
    a table without rows has no groups (with no ``by``, one row of nulls).
    """
    spark = df.sparkSession
    columns = {str(c): c for c, _ in wanted.values()}
    fields = {k: i for i, k in enumerate(columns)}
    cells = F.array(*[F.struct(F.lit(i).alias("f"), columns[k].cast("double").alias("v")) for k, i in fields.items()])
    keys = [*by, "f"]
    counts = df.select(*by, F.explode(cells).alias("x")).select(*by, "x.*").where("v is not null AND NOT isnan(v)").groupBy(*keys, "v").agg(F.count("*").alias("held"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range of a row is written with it: sampled bounds may differ when a plan runs again.
    rows = written(counts.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    totals = rows.groupBy("part", *keys).agg(F.sum("held").alias("sum"))
    totals = totals.select("part", *keys, F.coalesce(F.sum("sum").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("sum").over(group).alias("n"))
    inside = Window.partitionBy("part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("local", F.coalesce(F.sum("held").over(inside), F.lit(0)))
    at = own.alias("r").join(totals.alias("t"), _same("r", "t", ["part", *keys])).select("r.*", "t.offset", "t.n").withColumn("lo", F.col("offset") + F.col("local"))
    place = lambda q: F.floor(F.col("n") * F.lit(q)).cast("double") if index else (F.col("n") - 1) * F.lit(q)
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(fields[str(c)]).alias("f"), place(q).alias("at")) for name, (c, q) in wanted.items()])
    holds = lambda p: (p >= F.col("lo")) & (p < F.col("lo") + F.col("held"))
    hits = at.withColumn("x", F.explode(F.filter(asked, lambda x: (x["f"] == F.col("f")) & (holds(F.floor(x["at"])) | holds(F.ceil(x["at"])))))).select(*by, "x.name", "x.at", "v", "lo", "held")
    ends = hits.groupBy(*by, "name", "at").agg(F.max(F.when(holds(F.floor("at")), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("high"))
    weight = F.col("at") - F.floor("at")
    value = ends.withColumn("value", F.when(weight == 0, F.col("low")).otherwise(F.col("low") * (1 - weight) + F.col("high") * weight))
    return value.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted])


def with_quantiles(summary: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """A summary (one row a group) with its quantiles; groups may be null."""
    if not by:
        return summary.join(F.broadcast(quantiles))  # one row each
    joined = summary.alias("s").join(quantiles.alias("q"), _same("s", "q", by), "left")
    return joined.select("s.*", *[f"q.{c}" for c in quantiles.columns if c not in by])


def ranks(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order`` within its group, nulls first. Rows are dealt by ranges of
    (group, order) and counted there, so no task holds a group; rows that ``order`` doesn't tell apart have
    places that a new run may deal otherwise."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    totals = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1)
    joined = local.alias("r").join(totals.alias("t"), _same("r", "t", ["_part", *by]))
    return joined.select(*[f"r.{c}" for c in df.columns], (F.col("_local") + F.col("_before")).cast("long").alias(name))
