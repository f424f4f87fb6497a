"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; on a cluster that is an error, since
    executors don't see the driver's folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="fotolith-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, fixes what is not deterministic (range bounds, partition ids) and lets a
    lost executor be replaced without running the plan before it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(*names: str) -> list[str]:
    """Column names that no input has: helper columns must not clash with columns that pass through."""
    tag = uuid.uuid4().hex[:12]
    return [f"_{n}_{tag}" for n in names]


def smallest_by_hash(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The rows of the ``rows`` smallest hashes of ``key``, one row a hash: a bounded sample that doesn't
    depend on partitions. Only hashes are sorted; the rows themselves are read by the largest of them.
    Rows of equal keys must be equal in every column that is read."""
    h = F.xxhash64(key)
    top = df.select(h.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.withColumn("_h", h).where(F.col("_h") <= F.lit(top)).dropDuplicates(["_h"]).orderBy("_h").drop("_h")


def labelled_sample(df: DataFrame, text: str, label: str, rows: int) -> DataFrame:
    """``text, label`` of at most ``rows`` different texts, as many of each label as there are or an equal
    share: those of smallest hash.

    A text that stands there with several labels counts with the smallest of them, so the sample
    depends on the set of rows only, not on their order. A label's texts are thinned by a hash
    threshold (twice its share) before they are ranked, so no label is gathered whole.
    """
    light = df.select(F.xxhash64(text).alias("h"), F.col(label).alias("y")).groupBy("h").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in light.groupBy("y").agg(F.count("*").alias("n")).collect()}
    each = max(1, rows // max(len(counts), 1))
    spread = F.pmod(F.col("h"), F.lit(1 << 20))
    wanted: Column = F.lit(False)
    for y, n in counts.items():
        wanted = wanted | ((F.col("y") == F.lit(y)) & (spread < F.lit(min(1 << 20, max(1, (1 << 20) * 2 * each // n)))))
    few: dict[str, list[int]] = {}
    for r in light.where(wanted).collect():  # about 2 * rows pairs of a hash and a label
        few.setdefault(r["y"], []).append(r["h"])
    hashes = {h: y for y, own in few.items() for h in sorted(own, key=lambda h: (h % (1 << 20), h))[:each]}
    if not hashes:
        return df.select(F.col(text).alias("text"), F.col(label).alias("label")).limit(0)
    # isin over at most ``rows`` hashes is one set look-up a row; the texts come once each.
    picked = df.select(F.col(text).alias("text"), F.xxhash64(text).alias("h")).where(F.col("h").isin(list(hashes))).dropDuplicates(["h"])
    spark = df.sparkSession
    labels = spark.createDataFrame(list(hashes.items()), "h long, label string")
    return picked.join(F.broadcast(labels), "h").orderBy("h").select("text", "label")  # at most ``rows`` rows
