"""Session helpers and SQL-registered scalar functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary folder; on a
    cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="fotolith-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def register(spark: SparkSession) -> None:
    """SQL functions hamming64, cosine, iou and haversine_km, as SQL expressions that Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
              " / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(la DOUBLE, lo DOUBLE, lb DOUBLE, lp DOUBLE) RETURNS DOUBLE RETURN"
              " 12742D * asin(sqrt(least(1D, pow(sin((radians(lb) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin((radians(lp) - radians(lo)) / 2), 2))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION iou(al DOUBLE, at DOUBLE, ar DOUBLE, ab DOUBLE, bl DOUBLE, bt DOUBLE, br DOUBLE, bb DOUBLE) RETURNS DOUBLE RETURN"
              " greatest(0D, least(ar, br) - greatest(al, bl)) * greatest(0D, least(ab, bb) - greatest(at, bt))"
              " / ((ar - al) * (ab - at) + (br - bl) * (bb - bt) - greatest(0D, least(ar, br) - greatest(al, bl)) * greatest(0D, least(ab, bb) - greatest(at, bt)))")
