"""Tables kept by session: upserts that rewrite what they touch, versioned snapshots, undoing an export.

A table lies in one folder for each bucket of sessions (and version), so that its folders don't grow in number
with its sessions. Writes replace whole folders, dynamically: those that a write has rows for and no
others, so a write that runs again leaves what it left before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import written

#: Buckets named in a partition filter; with more, a semi-join finds them.
NAMED = 10_000
#: Into how many buckets sessions are dealt by their hash; a table keeps to it.
BUCKETS = 64
BUCKET = "session_bucket"


def _bucket(session: str) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``, nothing where none is written yet; any other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def _replace(df: DataFrame, path: str, parts: list[str]) -> None:
    """A large folder's rows are cut into several files, each by a task."""
    df.hint("rebalance", *[F.col(c) for c in parts]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def upsert_sessions(updates: DataFrame, path: str, keys: list[str], seq: str, session: str = "session_id") -> None:
    """Put ``updates`` into the table at ``path``: the last write of each key (by ``seq``) wins, whole rows.

    Only folders of buckets that hold sessions which ``updates`` names are read and rewritten; the first call
    makes the table. The merged rows are written aside before they replace the folders they came from.
    Columns that an update lacks are null in its rows. Of equal ``seq`` the update counts; rows without a
    session are kept in their bucket like others.
    """
    spark = updates.sparkSession
    held = read_or_none(spark, path, f"{_schema(updates)}, {BUCKET} int")
    new = updates.withColumns({BUCKET: _bucket(session), "_new": F.lit(1)})
    if held is not None:
        touched = new.select(BUCKET).distinct()
        named = [r[0] for r in touched.limit(NAMED + 1).collect()]
        held = held.where(F.col(BUCKET).isin(named)) if len(named) <= NAMED else held.join(touched, BUCKET, "left_semi")
        new = held.withColumn("_new", F.lit(0)).unionByName(new)
    w = Window.partitionBy(session, *keys).orderBy(F.desc_nulls_last(seq), F.desc("_new"))
    last = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")
    _replace(last if held is None else written(last), path, [BUCKET])


def save_version(df: DataFrame, path: str, version: int, session: str = "session_id") -> None:
    """Write the sessions that ``df`` has rows of as ``version``; sessions it lacks keep their newest one. Other
    sessions that this version has already stay in it."""
    rows = df.withColumns({BUCKET: _bucket(session), "version": F.lit(version).cast("long")})
    held = read_or_none(df.sparkSession, path, _schema(rows))
    if held is not None:
        held = held.where(F.col("version") == version)
        if not held.isEmpty():
            rows = written(rows)
            own = rows.select(F.col(session).alias("_session"), F.col(BUCKET).alias("_bucket")).distinct()
            others = held.join(F.broadcast(own.select("_bucket").distinct()), F.col(BUCKET) == F.col("_bucket"), "left_semi")
            others = others.join(own, F.col(session).eqNullSafe(F.col("_session")), "left_anti")
            rows = written(rows.unionByName(others))
    _replace(rows, path, ["version", BUCKET])


def as_of(spark: SparkSession, path: str, schema: str, version: int, session: str = "session_id", gone: str = "photo_id") -> DataFrame:
    """Each session as it stood at ``version``: its newest version that isn't newer, without rows whose
    ``gone`` is null (they only say that the session was empty then). Newer versions are not read; which of the
    others is a session's newest is read from the column of sessions alone."""
    t = spark.read.schema(f"{schema}, version long").parquet(path).drop(BUCKET).where(F.col("version") <= version)
    newest = t.groupBy(F.col(session).alias("_session")).agg(F.max("version").alias("_newest"))
    same = F.col(session).eqNullSafe(F.col("_session")) & (F.col("version") == F.col("_newest"))
    return t.where(F.col(gone).isNotNull()).join(newest, same).drop("_session", "_newest", "version")


def restore_version(spark: SparkSession, path: str, schema: str, undo: int, session: str = "session_id", gone: str = "photo_id") -> int:
    """Undo version ``undo``: the sessions it wrote stand again as they did before, in a new version, whose
    number is returned. A session that wasn't there before is empty again."""
    full = f"{schema}, version long"
    t = spark.read.schema(full).parquet(path)
    wrote = t.where(F.col("version") == undo).select(F.col(session).alias("_wrote")).distinct()
    before = as_of(spark, path, schema, undo - 1, session, gone).join(wrote, F.col(session).eqNullSafe(F.col("_wrote")), "left_semi")
    there = before.select(session).distinct()
    empty = wrote.join(there, F.col("_wrote").eqNullSafe(there[session]), "left_anti").select(F.col("_wrote").alias(session))
    number = (t.agg(F.max("version")).first()[0] or 0) + 1
    save_version(written(before.unionByName(empty, allowMissingColumns=True)), path, number, session)
    return number


def undo_counts(manifest: DataFrame, current: DataFrame, by: str = "folder_id") -> DataFrame:
    """What undoing an export does, by folder: packets restored, cleared (there was none before), failed (the file
    is gone) and all. ``manifest`` has ``path, previous`` and ``by``; ``current`` the paths that are there."""
    j = manifest.join(current.select("path").distinct().withColumn("_here", F.lit(True)), "path", "left")
    here, had = F.col("_here").isNotNull(), F.col("previous").isNotNull()
    return j.groupBy(by).agg(F.count_if(here & had).alias("restored"), F.count_if(here & ~had).alias("cleared"), F.count_if(~here).alias("failed"), F.count("*").alias("total"))
