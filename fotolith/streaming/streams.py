"""Structured Streaming forms, with batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Hours of quiet after a sync (fixed value).
QUIET = 8


def coalesce_deltas(deltas: DataFrame, fields: list[str], debounce: str = "50 milliseconds", watermark: str = "10 minutes", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Merge the metadata deltas of a path until it is quiet for ``debounce``: of each field the last value
    that isn't null, in ``order``, which should tell all rows of a path apart. Works on streams (append mode)
    and tables alike; :mod:`.ordered` has the form with flush messages."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields]
    return deltas.withWatermark("ts", watermark).groupBy("path", F.session_window("ts", debounce).alias("w")).agg(*last, F.count("*").alias("merged")).select("path", F.col("w.start").alias("start"), *fields, "merged")


def burst_stream(photos: DataFrame, gap: str = "2 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Bursts of each session by session windows: photos less than ``gap`` apart."""
    return (photos.withWatermark("ts", watermark).groupBy("session_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("photos"), F.min("photo_id").alias("first_photo")).select("session_id", F.col("w.start").alias("start"), "photos", "first_photo"))


def telemetry_stream(events: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Events of each kind and interval, each event_id once."""
    own = events.withWatermark("ts", watermark)
    own = own.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else own.dropDuplicates(["event_id"])
    return own.groupBy(F.window("ts", window, slide).alias("w"), "kind").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_duration")).select(F.col("w.start").alias("start"), "kind", "n", "mean_duration")


def _or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``, nothing where none is written yet; any other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


EXAMPLES = "event_id long, photo_id long, y int, bucket long, batch long"


#: At most this many folders hold a batch's examples.
FOLDERS = 64


def _starts(buckets: list[int]) -> tuple[list[int], int]:
    """The least power of two by which buckets fall into no more than :data:`FOLDERS` runs of that length, and where
    these runs start."""
    step = 1
    while len(runs := {b // step * step for b in buckets}) > FOLDERS:
        step *= 2
    return sorted(runs), step


def put_examples(batch: DataFrame, number: int, path: str, width: int) -> None:
    """Write the examples of a batch's events that no other batch holds.

    The table lies in folders by bucket (``width`` event ids, or a run of such buckets, by its first, where a batch
    spans too many) and batch. A batch reads the buckets that its own events fall in, of runs of any
    length, and no more, so what it reads doesn't grow with history while ids rise with time; it rewrites
    its own folders only, so a batch that runs again leaves what it left before.
    """
    spark = batch.sparkSession
    fine = F.floor(F.col("event_id") / width)
    new = batch.where("event_id is not null").dropDuplicates(["event_id"])
    runs, step = _starts([r[0] for r in new.select(fine.alias("bucket")).distinct().collect()])  # no more than the batch's ids span
    new = new.withColumn("bucket", F.floor(fine / step) * step)
    held = _or_none(spark, path, EXAMPLES)
    if held is not None and runs:
        longer = {b // (step << i) * (step << i) for b in runs for i in range(1, 41)}
        near = F.col("bucket").isin(sorted(longer))
        for b in runs:
            near = near | F.col("bucket").between(b, b + step - 1)
        new = new.join(held.where(near & (F.col("batch") != number)).select("event_id"), "event_id", "left_anti")
    both = F.array(F.struct(F.col("winner").alias("photo_id"), F.lit(1).alias("y")), F.struct(F.col("loser").alias("photo_id"), F.lit(-1).alias("y")))
    rows = new.select("event_id", "bucket", F.explode(both).alias("e")).select("event_id", "e.*", "bucket", F.lit(number).cast("long").alias("batch"))
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def preference_stream(events: DataFrame, path: str, checkpoint: str, width: int = 1_000_000):
    """Examples of duel events (``event_id, winner, loser``), +1 and -1, each event once, also where it comes again
    in a later batch or a batch runs again; see :func:`put_examples`. Events without an id are left out."""
    return events.writeStream.foreachBatch(lambda batch, number: put_examples(batch, number, path, width)).option("checkpointLocation", checkpoint)


def reminders(events: DataFrame, unit: int = 3_600_000_000) -> DataFrame:
    """``directory, exported_at, remind_after, synced_at, dismissed`` of each exported folder. A new export
    starts afresh; a snooze moves the reminder by its ``hours``, a sync by eight. ``at_us`` counts in parts of
    ``unit`` to the hour; of events at one time the larger event_id is the later."""
    c = F.col
    e = events.where(c("action").isin("export", "snooze", "sync", "dismiss")).withColumn("when_", F.struct("at_us", "event_id"))
    e = e.withColumn("last_", F.max(F.when(c("action") == "export", c("when_"))).over(Window.partitionBy("directory"))).where(c("when_") >= c("last_"))
    hours = F.when(c("action") == "snooze", c("hours")).when(c("action") == "sync", QUIET).when(c("action") == "export", 0)
    g = e.groupBy("directory").agg(F.max("last_.at_us").alias("exported_at"), F.max_by(c("at_us") + hours * unit, F.when(hours.isNotNull(), c("when_"))).alias("remind_after"),
                                   F.max(F.when(c("action") == "sync", c("at_us"))).alias("synced_at"), F.max(c("action") == "dismiss").alias("dismissed"))
    return g


def reminder_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """``directory, remind_at`` when event time passes a folder's reminder; a dismissed folder stays quiet until
    it is exported again. The state of a folder is two numbers. A folder reminds once; a later snooze or sync
    sets the next reminder. ``ts`` is the event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        exported, due = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.update((exported, 0))
            yield pd.DataFrame({"directory": [key[0]], "remind_at": [pd.Timestamp(due, unit="ms")]})
            return
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            at = int(e.ts.timestamp() * 1000)
            if e.action == "export":
                exported, due = 1, at
            elif exported and e.action in ("snooze", "sync"):
                due = at + (int(e.hours) if e.action == "snooze" else QUIET) * 3_600_000
            elif exported and e.action == "dismiss":
                exported, due = 0, 0
        state.update((exported, due))
        if due:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", watermark).groupBy("directory")
    return keyed.applyInPandasWithState(step, "directory long, remind_at timestamp", "exported int, due long", "update", GroupStateTimeout.EventTimeTimeout)
