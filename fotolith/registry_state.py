"""Registered queries of ordered streams and kept tables, with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixtures import view
from .functions.session import shared_dir, written
from .operators import sessions
from .registry import _query
from .sources import maintenance, tables
from .streaming import ordered, streams

#: Shots of a day lie in its first 24 minutes, so a session's shots are seconds apart.
SHOTS = """p AS (SELECT v.*, e.ts AS shot, CAST(date_trunc('day', e.ts) AS TIMESTAMP) + v.t_us * INTERVAL 1 MICROSECOND AS ts FROM v_photos v JOIN events e ON e.event_id = v.photo_id)"""


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _shots(spark, d) -> DataFrame:
    """Photos with the time of the shot, ``ts``."""
    p = view(spark, d, "v_photos")
    day = spark.table("events").select(F.col("event_id").alias("photo_id"), F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")).alias("day_us"))
    return p.join(day, "photo_id").withColumn("ts", F.timestamp_micros(F.col("day_us") + F.col("t_us"))).drop("day_us")


def cut(df: DataFrame, batch: Column, path: str, batches: int) -> DataFrame:
    """Write rows as files in ``batches`` goes and read them as a stream, eight files a batch or as many as a go has,
    so that a stream's batches don't grow in number with its rows."""
    spark = df.sparkSession
    rows = written(df.withColumn("_batch", batch))
    for b in range(batches):
        rows.where(F.col("_batch") == b).drop("_batch").write.mode("append").parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(8, -(-files // batches))).parquet(path)


def _by_days(days: int = 8) -> Column:
    """The batch of a row: some days each, a fifth of the rows a batch late."""
    return F.floor(F.dayofmonth("ts") / days) + (F.pmod(F.xxhash64("seq"), F.lit(5)) == 0).cast("int")


def _end(df: DataFrame, **values) -> DataFrame:
    """One more row, a year on, that moves the watermark past all others."""
    last = df.sparkSession.range(1).select(*[(values[c] if c in values else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(last)


def deltas(spark, d) -> DataFrame:
    """Metadata changes of paths: fields that come and go, an extra map, flush messages; a tenth at one instant."""
    p, k = _shots(spark, d), F.col("k")
    extra = F.map_from_entries(F.filter(F.array(F.when(k % 4 == 0, F.struct(F.lit("Contrast").alias("k"), k.cast("string").alias("v"))), F.when(k % 6 == 0, F.struct(F.lit("Clarity").alias("k"), (k + 1).cast("string").alias("v")))), lambda x: x.isNotNull()))
    ts = F.when(F.col("photo_id") % 10 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return p.select((F.col("folder_id") % 20).alias("path"), ts.alias("ts"), F.col("photo_id").alias("seq"), F.when(k % 3 == 0, k).cast("long").alias("rating"), F.when(k % 5 == 0, F.concat(F.lit("l"), k.cast("string"))).alias("label"),
                    F.when(k % 2 == 0, k / F.lit(8.0)).alias("exposure"), extra.alias("extra"), (k % 13 == 0).alias("flush"))


FIELDS = {"rating": "long", "label": "string", "exposure": "double"}
DELTAS = "WITH " + SHOTS + r""",
d AS (SELECT folder_id % 20 AS path, epoch_us(CASE WHEN photo_id % 10 = 0 THEN date_trunc('day', ts)::TIMESTAMP ELSE ts END) AS moment, photo_id AS seq, CASE WHEN k % 3 = 0 THEN k END AS rating, CASE WHEN k % 5 = 0 THEN 'l' || k END AS label,
  CASE WHEN k % 2 = 0 THEN k / #8.0# END AS exposure, CASE WHEN k % 4 = 0 THEN k END AS contrast, CASE WHEN k % 6 = 0 THEN k + 1 END AS clarity, k % 13 = 0 AS flush FROM p),
g AS (SELECT *, CASE WHEN moment - lag(moment) OVER w >= 30000000 OR lag(flush) OVER w THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY path ORDER BY moment, seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY moment, seq) AS segment FROM g),
m AS (SELECT path, segment, min(moment) FILTER (NOT flush) AS first_us, max(moment) FILTER (NOT flush) AS last_us, last(rating ORDER BY moment, seq) FILTER (NOT flush AND rating IS NOT NULL) AS rating, last(label ORDER BY moment, seq) FILTER (NOT flush AND label IS NOT NULL) AS label,
  last(exposure ORDER BY moment, seq) FILTER (NOT flush AND exposure IS NOT NULL) AS exposure, last(contrast ORDER BY moment, seq) FILTER (NOT flush AND contrast IS NOT NULL) AS contrast, last(clarity ORDER BY moment, seq) FILTER (NOT flush AND clarity IS NOT NULL) AS clarity,
  count(*) FILTER (NOT flush) AS merged, bool_or(flush) AS flushed FROM s GROUP BY path, segment)
SELECT path, first_us, last_us, rating, label, exposure, '{' || concat_ws(',', '"Clarity":"' || clarity || '"', '"Contrast":"' || contrast || '"') || '}' AS extra, merged, CASE WHEN flushed THEN 'flush' ELSE 'quiet' END AS cause FROM m WHERE merged > 0"""


@_query(DELTAS)
def merged_deltas(spark, d):
    return ordered.coalesce_deltas(deltas(spark, d), list(FIELDS), 30_000_000)


@_query(DELTAS)
def delta_stream(spark, d):
    at = _folder(spark)
    rows = _end(deltas(spark, d), ts=F.lit("2030-01-01"), path=F.lit(-1), seq=F.lit(-1), flush=F.lit(True))
    stream = cut(rows, F.when(F.col("path") < 0, 5).otherwise(_by_days()), f"{at}/in", 6)
    return ordered.run_to_end(ordered.delta_stream(stream, FIELDS, 30_000_000, "20 days"), f"{at}/out", f"{at}/state")()


@_query("WITH " + SHOTS + """, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 4000000 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY session_id ORDER BY ts, photo_id))
SELECT session_id, photo_id, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY ts, photo_id) AS BIGINT) AS burst FROM g""")
def burst_fold_stream(spark, d):
    at = _folder(spark)
    rows = _shots(spark, d).select("session_id", "ts", F.col("photo_id").alias("seq"), "photo_id")
    rows = _end(rows, session_id=F.lit("end"), ts=F.lit("2030-01-01"), seq=F.lit(-1), photo_id=F.lit(-1))
    stream = cut(rows, F.when(F.col("seq") < 0, 5).otherwise(_by_days()), f"{at}/in", 6)
    out = ordered.fold_stream(stream, ordered.Bursts(4_000_000), "session_id", "session_id string, photo_id long, burst long", "20 days")
    return ordered.run_to_end(out, f"{at}/out", f"{at}/state")().where("photo_id >= 0")


#: The fold of light sessions as recursion over each session's photos, its members as sorted lists.
LIGHT = """WITH RECURSIVE o AS (SELECT l.photo_id, l.session_id, row_number() OVER (PARTITION BY l.session_id ORDER BY p.t_us, l.photo_id) AS i, log2(greatest(l.global_lum, #0.0001#) / #0.18#) AS ev, l.wb_temp, l.wb_tint, count(*) OVER (PARTITION BY l.session_id) AS last FROM v_light l JOIN v_photos p USING (photo_id)),
s AS (SELECT session_id, 0::BIGINT AS i, 0::BIGINT AS n, []::DOUBLE[] AS evs, []::DOUBLE[] AS temps, []::DOUBLE[] AS tints, []::BIGINT[] AS stray, []::DOUBLE[] AS sev, []::DOUBLE[] AS stemp, []::DOUBLE[] AS stint, []::BIGINT[] AS told FROM o GROUP BY session_id
UNION ALL SELECT session_id, i + 1, CASE WHEN opens THEN n + 1 ELSE n END,
  CASE WHEN opens THEN list_sort(sev) WHEN stays THEN list_sort(list_concat(evs, sev)) ELSE evs END, CASE WHEN opens THEN list_sort(list_filter(stemp, lambda x: x IS NOT NULL)) WHEN stays THEN list_sort(list_concat(temps, list_filter(stemp, lambda x: x IS NOT NULL))) ELSE temps END,
  CASE WHEN opens THEN list_sort(list_filter(stint, lambda x: x IS NOT NULL)) WHEN stays THEN list_sort(list_concat(tints, list_filter(stint, lambda x: x IS NOT NULL))) ELSE tints END,
  CASE WHEN opens OR stays THEN [] ELSE stray END, CASE WHEN opens OR stays THEN [] ELSE sev END, CASE WHEN opens OR stays THEN [] ELSE stemp END, CASE WHEN opens OR stays THEN [] ELSE stint END, CASE WHEN opens OR stays OR i + 1 = last THEN stray ELSE [] END
  FROM (SELECT *, NOT far AS stays, far AND len(stray) >= 4 AS opens FROM (SELECT s.session_id, s.i, s.n, s.evs, s.temps, s.tints, list_append(s.stray, o.photo_id) AS stray, list_append(s.sev, o.ev) AS sev, list_append(s.stemp, o.wb_temp) AS stemp, list_append(s.stint, o.wb_tint) AS stint, o.last,
    len(s.evs) > 0 AND (abs(o.ev - s.evs[len(s.evs) // 2 + 1]) > 1 OR coalesce(abs(o.wb_temp - s.temps[len(s.temps) // 2 + 1]) > 12, false) OR coalesce(abs(o.wb_tint - s.tints[len(s.tints) // 2 + 1]) > 12, false)) AS far
    FROM s JOIN o ON o.session_id = s.session_id AND o.i = s.i + 1)))
SELECT session_id, unnest(told) AS photo_id, n AS light_session FROM s"""


@_query(LIGHT)
def light_sessions(spark, d):
    return sessions.light_sessions(view(spark, d, "v_light").join(view(spark, d, "v_photos").select("photo_id", "t_us"), "photo_id"))


def _light(spark, d) -> DataFrame:
    p = view(spark, d, "v_light").select("photo_id", "global_lum", "wb_temp", "wb_tint").join(_shots(spark, d).select("photo_id", "session_id", "ts"), "photo_id")
    return p.withColumn("seq", F.col("photo_id"))


@_query(LIGHT)
def light_session_stream(spark, d):
    at = _folder(spark)
    rows = _end(_light(spark, d), session_id=F.lit("end"), ts=F.lit("2030-01-01"), seq=F.lit(-1), photo_id=F.lit(-1), global_lum=F.lit(0.5))
    stream = cut(rows, F.when(F.col("seq") < 0, 5).otherwise(_by_days()), f"{at}/in", 6)
    out = ordered.fold_stream(stream, ordered.Light(), "session_id", "session_id string, photo_id long, light_session long", "20 days")
    return ordered.run_to_end(out, f"{at}/out", f"{at}/state")().where("photo_id >= 0")


@_query("WITH e AS (SELECT photo_id AS event_id, photo_id AS winner, photo_id + 1 AS loser FROM v_photos WHERE k % 3 = 0) SELECT event_id, winner AS photo_id, 1 AS y FROM e UNION ALL SELECT event_id, loser, -1 FROM e")
def preference_examples(spark, d):
    """Duels over several batches, every seventh of them sent again in another one."""
    at = _folder(spark)
    p = _shots(spark, d).where("k % 3 = 0").select("ts", F.col("photo_id").alias("seq"), F.col("photo_id").alias("event_id"), F.col("photo_id").alias("winner"), (F.col("photo_id") + 1).alias("loser"))
    again = p.where("event_id % 7 = 0").withColumn("seq", -F.col("seq"))
    stream = cut(p.unionByName(again), F.least(_by_days() + (F.col("seq") < 0).cast("int"), F.lit(4)), f"{at}/in", 5)
    streams.preference_stream(stream, f"{at}/out", f"{at}/state", 1000).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streams.EXAMPLES).parquet(f"{at}/out").select("event_id", "photo_id", "y")


@_query("SELECT session_id, photo_id, CASE WHEN photo_id % 7 = 0 AND folder_id % 2 = 0 THEN k + 1000 ELSE k END AS k, CASE WHEN photo_id % 7 = 0 AND folder_id % 2 = 0 THEN 2 ELSE 1 END AS seq FROM v_photos UNION ALL SELECT session_id, photo_id + 1000000000, k, 2 FROM v_photos WHERE photo_id % 11 = 0 AND folder_id % 2 = 0")
def session_upsert(spark, d):
    """The table of photos after new values, stale ones (an older sequence) and new photos came in."""
    at = _folder(spark)
    p = view(spark, d, "v_photos").select("session_id", "photo_id", "folder_id", "k", F.lit(1).alias("seq"))
    maintenance.upsert_sessions(p.drop("folder_id"), at, ["photo_id"], "seq")
    own = p.where("folder_id % 2 = 0")
    new = own.where("photo_id % 7 = 0").withColumns({"k": F.col("k") + 1000, "seq": F.lit(2)})
    stale = own.where("photo_id % 5 = 0").withColumns({"k": F.lit(-1), "seq": F.lit(0)})
    more = own.where("photo_id % 11 = 0").withColumns({"photo_id": F.col("photo_id") + 1_000_000_000, "seq": F.lit(2)})
    maintenance.upsert_sessions(new.unionByName(stale).unionByName(more).drop("folder_id"), at, ["photo_id"], "seq")
    return spark.read.schema("photo_id long, k int, seq int, session_id string").parquet(at).select("session_id", "photo_id", "k", "seq")


SNAPSHOT = "photo_id long, label string, develop string, crop double, identities array<long>, session_id string"


def _snapshots(spark, d) -> str:
    """Exports of sessions in three versions: all, those of some days again, and those undone."""
    at = _folder(spark)
    x = view(spark, d, "v_decisions").withColumns({"error": F.col("k") % 10 == 9, "linked_raw": F.when(F.col("photo_id") % 4 == 1, F.col("photo_id") + 1_000_000_000), "develop": F.when(F.col("k") % 2 == 0, F.concat(F.lit("ev"), F.col("k").cast("string"))),
                                                   "crop": F.when(F.col("k") % 3 == 0, F.col("k") / F.lit(100.0)), "identities": F.when(F.col("k") % 4 == 0, F.array((F.col("photo_id") % 9)))})
    snap = lambda df: tables.build_snapshot(df, ("session_id",)).select("photo_id", "label", "develop", "crop", "identities", "session_id")
    maintenance.save_version(snap(x.where("NOT endswith(session_id, '-03')")), at, 1)
    later = x.where("endswith(session_id, '-03') OR endswith(session_id, '-04')").withColumn("label", F.when(F.col("k") % 2 == 0, "recommended").otherwise(F.col("label")))
    maintenance.save_version(snap(later), at, 2)
    return at


_SNAP = """x AS (SELECT photo_id, session_id, k, label, {label} AS now, unnest(CASE WHEN photo_id % 4 = 1 THEN [photo_id, photo_id + 1000000000] ELSE [photo_id] END) AS file FROM v_decisions WHERE k % 10 <> 9)
SELECT session_id, file AS photo_id, now AS label, CASE WHEN k % 2 = 0 THEN 'ev' || k END AS develop, CASE WHEN k % 3 = 0 THEN k / #100.0# END AS crop, CASE WHEN k % 4 = 0 THEN photo_id % 9 END AS person FROM x"""


def _snapshot_columns(df: DataFrame) -> DataFrame:
    return df.select("session_id", "photo_id", "label", "develop", "crop", F.try_element_at("identities", F.lit(1)).alias("person"))


@_query("WITH " + _SNAP.format(label="CASE WHEN (session_id LIKE '%-03' OR session_id LIKE '%-04') AND k % 2 = 0 THEN 'recommended' ELSE label END"))
def snapshot_latest(spark, d):
    return _snapshot_columns(maintenance.as_of(spark, _snapshots(spark, d), SNAPSHOT, 2))


@_query("WITH " + _SNAP.format(label="label") + " WHERE session_id NOT LIKE '%-03'")
def snapshot_before(spark, d):
    return _snapshot_columns(maintenance.as_of(spark, _snapshots(spark, d), SNAPSHOT, 1))


@_query("WITH " + _SNAP.format(label="label") + " WHERE session_id NOT LIKE '%-03'")
def snapshot_restored(spark, d):
    """After version 2 is undone, the newest state is that of version 1 again."""
    at = _snapshots(spark, d)
    return _snapshot_columns(maintenance.as_of(spark, at, SNAPSHOT, maintenance.restore_version(spark, at, SNAPSHOT, 2)))


@_query("SELECT folder_id, count(*) FILTER (photo_id % 3 <> 0 AND photo_id % 2 <> 0) AS restored, count(*) FILTER (photo_id % 3 <> 0 AND photo_id % 2 = 0) AS cleared, count(*) FILTER (photo_id % 3 = 0) AS failed, count(*) AS total FROM v_files GROUP BY folder_id")
def undo_counts(spark, d):
    f = view(spark, d, "v_files").select("photo_id", "folder_id", F.col("photo_id").cast("string").alias("path"), F.when(F.col("photo_id") % 2 != 0, F.concat(F.lit("packet "), F.col("k").cast("string"))).alias("packet"))
    kept = tables.capture_state(f.select("path").union(f.select("path")), f).join(f.select("path", "folder_id"), "path")
    return maintenance.undo_counts(kept, f.where("photo_id % 3 <> 0"))
