"""Ordered streams and kept tables: any cut into batches gives the table's result; writes touch what they must."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fotolith.sources import maintenance
from fotolith.streaming import ordered, streams

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def in_batches(spark, df, fold, key, out, path, batches, seed):
    """The fold over a stream of ``df`` cut at random, rows in any order, and a last row that ends all keys."""
    rng = random.Random(seed)
    data = [tuple(r) for r in df.collect()]
    end = df.columns.index("ts")
    parts = [[] for _ in range(batches)]
    for r in data:
        parts[rng.randrange(batches)].append(r)
    last = list(data[0])
    last[end], last[df.columns.index(key)] = T0 + dt.timedelta(days=400), "end"
    for part in [*parts, [tuple(last)]]:
        rng.shuffle(part)
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    done = ordered.run_to_end(ordered.fold_stream(stream, fold, key, out, "30 days"), f"{path}/out", f"{path}/state")
    return rows(done().where(F.col(key) != "end"))


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_in_any_cut(spark, tmp_path, seed):
    """Ties of time, nulls, maps, flush messages with and without something pending, a gap of just the debounce."""
    rng = random.Random(seed)
    data = []
    for i in range(60):
        at = T0 + dt.timedelta(seconds=rng.choice([0, 0, 1, 2, 5, 7, 9, 30, 60]) + 100 * rng.randrange(3))
        data.append((rng.choice("ab"), at, i, rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), rng.choice([None, {}, {"A": "1"}, {"B": str(i), "A": None}]), rng.random() < 0.15 or None))
    df = spark.createDataFrame(data, "path string, ts timestamp, seq long, rating long, label string, extra map<string,string>, flush boolean")
    want = rows(ordered.coalesce_deltas(df, ["rating", "label"], 5_000_000))
    fold, out = ordered.Deltas(["rating", "label"], 5_000_000), "path string, first_us long, last_us long, rating long, label string, extra string, merged long, cause string"
    table = ordered.fold_table(df, fold, "path", out)
    assert want and [tuple(None if x != x else x for x in r) for r in rows(table)] == want and {r[-1] for r in want} == {"flush", "quiet"}
    assert in_batches(spark, df, fold, "path", out, tmp_path, 4, seed) == want


@pytest.mark.parametrize("batches", [1, 5])
def test_light_and_bursts_in_any_cut(spark, tmp_path, batches):
    rng = random.Random(batches)
    data, at = [], 0.0
    for i in range(80):
        at += rng.choice([0.5, 1, 4, 4.000001, 20])
        level = 0.18 if i // 9 % 2 else 0.7
        data.append(("s%d" % (i % 2), T0 + dt.timedelta(seconds=at), i, i, level * rng.choice([1, 1, 1, 5]), rng.choice([None, 1.0, 30.0]), 0.5))
    df = spark.createDataFrame(data, "session_id string, ts timestamp, seq long, photo_id long, global_lum double, wb_temp double, wb_tint double")
    for name, fold, out in (("l", ordered.Light(), "session_id string, photo_id long, light_session long"), ("b", ordered.Bursts(4_000_000), "session_id string, photo_id long, burst long")):
        want = rows(ordered.fold_table(df, fold, "session_id", out))
        assert len(want) == 80 and len({r[2] for r in want}) > 1
        assert in_batches(spark, df, fold, "session_id", out, f"{tmp_path}/{name}", batches, 3) == want


def test_quiet_sessions_are_forgotten():
    """A fold that is through leaves nothing behind."""
    for fold in (ordered.Light(), ordered.Bursts(4_000_000), ordered.Deltas(["r"], 5)):
        state = {}
        fold.advance(state, [(0, 0, '{"photo_id": 1, "global_lum": 0.2, "r": 1}')], 1)
        assert state
        fold.advance(state, [], 2 * ordered.DAY)
        assert not state


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """A run that stops between batches keeps waiting rows and half-decided sessions in its state."""
    schema = "session_id string, ts timestamp, seq long, photo_id long"
    out = "session_id string, photo_id long, burst long"
    for n, seconds in enumerate(([0, 3, 50], [1, 52, 53], [54, 90000])):
        spark.createDataFrame([("s", T0 + dt.timedelta(seconds=s), s, s) for s in seconds], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ordered.fold_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ordered.Bursts(4_000_000), "session_id", out, "60 seconds")
        got = rows(ordered.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/state")())
        assert len(got) == (0, 0, 7)[n]
    assert [r[1:] for r in sorted(got, key=lambda r: r[1])] == [(0, 1), (1, 1), (3, 1), (50, 2), (52, 2), (53, 2), (54, 2)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    at = f"{tmp_path}/t"
    batch = lambda ids: spark.createDataFrame([(i, 10 * i, 10 * i + 1) for i in ids], "event_id long, winner long, loser long")
    streams.put_examples(batch([1, 2, 2, 150]), 0, at, 100)
    streams.put_examples(batch([2, 151, 260]), 1, at, 100)
    want, held = rows(spark.read.parquet(at)), files(at)
    assert len(want) == 2 * 5
    streams.put_examples(batch([2, 151, 260]), 1, at, 100)
    assert rows(spark.read.parquet(at)) == want
    streams.put_examples(batch([261, 270]), 2, at, 100)
    streams.put_examples(spark.createDataFrame([], "event_id long, winner long, loser long"), 3, at, 100)
    old = {f: t for f, t in files(at).items() if "bucket=0" in f or "bucket=1" in f}
    assert len(spark.read.parquet(at).collect()) == 14 and {f for f in old if "batch=0" in f} == {f for f in held if "batch=0" in f}


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    """Of a history of ten buckets a batch's plan names its own one."""
    at = f"{tmp_path}/t"
    streams.put_examples(spark.range(1000).select(F.col("id").alias("event_id"), F.col("id").alias("winner"), F.col("id").alias("loser")), 0, at, 100)
    held = streams._or_none(spark, at, streams.EXAMPLES).where(F.col("bucket").isin([9]) & (F.col("batch") != 1))
    assert held._jdf.queryExecution().toRdd().getNumPartitions() and len(held.inputFiles()) == 10
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert held.count() == 200


def test_broken_tables_are_errors(spark, tmp_path):
    """Only a missing table means that nothing is there yet."""
    (tmp_path / "bucket=0" / "batch=0").mkdir(parents=True)
    (tmp_path / "bucket=0" / "batch=0" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        streams.put_examples(spark.createDataFrame([(1, 2, 3)], "event_id long, winner long, loser long"), 1, str(tmp_path), 100)
    assert maintenance.read_or_none(spark, f"{tmp_path}/none", "a int") is None


def test_upsert_rewrites_the_sessions_it_touches(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    schema = "session_id string, photo_id long, k int, seq int"
    maintenance.upsert_sessions(spark.createDataFrame([("a/1", 1, 10, 1), ("a/1", 2, 20, 1), ("b", 3, 30, 1), (None, 4, 40, 1)], schema), at, ["photo_id"], "seq")
    for named in (maintenance.NAMED, 0):
        monkeypatch.setattr(maintenance, "NAMED", named)
        before = files(at)
        maintenance.upsert_sessions(spark.createDataFrame([("a/1", 2, 21, 2), ("a/1", 1, 9, 0), ("c", 5, 50, 1), (None, 4, 41, 1)], schema), at, ["photo_id"], "seq")
        want = [("a/1", 1, 10, 1), ("a/1", 2, 21, 2), ("b", 3, 30, 1), ("c", 5, 50, 1), (None, 4, 41, 1)]
        assert rows(spark.read.schema("photo_id long, k int, seq int, session_id string").parquet(at).select("session_id", "photo_id", "k", "seq")) == sorted(want, key=str)
        assert {f: t for f, t in before.items() if "session_id=b" in f} == {f: t for f, t in files(at).items() if "session_id=b" in f}


def test_versions_and_undoing(spark, tmp_path):
    at, schema = f"{tmp_path}/t", "photo_id long, label string, session_id string"
    put = lambda data, n: maintenance.save_version(spark.createDataFrame(data, schema), at, n)
    put([(1, "x", "a"), (2, "x", "b")], 1)
    put([(1, "y", "a"), (3, "y", "c")], 2)
    put([(2, "z", "b")], 3)
    seen = lambda n: rows(maintenance.as_of(spark, at, schema, n).select("photo_id", "label"))
    assert (seen(0), seen(1), seen(2), seen(3)) == ([], [(1, "x"), (2, "x")], [(1, "y"), (2, "x"), (3, "y")], [(1, "y"), (2, "z"), (3, "y")])
    put([(2, "z", "b")], 3)
    assert seen(3) == [(1, "y"), (2, "z"), (3, "y")]
    number = maintenance.restore_version(spark, at, schema, 2)
    assert number == 4 and seen(4) == [(1, "x"), (2, "z")] and seen(2) == [(1, "y"), (2, "x"), (3, "y")]


def test_undo_counts(spark):
    kept = spark.createDataFrame([("p", "old", 1), ("q", None, 1), ("r", "old", 1), ("s", None, 2)], "path string, previous string, folder_id int")
    here = spark.createDataFrame([("p",), ("p",), ("q",), ("s",)], "path string")
    assert rows(maintenance.undo_counts(kept, here)) == [(1, 1, 1, 1, 3), (2, 0, 1, 0, 1)]
