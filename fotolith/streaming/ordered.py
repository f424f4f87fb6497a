"""Folds over a key's rows in event-time order, on streams and on tables.

A stream's rows wait in a list state until the watermark has passed them, so they are folded in the
order of (time, sequence) however they were cut into batches. What the fold remembers of a key is a
value state; a timer wakes it when a waiting row is due or when it has been quiet for long enough.
Rows behind the watermark are dropped by Spark, as in any stateful stream.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Microseconds.
DAY = 86_400_000_000


class Fold:
    """One key's fold. ``state`` is a dictionary that JSON can hold; an empty one is the start."""

    def push(self, state: dict, at: int, row: dict) -> list[tuple]:
        """Take the next row; results, if any are known now."""
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """The time at which quiet has a meaning: without a row before it, ``close`` is called."""
        raise NotImplementedError

    def close(self, state: dict) -> list[tuple]:
        """It has been quiet until ``due``. Leaves what is to be remembered in ``state``, or nothing."""
        raise NotImplementedError

    def advance(self, state: dict, rows: list[tuple[int, int, str]], now: float) -> list[tuple]:
        """Push rows (time, sequence, JSON) up to ``now``, closing where it is quiet between them."""
        out = []
        for at, _, text in sorted(rows):
            while (due := self.due(state)) is not None and due <= at:
                out += self.close(state)
            out += self.push(state, at, json.loads(text))
        while (due := self.due(state)) is not None and due <= now:
            out += self.close(state)
        return out


class Deltas(Fold):
    """Metadata deltas of a path, merged until it is quiet for ``debounce`` or a flush message comes: of each
    field the last value that isn't null, of ``extra`` (a map) the last value of each entry."""

    def __init__(self, fields: list[str], debounce: int):
        self.fields, self.debounce = fields, debounce

    def push(self, state, at, row):
        if row.get("flush"):
            return self._said(state, "flush")
        state["first"] = state.get("first", at)
        state["last"], state["n"] = at, state.get("n", 0) + 1
        kept = state.setdefault("fields", {})
        for f in self.fields:
            if row.get(f) is not None:
                kept[f] = row[f]
        state.setdefault("extra", {}).update({k: v for k, v in (row.get("extra") or {}).items() if v is not None})
        return []

    def due(self, state):
        return state["last"] + self.debounce if state else None

    def close(self, state):
        return self._said(state, "quiet")

    def _said(self, state, cause):
        if not state:
            return []
        out = (state["first"], state["last"], *[state["fields"].get(f) for f in self.fields], json.dumps(state["extra"], sort_keys=True, separators=(",", ":"), ensure_ascii=False), state["n"], cause)
        state.clear()
        return [out]


class Bursts(Fold):
    """Bursts of a session: a photo over ``gap`` after the one before opens the next. After ``idle`` without a
    photo a session is over, and what comes later starts again at burst 1."""

    def __init__(self, gap: int, idle: int = DAY):
        self.gap, self.idle = gap, idle

    def push(self, state, at, row):
        if not state or at - state["last"] > self.gap:
            state["burst"] = state.get("burst", 0) + 1
        state["last"] = at
        return [(row["photo_id"], state["burst"])]

    def due(self, state):
        return state["last"] + self.idle if state else None

    def close(self, state):
        state.clear()
        return []


class Light(Fold):
    """Light changes with hysteresis: ``run`` photos in a row that stray from the open session's upper medians
    open a new one; fewer are absorbed. A photo's session is told once it is decided, at the latest after
    ``idle`` without a photo, when the session is over."""

    def __init__(self, run: int = 4, dwb: float = 12.0, dev: float = 1.0, idle: int = DAY):
        self.run, self.dwb, self.dev, self.idle = run, dwb, dev, idle

    @staticmethod
    def _join(state: dict, photo: list) -> None:
        for sorted_values, x in zip(state["members"], photo[1:], strict=True):
            if x is not None:
                insort(sorted_values, x)

    def push(self, state, at, row):
        state["last"] = at
        members, stray = state.setdefault("members", [[], [], []]), state.setdefault("stray", [])
        session = state.setdefault("session", 0)
        photo = [row["photo_id"], float(np.log2(max(row["global_lum"], 1e-4) / 0.18)), row.get("wb_temp"), row.get("wb_tint")]
        mid = [x[len(x) // 2] if x else None for x in members]
        far = bool(members[0]) and (abs(photo[1] - mid[0]) > self.dev or any(photo[j] is not None and mid[j - 1] is not None and abs(photo[j] - mid[j - 1]) > self.dwb for j in (2, 3)))
        stray.append(photo)
        if far and len(stray) < self.run:
            return []
        if far:
            state["members"], state["session"] = [[], [], []], session + 1
        for p in stray:
            self._join(state, p)
        state["stray"] = []
        return [(p[0], state["session"]) for p in stray]

    def due(self, state):
        return state["last"] + self.idle if state else None

    def close(self, state):
        out = [(p[0], state["session"]) for p in state["stray"]]
        state.clear()
        return out


def _up(us: int) -> int:
    """The first millisecond at or after a time."""
    return -(-us // 1000)


class Ordered(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then folds them in order."""

    def __init__(self, fold: Fold, key: str, columns: list[str]):
        self.fold, self.key, self.columns = fold, key, columns

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, row string")
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            own = list(zip(pdf["at"].tolist(), pdf["seq"].tolist(), pdf["row"].tolist(), strict=True))
            if own:
                self.waiting.appendList(own)
                first = min([x[0] for x in own] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(_up(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        later = [r for r in rows if r[0] > now]
        state = json.loads(self.held.get()[0]) if self.held.exists() else {}
        out = self.fold.advance(state, [r for r in rows if r[0] <= now], now)
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        if state:
            self.held.update((json.dumps(state),))
        elif self.held.exists():
            self.held.clear()
        wake = [x for x in (self.fold.due(state), min((r[0] for r in later), default=None)) if x is not None]
        if wake:
            self.handle.registerTimer(_up(min(wake)))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=self.columns)

    def close(self):
        pass


def _packed(df: DataFrame, key: str, time: str, sequence: str) -> DataFrame:
    """Key, time, its microseconds, sequence, and the row as JSON, which keeps nulls apart from numbers."""
    return df.select(key, F.col(time).alias("ts"), F.unix_micros(time).alias("at"), F.col(sequence).cast("long").alias("seq"), F.to_json(F.struct(*[c for c in df.columns if c not in (key, time)])).alias("row"))


def fold_stream(df: DataFrame, fold: Fold, key: str, out: str, watermark: str, time: str = "ts", sequence: str = "seq") -> DataFrame:
    """The fold's results ``out`` (a schema that starts with the key) over a stream, in append mode.

    Rows may come up to ``watermark`` late. The state of a key is what waits for the watermark and what
    its fold remembers; both go when the fold is through. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    names = [c.split()[0] for c in out.split(", ")]
    packed = _packed(df, key, time, sequence).withWatermark("ts", watermark)
    return packed.groupBy(key).transformWithStateInPandas(Ordered(fold, key, names), out, "append", "eventtime")


def fold_table(df: DataFrame, fold: Fold, key: str, out: str, time: str = "ts", sequence: str = "seq") -> DataFrame:
    """The same over a table: one key's rows at a time, so keys must be bounded (a folder's day)."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["at"].tolist(), pdf["seq"].tolist(), pdf["row"].tolist(), strict=True))
        return pd.DataFrame([(pdf[key].iloc[0], *o) for o in fold.advance({}, rows, float("inf"))], columns=names)

    return _packed(df, key, time, sequence).drop("ts").groupBy(key).applyInPandas(run, out)


def coalesce_deltas(deltas: DataFrame, fields: list[str], debounce: int, flush: str = "flush", extra: str = "extra") -> DataFrame:
    """``path, first_us, last_us, <fields>, extra, merged, cause`` of a table of deltas (``path, ts, seq``, the fields,
    a map ``extra`` and a boolean ``flush``), by windows: a path of any length is spread over its segments.

    A segment ends when the path is quiet for ``debounce`` microseconds or with a flush message; of each
    field, and of each entry of ``extra``, the last value that isn't null counts, in the order of (ts, seq).
    A flush with nothing pending says nothing. Rows without a path are left out.
    """
    c = F.col
    own = Window.partitionBy("path").orderBy("at", "seq")
    d = deltas.where("path is not null").withColumns({"at": F.unix_micros("ts"), "flush_": F.coalesce(c(flush), F.lit(False))})
    quiet = c("at") - F.lag("at").over(own) >= debounce
    starts = F.coalesce(quiet | F.lag("flush_").over(own), F.lit(True))
    d = d.withColumn("starts", starts.cast("long")).withColumn("segment", F.sum("starts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("at", "seq")
    last = [F.max_by(f, F.when(c(f).isNotNull() & ~c("flush_"), order)).alias(f) for f in fields]
    said = ~c("flush_")
    merged = d.groupBy("path", "segment").agg(F.min(F.when(said, c("at"))).alias("first_us"), F.max(F.when(said, c("at"))).alias("last_us"), *last, F.count_if(said).alias("merged"), F.when(F.max("flush_"), "flush").otherwise("quiet").alias("cause"))
    entries = d.where(said & c(extra).isNotNull()).select("path", "segment", "at", "seq", F.explode(extra).alias("k", "v")).where("v is not null").groupBy("path", "segment", "k").agg(F.max_by("v", order).alias("v"))
    entries = entries.groupBy("path", "segment").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("extra"))
    return (merged.where("merged > 0").join(entries, ["path", "segment"], "left")
            .select("path", "first_us", "last_us", *fields, F.coalesce("extra", F.lit("{}")).alias("extra"), "merged", "cause"))


def delta_stream(deltas: DataFrame, fields: dict[str, str], debounce: int, watermark: str) -> DataFrame:
    """:func:`coalesce_deltas` over a stream; ``fields`` are names with their types."""
    out = ", ".join([f"path {dict(deltas.dtypes)['path']}", "first_us long", "last_us long", *[f"{f} {t}" for f, t in fields.items()], "extra string", "merged long", "cause string"])
    return fold_stream(deltas.where("path is not null"), Deltas(list(fields), debounce), "path", out, watermark)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> Callable[[], DataFrame]:
    """Run a stream over all that is there now, into a Parquet table, and give a reader of it. Starting it again
    with the same folders goes on where it ended."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    schema = stream.schema
    return lambda: spark.read.schema(schema).parquet(path)


