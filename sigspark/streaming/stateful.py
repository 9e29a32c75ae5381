"""Keyed state with timers: signal life cycle, resignals, seen ids and the guard of quotes.

Each job is one operator keyed by symbol (or feed) whose state is a single small row; an event-time
timer drops the state of a day that is over, so state is bounded by the keys of a day. Rows of a
key are worked through in their own order inside a batch. State and progress live in the job's
checkpoint in the shared folder: a restarted query goes on where the last one stopped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sigspark.session import shared_dir

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY = 86_400_000_000
NEW_EVENT, SHARES = 10.0, 256  # SHARES: groups that the ids of one feed are dealt to


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> list:
    return list(pd.concat(list(parts)).sort_values(order, kind="stable").itertuples(index=False))


class Daily(StatefulProcessor):
    """One state row a key, dropped by a timer when the watermark passes the end of its day."""

    STATE: str
    ORDER: list[str]
    OUT: str
    CLOCK = "at"

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", self.STATE)

    def day_of(self, state: tuple) -> int:
        return state[0]

    def put(self, state: tuple) -> None:
        if not self.state.exists() or self.day_of(self.state.get()) != self.day_of(state):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((self.day_of(state) + 1) * DAY // 1000)
        self.state.update(state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for row in _rows(rows, self.ORDER):
            state, new = self.step(state, row)
            out += [(*key, *x) for x in new]
        if state is not None:
            self.put(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in self.OUT.split(", ")])

    def step(self, state: tuple | None, row) -> tuple[tuple | None, list[tuple]]:
        raise ValueError("a job says what a row does")

    def close(self) -> None:
        self.state = None


class Life(Daily):
    """BUY, SELL or WATCH signals to states, with start and age; important says what to persist.

    The same data again with the same signal keeps the state; data older than the last is ignored.
    """

    STATE = "day long, signal string, side string, state string, since long, at long, score double, confidence double"
    ORDER = ["at"]
    OUT = "symbol string, at long, signal string, previous_side string, state string, previous_state string, started_at long, age_minutes double, score double, important boolean"
    SIDES = {("BUY", "BUY"): "BUY_ON", ("BUY", "SELL"): "RECOVERING", ("BUY", "WATCH"): "NEW_BUY", ("SELL", "BUY"): "TURNED_SELL", ("SELL", "SELL"): "SELL_ON",
             ("SELL", "WATCH"): "NEW_SELL", ("WATCH", "BUY"): "WEAKENING", ("WATCH", "SELL"): "RECOVERING", ("WATCH", "WATCH"): "WATCH"}

    def step(self, state, row):
        day = row.at // DAY
        if state is not None and state[0] != day:
            state = None
        if state is not None and row.at < state[5]:
            return state, []
        old = state[2] if state else "WATCH"
        name, side = self.SIDES[row.signal, old], row.signal if row.signal != "WATCH" else old
        if state and row.at == state[5] and row.signal == state[1]:
            name = state[3]
        since = state[4] if state and old == side else row.at
        turned = state is None or (name != state[3] and name not in ("BUY_ON", "SELL_ON"))
        moved = state is not None and (abs(row.score - state[6]) >= NEW_EVENT or abs(row.confidence - state[7]) >= NEW_EVENT)
        out = (row.at, row.signal, old, name, state[3] if state else None, since, (row.at - since) / 60e6, row.score, name != "WATCH" and (turned or moved))
        return (day, row.signal, side, name, since, row.at, row.score, row.confidence), [out]


class Resignal(Daily):
    """Signals that differ enough from the last kept one of the day, never from the same candle."""

    STATE = "day long, decision string, price double, score double, target double, stop double, at long"
    ORDER = ["at"]
    OUT = "symbol string, at long, price double, decision string, score double"

    def step(self, state, row):
        day = row.at // DAY
        last = state if state is not None and state[0] == day else None
        if last is not None:
            if row.at <= last[6]:
                return state, []
            moved = lambda new, old: bool(old and new and abs(new / old - 1) >= 0.01)
            closed = row.price >= last[4] or row.price <= last[5] if last[1] == "BUY" else row.price <= last[4] or row.price >= last[5]
            if not (row.decision != last[1] or closed or moved(row.price, last[2]) or abs(row.score - last[3]) >= 5 or moved(row.target, last[4]) or moved(row.stop, last[5])):
                return state, []
        return (day, row.decision, row.price, row.score, row.target, row.stop, row.at), [(row.at, row.price, row.decision, row.score)]


class LatestQuote(Daily):
    """The newest valid quote of a symbol; every quote leaves with the reason why it was refused, if it was."""

    STATE = "day long, at long, price double"
    ORDER = ["arrived", "quote_id"]
    CLOCK = "arrived"  # the watermark would drop quotes of an old event time before they can be quarantined
    OUT = "symbol string, quote_id long, at long, price double, arrived long, reason string"

    def step(self, state, row):
        if row.price is None or pd.isna(row.price) or row.price <= 0:
            reason = "INVALID_PRICE"
        elif row.at > row.arrived:
            reason = "FUTURE"
        elif row.at // DAY != row.arrived // DAY:
            reason = "OTHER_DAY"
        elif state is not None and row.at < state[1]:
            reason = "LATE"
        elif state is not None and row.at == state[1] and row.price != state[2]:
            reason = "CONFLICT"
        else:
            reason, state = None, (row.at // DAY, row.at, row.price)
        return state, [(row.quote_id, row.at, row.price, row.arrived, reason)]


class Seen(StatefulProcessor):
    """First sights of the ids of a feed. A group is one share of a feed's ids, and every id is kept.

    What the first sync of a feed brings counts as seen; with one_sync the job's first batch is
    the first sync of all feeds.
    """

    OUT = "feed string, id long, at long"

    def __init__(self, one_sync: bool = False):
        self.one_sync = one_sync

    def init(self, handle) -> None:
        self.ids = handle.getListState("ids", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:  # no more than the ids of the share are held
            low = part.groupby("id")["at"].min()
            first = low if first is None else pd.concat([first, low]).groupby(level=0).min()
        new = first.drop([i for (i,) in self.ids.get()], errors="ignore") if self.ids.exists() else first
        if len(new):
            self.ids.appendList([(int(i),) for i in new.index])
        yield pd.DataFrame({"feed": key[0], "id": new.index.astype("int64"), "at": new.to_numpy()}, columns=["feed", "id", "at"])

    def close(self) -> None:
        self.ids = None

    def finish(self, batch: DataFrame, number: int, base: str) -> DataFrame:
        """The batch without first syncs: the feeds of each batch are kept, and those of earlier ones are known."""
        spark = batch.sparkSession
        batch.select("feed").distinct().write.mode("overwrite").parquet(f"{base}/feeds/batch={number}")
        known = spark.read.schema("feed string, batch long").parquet(f"{base}/feeds").filter(F.col("batch") < number)
        if self.one_sync:
            return batch.crossJoin(known.agg(F.count(F.lit(1)).alias("_n"))).filter("_n > 0").drop("_n")
        return batch.join(known.select("feed").distinct(), "feed", "left_semi")


def keyed(stream: DataFrame, key: str, job, late: str = "2 hours") -> DataFrame | tuple[DataFrame, Callable]:
    """The job over a stream; the watermark follows its clock, in microseconds. Seen ids need none.

    For seen ids, a pair: the stream and what a batch of it passes through before the sinks.
    """
    timed, mode = stream, "None"
    if isinstance(job, Daily):
        timed, mode = stream.withColumn("event_time", F.timestamp_micros(job.CLOCK)).withWatermark("event_time", late), "EventTime"
    by = [key]
    if isinstance(job, Seen):
        timed, by = stream.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES))), [key, "share"]
    out = timed.groupBy(*by).transformWithStateInPandas(statefulProcessor=job, outputStructType=job.OUT, outputMode="Append", timeMode=mode)
    return (out, job.finish) if isinstance(job, Seen) else out


class Job:
    """A folder of landed input, a checkpoint and sinks; ``run`` takes in what has landed since."""

    def __init__(self, spark: SparkSession, schema: str, build: Callable[[DataFrame], DataFrame | tuple[DataFrame, Callable]], sinks: dict[str, str], base: str | None = None):
        self.spark, self.schema, self.build, self.sinks = spark, schema, build, sinks
        self.finish: Callable | None = None
        self.base = base or os.path.join(shared_dir(spark), f"job-{uuid.uuid4().hex}")

    def land(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.base}/in")

    def run(self) -> None:
        held = self.spark.conf.get(STORE[0], None)
        self.spark.conf.set(*STORE)
        try:
            built = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.base}/in"))
            stream, self.finish = built if isinstance(built, tuple) else (built, None)
            query = stream.writeStream.foreachBatch(self.split).option("checkpointLocation", f"{self.base}/cp").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            self.spark.conf.set(STORE[0], held) if held else self.spark.conf.unset(STORE[0])

    def split(self, batch: DataFrame, number: int) -> None:
        """Each sink takes its rows; a batch that is run again replaces what it wrote before."""
        batch.persist()
        rows = self.finish(batch, number, self.base) if self.finish else batch
        for name, test in self.sinks.items():
            rows.filter(test).write.mode("overwrite").parquet(f"{self.base}/{name}/batch={number}")
        batch.unpersist()

    def read(self, sink: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{sink}").drop("batch")


def in_two_parts(job: Job, rows: DataFrame, first: str) -> Job:
    """Land the rows of the first part and run, then the others and run again from the checkpoint."""
    for part in (first, f"NOT ({first})"):
        job.land(rows.filter(part))
        job.run()
    return job
