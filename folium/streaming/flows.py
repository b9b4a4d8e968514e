"""Structured Streaming: an inbox keyed by content hash and documents that wait for their works, deadlines that timers wake, all with keyed state; latest-wins state, windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def inbox(spark: SparkSession, path: str, schema, hash_of: str = "text") -> DataFrame:
    """STR1: files as they arrive, each with its content hash."""
    return spark.readStream.schema(schema).parquet(path).withColumn("file_hash", F.sha2(hash_of, 256))


class _First(StatefulProcessor):
    """Lets the first row of a key through, for as long as the key is remembered."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "here boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.seen.exists()
        for batch in rows:
            if not known and len(batch):
                known = True
                self.seen.update((True,))
                yield batch.head(1)

    def close(self) -> None:
        pass


def first_of_each(stream: DataFrame, key: str = "file_hash", days: int | None = None) -> DataFrame:
    """STR1: each content once, however often and in however many batches it arrives; state knows what has been seen (for so many days, if told), not the target."""
    _durable_state(stream.sparkSession)
    # Without a time to live no batch is run for the clock's sake.
    return stream.groupBy(key).transformWithStateInPandas(_First(days and days * 86_400_000), stream.schema, "Append", "ProcessingTime" if days else "None")


def _durable_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str = "file_hash", days: int | None = None) -> StreamingQuery:
    """STR1: the first of each content, appended by a sink that writes each batch once. What has arrived is taken, and the query ends; with a time to live it takes one batch."""
    out = first_of_each(stream, key, days).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (out.trigger(once=True) if days else out.trigger(availableNow=True)).start()


class _Waiting(StatefulProcessor):
    """Of one identity: the least work that has come, and the documents that wait or have a work, until their time is over."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getValueState("work", "work_id long")
        self.docs = handle.getMapState("docs", "doc_id long", "work_id long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        work = self.work.get()[0] if self.work.exists() else None
        came: list[int] = []
        for batch in rows:
            for kind, ident in zip(batch["kind"], batch["id"], strict=True):
                if kind == "work":
                    work = int(ident) if work is None else min(work, int(ident))
                else:
                    came.append(int(ident))
        if work is not None:
            self.work.update((work,))
        out = []
        until = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
        for doc in sorted(set(came)):
            if not self.docs.containsKey((doc,)):
                self.docs.updateValue((doc,), (-1, until))
                self.handle.registerTimer(until)
        if work is not None:
            for (doc,), (best, end) in list(self.docs.iterator()):
                if best == -1 or work < best:
                    self.docs.updateValue((doc,), (work, end))
                    out.append((key[0], doc, work))
        if out:
            yield pd.DataFrame(out, columns=["key", "doc_id", "work_id"]).astype({"work_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (doc,), (best, end) in list(self.docs.iterator()):
            if end <= now:
                self.docs.removeKey((doc,))
                if best == -1:
                    out.append((key[0], doc, None))
        if out:
            yield pd.DataFrame(out, columns=["key", "doc_id", "work_id"]).astype({"work_id": "Int64"})

    def close(self) -> None:
        pass


def waiting_matches(documents: DataFrame, works: DataFrame, patience_ms: int = 30 * 86_400_000) -> DataFrame:
    """STR2: documents (key, doc_id) and works (key, work_id) as they arrive, in whatever order: (key, doc_id, work_id) whenever a document gets a work or a lesser one.

    A document waits in state for a work of its key; one that none has come for in ``patience_ms`` is told with no work, and may come again. The last row of each
    document is the batch's match: the least work of its key.
    """
    _durable_state(documents.sparkSession)
    both = documents.select("key", F.lit("doc").alias("kind"), F.col("doc_id").cast("long").alias("id")).unionByName(works.select("key", F.lit("work").alias("kind"), F.col("work_id").cast("long").alias("id")))
    return both.groupBy("key").transformWithStateInPandas(_Waiting(patience_ms), "key string, doc_id long, work_id long", "Append", "ProcessingTime")


class _Bands(StatefulProcessor):
    """Of one deadline: its last row and band. A change that the clock brings is told when the watermark passes it, or before a row that comes after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, soon long, over long, done boolean, band string")

    @staticmethod
    def _next(at: int, soon: int | None, over: int | None, done: bool) -> int | None:
        """When the band next changes by itself."""
        return None if done or soon is None else soon if at < soon else over if at < over else None

    @staticmethod
    def _band(at: int, soon: int | None, over: int | None, done: bool) -> str:
        return "Handed in" if done else "No date found" if soon is None else "Later" if at < soon else "Next 7 days" if at < over else "Overdue"

    def _advanced(self, key, state, to: int, out: list) -> tuple:
        """The state after the changes before a time, each of which is told."""
        at, soon, over, done, band = state
        while (then := self._next(at, soon, over, done)) is not None and then < to:
            at, band = then, self._band(then, soon, over, done)
            out.append((key[0], at, band))
        return at, soon, over, done, band

    @staticmethod
    def _rows(out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["id", "at_ms", "band"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last: dict[int, tuple] = {}
        for batch in rows:
            for row in zip(batch["at_ms"], batch["soon"], batch["over"], batch["done"], strict=True):
                if row[3] or not last.get(row[0], row)[3]:
                    last[row[0]] = row
        state, out = (tuple(self.held.get()) if self.held.exists() else None), []
        before = state and self._next(*state[:4])
        for at, soon, over, done in (last[at] for at in sorted(last)):
            if state is not None:
                if at < state[0] or (at == state[0] and state[3]):
                    continue
                state = self._advanced(key, state, int(at), out)
            soon, over = (None, None) if pd.isna(soon) else (int(soon), int(over))
            band = self._band(at, soon, over, bool(done))
            if state is None or band != state[4]:
                out.append((key[0], int(at), band))
            state = (int(at), soon, over, bool(done), band)
        after = state and self._next(*state[:4])
        self.held.update(state)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        state = self._advanced(key, tuple(self.held.get()), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) + 1, out)
        self.held.update(state)
        then = self._next(*state[:4])
        if then is not None:
            self.handle.registerTimer(then)
        yield from self._rows(out)

    def close(self) -> None:
        pass


def band_changes(deadlines: DataFrame, late: str = "1 day") -> DataFrame:
    """SRV2, STR7: deadlines (id, at, due_date, done) as they are entered and changed: (id, at, band) once for each change of band, brought by a row or by the clock.

    The clock is the watermark, ``late`` behind the newest ``at``; a timer in state wakes each deadline alone, so that no batch reads the others. Of a deadline's rows
    one that comes after a later one is passed over; of two at one time the one that is done holds. Rows without an id or a time are not deadlines. The last change up
    to a day is the batch's ``serving.band`` on that day. A deadline's state stays, as a later row may change it.
    """
    _durable_state(deadlines.sparkSession)
    ms = lambda d: F.unix_millis(d.cast("timestamp"))
    rows = deadlines.where("id is not null and at is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    told = rows.select(F.col("id").cast("long").alias("id"), "at", F.unix_millis("at").alias("at_ms"), ms(F.date_sub("due_date", 7)).alias("soon"), ms(F.date_add("due_date", 1)).alias("over"), F.coalesce("done", F.lit(False)).alias("done"))
    changes = told.groupBy("id").transformWithStateInPandas(_Bands(), "id long, at_ms long, band string", "Append", "EventTime")
    return changes.select("id", F.timestamp_millis("at_ms").alias("at"), "band")


def windows(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """STR7: counts and sums by window and type, with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """STR3: the last value of each key, for update or complete mode."""
    return events.groupBy(key).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
