"""Answers of very long streams (D7), and subscriptions that are a stream too.

* :func:`assemble_answers_by_bucket` keeps a query's Partials in a map state by bucket of
  ``BUCKET`` sequence numbers (``transformWithStateInPandas``, RocksDB): an event rewrites
  the one small entry of its bucket and a fixed-size header, however long the answer is.
  Event-time timers end it at the deadline.
* :func:`subscribe_streams` is an interval join of two streams with watermarks on both
  sides, so its state is bounded by the timeout and the delays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragframe import constants as K
from ragframe.streaming.responses import OUT_SCHEMA, run_to_table

#: Sequence numbers in one entry of the state.
BUCKET = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


class AnswerProcessor(StatefulProcessor):
    """State of one query: a header (first time, sequence number from which its Partials
    don't count any more, whether it is answered) and its Partials by bucket."""

    def __init__(self, timeout_ms: int, leading: bool, zone: str, forget_ms: int | None, bucket: int):
        self.timeout_ms, self.leading, self.zone, self.forget_ms, self.bucket = timeout_ms, leading, zone, forget_ms, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.header = handle.getValueState("header", "first_ts long, frozen long, done boolean")
        self.parts = handle.getMapState("parts", "bucket long", "seqs array<long>, contents array<string>")

    def _answer(self, key, status: str, stop: int | None, first_ts: int, watermark: int) -> pd.DataFrame:
        """The answer; of its state only the mark that it was given stays."""
        found = [(s, c) for _, (seqs, contents) in self.parts.iterator() for s, c in zip(seqs, contents) if stop is None or s < stop]
        found.sort(key=lambda x: x[0])
        self.parts.clear()
        self.header.update((first_ts, None, True))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.forget_ms is not None:
            self.handle.registerTimer(max(first_ts + self.timeout_ms + self.forget_ms, watermark + 1))
        return pd.DataFrame({"query_id": [int(key[0])], "answer": ["".join(c or "" for _, c in found)], "status": [status]})

    def _keep(self, added: dict) -> None:
        for b, items in added.items():
            old = self.parts.getValue((b,))
            seqs, contents = (list(old[0]), list(old[1])) if old is not None else ([], [])
            self.parts.updateValue((b,), (seqs + [s for s, _ in items], contents + [c for _, c in items]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first_ts, frozen, done = self.header.get() if self.header.exists() else (None, None, False)
        if done:
            return
        ev = pd.concat(list(rows), ignore_index=True)
        ts = ev["ts"]
        ts = ts.dt.tz_localize(self.zone) if ts.dt.tz is None else ts
        ev["ms"] = ts.dt.tz_convert("UTC").dt.tz_localize(None).astype("datetime64[us]").astype("int64") // 1000
        ev = ev.sort_values(["ms", "seq"], kind="stable")
        new, watermark = first_ts is None, timerValues.getCurrentWatermarkInMs()
        if new:
            first_ts = int(ev["ms"].iloc[0])
        deadline, added = first_ts + self.timeout_ms, {}
        for r in ev.itertuples(index=False):
            if r.ms >= deadline or r.type == K.EVENT_FINISHED:
                self._keep(added)
                stop = frozen if r.ms >= deadline or frozen is not None else int(r.seq)
                yield self._answer(key, "timeout" if r.ms >= deadline else "finished", stop, first_ts, watermark)
                return
            if r.type == K.EVENT_PARTIAL:
                if frozen is None:
                    added.setdefault(int(r.seq) // self.bucket, []).append((int(r.seq), r.content))
            elif self.leading and frozen is None:
                frozen = int(r.seq)
        self._keep(added)
        self.header.update((first_ts, frozen, False))
        if new:
            self.handle.registerTimer(max(deadline, watermark + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.header.exists():
            return
        first_ts, frozen, done = self.header.get()
        if done:
            self.header.clear()
        else:
            yield self._answer(key, "timeout", frozen, first_ts, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def assemble_answers_by_bucket(events: DataFrame, timeout_seconds: int = K.RESPONSE_TIMEOUT_SECONDS, watermark: str = "1 minute",
                               mode: str = "until_finished", forget_after_seconds: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``assemble_answers_stream``, with a state whose entries are small.
    Needs the RocksDB state store; :func:`run` starts it with that."""
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
    forget = None if forget_after_seconds is None else int(forget_after_seconds) * 1000
    processor = AnswerProcessor(int(timeout_seconds) * 1000, mode == "leading", zone, forget, bucket)
    return events.withWatermark("ts", watermark).groupBy("query_id").transformWithStateInPandas(
        processor, OUT_SCHEMA, "append", "EventTime")


def run(stream: DataFrame, name: str | None = None, path: str | None = None) -> DataFrame:
    """``run_to_table`` with the RocksDB state store; the session's own setting comes back."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE_KEY, None)
    conf.set(STORE_KEY, ROCKSDB)
    try:
        return run_to_table(stream, name, path)
    finally:
        if before is None:
            conf.unset(STORE_KEY)
        else:
            conf.set(STORE_KEY, before)


def subscribe_streams(events: DataFrame, subscriptions: DataFrame, timeout_seconds: int = K.RESPONSE_TIMEOUT_SECONDS,
                      events_delay: str = "1 minute", subscriptions_delay: str = "1 minute") -> DataFrame:
    """D6 between streams: ``events`` (query_id, seq, ts, type, content) and ``subscriptions``
    (query_id, start_ts), each with a watermark.

    A subscription gets the query's events from its start until its deadline, whichever of
    the two arrives first: events wait for later subscribers, and subscriptions for later
    events, as long as a partner within the delays can still come. What arrives later than
    its delay is dropped. Several subscriptions of a query each get its events."""
    e = events.withWatermark("ts", events_delay)
    s = subscriptions.select(F.col("query_id").alias("_q"), "start_ts").withWatermark("start_ts", subscriptions_delay)
    end = F.col("start_ts") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    return e.join(s, (F.col("query_id") == F.col("_q")) & (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < end)).drop("_q")
