"""Response streams with Structured Streaming.

* :func:`event_source` reads response events as a file stream.
* :func:`subscribe_stream` is D6: a stream-static join with the subscriptions
  and the whole-stream deadline (``start_ts + timeout``).
* :func:`assemble_answers_stream` is D7: ``applyInPandasWithState`` keyed by
  query id with an event-time timeout. The 5-minute timer is set once, at the
  query's first event; the answer is emitted on ``Finished`` (status
  ``finished``), or when an event past the deadline arrives or the watermark
  passes the deadline (status ``timeout``). A quiet stream keeps its state until
  later events move the watermark.

State per query is the buffered Partials of that one answer. Once the answer is
emitted only a marker stays, so that later events of the query, in whatever
micro-batch they come, never start a second answer.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ragframe import constants as K
from ragframe import schemas as S
from ragframe.session import broadcast_if_small, ensure_checkpoint_dir

OUT_SCHEMA = "query_id long, answer string, status string"
STATE_SCHEMA = "first_ts long, frozen boolean, done boolean, seqs array<long>, contents array<string>"


def event_source(spark: SparkSession, path: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Response events (query_id, seq, ts, type, content) as a parquet file
    stream with an explicit schema."""
    r = spark.readStream.schema(S.EVENTS)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def subscribe_stream(events: DataFrame, subscriptions: DataFrame,
                     timeout_seconds: int = K.RESPONSE_TIMEOUT_SECONDS) -> DataFrame:
    """D6 streaming: stream-static join with (query_id, start_ts), events kept
    from the start until the deadline."""
    s = subscriptions.select("query_id", "start_ts")
    j = events.join(broadcast_if_small(s, 2_000_000), "query_id")
    return j.where((F.col("ts") >= F.col("start_ts")) &
                   (F.col("ts") < F.col("start_ts") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")))


def _answer(seqs, contents, stop):
    parts = sorted((s, c) for s, c in zip(seqs, contents) if stop is None or s < stop)
    return "".join(c or "" for _, c in parts)


def _assembler(timeout_ms: int, mode: str, session_tz: str = "UTC", forget_ms: int | None = None):
    def fn(key, pdfs, state):
        qid = int(key[0])

        def emit(first_ts, status, seqs, contents, stop=None):
            """The answer, and the marker that stays in the state."""
            state.update((first_ts, True, True, [], []))
            if forget_ms is not None:
                state.setTimeoutTimestamp(max(first_ts + timeout_ms + forget_ms, state.getCurrentWatermarkMs() + 1))
            return pd.DataFrame({"query_id": [qid], "answer": [_answer(seqs, contents, stop)], "status": [status]})

        if state.hasTimedOut:
            first_ts, frozen, done, seqs, contents = state.get
            if done:
                state.remove()
            else:
                yield emit(first_ts, "timeout", seqs, contents)
            return
        if state.exists:
            first_ts, frozen, done, seqs, contents = state.get
            if done:
                return
            seqs, contents = list(seqs), list(contents)
        else:
            first_ts, frozen, seqs, contents = None, False, [], []
        ev = pd.concat(list(pdfs), ignore_index=True)
        ts = ev["ts"]
        # timestamps arrive as session-local wall clock; timers are epoch (UTC) ms
        ts = ts.dt.tz_localize(session_tz) if ts.dt.tz is None else ts
        ev["ms"] = ts.dt.tz_convert("UTC").dt.tz_localize(None).astype("datetime64[us]").astype("int64") // 1000
        ev = ev.sort_values(["ms", "seq"], kind="stable")
        if first_ts is None:
            first_ts = int(ev["ms"].iloc[0])
        deadline = first_ts + timeout_ms
        for r in ev.itertuples(index=False):
            if r.ms >= deadline:
                yield emit(first_ts, "timeout", seqs, contents)
                return
            if r.type == K.EVENT_FINISHED:
                yield emit(first_ts, "finished", seqs, contents, None if frozen else int(r.seq))
                return
            if r.type == K.EVENT_PARTIAL:
                if not frozen:
                    seqs.append(int(r.seq))
                    contents.append(r.content)
            elif mode == "leading" and not frozen:
                # the answer is complete; its status is known at the end
                frozen = True
                kept = [(s, c) for s, c in zip(seqs, contents) if s < int(r.seq)]
                seqs, contents = [s for s, _ in kept], [c for _, c in kept]
        state.update((first_ts, frozen, False, seqs, contents))
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
    return fn


def assemble_answers_stream(events: DataFrame, timeout_seconds: int = K.RESPONSE_TIMEOUT_SECONDS,
                            watermark: str = "1 minute", mode: str = "until_finished",
                            forget_after_seconds: int | None = None) -> DataFrame:
    """D7 streaming: one (query_id, answer, status) row per query, emitted
    once (append mode), with the statuses of the batch form. A marker of a few
    bytes stays for every answered query; ``forget_after_seconds`` drops it that
    long (in event time) after the query's deadline, for streams whose queries
    have no events after that."""
    tz = events.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
    forget = None if forget_after_seconds is None else int(forget_after_seconds) * 1000
    return (events.withWatermark("ts", watermark)
            .groupBy("query_id")
            .applyInPandasWithState(_assembler(int(timeout_seconds) * 1000, mode, tz, forget), OUT_SCHEMA,
                                    STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


def run_to_table(stream: DataFrame, name: str | None = None, path: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over everything available (``availableNow``)
    into a parquet table under ``path`` (None: a new place in the shared
    checkpoint folder) and return it as a batch DataFrame. Fault tolerant:
    progress is in the query's checkpoint beside the table."""
    spark = stream.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/stream-{name or 'out'}-{uuid.uuid4().hex[:8]}"
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{path}/_checkpoint")
         .option("path", f"{path}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
