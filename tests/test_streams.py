"""Streams of answers and subscriptions against their batch forms."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from ragframe.operators import chat as CH
from ragframe.streaming import answers as SA
from ragframe.streaming import responses as ST

EVENTS = "query_id long, seq long, ts timestamp, type string, content string"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def base():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def arriving(spark, path, rows, schema, parts):
    for i in range(parts):
        part = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def chats():
    rows = []
    for q in range(40):
        rows.append((q, 0, at(7 * q), "Retrieval" if q % 4 else "Partial", "r"))
        for k in range(1, 9):
            kind = "Finished" if q % 3 and k == 2 + q % 6 else ("Retrieval" if q % 5 == 0 and k == 5 else "Partial")
            rows.append((q, k, at(7 * q + k * 20), kind, f"{q}.{k} " if k % 4 else None))
        rows.append((q, 20, at(7 * q + 900), "Partial", "late"))
    rows.append((999, 0, at(5000), "Partial", "moves the watermark"))
    return sorted(rows, key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("mode", ["until_finished", "leading"])
@pytest.mark.parametrize("parts, bucket", [(1, 4), (5, 3)])
def test_answers_by_bucket_equal_the_batch(spark, base, mode, parts, bucket):
    rows = chats()
    ev = spark.createDataFrame(rows, EVENTS)
    inside = CH.subscribe_responses(ev, CH.first_event_subscriptions(ev)).where("query_id <> 999")
    want = sorted((r.query_id, r.answer, r.status) for r in CH.assemble_answers(inside, mode).collect())
    stream = SA.assemble_answers_by_bucket(arriving(spark, f"{base}/in", rows, EVENTS, parts), mode=mode, bucket=bucket)
    before = spark.conf.get(SA.STORE_KEY, None)
    got = sorted((r.query_id, r.answer, r.status) for r in SA.run(stream, path=f"{base}/out").collect())
    # the last timers need events behind them
    assert got == want if parts > 1 else set(got) <= set(want) and len(got) >= 26
    assert spark.conf.get(SA.STORE_KEY, None) == before


def test_one_query_of_100_000_events_writes_small_entries(spark, base):
    """Each of ten micro-batches writes the entries of its own buckets, not the answer so far."""
    n, parts = 100_000, 10
    events = spark.range(n).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("seq"),
                                   F.timestamp_add("MILLISECOND", F.col("id"), F.lit(T0)).alias("ts"),
                                   F.when(F.col("id") == n - 1, "Finished").otherwise("Partial").alias("type"), F.lit("word ").alias("content"))
    for i in range(parts):
        events.where((F.col("seq") >= i * n // parts) & (F.col("seq") < (i + 1) * n // parts)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = SA.assemble_answers_by_bucket(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(f"{base}/in"))
    spark.conf.set(SA.STORE_KEY, SA.ROCKSDB)
    try:
        q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/c").option("path", f"{base}/out")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(SA.STORE_KEY)
    out = spark.read.parquet(f"{base}/out").collect()
    assert [(r.query_id, len(r.answer), r.status) for r in out] == [(1, 5 * (n - 1), "finished")]
    puts = [p["stateOperators"][0]["customMetrics"].get("rocksdbPutCount", 0) for p in q.recentProgress if p["numInputRows"]]
    assert len(puts) == parts and max(puts[:-1]) <= 2 * (n // parts // SA.BUCKET + 2) + 20
    assert puts[-1] <= n // SA.BUCKET + 100  # the end removes every entry once


def test_subscriptions_as_a_stream(spark, base):
    """Subscribers before, during and after the events, several of one query, none of another."""
    rows = [(q, k, at(10 * k + q), "Partial", f"{q}.{k}") for k in range(60) for q in range(6)]
    subs = [(0, at(-30)), (1, at(100)), (2, at(300)), (2, at(310)), (3, at(590)), (5, at(605)), (7, at(0))]
    ev, sb = spark.createDataFrame(rows, EVENTS), spark.createDataFrame(subs, "query_id long, start_ts timestamp")

    def plain(df):
        return sorted((r.query_id, r.seq, r.start_ts, r.content) for r in df.collect())

    want = plain(CH.subscribe_responses(ev, sb, 200))
    assert len(want) > 60
    for k, (a, b) in enumerate([(1, 1), (6, 1), (1, 7), (6, 7)]):
        events = arriving(spark, f"{base}/e{k}", rows, EVENTS, a)
        subscriptions = arriving(spark, f"{base}/s{k}", subs, "query_id long, start_ts timestamp", b)
        got = SA.subscribe_streams(events, subscriptions, 200, events_delay="20 minutes", subscriptions_delay="20 minutes")
        assert plain(ST.run_to_table(got, path=f"{base}/out{k}")) == want


def chat_world(spark):
    """Two contexts with the default settings, fragments with vectors, and questions."""
    from ragframe.operators import vectors as V
    from ragframe.sources import tables as TB
    one = TB.default_context(spark.createDataFrame([], TB.S.CONTEXTS)).drop("is_default")
    contexts = one.withColumn("context_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    lines = [(d * 10 + i, "ab"[d % 2], d, i, 0, f"topic{d} fact{i} of document {d}") for d in range(8) for i in range(6)]
    f = spark.createDataFrame(lines, "id long, context_id string, document_id long, fragment_index long, chunk_index long, value string").withColumn(
        "metadata", F.create_map().cast("map<string,string>"))
    questions = [(i, "ab"[i % 2], f"what is topic{i % 8} fact{i % 6}", at(i)) for i in range(12)] + [(99, "none", "no context", at(99))]
    return contexts, V.embed_chunks(f), questions


def events(df):
    return sorted((r.query_id, r.seq, r.ts, r.type, r.content, r.n_fragments) for r in df.collect())


def test_questions_as_a_stream(spark, base):
    """Any cut into micro-batches gives the batch's events; a failed batch is replayed, one
    that was logged does nothing; D7 over the log gives each question's answer."""
    from ragframe.functions.plugins import extractive_completer
    from ragframe.streaming import chat as SC
    contexts, fragments, questions = chat_world(spark)
    schema = "query_id long, context_id string, query string, asked_at timestamp"
    want = events(SC.answer_batch(spark.createDataFrame(questions, schema), fragments, contexts))
    assert {e[0] for e in want} == set(range(12)) and {e[3] for e in want} == {"Retrieval", "Partial", "Finished"}
    stream, log = arriving(spark, f"{base}/q", questions, schema, 3), SC.EventLog(spark, f"{base}/log")
    plain = extractive_completer()

    def broken(batch):
        if any("topic4" in str(m) for m in batch["messages"]):
            raise RuntimeError("model is away")
        return plain(batch)

    with pytest.raises(Exception, match="model is away"):
        SC.answer_stream(stream, log, f"{base}/c", fragments, contexts, completer=broken).awaitTermination()
    assert len(log.manifest()["batches"]) < 3
    SC.answer_stream(stream, log, f"{base}/c", fragments, contexts).awaitTermination()
    assert events(log.table()) == want
    log.add(log.table(), "000000000")
    assert events(log.table()) == want
    answers = SA.run(SA.assemble_answers_by_bucket(log.stream(), watermark="1 second"), path=f"{base}/answers").collect()
    got = {r.query_id: r.answer for r in answers}
    assert got == {q: "".join(e[4] for e in want if e[0] == q and e[3] == "Partial") for q in range(12)}
    assert all(r.status == "finished" for r in answers)
