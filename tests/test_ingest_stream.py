"""Continuous ingestion against a batch one: failures, replays, documents sent again."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe.operators import ingest as IG
from ragframe.streaming import ingest as SI

FILES = "document_id long, context_id string, name string, content binary, mime string"


@pytest.fixture
def base():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def files(spark, rows):
    return spark.createDataFrame([(i, f"c{i % 2}", f"f{i}-{v:03d}", None if t is None else t.encode(), m) for i, v, t, m in rows], FILES)


def texts(n, v=0):
    return [(i, v, f"Line {i} version {v}.\n" + "More words here. " * (i % 40), "text/plain") for i in range(n)]


def fragments(df):
    return sorted((r["document_id"], r["fragment_index"], r["value"], len(r["embedding"])) for r in df.collect())


def documents(df):
    return sorted((r["document_id"], r["context_id"], r["name"], r["type"]) for r in df.collect())


def batch_result(spark, rows):
    docs = spark.createDataFrame([], SI.DOCUMENTS.format("long"))
    emb = spark.createDataFrame([], SI.EMBEDDINGS.format("long"))
    d, e, r = IG.ingest(files(spark, rows), docs, emb, max_chars=100)
    return documents(d), fragments(e), sorted((x["document_id"], x["error"]) for x in r.collect())


def state(store):
    return documents(store.documents()), fragments(store.embeddings()), sorted((x["document_id"], x["error"]) for x in store.rejects().collect())


def arriving(spark, base, rows, parts):
    for k in range(parts):
        files(spark, rows[k::parts]).coalesce(1).write.mode("append").parquet(f"{base}/files")
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", "1").parquet(f"{base}/files")


def test_stream_equals_one_batch(spark, base):
    rows = texts(60) + [(100, 0, None, "text/plain"), (101, 0, "x", "application/pdf"), (102, 0, "", "text/plain"), (103, 0, "<p>a &amp; b", "text/html")]
    stream = arriving(spark, base, rows, 4)
    store = SI.Store(spark, f"{base}/tables")
    SI.ingest_stream(stream, store, f"{base}/progress", max_chars=100).awaitTermination()
    assert state(store) == batch_result(spark, rows)
    m = store.manifest()
    assert len(m["done"]) == 4
    ids = [r["id"] for r in store.embeddings().collect()]
    assert sorted(ids) == list(range(1, m["max_id"] + 1))
    store.compact()
    assert state(store) == batch_result(spark, rows) and len(store.manifest()["batches"]) == 1


def test_replay_after_a_failure(spark, base):
    """The embedder fails in the second batch; the stream is started again and replays it. A
    batch whose commit to the stream was lost is replayed without effect."""
    rows = texts(40)
    stream = arriving(spark, base, rows, 3)
    store = SI.Store(spark, f"{base}/tables")

    def broken(batch):
        if any("Line 1 " in t for t in batch):
            raise RuntimeError("model is away")
        return [np.ones(64, np.float32) for _ in batch]

    with pytest.raises(Exception, match="model is away"):
        SI.ingest_stream(stream, store, f"{base}/progress", max_chars=100, embedder=broken).awaitTermination()
    assert len(store.manifest()["done"]) < 3
    SI.ingest_stream(stream, store, f"{base}/progress", max_chars=100).awaitTermination()
    once = state(store)
    assert once[:2] == batch_result(spark, rows)[:2]
    store.apply(files(spark, texts(5, 9)), "000000001", max_chars=100)
    assert state(store) == once


def test_documents_sent_again(spark, base):
    """Name, context and time stay, fragments are those of the latest content; a broken
    second version changes nothing. Two versions in one batch: the last by name."""
    store = SI.Store(spark, base)
    assert store.documents() is None and store.embeddings() is None
    store.apply(files(spark, texts(6)), "a", max_chars=100)
    store.apply(files(spark, texts(3, 1)[1:] + texts(3, 2)[1:] + [(4, 1, "x", "application/pdf")]).withColumn("context_id", F.lit("moved")), "b", max_chars=100)
    want = texts(6)
    want[1:3] = texts(3, 2)[1:]
    got_docs, got_frags, got_rejects = state(store)
    expected = batch_result(spark, want)
    assert [f[:3] for f in got_frags] == [f[:3] for f in expected[1]]
    assert [(d, c, n.split("-")[0]) for d, c, n, _ in got_docs] == [(d, c, n.split("-")[0]) for d, c, n, _ in expected[0]]
    assert got_docs[1][2] == "f1-000" and got_rejects == [(4, "no parser for application/pdf")]
    store.compact()
    assert state(store) == (got_docs, got_frags, got_rejects)
    store.apply(files(spark, []), "c", max_chars=100)
    assert state(store) == (got_docs, got_frags, got_rejects)


def test_files_of_a_folder_as_a_stream(spark, base):
    import os
    os.makedirs(f"{base}/in")
    for i in range(5):
        with open(f"{base}/in/{i}.txt", "w") as f:
            f.write(f"file {i}")
    with open(f"{base}/in/skip.bin", "w") as f:
        f.write("x")
    found = SI.scan_stream(spark, f"{base}/in", glob="*.txt", max_files=2).select(
        F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("document_id"), F.lit("c").alias("context_id"), "name", "content")
    store = SI.Store(spark, f"{base}/tables")
    SI.ingest_stream(found, store, f"{base}/progress").awaitTermination()
    assert fragments(store.embeddings()) == [(i, 0, f"file {i}", 64) for i in range(5)] and len(store.manifest()["done"]) == 3
