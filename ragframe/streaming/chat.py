"""A stream of questions answered against the stored fragments.

Each micro-batch of questions is retrieved for, prompted and completed at once by the batch
operators; its response events are written as one folder of the event log. The log's
manifest is written last: a batch that is replayed after it does nothing, and one that
failed before it writes its folder anew, so every event is in the log once. D6 and D7 read
the log as a stream, or as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators import chat as CH
from ragframe.operators import prompt as PR
from ragframe.operators.fulltext import Bm25Index
from ragframe.operators.vectors import embed_queries
from ragframe.plans.retrieve import retrieval_stages
from ragframe.session import checkpoint, ship_package
from ragframe.sources import versions

EVENTS = "query_id long, seq long, ts timestamp, type string, content string, n_fragments long"


class EventLog:
    """Response events under ``path``, one folder for each batch of questions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        return versions.latest(self.spark, self.path) or {"version": 0, "batches": []}

    def add(self, events: DataFrame, batch: str) -> None:
        m = self.manifest()
        if batch in m["batches"]:
            return
        events.select(*[f.split()[0] for f in EVENTS.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/events/{batch}")
        versions.commit(self.spark, self.path, {**m, "batches": [*m["batches"], batch]})

    def table(self) -> DataFrame:
        """All events of the batches that are in the log."""
        paths = [f"{self.path}/events/{b}" for b in self.manifest()["batches"]]
        reader = self.spark.read.schema(EVENTS)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], EVENTS)

    def stream(self, max_files: int | None = None) -> DataFrame:
        """The events as they arrive. A batch whose writer failed after its files were seen
        has the same events again; ``dropDuplicatesWithinWatermark`` on (query_id, seq) drops them."""
        r = self.spark.readStream.schema(EVENTS)
        if max_files:
            r = r.option("maxFilesPerTrigger", str(max_files))
        return r.parquet(f"{self.path}/events/*")


def answer_batch(questions: DataFrame, fragments: DataFrame, contexts: DataFrame, index: Bm25Index | None = None, embedder=None,
                 completer=None, dim: int = 64) -> DataFrame:
    """The response events of a batch of ``questions`` (query_id, context_id, query
    [, embedding] [, asked_at]); an event's time is ``asked_at`` (None: now) and its
    sequence number in milliseconds. A question of an unknown context gets no events."""
    q = questions
    if "embedding" not in q.columns:
        q = embed_queries(q, embedder, dim)
    if "asked_at" not in q.columns:
        q = q.withColumn("asked_at", F.current_timestamp())
    q = checkpoint(q)
    found = checkpoint(retrieval_stages(q.drop("asked_at"), fragments, contexts, index)["retrieved"])
    text = PR.assemble_context(found, q.select("query_id", "context_id", "query"))
    rendered = PR.render_prompt(text.join(contexts.select("context_id", "prompt_template"), "context_id"))
    answers = checkpoint(CH.complete_chat(PR.build_messages(rendered), completer))
    events = CH.response_events(answers, found).join(q.select("query_id", "asked_at"), "query_id")
    return events.withColumn("ts", F.timestamp_add("MILLISECOND", F.col("seq"), F.col("asked_at"))).drop("asked_at")


def answer_stream(questions: DataFrame, log: EventLog, checkpoint_path: str, fragments: DataFrame, contexts: DataFrame,
                  index: Bm25Index | None = None, available_now: bool = True, **options):
    """Starts answering a stream of ``questions`` into ``log``; returns the streaming query.
    ``fragments``, ``contexts`` and ``index`` are the stored tables that all batches ask."""
    def one(batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:09d}"
        if name not in log.manifest()["batches"]:
            ship_package(log.spark)
            log.add(answer_batch(batch, fragments, contexts, index, **options), name)

    writer = questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
