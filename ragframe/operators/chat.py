"""Chat completion and the response event stream, batch form.

Events are rows ``(query_id, seq, [ts,] type, content)`` with type one of
Retrieval / Partial / Finished. Answer assembly is an *ordered* string
concatenation; it is done in two levels -- within (query_id, seq bucket), then
per query over the bucket strings -- so a query with a huge number of events is
pre-aggregated by many groups before its final row is built.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe import constants as K
from ragframe.functions import plugins
from ragframe.operators.fusion import group_by_document

SEQ_BUCKET = 1024


def complete_chat(messages: DataFrame, completer=None, settings_col: str | None = None) -> DataFrame:
    """One model call per prompt. ``messages``: (query_id, pos, role,
    content); messages of a prompt are gathered (bounded by the template) and a
    batch completer is applied per Arrow batch. Output (query_id, answer); a
    missing choice gives ''."""
    completer = completer or plugins.extractive_completer()
    extra = [F.any_value(settings_col).alias(settings_col)] if settings_col else []
    grouped = messages.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .alias("messages"), *extra)

    def run(batches):
        for pdf in batches:
            ans = completer(pdf) if len(pdf) else pd.Series([], dtype=object)
            yield pd.DataFrame({"query_id": pdf["query_id"], "answer": pd.Series(ans).fillna("").to_numpy()})

    key_type = messages.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", key_type), T.StructField("answer", T.StringType())])
    return grouped.mapInPandas(run, schema)


def response_events(answers: DataFrame, retrieved: DataFrame | None = None,
                    answer_col: str = "answer") -> DataFrame:
    """Per query one Retrieval event (seq 0, with the number of retrieved
    fragments and the fragments themselves grouped by document, as JSON in
    ``content``), the answer as Partial events (one per word with its leading
    whitespace, seq 1..n), then Finished (seq n+1)."""
    a = answers.select("query_id", F.regexp_extract_all(F.coalesce(F.col(answer_col), F.lit("")),
                                                        F.lit(r"(\s*\S+)"), 1).alias("_parts"))
    if retrieved is not None:
        docs = group_by_document(retrieved).select("query_id", F.size("fragments").alias("_n"), F.struct(
            "document_id", F.transform("fragments", lambda x: F.struct(
                x["fragment_index"].alias("fragment_index"), x["chunk_index"].alias("chunk_index"),
                x["value"].alias("value"))).alias("fragments")).alias("_doc"))
        counts = docs.groupBy("query_id").agg(F.sum("_n").alias("n_fragments"),
                                              F.to_json(F.array_sort(F.collect_list("_doc"))).alias("_grouped"))
        a = (a.join(counts, "query_id", "left").withColumn("n_fragments", F.coalesce("n_fragments", F.lit(0)))
             .withColumn("_grouped", F.coalesce("_grouped", F.lit("[]"))))
    else:
        a = a.withColumn("n_fragments", F.lit(None).cast("long")).withColumn("_grouped", F.lit(None).cast("string"))
    ret = a.select("query_id", F.lit(0).cast("long").alias("seq"), F.lit(K.EVENT_RETRIEVAL).alias("type"),
                   F.col("_grouped").alias("content"), F.col("n_fragments").cast("long").alias("n_fragments"))
    parts = a.select("query_id", F.posexplode("_parts").alias("_p", "content")).select(
        "query_id", (F.col("_p") + 1).cast("long").alias("seq"), F.lit(K.EVENT_PARTIAL).alias("type"),
        "content", F.lit(None).cast("long").alias("n_fragments"))
    fin = a.select("query_id", (F.size("_parts") + 1).cast("long").alias("seq"),
                   F.lit(K.EVENT_FINISHED).alias("type"), F.lit(None).cast("string").alias("content"),
                   F.lit(None).cast("long").alias("n_fragments"))
    return ret.unionByName(parts).unionByName(fin)


def subscribe_responses(events: DataFrame, subscriptions: DataFrame,
                        timeout_seconds: int = K.RESPONSE_TIMEOUT_SECONDS) -> DataFrame:
    """Events of the subscribed queries that arrive within ``timeout`` of
    the subscription start (``start_ts``); earlier events are not replayed."""
    s = subscriptions.select("query_id", "start_ts")
    # Equi-join on query_id: Spark broadcasts the subscriptions when their
    # measured size is small; otherwise AQE's skew-join split divides a hot
    # query's events over several tasks (replicating its one subscription row).
    j = events.join(s, "query_id")
    return j.where((F.col("ts") >= F.col("start_ts")) &
                   (F.col("ts") < F.col("start_ts") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")))


def first_event_subscriptions(events: DataFrame) -> DataFrame:
    """Subscriptions that start at each query's first event (the timer is set
    once, at the first event)."""
    return events.groupBy("query_id").agg(F.min("ts").alias("start_ts"))


def assemble_answers(events: DataFrame, mode: str = "until_finished") -> DataFrame:
    """D7 (batch): one answer per query.

    ``until_finished``: all Partial contents before the first Finished (by seq),
    status 'finished'; without a Finished event status 'timeout' and every
    Partial is used. ``leading``: only the Partials before the first
    non-Partial event (what collecting the *leading* Partials of a stream that
    starts with Retrieval yields).

    Two aggregations and no join: each (query, seq bucket) group concatenates
    its Partials before its own first stop event; per query, the buckets up to
    the first bucket that holds a stop are joined in order. A query with a huge
    number of events is therefore split over many groups (at most
    ``SEQ_BUCKET`` events each) before its single answer row is built."""
    stop = (F.col("type") == K.EVENT_FINISHED) if mode == "until_finished" else (
        F.col("type") != K.EVENT_PARTIAL)
    item = F.when(F.col("type") == K.EVENT_PARTIAL,
                  F.struct(F.col("seq"), F.coalesce(F.col("content"), F.lit("")).alias("content")))
    lvl1 = (events.withColumn("_b", F.floor(F.col("seq") / SEQ_BUCKET))
            .groupBy("query_id", "_b")
            .agg(F.min(F.when(stop, F.col("seq"))).alias("_stop"),
                 F.max(F.when(F.col("type") == K.EVENT_FINISHED, F.lit(1)).otherwise(F.lit(0))).alias("_fin"),
                 F.array_sort(F.collect_list(item)).alias("_items")))
    lvl1 = lvl1.select(
        "query_id", "_b", "_stop", "_fin",
        F.array_join(F.transform(F.filter("_items", lambda x: F.col("_stop").isNull() | (x["seq"] < F.col("_stop"))),
                                 lambda x: x["content"]), "").alias("_s"))
    lvl2 = lvl1.groupBy("query_id").agg(
        F.min(F.when(F.col("_stop").isNotNull(), F.col("_b"))).alias("_sb"),
        F.max("_fin").alias("_fin"),
        F.array_sort(F.collect_list(F.struct("_b", "_s"))).alias("_parts"))
    answer = F.array_join(F.transform(F.filter("_parts", lambda x: F.col("_sb").isNull() | (x["_b"] <= F.col("_sb"))),
                                      lambda x: x["_s"]), "")
    return lvl2.select("query_id", answer.alias("answer"),
                       F.when(F.col("_fin") == 1, F.lit("finished")).otherwise(F.lit("timeout")).alias("status"))
