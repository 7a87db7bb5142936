"""Keyed mutations of the three tables (A6-A11) as DataFrame -> DataFrame
functions: the caller writes the returned version (Parquet has no MERGE).

Upserts with a small (size-checked) change batch never shuffle the current
table: a broadcast left join updates existing rows and a broadcast-filtered key
scan finds the new ones; a large batch falls back to one full outer join on the
key. Deletes are anti joins whose key side is broadcast when a size check proves
it small. Outputs of one call derive from one input snapshot.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.session import broadcast_if_small, checkpoint, fits

KEY_SIDE_MAX_ROWS = 1_000_000
CHANGES_BROADCAST_MAX_ROWS = 1_000_000
CONTEXT_COLS = ["name", "description", "prompt_template", "retrieval_settings",
                "chat_completion_settings", "chat_model", "embeddings_model"]
DOCUMENT_UPDATABLE = ["description", "type", "metadata"]


def _last_change(changes: DataFrame, key: str, seq_col: str | None) -> DataFrame:
    """Two changes to one key in one batch: the highest ``seq_col`` wins. A
    ``max_by`` aggregate, so a key with very many changes is reduced map-side."""
    if not seq_col or seq_col not in changes.columns:
        return changes
    rest = [c for c in changes.columns if c not in (key, seq_col)]
    return (changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq_col)).alias("_last"))
            .select(key, *[F.col("_last")[c].alias(c) for c in rest]))


def _keyed_merge(current: DataFrame, changes: DataFrame, key: str, select_cols) -> DataFrame:
    """Merge ``changes`` into ``current`` on ``key``; ``select_cols`` builds the
    output from aliases ``c`` (current, NULL for new keys) and ``n`` (change,
    NULL for untouched keys).

    Small change batch (size-checked): no shuffle of the current table --
    existing rows take a broadcast left join with the changes, new keys are
    the changes whose key a broadcast-filtered scan of the current keys does not
    find. Large batch: one full outer join (both sides shuffle on the key)."""
    if fits(changes, CHANGES_BROADCAST_MAX_ROWS):
        n = F.broadcast(changes.alias("n"))
        existing = current.alias("c").join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "left")
        hit = current.select(key).join(F.broadcast(changes.select(key)), key, "left_semi")
        fresh = changes.join(hit, key, "left_anti").alias("n").join(
            current.limit(0).alias("c"), F.col(f"c.{key}") == F.col(f"n.{key}"), "left")
        return existing.select(*select_cols()).unionByName(fresh.select(*select_cols()))
    j = current.alias("c").join(changes.alias("n"), F.col(f"c.{key}") == F.col(f"n.{key}"), "full")
    return j.select(*select_cols())


def upsert_contexts(current: DataFrame, changes: DataFrame, now: Column | None = None,
                    seq_col: str | None = "change_seq") -> DataFrame:
    """Insert new contexts; on an existing id replace every column and set
    ``updated_at = now``."""
    now = now if now is not None else F.current_timestamp()
    ch = _last_change(changes, "context_id", seq_col).withColumn("_new", F.lit(True))

    def cols():
        matched = F.col("n._new").isNotNull()
        out = [F.coalesce(F.col("n.context_id"), F.col("c.context_id")).alias("context_id")]
        out += [F.when(matched, F.col(f"n.{k}")).otherwise(F.col(f"c.{k}")).alias(k) for k in CONTEXT_COLS]
        out.append(F.when(matched, now.cast("timestamp")).otherwise(F.col("c.updated_at")).alias("updated_at"))
        return out

    return _keyed_merge(current, ch, "context_id", cols)


def upsert_documents(current: DataFrame, changes: DataFrame, now: Column | None = None,
                     seq_col: str | None = "change_seq") -> DataFrame:
    """Insert new documents (``updated_at = now``); on an existing id update
    only description, type and metadata -- name, context and updated_at keep
    their old values."""
    now = now if now is not None else F.current_timestamp()
    ch = _last_change(changes, "document_id", seq_col).withColumn("_new", F.lit(True))

    def cols():
        exists = F.col("c.document_id").isNotNull()
        matched = F.col("n._new").isNotNull()
        out = [F.coalesce(F.col("c.document_id"), F.col("n.document_id")).alias("document_id")]
        for k in ["context_id", "name"]:
            out.append(F.when(exists, F.col(f"c.{k}")).otherwise(F.col(f"n.{k}")).alias(k))
        for k in DOCUMENT_UPDATABLE:
            out.append(F.when(matched, F.col(f"n.{k}")).otherwise(F.col(f"c.{k}")).alias(k))
        out.append(F.when(exists, F.col("c.updated_at")).otherwise(now.cast("timestamp")).alias("updated_at"))
        return out

    return _keyed_merge(current, ch, "document_id", cols)


def assign_ids(rows: DataFrame, order_cols: list[str], start: Column, id_col: str = "id",
               num_partitions: int | None = None) -> DataFrame:
    """Dense, consecutive ids ``start + 1, start + 2, ...`` in ``order_cols``
    order, computed without a global window: range-partition and sort by the
    order, number rows inside each partition, checkpoint (so the partitioning is
    fixed even if a task is re-run), then add each partition's offset (a table
    of one row per partition, broadcast)."""
    spark = rows.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (rows.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id()))
    # the low 33 bits of the generated id are the row's place in its partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = checkpoint(ranged.withColumn("_pos", place))
    # one row per partition (bounded by the partition count), as zipWithIndex does
    counts = sorted((r[0], r[1]) for r in numbered.groupBy("_pid").agg(F.count(F.lit(1))).collect())
    offsets, acc = [], 0
    for pid, cnt in counts:
        offsets.append((pid, acc))
        acc += cnt
    table = spark.createDataFrame(offsets, "_pid int, _off long")
    return (numbered.join(F.broadcast(table), "_pid")
            .withColumn(id_col, start + F.col("_off") + F.col("_pos") + F.lit(1)).drop("_pid", "_pos", "_off"))


def append_embeddings(current: DataFrame, new: DataFrame, expected_dim: int | None = None,
                      order_cols=("document_id", "fragment_index", "chunk_index")):
    """Append vectors with generated ids ``max(id) + 1 ...`` (ordered by
    document, fragment, chunk). Returns (table, rejects): rows whose vector has
    the wrong dimension go to rejects instead of failing the batch."""
    if expected_dim is not None:
        good = new.where(F.size("embedding") == F.lit(expected_dim))
        rejects = new.where(~(F.size("embedding") == F.lit(expected_dim)) | F.col("embedding").isNull())
    else:
        good, rejects = new, new.limit(0)
    start = F.coalesce(current.agg(F.max("id")).scalar(), F.lit(0).cast("long"))
    if "id" in good.columns:
        good = good.drop("id")
    with_ids = assign_ids(good, list(order_cols), start)
    return current.unionByName(with_ids.select(*current.columns)), rejects


def delete_embeddings(embeddings: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete every embedding of the given (context, document) keys."""
    k = keys.select("context_id", "document_id").distinct()
    return embeddings.join(broadcast_if_small(k, KEY_SIDE_MAX_ROWS), ["context_id", "document_id"], "left_anti")


def purge_documents(documents: DataFrame, embeddings: DataFrame, keys: DataFrame):
    """A10: delete the embeddings of the (context, document) keys, then the
    documents by id. Returns (documents, embeddings)."""
    emb = delete_embeddings(embeddings, keys)
    ids = keys.select("document_id").distinct()
    docs = documents.join(broadcast_if_small(ids, KEY_SIDE_MAX_ROWS), "document_id", "left_anti")
    return docs, emb


def purge_contexts(contexts: DataFrame, documents: DataFrame, embeddings: DataFrame, ids: DataFrame):
    """Purge every document of the contexts, then the contexts. Returns
    (contexts, documents, embeddings)."""
    cid = ids.select("context_id").distinct()
    cid_b = broadcast_if_small(cid, KEY_SIDE_MAX_ROWS)
    keys = documents.join(cid_b, "context_id", "left_semi").select("context_id", "document_id")
    docs, emb = purge_documents(documents, embeddings, keys)
    # embeddings of the purged contexts whose document row is missing go too
    emb = emb.join(cid_b, "context_id", "left_anti")
    ctx = contexts.join(cid_b, "context_id", "left_anti")
    return ctx, docs, emb


def integrity_report(contexts: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Orphan counts (embeddings without document, documents without context)."""
    e_orph = embeddings.select("document_id").join(documents.select("document_id"), "document_id", "left_anti")
    d_orph = documents.select("context_id").join(contexts.select("context_id"), "context_id", "left_anti")
    return e_orph.agg(F.count(F.lit(1)).alias("orphan_embeddings")).select(
        "orphan_embeddings", d_orph.agg(F.count(F.lit(1))).scalar().alias("orphan_documents"))
