"""Lookups and sources over the context / document / embedding tables
(A1-A5, A12-A14). Lookups are semi/anti joins; the key side is broadcast when
a size check proves it small, else both sides shuffle on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe import schemas as S
from ragframe.functions.text import format_file_size
from ragframe.session import broadcast_if_small

KEY_SIDE_MAX_ROWS = 1_000_000


def context_get(contexts: DataFrame, ids: DataFrame) -> DataFrame:
    """A1: contexts whose id is in ``ids`` (column ``context_id``)."""
    keys = ids.select("context_id").distinct()
    return contexts.join(broadcast_if_small(keys, KEY_SIDE_MAX_ROWS), "context_id", "left_semi")


def context_by_name(contexts: DataFrame, names: DataFrame) -> DataFrame:
    """A2: every context carrying one of the names (names are not unique: 0..n
    rows per name)."""
    keys = names.select("name").distinct()
    return contexts.join(broadcast_if_small(keys, KEY_SIDE_MAX_ROWS), "name", "left_semi")


def context_list(contexts: DataFrame) -> DataFrame:
    """A3: all contexts (projection only; unused columns are pruned from scans)."""
    return contexts.select("context_id", "name", "description", "prompt_template",
                           "retrieval_settings", "chat_completion_settings", "chat_model",
                           "embeddings_model", "updated_at")


def document_list(documents: DataFrame, context_ids: DataFrame) -> DataFrame:
    """A4: documents of the given contexts."""
    keys = context_ids.select("context_id").distinct()
    return documents.join(broadcast_if_small(keys, KEY_SIDE_MAX_ROWS), "context_id", "left_semi")


def embeddings_exist(keys: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A5: add ``exists``: whether any embedding row has the key's (context,
    document). The key batch is broadcast (size-checked) to filter the
    embedding scan map-side; only matching keys are de-duplicated."""
    k = ["context_id", "document_id"]
    batch = broadcast_if_small(keys.select(*k).distinct(), KEY_SIDE_MAX_ROWS)
    # scan the big table once, filtered map-side by the broadcast key batch
    have = embeddings.select(*k).join(batch, k, "left_semi").distinct().withColumn("_e", F.lit(True))
    return (keys.join(have, k, "left")
            .withColumn("exists", F.coalesce(F.col("_e"), F.lit(False))).drop("_e"))


def scan_documents(spark: SparkSession, path: str, glob: str | None = None,
                   recursive: bool = False, limit: int | None = None) -> DataFrame:
    """Files of a directory as rows (path, modificationTime, length,
    content) via the ``binaryFile`` source; ``name`` is the base name.
    ``limit`` keeps the first files by path (the seed path takes one)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return df.orderBy("path").limit(limit) if limit is not None else df


def default_context(contexts: DataFrame, default_id: str = "00000000-0000-0000-0000-000000000000",
                    now=None) -> DataFrame:
    """The contexts table with at least one row (a default context is added
    when the table is empty) and ``is_default`` marking the chosen context: the
    first by (updated_at, context_id)."""
    spark = contexts.sparkSession
    now = now if now is not None else F.current_timestamp()
    dflt = spark.range(1).select(
        F.lit(default_id).alias("context_id"), F.lit(K.DEFAULT_CONTEXT_NAME).alias("name"),
        F.lit(K.DEFAULT_CONTEXT_DESCRIPTION).alias("description"),
        F.struct(F.lit(K.DEFAULT_TASK_CONTEXT).alias("taskContext"),
                 F.lit(None).cast("string").alias("toneContext"),
                 F.lit(None).cast("string").alias("taskDescription"),
                 F.array().cast("array<struct<role:string,text:string>>").alias("examples"),
                 F.lit(K.DEFAULT_QUERY_TEMPLATE).alias("queryTemplate"),
                 F.lit(K.DEFAULT_QUERY_CONTEXT_TEMPLATE).alias("queryContextTemplate"),
                 F.lit(None).cast("string").alias("precognition"),
                 F.lit(None).cast("string").alias("outputFormatting"),
                 F.lit(None).cast("string").alias("prefill")).cast(S.PROMPT_TEMPLATE).alias("prompt_template"),
        F.struct(F.lit(K.DEFAULT_FULL_TEXT_SEARCH_LIMIT).alias("fullTextSearchLimit"),
                 F.lit(K.DEFAULT_SEMANTIC_SEARCH_LIMIT).alias("semanticSearchLimit"),
                 F.lit(K.DEFAULT_RRF_LIMIT).alias("rrfLimit"),
                 F.struct(F.lit(K.DEFAULT_LOOK_BACK).alias("lookBack"),
                          F.lit(K.DEFAULT_LOOK_AHEAD).alias("lookAhead")).alias("fragmentLookupRange"),
                 ).cast(S.RETRIEVAL_SETTINGS).alias("retrieval_settings"),
        F.lit(None).cast(S.CHAT_COMPLETION_SETTINGS).alias("chat_completion_settings"),
        F.lit(K.DEFAULT_CHAT_MODEL).alias("chat_model"),
        F.lit(K.DEFAULT_EMBEDDINGS_MODEL).alias("embeddings_model"),
        now.cast("timestamp").alias("updated_at"),
    )
    base = context_list(contexts)
    # add the default row only when the table is empty: a scalar subquery that
    # reads at most one row of the table
    present = base.limit(1).agg(F.count(F.lit(1))).scalar()
    extra = dflt.where(present == 0)
    allc = base.unionByName(extra)
    first = allc.agg(F.min(F.struct("updated_at", "context_id")).alias("_f")).select(
        F.col("_f.context_id").alias("_chosen"))
    return (allc.join(F.broadcast(first), F.col("context_id") == F.col("_chosen"), "left")
            .withColumn("is_default", F.col("_chosen").isNotNull()).drop("_chosen"))


def admit_uploads(files: DataFrame, allowed: list[str] | None = None,
                  max_bytes: int = K.MAX_UPLOAD_BYTES, compat: bool = False,
                  mime_col: str = "mime", size_col: str = "size") -> DataFrame:
    """``valid`` and ``error`` per file. The type check is exact membership
    (``compat=True``: substring of the comma-joined list, so '' passes); then the
    size limit. The allow-list is a literal set, evaluated map-side."""
    allowed = allowed if allowed is not None else K.ALLOWED_MIME_TYPES
    mime = F.coalesce(F.col(mime_col), F.lit(""))
    if compat:
        type_ok = F.instr(F.lit(",".join(allowed)), mime) > 0
    else:
        type_ok = mime.isin(allowed)
    size_ok = ~(F.col(size_col) > F.lit(max_bytes)) if max_bytes else F.lit(True)
    err = (F.when(~type_ok, F.concat(F.lit("File type "), mime, F.lit(" is not allowed.")))
           .when(~size_ok, F.concat(F.lit("File size "), format_file_size(size_col),
                                    F.lit(" exceeds maximum size of "), format_file_size(F.lit(max_bytes)))))
    return files.withColumn("valid", type_ok & size_ok).withColumn("error", err)



FRAGMENT_ORDER = ["context_id", "document_id", "fragment_index", "chunk_index"]


def deal_fragments(fragments: DataFrame) -> DataFrame:
    """Rows dealt by ranges of the fragment key. Ranges are found by computing the rows
    once more, so this comes before what is dear, such as embedding."""
    return fragments.repartitionByRange(int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions")), *FRAGMENT_ORDER)


def write_fragments(fragments: DataFrame, path: str, mode: str = "overwrite", dealt: bool = False) -> None:
    """Store a fragment (embeddings) table in the layout the retrieval prunes
    on: partitioned by ``context_id`` (vector search and neighbour expansion read
    only the batch's contexts), files sorted by (document_id, fragment_index,
    chunk_index) so pushed ``In(document_id, ...)`` filters skip row groups. The
    range partitioning on the full key spreads a context that holds a third of
    all rows over many writer tasks. ``dealt``: the rows come from
    :func:`deal_fragments` and stay in their tasks."""
    rows = fragments if dealt else deal_fragments(fragments)
    (rows.sortWithinPartitions(*FRAGMENT_ORDER)
     .write.mode(mode).partitionBy("context_id").parquet(path))
