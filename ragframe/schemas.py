"""Spark types of the data model (contexts, documents, embeddings, queries,
events, commands)."""

from __future__ import annotations

from pyspark.sql import types as T

EXAMPLE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

PROMPT_TEMPLATE = T.StructType([
    T.StructField("taskContext", T.StringType()),
    T.StructField("toneContext", T.StringType()),
    T.StructField("taskDescription", T.StringType()),
    T.StructField("examples", T.ArrayType(EXAMPLE)),
    T.StructField("queryTemplate", T.StringType()),
    T.StructField("queryContextTemplate", T.StringType()),
    T.StructField("precognition", T.StringType()),
    T.StructField("outputFormatting", T.StringType()),
    T.StructField("prefill", T.StringType()),
])

LOOKUP_RANGE = T.StructType([
    T.StructField("lookBack", T.IntegerType()),
    T.StructField("lookAhead", T.IntegerType()),
])

RETRIEVAL_SETTINGS = T.StructType([
    T.StructField("fullTextSearchLimit", T.IntegerType()),
    T.StructField("semanticSearchLimit", T.IntegerType()),
    T.StructField("rrfLimit", T.IntegerType()),
    T.StructField("fragmentLookupRange", LOOKUP_RANGE),
])

CHAT_COMPLETION_SETTINGS = T.StructType([
    T.StructField("logitBias", T.MapType(T.StringType(), T.FloatType())),
    T.StructField("maxTokens", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("frequencyPenalty", T.DoubleType()),
    T.StructField("presencePenalty", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("topP", T.DoubleType()),
])

CONTEXTS = T.StructType([
    T.StructField("context_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("prompt_template", PROMPT_TEMPLATE),
    T.StructField("retrieval_settings", RETRIEVAL_SETTINGS),
    T.StructField("chat_completion_settings", CHAT_COMPLETION_SETTINGS),
    T.StructField("chat_model", T.StringType()),
    T.StructField("embeddings_model", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

METADATA = T.MapType(T.StringType(), T.StringType())

EMBEDDINGS_KEYS = ["id", "context_id", "document_id", "fragment_index", "chunk_index"]

EVENTS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("content", T.StringType()),
])
