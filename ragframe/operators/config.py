"""Settings and models (F1-F4): JSON parse/render with native ``from_json`` /
``to_json``, model lookup by a broadcast join to the 5-row model dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe import schemas as S
from ragframe.functions.text import format_file_size as _fmt
from ragframe.session import broadcast_if_small

# fields of the three JSON columns: (path, kind, required)
_FIELDS = {
    "retrieval_settings": (S.RETRIEVAL_SETTINGS, [
        ("fullTextSearchLimit", "an integer", True), ("semanticSearchLimit", "an integer", True),
        ("rrfLimit", "an integer", True), ("fragmentLookupRange.lookBack", "an integer", True),
        ("fragmentLookupRange.lookAhead", "an integer", True)]),
    "prompt_template": (S.PROMPT_TEMPLATE, [
        ("taskContext", "a string", True), ("toneContext", "a string", False), ("taskDescription", "a string", False),
        ("examples", "a list", True), ("queryTemplate", "a string", True), ("queryContextTemplate", "a string", True),
        ("precognition", "a string", False), ("outputFormatting", "a string", False), ("prefill", "a string", False)]),
    "chat_completion_settings": (S.CHAT_COMPLETION_SETTINGS, [
        ("logitBias", "a map", False), ("maxTokens", "an integer", False), ("n", "an integer", False),
        ("frequencyPenalty", "a number", False), ("presencePenalty", "a number", False),
        ("temperature", "a number", False), ("topP", "a number", False)]),
}


def _parsed(json_col: str, kind: str, prefix: str = ""):
    """(typed value or NULL, array of problems) of one JSON column."""
    schema, fields = _FIELDS[kind]
    text = F.col(json_col)
    # presence in the raw JSON tells "missing" apart from "wrong type"
    malformed = F.get_json_object(text, "$").isNull()
    value = F.when(~malformed, F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    errs = [F.when(malformed, F.lit(f"{prefix or '$'}: malformed JSON"))]
    for path, what, required in fields:
        v = value
        for p in path.split("."):
            v = v[p]
        absent = F.get_json_object(text, "$." + path).isNull()
        name = f"{prefix}.{path}" if prefix else path
        errs.append(F.when(~malformed & v.isNull(), F.when(~absent, F.lit(f"{name}: expected {what}"))
                           .otherwise(F.lit(f"{name}: missing") if required else F.lit(None).cast("string"))))
    return value, F.array_compact(F.array(*errs))


def parse_settings(raw: DataFrame, json_col: str = "settings_json", kind: str = "retrieval_settings"):
    """JSON text -> typed settings column ``kind``. Rows with malformed JSON,
    a missing field or a field of the wrong type are rejected with every
    problem as ``path: message``, joined by ", ". Returns (valid, rejects)."""
    value, errors = _parsed(json_col, kind)
    d = raw.withColumn(kind, value).withColumn("errors", F.array_join(errors, ", "))
    ok = d.where(F.col("errors") == "").drop("errors")
    bad = d.where(F.col("errors") != "").drop(kind)
    return ok, bad


def parse_context_settings(raw: DataFrame, suffix: str = "_json"):
    """F1 for a whole context form: the columns ``<kind><suffix>`` of all three
    kinds become typed columns; a row with any problem is rejected with the
    problems of all three. Returns (valid, rejects)."""
    d, errors = raw, []
    for kind in _FIELDS:
        value, errs = _parsed(kind + suffix, kind, kind)
        d = d.withColumn(kind, value)
        errors.append(errs)
    d = d.withColumn("errors", F.array_join(F.concat(*errors), ", "))
    ok = d.where(F.col("errors") == "").drop("errors", *[k + suffix for k in _FIELDS])
    bad = d.where(F.col("errors") != "").drop(*_FIELDS)
    return ok, bad


def render_settings(contexts: DataFrame) -> DataFrame:
    """typed settings -> JSON text (fields in declaration order, NULL
    fields omitted)."""
    return (contexts
            .withColumn("retrieval_settings_json", F.to_json("retrieval_settings"))
            .withColumn("prompt_template_json", F.to_json("prompt_template"))
            .withColumn("chat_completion_settings_json",
                        F.coalesce(F.to_json("chat_completion_settings"), F.lit("{}"))))


def models(spark: SparkSession) -> DataFrame:
    """The model dimension (name, context_length)."""
    return spark.createDataFrame(K.MODELS, "name string, context_length int")


def resolve_models(rows: DataFrame, model_cols=("chat_model", "embeddings_model"),
                   dim: DataFrame | None = None) -> DataFrame:
    """model name -> context length for each model column
    (``<col>_context_length``); an unknown name gives NULL and an ``error``."""
    dim = dim if dim is not None else models(rows.sparkSession)
    out = rows
    errs = []
    for c in model_cols:
        m = broadcast_if_small(dim.select(F.col("name").alias(c), F.col("context_length").alias(f"{c}_context_length")),
                               100_000)
        out = out.join(m, c, "left")
        errs.append(F.when(F.col(c).isNotNull() & F.col(f"{c}_context_length").isNull(),
                           F.concat(F.lit(f"{c}: unknown model "), F.col(c))))
    return out.withColumn("error", F.array_join(F.array_compact(F.array(*errs)), ", ")).withColumn(
        "error", F.when(F.col("error") != "", F.col("error")))


def format_file_size(rows: DataFrame, col: str, out_col: str = "size_text") -> DataFrame:
    """human-readable file size column."""
    return rows.withColumn(out_col, _fmt(col))
