"""Prompt assembly and display (D1-D3, D8, D9): native string expressions,
one aggregate per query for the ordered context text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe.functions.text import embedding_input, escape_html as _escape_html_expr


def assemble_context(retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query, the embedding inputs of its retrieved chunks joined by
    newline, in retrieval order (document, fragment, chunk); '' without hits.
    The per-query group is bounded by the retrieval limits."""
    item = F.struct("document_id", "fragment_index", "chunk_index",
                    embedding_input("metadata", "value").alias("inp"))
    agg = retrieved.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["inp"]), "\n")
        .alias("context_text"))
    return (queries.join(agg, "query_id", "left")
            .withColumn("context_text", F.coalesce("context_text", F.lit(""))))


def render_prompt(rows: DataFrame, template_col: str = "prompt_template", query_col: str = "query",
                  context_col: str = "context_text") -> DataFrame:
    """Render the structured template. system = the three system parts
    joined by newline (absent parts are empty but keep their newline); user =
    context template (with {{context}}), query template (with {{query}}),
    precognition, formatting, joined by newline; assistant = prefill."""
    t = F.col(template_col)
    system = F.concat_ws("\n", F.coalesce(t["taskContext"], F.lit("")),
                         F.coalesce(t["toneContext"], F.lit("")),
                         F.coalesce(t["taskDescription"], F.lit("")))
    ctx_part = F.when(F.col(context_col).isNotNull(),
                      F.replace(t["queryContextTemplate"], F.lit(K.CONTEXT_VAR), F.col(context_col)))
    user = F.concat_ws("\n", F.coalesce(ctx_part, F.lit("")),
                       F.coalesce(F.replace(t["queryTemplate"], F.lit(K.QUERY_VAR), F.col(query_col)), F.lit("")),
                       F.coalesce(t["precognition"], F.lit("")),
                       F.coalesce(t["outputFormatting"], F.lit("")))
    rendered = F.struct(system.alias("system"),
                        F.coalesce(t["examples"], F.array().cast("array<struct<role:string,text:string>>"))
                        .alias("examples"),
                        user.alias("user"), t["prefill"].alias("assistant"))
    return rows.withColumn("rendered", rendered)


def build_messages(rendered: DataFrame, rendered_col: str = "rendered") -> DataFrame:
    """D3: chat messages in order: system, examples..., user, assistant prefill
    (when present). Output (query_id, pos, role, content)."""
    r = F.col(rendered_col)
    empty = F.array().cast("array<struct<role:string,content:string>>")
    msgs = F.concat(
        F.when(r["system"].isNotNull(),
               F.array(F.struct(F.lit("system").alias("role"), r["system"].alias("content")))).otherwise(empty),
        F.transform(r["examples"], lambda e: F.struct(e["role"].alias("role"), e["text"].alias("content"))),
        F.array(F.struct(F.lit("user").alias("role"), r["user"].alias("content"))),
        F.when(r["assistant"].isNotNull(),
               F.array(F.struct(F.lit("assistant").alias("role"), r["assistant"].alias("content"))))
        .otherwise(empty),
    )
    return (rendered.select("query_id", F.posexplode(msgs).alias("pos", "m"))
            .select("query_id", F.col("pos").cast("long").alias("pos"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("content")))


def escape_html(rows: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """HTML-escape a text column for display."""
    return rows.withColumn(out_col or col, _escape_html_expr(col))


def retrieval_report(retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query, one row per retrieved fragment (fragment index, matched
    index, three scores, escaped chunk) under 'Document fragments:'; a query
    without hits gets one row 'No documents retrieved.'."""
    r = retrieved.select("query_id", "document_id", "fragment_index", "chunk_index",
                         "matched_fragment_index", "rrf_score", "semantic_score", "full_text_score",
                         _escape_html_expr("value").alias("chunk_html"))
    q = queries.select("query_id")
    j = q.join(r, "query_id", "left")
    return j.withColumn("message", F.when(F.col("document_id").isNull(), F.lit(K.NO_DOCUMENTS_RETRIEVED))
                        .otherwise(F.lit("Document fragments:")))
