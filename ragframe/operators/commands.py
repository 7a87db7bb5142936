"""Slash commands: decode, parse, resolve, route, answer, payload.
All row-local native expressions plus one broadcast join to the (small,
checked) per-name context table and one join to the answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe.functions.text import java_trim
from ragframe.session import broadcast_if_small


def encode_form(rows: DataFrame, fields: list[str], out_col: str = "body") -> DataFrame:
    """Inverse of E1 (used to build raw bodies): ``k=v&...`` with URL-encoded
    values; NULL fields are left out."""
    pairs = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.url_encode(F.col(f).cast("string"))))
             for f in fields]
    return rows.withColumn(out_col, F.concat_ws("&", *pairs))


def _named(field: str):
    return lambda p: p["k"] == field


def decode_commands(raw: DataFrame, body_col: str = "body"):
    """Form body -> 13 typed columns. Blank values count as missing; a
    missing required field (or a non-boolean ``is_enterprise_install``) rejects
    the row. Names and values are URL-decoded; of a repeated field the first
    value counts. Returns (commands, rejects) where rejects carry ``error``."""
    pairs = F.transform(F.split(F.col(body_col), "&"), lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.when(F.instr(p, "=") > 0, F.try_url_decode(p.substr(F.instr(p, "=") + 1, F.length(p)))).alias("v")))
    raw = raw.withColumn("_pairs", pairs)
    cols = []
    for f in K.COMMAND_FIELDS:
        v = F.try_element_at(F.filter("_pairs", _named(f)), F.lit(1))["v"]
        cols.append(F.when(F.length(F.trim(v)) > 0, v).alias(f))
    d = raw.select(*[c for c in raw.columns if c not in (body_col, "_pairs")], *cols)
    flag = F.lower(F.col("is_enterprise_install"))
    d = d.withColumn("is_enterprise_install",
                     F.when(flag == "true", F.lit(True)).when(flag == "false", F.lit(False)))
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in K.COMMAND_FIELDS_REQUIRED]))
    d = d.withColumn("_missing", missing)
    ok = d.where(F.size("_missing") == 0).drop("_missing")
    bad = d.where(F.size("_missing") > 0).withColumn(
        "error", F.concat(F.lit("missing or invalid: "), F.array_join("_missing", ", "))).drop("_missing")
    return ok, bad


def parse_command(commands: DataFrame, text_col: str = "text") -> DataFrame:
    """Trim (every char <= U+0020), split on single spaces: the head is the
    context name, the tail re-joined by spaces is the query (double spaces keep
    an empty part, so the query may start with a space)."""
    d = commands.withColumn("_t", java_trim(F.col(text_col)))
    t = F.col("_t")
    sp = F.instr(t, " ")
    return (d.withColumn("parsed", t.isNotNull())
            .withColumn("context_name", F.when(sp > 0, F.substring_index(t, " ", 1)).otherwise(t))
            .withColumn("user_query", F.when(sp > 0, F.substr(t, sp + 1))
                        .otherwise(F.when(t.isNotNull(), F.lit(""))))
            .drop("_t"))


def contexts_by_name(contexts: DataFrame) -> DataFrame:
    """First context per name by (updated_at, context_id): names are not unique.
    A ``min_by`` aggregate (partial aggregation map-side), so a name shared by a
    third of all contexts is reduced in every task before the shuffle. NULL
    timestamps order last."""
    order = F.struct(F.col("updated_at").isNull().alias("_n"), F.col("updated_at"), F.col("context_id"))
    return (contexts.groupBy("name").agg(F.min_by("context_id", order).alias("context_id"))
            .select(F.col("name").alias("context_name"), "context_id", F.col("name").alias("context_label")))


def resolve_context(parsed: DataFrame, contexts: DataFrame) -> DataFrame:
    """Attach the first context with the parsed name (NULL when none)."""
    byname = contexts_by_name(contexts)
    return parsed.join(broadcast_if_small(byname, 1_000_000), "context_name", "left")


def _filled(template: str, **values) -> Column:
    """``template`` with each ``{name}`` replaced by its column, as one concatenation."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def route_commands(resolved: DataFrame, text_col: str = "text") -> DataFrame:
    """``route`` in (unparsed, unknown_context, query) and the reply text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    route = (F.when(~F.col("parsed"), F.lit("unparsed"))
             .when(F.col("context_id").isNull(), F.lit("unknown_context"))
             .otherwise(F.lit("query")))
    reply = (F.when(route == "unparsed", _filled(K.REPLY_UNPARSED, text=text))
             .when(route == "unknown_context", _filled(K.REPLY_UNKNOWN_CONTEXT, context=F.col("context_name"), text=text))
             .otherwise(_filled(K.REPLY_ACK, name=F.col("context_label"), query=F.col("user_query"))))
    return resolved.withColumn("route", route).withColumn("reply", reply)


def answer_commands(routed: DataFrame, answers: DataFrame, key: str = "query_id") -> DataFrame:
    """E5: per routed command the outgoing messages: acknowledgement (plain)
    then the answer (markdown) for a query; one plain error message otherwise.
    Output (command_id, pos, kind, text) and, where the commands have it,
    ``response_url``, the address that the message is sent to."""
    j = routed.join(answers.select(key, "answer"), key, "left")
    msgs = F.when(F.col("route") == "query",
                  F.array(F.struct(F.lit("plain").alias("kind"), F.col("reply").alias("text")),
                          F.struct(F.lit("markdown").alias("kind"),
                                   F.coalesce(F.col("answer"), F.lit("")).alias("text")))
                  ).otherwise(F.array(F.struct(F.lit("plain").alias("kind"), F.col("reply").alias("text"))))
    to = [c for c in ("response_url",) if c in routed.columns]
    return (j.select("command_id", *to, F.posexplode(msgs).alias("pos", "m"))
            .select("command_id", *to, F.col("pos").cast("long").alias("pos"),
                    F.col("m.kind").alias("kind"), F.col("m.text").alias("text")))


def message_payload(messages: DataFrame) -> DataFrame:
    """Message JSON: text plus one section block, plain text (with
    ``emoji: true``) or markdown. Always valid JSON (values are escaped)."""
    plain = F.col("kind") == "plain"
    block_text = F.struct(F.when(plain, F.lit("plain_text")).otherwise(F.lit("mrkdwn")).alias("type"),
                          F.col("text").alias("text"),
                          F.when(plain, F.lit(True)).alias("emoji"))
    payload = F.struct(F.col("text").alias("text"),
                       F.array(F.struct(F.lit("section").alias("type"), block_text.alias("text"))).alias("blocks"))
    return messages.withColumn("payload", F.to_json(payload))
