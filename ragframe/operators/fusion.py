"""Reciprocal-rank fusion, de-duplication and neighbour expansion (C11-C14,
C16). All inputs here are already limited per query (<= 40 candidates, <= rrf
matches), so every window is small per key; partitioning is by ``query_id``
throughout, never a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragframe import constants as K
from ragframe.session import fits

LIMIT_COLS = ["_rrf_limit", "_look_back", "_look_ahead"]


def rrf_fuse(semantic: DataFrame, fulltext: DataFrame, limit_cap: int | None = None,
             limit_col: str = "_rrf_limit") -> DataFrame:
    """C11: full outer join of the two ranked lists on (query_id, id);
    ``rrf = sum 1/(60 + rank)``; a hit missing from a list scores 0 there (both
    score columns are 0 when absent, S2); top ``rrfLimit`` per query by rrf desc,
    ties by id. The limit is ``limit_col``'s; ``limit_cap`` is the batch's largest
    (or, where no column has it, the limit).

    ``semantic`` needs query_id, id, keys, semantic_score, semantic_rank;
    ``fulltext`` query_id, id, keys, full_text_score, full_text_rank; both carry
    the per-query settings columns."""
    carry = [c for c in LIMIT_COLS if c in semantic.columns]
    s = semantic.select("query_id", "id", *[F.col(c).alias("s_" + c) for c in
                        ["context_id", "document_id", "fragment_index"] + carry],
                        "semantic_score", "semantic_rank")
    f = fulltext.select("query_id", "id", *[F.col(c).alias("f_" + c) for c in
                        ["context_id", "document_id", "fragment_index"] + carry],
                        "full_text_score", "full_text_rank")
    j = s.join(f, ["query_id", "id"], "full")
    rrf = (F.coalesce(F.lit(1.0) / (F.lit(float(K.RRF_K)) + F.col("semantic_rank")), F.lit(0.0))
           + F.coalesce(F.lit(1.0) / (F.lit(float(K.RRF_K)) + F.col("full_text_rank")), F.lit(0.0)))
    out = j.select(
        "query_id", "id",
        F.coalesce("s_context_id", "f_context_id").alias("context_id"),
        F.coalesce("s_document_id", "f_document_id").alias("document_id"),
        F.coalesce("s_fragment_index", "f_fragment_index").alias("matched_fragment_index"),
        *[F.coalesce("s_" + c, "f_" + c).alias(c) for c in carry],
        F.coalesce("full_text_score", F.lit(0.0)).alias("full_text_score"),
        F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        "semantic_rank", "full_text_rank",
        F.round(rrf, K.RRF_DIGITS).alias("rrf_score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc_nulls_first(), F.col("id"))
    out = out.withColumn("_rn", F.row_number().over(w))
    if limit_col in out.columns:
        out = out.where(F.col("_rn") <= F.col(limit_col))
        return (out if limit_cap is None else out.where(F.col("_rn") <= F.lit(limit_cap))).drop("_rn")
    return out.where(F.col("_rn") <= F.lit(limit_cap or K.DEFAULT_RRF_LIMIT)).drop("_rn")


def dedupe_matches(matched: DataFrame, keep: str = "lowest") -> DataFrame:
    """One match per (query, document, matched fragment). ``keep='lowest'``
    keeps the lowest rrf (what an ascending DISTINCT ON does, S3); ``'best'``
    the highest. Ties by id."""
    order = F.col("rrf_score").asc() if keep == "lowest" else F.col("rrf_score").desc()
    w = Window.partitionBy("query_id", "document_id", "matched_fragment_index").orderBy(order, F.col("id"))
    return matched.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def expand_neighbors(matches: DataFrame, fragments: DataFrame, broadcast_matches: bool | None = None,
                     look_back: int = K.DEFAULT_LOOK_BACK, look_ahead: int = K.DEFAULT_LOOK_AHEAD,
                     with_vectors: bool = False) -> DataFrame:
    """Every fragment of the same context and document whose index lies in
    ``[matched - lookBack, matched + lookAhead]``. The band is exploded into
    offsets (at most back+ahead+1 per match) so the join is an equi-join on
    (context, document, fragment); the match side is small and broadcast, so the
    fragment table is only scanned. Negative indexes match nothing (S9)."""
    back = F.col("_look_back") if "_look_back" in matches.columns else F.lit(look_back)
    ahead = F.col("_look_ahead") if "_look_ahead" in matches.columns else F.lit(look_ahead)
    lo = F.greatest(F.col("matched_fragment_index") - back, F.lit(0)).cast("long")
    hi = (F.col("matched_fragment_index") + ahead).cast("long")
    m = (matches.withColumnRenamed("id", "match_id")
         .withColumn("fragment_index", F.explode(
             F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>")))))
    if broadcast_matches is None:  # standalone call: check the size (retrieve passes a proven bound)
        broadcast_matches = fits(m, 2_000_000)
    m = F.broadcast(m) if broadcast_matches else m
    cols = ["context_id", "document_id", "fragment_index", "chunk_index", "id", "value", "metadata"]
    if with_vectors:
        cols.append("embedding")
    f = fragments.select(*[c for c in cols if c in fragments.columns])
    return f.join(m, ["context_id", "document_id", "fragment_index"])


def dedupe_fragments(expanded: DataFrame) -> DataFrame:
    """C14: one row per (query, document, fragment): the lowest chunk_index; when
    two matches' windows overlap, the row of the best-scoring match survives
    (tie rule: chunk_index, rrf desc, matched fragment, match id, id; S4)."""
    w = Window.partitionBy("query_id", "document_id", "fragment_index").orderBy(
        F.col("chunk_index").asc(), F.col("rrf_score").desc(), F.col("matched_fragment_index").asc(),
        F.col("match_id").asc(), F.col("id").asc())
    return expanded.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def group_by_document(retrieved: DataFrame) -> DataFrame:
    """Retrieved rows grouped per (query, document), rows ordered by
    (fragment, chunk). Groups are bounded by the retrieval limits."""
    item = F.struct("fragment_index", "chunk_index", "matched_fragment_index", "rrf_score",
                    "semantic_score", "full_text_score", "value")
    return (retrieved.groupBy("query_id", "document_id")
            .agg(F.array_sort(F.collect_list(item)).alias("fragments")))
