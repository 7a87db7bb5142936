"""C15 ``retrieve``: hybrid retrieval for a whole table of queries.

BM25 top-k (global, then context filter) and exact vector top-k per context are
fused by reciprocal rank, de-duplicated and widened to neighbouring fragments.
Per-query limits come from each query's context settings (columns); the
literal caps that let Spark push the limits below the shuffles are the maxima
over the batch, read in one single-row aggregate together with the batch size.
Those numbers also *prove* the size of every small side before it is broadcast:

* query tokens   <= n_queries * max distinct tokens per query, and the bytes of their texts
* query vectors  <= n_queries * dimension
* expanded band  <= matches, measured in rows and bytes, * (lookBack + lookAhead + 1)

Above the bounds the query vectors are sent in several blocks, and the other
sides are joined by shuffle (AQE handles skew); the stages stay the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe.functions.text import tokens
from ragframe.operators.fulltext import (Bm25Index, bm25_search, bm25_stats, context_post_filter,
                                         fulltext_rank)
from ragframe.operators.fusion import dedupe_fragments, dedupe_matches, expand_neighbors, rrf_fuse
from ragframe.operators.vectors import semantic_rank, semantic_search
from ragframe.session import checkpoint, conf_int, fits, measured

SETTINGS_COLS = ["_fts_limit", "_sem_limit", "_rrf_limit", "_look_back", "_look_ahead"]
BROADCAST_MAX_ROWS = "ragframe.broadcast.maxRows"
BROADCAST_MAX_BYTES = "ragframe.broadcast.maxBytes"


@dataclass
class BatchBounds:
    n_queries: int
    fts_cap: int
    sem_cap: int
    rrf_cap: int
    band_cap: int
    max_query_tokens: int
    dim: int
    text_bytes: int
    key_bytes: int

    def tokens_fit(self, max_rows: int, max_bytes: int) -> bool:
        """Whether the batch's query tokens, with their settings, may be broadcast."""
        rows = self.n_queries * self.max_query_tokens
        return rows <= max_rows and self.text_bytes + rows * (64 + self.key_bytes // max(self.n_queries, 1)) <= max_bytes

    def keys_fit(self, max_rows: int, max_bytes: int) -> bool:
        """Whether the batch's context ids may be broadcast."""
        return self.n_queries <= max_rows and self.key_bytes + self.n_queries * 16 <= max_bytes


def with_settings(queries: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Flatten each query's retrieval settings into columns (``_fts_limit`` ...).
    Settings come from a ``retrieval_settings`` column of the queries, else from
    the query's context; missing values fall back to the defaults."""
    q = queries
    if "retrieval_settings" not in q.columns and contexts is not None:
        cs = contexts.select("context_id", "retrieval_settings")
        q = q.join(F.broadcast(cs) if fits(cs, 100_000) else cs, "context_id", "left")
    if "retrieval_settings" in q.columns:
        rs = F.col("retrieval_settings")
        vals = [rs["fullTextSearchLimit"], rs["semanticSearchLimit"], rs["rrfLimit"],
                rs["fragmentLookupRange"]["lookBack"], rs["fragmentLookupRange"]["lookAhead"]]
    else:
        vals = [F.lit(None)] * 5
    defaults = [K.DEFAULT_FULL_TEXT_SEARCH_LIMIT, K.DEFAULT_SEMANTIC_SEARCH_LIMIT, K.DEFAULT_RRF_LIMIT,
                K.DEFAULT_LOOK_BACK, K.DEFAULT_LOOK_AHEAD]
    for name, v, d in zip(SETTINGS_COLS, vals, defaults):
        q = q.withColumn(name, F.coalesce(v.cast("int"), F.lit(d)))
    return q


def batch_bounds(q: DataFrame, text_col: str = "query") -> BatchBounds:
    """One single-row aggregate over the query batch (the only driver-side read)."""
    r = q.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_fts_limit").alias("fts"), F.max("_sem_limit").alias("sem"),
        F.max("_rrf_limit").alias("rrf"),
        F.max(F.col("_look_back") + F.col("_look_ahead") + 1).alias("band"),
        F.max(F.size(F.array_distinct(tokens(text_col)))).alias("toks"),
        F.max(F.size("embedding")).alias("dim"),
        F.sum(F.octet_length(text_col)).alias("bytes"), F.sum(F.octet_length("context_id")).alias("keys"),
    ).first()
    return BatchBounds(int(r["n"] or 0), int(r["fts"] or 0), int(r["sem"] or 0), int(r["rrf"] or 0),
                       int(r["band"] or 1), max(int(r["toks"] or 0), 0), max(int(r["dim"] or 0), 0),
                       int(r["bytes"] or 0), int(r["keys"] or 0))


def _only(fragments: DataFrame, keys: DataFrame, on: list[str], small: bool) -> DataFrame:
    """The fragments whose key is among ``keys``: a semi-join (broadcast behind its
    bound), which prunes the partitions of a table stored by that key."""
    keys = keys.select(*on).distinct()
    return fragments.join(F.broadcast(keys) if small else keys, on, "left_semi")


class _Stages(dict):
    """Lazy mapping of stage name -> DataFrame: a stage (and what it needs,
    e.g. the index build or the materialized matches) is built on first access."""

    def __init__(self, builders):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        value = self._builders[key]()
        self[key] = value
        return value


def retrieval_stages(queries: DataFrame, fragments: DataFrame, contexts: DataFrame | None = None,
                     index: Bm25Index | Callable[[], Bm25Index] | None = None, scope: str = "global", method: str = "block",
                     with_vectors: bool = False, dedupe_keep: str = "lowest",
                     materialize_matches: bool = True) -> dict[str, DataFrame]:
    """Every intermediate of :func:`retrieve`, by name (built lazily; so is an ``index`` that
    is given as a function: stages without a text search need none)."""
    spark = queries.sparkSession
    max_rows = conf_int(spark, BROADCAST_MAX_ROWS, 2_000_000)
    max_bytes = conf_int(spark, BROADCAST_MAX_BYTES, 32 * 1024 * 1024)
    memo: dict = {}

    def q():
        if "q" not in memo:
            memo["q"] = with_settings(queries, contexts)
        return memo["q"]

    def b() -> BatchBounds:
        if "b" not in memo:
            memo["b"] = batch_bounds(q())
        return memo["b"]

    def ix() -> Bm25Index:
        if "ix" not in memo:
            # corpus statistics are global in both scopes; 'context' only
            # restricts which postings are scored
            memo["ix"] = (index() if callable(index) else index) or bm25_stats(fragments, materialize=True)
        return memo["ix"]

    def fts_top():
        return bm25_search(q(), ix(), "_fts_limit", max(b().fts_cap, 1), scope,
                           broadcast_tokens=b().tokens_fit(max_rows, max_bytes),
                           carry=SETTINGS_COLS)

    def sem_top():
        # vector search only ever reads the batch's contexts
        return semantic_search(q(), _only(fragments, q(), ["context_id"], b().keys_fit(max_rows, max_bytes)), "_sem_limit",
                               max(b().sem_cap, 1), blocks=max(1, -(-b().n_queries * (b().dim * 4 + 64) // max_bytes)),
                               method=method, carry=SETTINGS_COLS)

    def matches():
        # at most n * rrf cap rows: stored once, which cuts the lineage of the search
        found = dedupe_matches(st["fused"], dedupe_keep)
        return checkpoint(found) if materialize_matches else found

    def expanded():
        # the stored matches are measured in rows and bytes; each meets a band of fragments
        rows, size = measured(st["matches"])
        small = rows * b().band_cap <= max_rows and size * b().band_cap <= 2 * max_bytes
        # text is read of the matched documents only
        frags = _only(fragments, st["matches"], ["context_id", "document_id"], small)
        return expand_neighbors(st["matches"], frags, broadcast_matches=small, with_vectors=with_vectors)

    def retrieved():
        out = dedupe_fragments(st["expanded"])
        cols = ["query_id", "context_id", "document_id", "fragment_index", "chunk_index", "id", "value",
                "metadata"] + (["embedding"] if with_vectors else []) + [
                "matched_fragment_index", "full_text_score", "semantic_score", "rrf_score",
                "semantic_rank", "full_text_rank"]
        return out.select(*[c for c in cols if c in out.columns])

    st = _Stages({
        "queries": q,
        "fts_top": fts_top,
        "fts_ctx": lambda: context_post_filter(st["fts_top"]),
        "fts_ranked": lambda: fulltext_rank(st["fts_ctx"]),
        "sem_top": sem_top,
        "sem_ranked": lambda: semantic_rank(st["sem_top"]),
        "fused": lambda: rrf_fuse(st["sem_ranked"], st["fts_ranked"], max(b().rrf_cap, 1)),
        "matches": matches,
        "expanded": expanded,
        "retrieved": retrieved,
    })
    return st


def retrieve(queries: DataFrame, fragments: DataFrame, contexts: DataFrame | None = None,
             index: Bm25Index | None = None, scope: str = "global", method: str = "block",
             with_vectors: bool = False, dedupe_keep: str = "lowest") -> DataFrame:
    """Hybrid retrieval (C2-C14) for a table of queries.

    ``queries``: query_id, context_id, query, embedding [, retrieval_settings].
    ``fragments``: id, context_id, document_id, fragment_index, chunk_index,
    value, metadata, embedding. Output one row per retrieved fragment with
    matched_fragment_index, full_text_score, semantic_score, rrf_score and the
    two nullable ranks. Unordered; order by (query_id, document_id,
    fragment_index, chunk_index) to present it."""
    return retrieval_stages(queries, fragments, contexts, index, scope, method, with_vectors,
                            dedupe_keep)["retrieved"]
