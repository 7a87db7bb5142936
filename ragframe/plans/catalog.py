"""Registered queries (one per operator of the inventory) and their DuckDB
oracles. Every query reads the driver tables of ``sf_dir`` (or views Spark
derives from them) in full; outputs are flat, with aliased columns whose names
match the oracle's."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe.functions.vector import norm_expr
from ragframe.operators import balls as BA
from ragframe.operators import chat as CH
from ragframe.operators import codes as BC
from ragframe.operators import commands as CM
from ragframe.operators import config as CF
from ragframe.operators import evals as EV
from ragframe.operators import filetypes as FY
from ragframe.operators import fulltext as FT
from ragframe.operators import fusion as FU
from ragframe.operators import ingest as IG
from ragframe.operators import lsa as LS
from ragframe.operators import maintenance as M
from ragframe.operators import prompt as PR
from ragframe.operators import sentences as SE
from ragframe.operators import textindex as TI
from ragframe.operators import vectors as V
from ragframe.plans.oracle_retrieval import RETRIEVED_COLS, retrieval_with
from ragframe.plans.retrieve import retrieval_stages
from ragframe.session import broadcast_if_small, checkpoint, ensure_checkpoint_dir
from ragframe.sources import tables as TB
from ragframe.sources import testdata as TD
from ragframe.streaming import answers as SA
from ragframe.streaming import chat as SC
from ragframe.streaming import ingest as SI
from ragframe.streaming import responses as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------
# Retrieval (C)
# --------------------------------------------------------------------------

_STAGE_CACHE: dict[tuple, dict] = {}
_CACHED = 6


def _kept(spark: SparkSession, key: tuple, build):
    """``build()``, kept for this session and this version of the tables. The few
    latest results stay; a rewritten table or a new session never hits an old one."""
    hit = _STAGE_CACHE.pop(key, None)
    if hit is None or hit[0] is not spark:
        hit = (spark, build())
    _STAGE_CACHE[key] = hit
    while len(_STAGE_CACHE) > _CACHED:
        _STAGE_CACHE.pop(next(iter(_STAGE_CACHE)))
    return hit[1]


def _fragments(spark: SparkSession, sf: str, corpus: str = "corpus") -> DataFrame:
    """The fragment table as an engine holds it: stored, partitioned by context."""
    def build():
        path = f"{ensure_checkpoint_dir(spark)}/fragments-{uuid.uuid4().hex}"
        TB.write_fragments(getattr(TD, corpus)(spark, sf, arrange=TB.deal_fragments), path, dealt=True)
        return spark.read.parquet(path)
    return _kept(spark, ("fragments", id(spark), sf, corpus, TD.version(spark, sf)), build)


def _index(spark: SparkSession, sf: str, corpus: str = "corpus"):
    """The stored text index of the fragment table."""
    return _kept(spark, ("index", id(spark), sf, corpus, TD.version(spark, sf)),
                 lambda: FT.bm25_stats(_fragments(spark, sf, corpus), materialize=True))


def _stages(spark: SparkSession, sf: str, corpus: str = "corpus", **opts) -> dict[str, DataFrame]:
    """Retrieval stages over the stored fragment table and its stored index."""
    key = ("stages", id(spark), sf, corpus, tuple(sorted(opts.items())), TD.version(spark, sf))
    return _kept(spark, key, lambda: retrieval_stages(
        TD.queries(spark, sf), _fragments(spark, sf, corpus), TD.contexts(spark, sf),
        lambda: _index(spark, sf, corpus), **opts))


def _digest(vec: str = "embedding"):
    """A whole-number digest of a vector: its values at six decimals, by place."""
    scaled = F.transform(vec, lambda x, i: F.round(x.cast("double") * 1000000).cast("long") * (i + 1))
    return F.aggregate(scaled, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("digest")


_DIGEST_SQL = """CAST(list_sum(list_transform(embedding, lambda x, i: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) * i)) AS BIGINT) AS digest"""


FTS_COLS = ["query_id", "q_context_id", "id", "context_id", "document_id", "fragment_index",
            "full_text_score"]
SEM_COLS = ["query_id", "id", "context_id", "document_id", "fragment_index", "semantic_score"]
FUSED_COLS = ["query_id", "id", "context_id", "document_id", "matched_fragment_index",
              "full_text_score", "semantic_score", "rrf_score", "semantic_rank", "full_text_rank"]
RCOLS = [c.strip() for c in RETRIEVED_COLS.split(",")]


def _sel(cols):
    return ", ".join(cols)


@register("escape_query", TD.sql_with("queries") + r"""
SELECT query_id, regexp_replace(query, '([+''^:{}"\[\]()<>~\\!* ])', '\\\1', 'g') AS escaped FROM queries""")
def q_escape_query(spark, sf):
    return FT.escape_query(TD.queries(spark, sf)).select("query_id", "escaped")


@register("analyze_text", TD.sql_with("corpus") + r"""
SELECT id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS position, unnest(toks) AS token
FROM (SELECT id, list_filter(regexp_extract_all(lower(value), '[\p{L}\p{N}]+'), lambda t: length(t) <= 255) AS toks
      FROM corpus)""")
def q_analyze_text(spark, sf):
    out = FT.analyze_text(TD.corpus(spark, sf), "value", keep=("id",), with_position=True)
    return out.select("id", F.col("position").cast("long").alias("position"), "token")


@register("bm25_stats", retrieval_with() + """
SELECT p.id, p.token, p.tf, p.dl, d.df, t.n_docs, t.avgdl
FROM postings p JOIN doc_freq d USING (token), totals t""")
def q_bm25_stats(spark, sf):
    ix = FT.bm25_stats(TD.corpus(spark, sf, embedded=False), materialize=True)
    return (ix.postings.join(broadcast_if_small(ix.doc_freq, FT.BROADCAST_MAX_ROWS), "token")
            .select("id", "token", "tf", "dl", "df",
                    ix.totals.select("n_docs").scalar().alias("n_docs"),
                    ix.totals.select("avgdl").scalar().alias("avgdl")))


@register("bm25_search", retrieval_with() + f"\nSELECT {_sel(FTS_COLS)} FROM fts_top")
def q_bm25_search(spark, sf):
    return _stages(spark, sf)["fts_top"].select(*FTS_COLS)


def _text_index(spark, sf):
    """The stored index in blocks of the whole fragment table."""
    return _kept(spark, ("text_index", id(spark), sf, TD.version(spark, sf)), lambda: TI.TextIndex.create(
        spark, f"{ensure_checkpoint_dir(spark)}/text-index-{uuid.uuid4().hex}", _fragments(spark, sf)))


@register("bm25_search_blocks", retrieval_with() + f"\nSELECT {_sel(FTS_COLS)} FROM fts_top")
def q_bm25_search_blocks(spark, sf):
    """The search that reads only the blocks of postings that can reach each query's threshold."""
    return _text_index(spark, sf).search(_stages(spark, sf)["queries"]).select(*FTS_COLS)


@register("index_upkeep", retrieval_with("kept_corpus") + f"\nSELECT {_sel(FTS_COLS)} FROM fts_top")
def q_index_upkeep(spark, sf):
    """An index of the labelled documents, to which all others are appended and from which
    the toxic ones are deleted: its search finds what a fresh index of the rest would."""
    f = _fragments(spark, sf)
    labels = TD.read(spark, sf, "labels").select(F.col("doc_id").alias("document_id")).distinct()
    index = TI.TextIndex.create(spark, f"{ensure_checkpoint_dir(spark)}/text-index-{uuid.uuid4().hex}",
                                f.join(labels, "document_id", "left_semi"), batch="labelled")
    index.append(f.join(labels, "document_id", "left_anti"), batch="others")
    index.delete(_keys(spark, sf, F.col("toxic") == 1), batch="toxic")
    return index.search(_stages(spark, sf)["queries"]).select(*FTS_COLS)


@register("context_post_filter", retrieval_with() + f"\nSELECT {_sel(FTS_COLS)} FROM fts_ctx")
def q_context_post_filter(spark, sf):
    return _stages(spark, sf)["fts_ctx"].select(*FTS_COLS)


@register("fulltext_rank", retrieval_with() + f"\nSELECT {_sel(FTS_COLS)}, full_text_rank FROM fts_ranked")
def q_fulltext_rank(spark, sf):
    return _stages(spark, sf)["fts_ranked"].select(*FTS_COLS, "full_text_rank")


@register("cosine_distance", retrieval_with() + f"""
SELECT {_sel(["f." + c for c in SEM_COLS[:-1]])}, round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), {K.DISTANCE_DIGITS}) AS semantic_score
FROM fts_top f JOIN corpus e ON e.id = f.id JOIN qs q ON q.query_id = f.query_id""")
def q_cosine_distance(spark, sf):
    """Distances of the pairs that the text search found (at most its limit a query)."""
    st = _stages(spark, sf)
    hits = checkpoint(st["fts_top"].select("query_id", "id"))
    q = checkpoint(st["queries"].select("query_id", F.col("embedding").alias("q_vec")))
    f = _fragments(spark, sf).select("id", "context_id", "document_id", "fragment_index", "embedding")
    # both sides grow with the queries, not with the fragments: these are only scanned
    pairs = f.join(broadcast_if_small(hits, FT.BROADCAST_MAX_ROWS), "id").join(broadcast_if_small(q, FT.BROADCAST_MAX_ROWS), "query_id")
    out = V.cosine_distance(pairs, "q_vec", "embedding", "semantic_score")
    return out.select(*SEM_COLS).withColumn("semantic_score", F.round("semantic_score", K.DISTANCE_DIGITS))


@register("semantic_search", retrieval_with() + f"\nSELECT {_sel(SEM_COLS)} FROM sem_top")
def q_semantic_search(spark, sf):
    return _stages(spark, sf)["sem_top"].select(*SEM_COLS)


@register("semantic_search_balls", retrieval_with() + f"\nSELECT {_sel(SEM_COLS)} FROM sem_top")
def q_semantic_search_balls(spark, sf):
    """The exact search that skips balls of fragments beyond each query's bound."""
    index = _kept(spark, ("balls", id(spark), sf, TD.version(spark, sf)), lambda: BA.ball_build(_fragments(spark, sf)))
    return BA.ball_search(_stages(spark, sf)["queries"], index).select(*SEM_COLS)


@register("semantic_rank", retrieval_with() + f"\nSELECT {_sel(SEM_COLS)}, semantic_rank FROM sem_ranked")
def q_semantic_rank(spark, sf):
    return _stages(spark, sf)["sem_ranked"].select(*SEM_COLS, "semantic_rank")


@register("rrf_fuse", retrieval_with() + f"\nSELECT {_sel(FUSED_COLS)} FROM fused")
def q_rrf_fuse(spark, sf):
    return _stages(spark, sf)["fused"].select(*FUSED_COLS)


@register("bm25_search_context_scope", retrieval_with() + f"""
SELECT {_sel(FTS_COLS)} FROM fts_scored WHERE context_id = q_context_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY full_text_score DESC, id) <= fts_limit""")
def q_bm25_search_context_scope(spark, sf):
    return _stages(spark, sf, scope="context")["fts_top"].select(*FTS_COLS)


@register("dedupe_matches_best", retrieval_with("dup_corpus") + f"""
SELECT {_sel(FUSED_COLS)} FROM fused
QUALIFY row_number() OVER (PARTITION BY query_id, document_id, matched_fragment_index ORDER BY rrf_score DESC, id) = 1""")
def q_dedupe_matches_best(spark, sf):
    return _stages(spark, sf, "dup_corpus", dedupe_keep="best")["matches"].select(*FUSED_COLS)


@register("dedupe_matches", retrieval_with("dup_corpus") + f"\nSELECT {_sel(FUSED_COLS)} FROM matches")
def q_dedupe_matches(spark, sf):
    return _stages(spark, sf, "dup_corpus")["matches"].select(*FUSED_COLS)


EXP_COLS = ["query_id", "context_id", "document_id", "fragment_index", "chunk_index", "id", "match_id",
            "matched_fragment_index", "rrf_score"]


@register("expand_neighbors", retrieval_with() + f"\nSELECT {_sel(EXP_COLS)} FROM expanded")
def q_expand_neighbors(spark, sf):
    return _stages(spark, sf)["expanded"].select(*EXP_COLS)


@register("dedupe_fragments", retrieval_with("corpus2") + f"\nSELECT {RETRIEVED_COLS} FROM retrieved")
def q_dedupe_fragments(spark, sf):
    return _stages(spark, sf, "corpus2")["retrieved"].select(*RCOLS)


@register("retrieve", retrieval_with() + f"\nSELECT {RETRIEVED_COLS} FROM retrieved")
def q_retrieve(spark, sf):
    return _stages(spark, sf)["retrieved"].select(*RCOLS)


@register("retrieve_with_vectors", retrieval_with() + f"""
SELECT query_id, id, fragment_index, rrf_score, '{{}}' AS metadata, {_DIGEST_SQL} FROM (
  SELECT r.*, c.embedding FROM retrieved r JOIN corpus c USING (id))""")
def q_retrieve_with_vectors(spark, sf):
    """The flagship with metadata and vectors in its output."""
    st = _stages(spark, sf, with_vectors=True)
    return st["retrieved"].select("query_id", "id", "fragment_index", "rrf_score", F.to_json("metadata").alias("metadata"), _digest())


@register("retrieve_context_scope", retrieval_with(scope="context") + f"\nSELECT {RETRIEVED_COLS} FROM retrieved")
def q_retrieve_context_scope(spark, sf):
    return _stages(spark, sf, scope="context")["retrieved"].select(*RCOLS)


@register("retrieve_dup_corpus", retrieval_with("dup_corpus") + f"\nSELECT {RETRIEVED_COLS} FROM retrieved")
def q_retrieve_dup(spark, sf):
    return _stages(spark, sf, "dup_corpus")["retrieved"].select(*RCOLS)


@register("group_by_document", retrieval_with() + """
SELECT query_id, document_id, count(*) AS n_fragments,
       string_agg(CAST(fragment_index AS VARCHAR), ',' ORDER BY fragment_index, chunk_index) AS fragment_list
FROM retrieved GROUP BY query_id, document_id""")
def q_group_by_document(spark, sf):
    g = FU.group_by_document(_stages(spark, sf)["retrieved"])
    return g.select("query_id", "document_id", F.size("fragments").cast("long").alias("n_fragments"),
                    F.array_join(F.transform("fragments", lambda x: x["fragment_index"].cast("string")),
                                 ",").alias("fragment_list"))


@register("embed_queries", "WITH " + TD._vectors_sql("made", "benchmark", "item_id", "text", f"""
  SELECT item_id AS query_id, 'src' || CAST(item_id % 5 AS VARCHAR) AS context_id, CAST(len(embedding) AS INTEGER) AS dim, {_DIGEST_SQL}
  FROM made_vec JOIN benchmark ON id = item_id""").strip() + " SELECT * FROM made")
def q_embed_queries(spark, sf):
    out = V.embed_queries(TD.queries(spark, sf).select("query_id", "context_id", "query"), dim=64)
    return out.select("query_id", "context_id", F.size("embedding").alias("dim"), _digest())


def _ivf(spark, sf):
    return _kept(spark, ("ivf", id(spark), sf, TD.version(spark, sf)), lambda: V.ivf_build(_fragments(spark, sf)))


def _codes(spark, sf):
    return _kept(spark, ("codes", id(spark), sf, TD.version(spark, sf)), lambda: BC.code_build(_fragments(spark, sf), dim=64))


@register("ann_search")
def q_ann_search(spark, sf):
    """The approximate search by binary codes and each query's recall against the exact one."""
    st = _stages(spark, sf)
    approx = BC.code_search(st["queries"], _codes(spark, sf))
    rec = V.recall_at_k(approx, st["sem_top"])
    return approx.join(rec, "query_id", "left").select("query_id", "id", "semantic_score", "recall")


@register("ann_search_all_codes", retrieval_with() + f"\nSELECT {_sel(SEM_COLS)} FROM sem_top")
def q_ann_search_all_codes(spark, sf):
    """The same path with a shortlist of every row of the context: the exact result."""
    index = _codes(spark, sf)
    rows = index.codes.count()
    return BC.code_search(_stages(spark, sf)["queries"], index, oversample=rows).select(*SEM_COLS)


@register("ann_search_all_cells", retrieval_with() + f"\nSELECT {_sel(SEM_COLS)} FROM sem_top")
def q_ann_search_all_cells(spark, sf):
    """The approximate search's own path with every cell probed: the exact result."""
    index = _ivf(spark, sf)
    return V.ann_search(_stages(spark, sf)["queries"], index, n_probe=len(index.centers)).select(*SEM_COLS)


# --------------------------------------------------------------------------
# Tables (A)
# --------------------------------------------------------------------------


NOW_SQL = "TIMESTAMP '2024-06-01 00:00:00'"


def _now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


def _ctx_flat(df: DataFrame) -> DataFrame:
    return df.select("context_id", "name", "description", "chat_model", "embeddings_model",
                     F.col("retrieval_settings.rrfLimit").cast("long").alias("rrf_limit"),
                     F.col("updated_at").cast("string").alias("updated_at"))


_CTX_FLAT_SQL = ("context_id, name, description, chat_model, embeddings_model, "
                 "CAST(rrf_limit AS BIGINT) AS rrf_limit, CAST(updated_at AS VARCHAR) AS updated_at")


@register("context_get", TD.sql_with("ctx", "queries") + f"""
SELECT {_CTX_FLAT_SQL} FROM ctx WHERE context_id IN (SELECT context_id FROM queries)""")
def q_context_get(spark, sf):
    return _ctx_flat(TB.context_get(TD.contexts(spark, sf), TD.queries(spark, sf)))


_NAMES_SQL = "SELECT DISTINCT 'src' || CAST(conv_id % 25 AS VARCHAR) AS name FROM conversations WHERE role = 'user'"


def _names(spark, sf):
    c = TD.read(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select(F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("name")).distinct()


@register("context_by_name", TD.sql_with("ctx") + f"""
SELECT {_CTX_FLAT_SQL} FROM ctx WHERE name IN ({_NAMES_SQL})""")
def q_context_by_name(spark, sf):
    return _ctx_flat(TB.context_by_name(TD.contexts(spark, sf), _names(spark, sf)))


@register("context_list", TD.sql_with("ctx") + f"\nSELECT {_CTX_FLAT_SQL} FROM ctx")
def q_context_list(spark, sf):
    return _ctx_flat(TB.context_list(TD.contexts(spark, sf)))


@register("document_list", TD.sql_with("docs", "queries") + """
SELECT document_id, context_id, name, description, type FROM docs
WHERE context_id IN (SELECT context_id FROM queries)""")
def q_document_list(spark, sf):
    d = TB.document_list(TD.documents_table(spark, sf), TD.queries(spark, sf))
    return d.select("document_id", "context_id", "name", "description", "type")


@register("embeddings_exist", TD.sql_with("docs", "labelled_chunks") + """
SELECT d.context_id, d.document_id,
       EXISTS (SELECT 1 FROM labelled_chunks c WHERE c.context_id = d.context_id AND c.document_id = d.document_id) AS "exists"
FROM docs d""")
def q_embeddings_exist(spark, sf):
    keys = TD.documents_table(spark, sf).select("context_id", "document_id")
    return TB.embeddings_exist(keys, TD.labelled_chunks(spark, sf)).select("context_id", "document_id", "exists")


@register("upsert_contexts", TD.sql_with("ctx") + f""",
changes AS (
  SELECT DISTINCT source AS context_id, source AS name, lang FROM documents
  UNION ALL SELECT DISTINCT 'lang-' || lang, 'lang-' || lang, lang FROM documents),
last_change AS (SELECT context_id, name, 'Docs in ' || max(lang) AS description FROM changes GROUP BY context_id, name)
SELECT COALESCE(l.context_id, c.context_id) AS context_id,
       CASE WHEN l.context_id IS NOT NULL THEN l.name ELSE c.name END AS name,
       CASE WHEN l.context_id IS NOT NULL THEN l.description ELSE c.description END AS description,
       CASE WHEN l.context_id IS NOT NULL THEN 'mistral-large-latest' ELSE c.chat_model END AS chat_model,
       CASE WHEN l.context_id IS NOT NULL THEN 'mistral-embed' ELSE c.embeddings_model END AS embeddings_model,
       CAST(CASE WHEN l.context_id IS NOT NULL THEN {K.DEFAULT_RRF_LIMIT} ELSE c.rrf_limit END AS BIGINT) AS rrf_limit,
       CASE WHEN l.context_id IS NOT NULL THEN CAST({NOW_SQL} AS VARCHAR) ELSE CAST(c.updated_at AS VARCHAR) END AS updated_at
FROM ctx c FULL OUTER JOIN last_change l ON c.context_id = l.context_id""")
def q_upsert_contexts(spark, sf):
    d = TD.read(spark, sf, "documents").select("source", "lang").distinct()
    dflt = TB.default_context(TD.contexts(spark, sf).limit(0), now=_now())
    upd = d.select(F.col("source").alias("context_id"), F.col("source").alias("name"), "lang")
    new = d.select(F.concat(F.lit("lang-"), "lang").alias("context_id"),
                   F.concat(F.lit("lang-"), "lang").alias("name"), "lang").distinct()
    ch = upd.unionByName(new).select(
        "context_id", "name", F.concat(F.lit("Docs in "), "lang").alias("description"),
        dflt.select("prompt_template").scalar().alias("prompt_template"),
        dflt.select("retrieval_settings").scalar().alias("retrieval_settings"),
        F.lit(None).cast(TD.S.CHAT_COMPLETION_SETTINGS).alias("chat_completion_settings"),
        F.lit("mistral-large-latest").alias("chat_model"), F.lit("mistral-embed").alias("embeddings_model"),
        F.col("lang").alias("change_seq"))
    return _ctx_flat(M.upsert_contexts(TD.contexts(spark, sf), ch, _now()))


@register("upsert_documents", TD.sql_with("docs") + f""",
changes AS (
  SELECT l.doc_id AS document_id, 'quality ' || CAST(l.quality AS VARCHAR) AS description,
         CASE WHEN l.toxic = 1 THEN 'flagged' ELSE 'PDF' END AS type, d.source AS context_id,
         'doc-' || CAST(l.doc_id AS VARCHAR) AS name
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
  UNION ALL
  SELECT l.doc_id + (SELECT max(doc_id) + 1 FROM documents), 'new', 'PDF', 'new', 'doc-new-' || CAST(l.doc_id AS VARCHAR) FROM labels l)
SELECT COALESCE(c.document_id, n.document_id) AS document_id,
       CASE WHEN c.document_id IS NOT NULL THEN c.context_id ELSE n.context_id END AS context_id,
       CASE WHEN c.document_id IS NOT NULL THEN c.name ELSE n.name END AS name,
       CASE WHEN n.document_id IS NOT NULL THEN n.description ELSE c.description END AS description,
       CASE WHEN n.document_id IS NOT NULL THEN n.type ELSE c.type END AS type,
       CASE WHEN c.document_id IS NOT NULL THEN CAST(c.updated_at AS VARCHAR) ELSE CAST({NOW_SQL} AS VARCHAR) END AS updated_at
FROM docs c FULL OUTER JOIN changes n ON c.document_id = n.document_id""")
def q_upsert_documents(spark, sf):
    lab = TD.read(spark, sf, "labels")
    d = TD.read(spark, sf, "documents").select("doc_id", "source")
    upd = lab.join(d, "doc_id").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("context_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"),
        F.when(F.col("toxic") == 1, F.lit("flagged")).otherwise(F.lit("PDF")).alias("type"),
        F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    top = d.agg(F.max("doc_id").alias("m")).scalar()
    new = lab.select((F.col("doc_id") + top + 1).alias("document_id"), F.lit("new").alias("context_id"),
                     F.concat(F.lit("doc-new-"), F.col("doc_id").cast("string")).alias("name"),
                     F.lit("new").alias("description"), F.lit("PDF").alias("type"),
                     F.create_map().cast("map<string,string>").alias("metadata"))
    out = M.upsert_documents(TD.documents_table(spark, sf), upd.unionByName(new), _now(), seq_col=None)
    return out.select("document_id", "context_id", "name", "description", "type",
                      F.col("updated_at").cast("string").alias("updated_at"))


@register("append_embeddings", TD.sql_with("labelled_chunks") + """
SELECT id, context_id, document_id, fragment_index, chunk_index FROM labelled_chunks
UNION ALL
SELECT (SELECT max(id) FROM labelled_chunks) + row_number() OVER (ORDER BY document_id, fragment_index, chunk_index),
       context_id, document_id, fragment_index, chunk_index FROM line_chunks""")
def q_append_embeddings(spark, sf):
    cur = V.embed_chunks(TD.labelled_chunks(spark, sf), dim=64)
    new = V.embed_chunks(TD.line_chunks(spark, sf).drop("id"), dim=64)
    out, _rej = M.append_embeddings(cur, new, expected_dim=64)
    return out.select("id", "context_id", "document_id", "fragment_index", "chunk_index")


_TOXIC_KEYS_SQL = ("SELECT d.source AS context_id, d.doc_id AS document_id FROM labels l "
                   "JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 1")


def _keys(spark, sf, cond):
    lab = TD.read(spark, sf, "labels").where(cond)
    d = TD.read(spark, sf, "documents").select("doc_id", "source")
    return lab.join(d, "doc_id").select(F.col("source").alias("context_id"), F.col("doc_id").alias("document_id"))


@register("delete_embeddings", TD.sql_with("line_chunks") + f"""
SELECT id, context_id, document_id, fragment_index FROM line_chunks
WHERE (context_id, document_id) NOT IN ({_TOXIC_KEYS_SQL})""")
def q_delete_embeddings(spark, sf):
    out = M.delete_embeddings(TD.line_chunks(spark, sf), _keys(spark, sf, F.col("toxic") == 1))
    return out.select("id", "context_id", "document_id", "fragment_index")


@register("purge_documents", TD.sql_with("docs", "line_chunks") + """,
k AS (SELECT d.source AS context_id, d.doc_id AS document_id FROM labels l
      JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0),
e AS (SELECT * FROM line_chunks lc WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.context_id = lc.context_id AND k.document_id = lc.document_id)),
dd AS (SELECT * FROM docs WHERE document_id NOT IN (SELECT document_id FROM k))
SELECT dd.document_id, dd.context_id, COALESCE(n.n_embeddings, 0) AS n_embeddings
FROM dd LEFT JOIN (SELECT document_id, count(*) AS n_embeddings FROM e GROUP BY document_id) n USING (document_id)""")
def q_purge_documents(spark, sf):
    docs, emb = M.purge_documents(TD.documents_table(spark, sf), TD.line_chunks(spark, sf),
                                  _keys(spark, sf, F.col("quality") == 0))
    n = emb.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_embeddings"))
    return (docs.join(n, "document_id", "left")
            .select("document_id", "context_id", F.coalesce("n_embeddings", F.lit(0)).cast("long").alias("n_embeddings")))


@register("purge_contexts", TD.sql_with("ctx", "docs", "line_chunks") + """,
ids AS (SELECT DISTINCT d.source AS context_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id
        WHERE l.toxic = 1 AND l.quality = 0),
c2 AS (SELECT * FROM ctx WHERE context_id NOT IN (SELECT context_id FROM ids)),
d2 AS (SELECT * FROM docs WHERE context_id NOT IN (SELECT context_id FROM ids)),
e2 AS (SELECT * FROM line_chunks WHERE context_id NOT IN (SELECT context_id FROM ids))
SELECT c2.context_id,
       (SELECT count(*) FROM d2 WHERE d2.context_id = c2.context_id) AS n_documents,
       (SELECT count(*) FROM e2 WHERE e2.context_id = c2.context_id) AS n_embeddings
FROM c2""")
def q_purge_contexts(spark, sf):
    ids = _keys(spark, sf, (F.col("toxic") == 1) & (F.col("quality") == 0)).select("context_id")
    ctx, docs, emb = M.purge_contexts(TD.contexts(spark, sf), TD.documents_table(spark, sf),
                                      TD.line_chunks(spark, sf), ids)
    nd = docs.groupBy("context_id").agg(F.count(F.lit(1)).alias("n_documents"))
    ne = emb.groupBy("context_id").agg(F.count(F.lit(1)).alias("n_embeddings"))
    return (ctx.select("context_id").join(nd, "context_id", "left").join(ne, "context_id", "left")
            .select("context_id", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
                    F.coalesce("n_embeddings", F.lit(0)).cast("long").alias("n_embeddings")))


@register("scan_documents", """
SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS digest FROM pages""")
def q_scan_documents(spark, sf):
    """Pages written out as text files, one JSON line each, and read back as files."""
    path = f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}"
    TD.read(spark, sf, "pages").select(F.to_json(F.struct("page_id", "html")).alias("value")).write.text(path)
    lines = TB.scan_documents(spark, path, glob="part-*").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    page = F.from_json("line", "page_id long, html string")
    return lines.where("line <> ''").select(page.alias("p")).select(
        "p.page_id", F.length("p.html").cast("long").alias("n_chars"), F.md5("p.html").alias("digest"))


@register("default_context", TD.sql_with("ctx") + """
SELECT context_id, name,
       context_id = (SELECT context_id FROM ctx ORDER BY updated_at, context_id LIMIT 1) AS is_default
FROM ctx""")
def q_default_context(spark, sf):
    return TB.default_context(TD.contexts(spark, sf)).select("context_id", "name", "is_default")


def _fmt_sql(x: str) -> str:
    i = f"floor(ln({x}) / ln(1024))"
    units = "[" + ", ".join(f"'{u}'" for u in K.FILE_SIZE_UNITS) + "]"
    return (f"CASE WHEN {x} = 0 THEN '0 Bytes' ELSE "
            f"regexp_replace(CAST(round({x} / pow(1024, {i}), 2) AS VARCHAR), '\\.0$', '') || ' ' || "
            f"COALESCE({units}[CAST({i} AS INTEGER) + 1], 'undefined') END")


_ALLOWED_SQL = "[" + ", ".join(f"'{m}'" for m in K.ALLOWED_MIME_TYPES) + "]"
_UPLOADS_SQL = """
uploads AS (
  SELECT doc_id AS file_id,
         ['application/pdf', 'text/plain', 'text/html', 'image/png', ''][CAST(doc_id % 5 AS INTEGER) + 1] AS mime,
         n_chars * 50000 AS size
  FROM documents)"""


@register("admit_uploads", "WITH " + _UPLOADS_SQL.strip() + f"""
SELECT file_id, mime, size,
       list_contains({_ALLOWED_SQL}, mime) AND NOT (size > {K.MAX_UPLOAD_BYTES}) AS valid,
       CASE WHEN NOT list_contains({_ALLOWED_SQL}, mime) THEN 'File type ' || mime || ' is not allowed.'
            WHEN size > {K.MAX_UPLOAD_BYTES} THEN 'File size ' || {_fmt_sql('size')} || ' exceeds maximum size of ' || {_fmt_sql(str(K.MAX_UPLOAD_BYTES))}
       END AS error
FROM uploads""")
def q_admit_uploads(spark, sf):
    return TB.admit_uploads(TD.uploads(spark, sf)).select("file_id", "mime", "size", "valid", "error")


# --------------------------------------------------------------------------
# Ingestion (B)
# --------------------------------------------------------------------------



def _html_sql(x: str) -> str:
    """The HTML parser on this data's entities, '&amp;' last so that nothing is decoded twice."""
    s = x
    for tag in ["script", "style", "head"]:
        s = f"regexp_replace({s}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "\u00a9"), ("middot", "\u00b7"), ("amp", "&")]:
        s = f"regexp_replace({s}, '&{name};?', '{char}', 'g')"
    return f"regexp_replace(regexp_replace({s}, '[ \\t\\r\\f\\v]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


_EXTRA_PAGES = [(-1, "application/pdf", "no magic"), (-2, "text/html", None), (-3, None, "plain <text>"), (-4, "application/json", '{"a": 1}')]


@register("parse_documents", f"""
SELECT page_id, {_html_sql('html')} AS text, CAST(NULL AS VARCHAR) AS parse_error FROM pages
UNION ALL SELECT * FROM (VALUES (-1, NULL, 'no parser for application/pdf'), (-2, NULL, 'no content'), (-3, 'plain <text>', NULL),
  (-4, '{{"a": 1}}', NULL)) t(page_id, text, parse_error)""")
def q_parse_documents(spark, sf):
    """All pages as raw bytes, half typed as HTML and half of unknown type (detected), and
    four files added by hand: without a parser, without content, plain text, JSON."""
    p = TD.read(spark, sf, "pages")
    files = p.select("page_id", F.encode("html", "UTF-8").alias("content"), F.when(F.col("page_id") % 2 == 0, "text/html").alias("mime"))
    extra = spark.createDataFrame(_EXTRA_PAGES, "page_id long, mime string, content string").select(
        "page_id", F.encode("content", "UTF-8").alias("content"), "mime")
    return IG.parse_documents(files.unionByName(extra)).select("page_id", "text", "parse_error")


_TYPED_FILES = [("a.png", "text/plain", "89504E470D0A1A0A"), ("b.pdf", "application/pdf", "255044462D312E37"), ("c.json", "application/json", "7B20"),
                ("d.json", "application/json", "7B7D"), ("e.pdf", "application/pdf", "74657874"), ("f.zip", "application/epub+zip", "504B030400"), ("g", "", "FF00")]


@register("detect_types", """
SELECT 'page-' || CAST(page_id AS VARCHAR) AS name, 'text/html' AS detected, CAST(NULL AS VARCHAR) AS type_error FROM pages
UNION ALL SELECT 'doc-' || CAST(doc_id AS VARCHAR), 'text/plain', NULL FROM documents
UNION ALL SELECT 'doc-as-pdf-' || CAST(doc_id AS VARCHAR), 'text/plain', 'content is text/plain, not application/pdf' FROM documents
UNION ALL SELECT * FROM (VALUES ('a.png', 'image/png', 'content is image/png, not text/plain'), ('b.pdf', 'application/pdf', NULL),
  ('c.json', 'text/plain', 'content is text/plain, not application/json'), ('d.json', 'application/json', NULL),
  ('e.pdf', 'text/plain', 'content is text/plain, not application/pdf'), ('f.zip', 'application/zip', 'content is application/zip, not application/epub+zip'),
  ('g', 'application/octet-stream', NULL)) t(name, detected, type_error)""")
def q_detect_types(spark, sf):
    """Types by content: every page, every document as text and once more declared as PDF,
    and files added by hand."""
    p = TD.read(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"),
                                           F.lit("text/html").alias("mime"), F.encode("html", "UTF-8").alias("content"))
    d = TD.read(spark, sf, "documents")
    as_text, as_pdf = (d.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("name"), F.lit(mime).alias("mime"),
                                F.encode("text", "UTF-8").alias("content")) for prefix, mime in (("doc-", "text/plain"), ("doc-as-pdf-", "application/pdf")))
    extra = spark.createDataFrame(_TYPED_FILES, "name string, mime string, content string").withColumn("content", F.unhex("content"))
    return FY.check_types(p.unionByName(as_text).unionByName(as_pdf).unionByName(extra)).select("name", "detected", "type_error")


@register("chunk_documents", "WITH RECURSIVE " + TD.chunks_sql("documents", 512).strip() + """
SELECT doc_id AS document_id, fragment_index, length(value) AS n_chars, md5(value) AS digest FROM chunks""")
def q_chunk_documents(spark, sf):
    """Every piece of every document, with the splitter's own overlap."""
    d = TD.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"),
                                                F.col("source").alias("context_id"), "text")
    out = IG.chunk_documents(d, 512)
    return out.select("document_id", "fragment_index", F.length("value").cast("long").alias("n_chars"), F.md5("value").alias("digest"))


def _document_digest(fragments: DataFrame) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct("fragment_index", "value")))
    return fragments.groupBy("document_id").agg(
        F.md5(F.array_join(F.transform(pieces, lambda x: x["value"]), "\n")).alias("digest"), F.count(F.lit(1)).alias("n"))


_WORDS_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM documents),
toks AS (SELECT doc_id, unnest(generate_series(1, len(ts))) AS i, unnest(ts) AS tok FROM t),
words AS (SELECT doc_id, i, tok, lag(tok) OVER (PARTITION BY doc_id ORDER BY i) AS before,
                 lower(regexp_extract(tok, '^[^\p{L}\p{N}]*(\p{L}(?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?)', 1)) AS word FROM toks),
wc AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE regexp_matches(tok, '[\p{L}\p{N}]\.$')) AS n_period FROM words WHERE word <> '' GROUP BY word),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n_period) AS DOUBLE) / sum(n) AS rate FROM wc),
abbr AS (SELECT * FROM (
  SELECT word, wc.n, n_period, round(2 * (n_period * ln(0.99) + (wc.n - n_period) * ln(1 - 0.99) - n_period * ln(rate) - (wc.n - n_period) * ln(1 - rate))
         * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1)
         * pow(CAST(length(replace(word, '.', '')) AS DOUBLE), n_period - wc.n), 9) AS score
  FROM wc, tot WHERE wc.n >= 5 AND n_period > 0) WHERE score >= 0.3)"""


@register("sentence_abbreviations", _WORDS_SQL + "\nSELECT word, n, n_period, round(score, 6) AS score FROM abbr")
def q_sentence_abbreviations(spark, sf):
    """The abbreviations of the corpus by their collocation with a period."""
    return SE.abbreviations(TD.read(spark, sf, "documents")).select("word", "n", F.col("n_period").cast("long").alias("n_period"), F.round("score", 6).alias("score"))


@register("sentence_starters", _WORDS_SQL + r""",
flag AS (SELECT w.word, coalesce(regexp_matches(before, '[.!?]$'), false) AND regexp_matches(tok, '^[^\p{L}\p{N}]*\p{Lu}')
                AND NOT (coalesce(regexp_matches(before, '[\p{L}\p{N}]\.$'), false) AND a.word IS NOT NULL) AS stop
         FROM words w LEFT JOIN abbr a ON a.word = lower(regexp_extract(w.before, '^[^\p{L}\p{N}]*(\p{L}(?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?)', 1)) WHERE w.word <> ''),
sc AS (SELECT word, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE stop) AS DOUBLE) AS s FROM flag GROUP BY word),
st AS (SELECT sum(n) AS tn, sum(s) AS ts FROM sc)
SELECT word, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS n_start FROM (
  SELECT word, n, s, 2 * (CASE WHEN s > 0 THEN s * ln(s * tn / (n * ts)) ELSE 0 END + CASE WHEN n - s > 0 THEN (n - s) * ln((n - s) * tn / (n * (tn - ts))) ELSE 0 END
    + CASE WHEN ts - s > 0 THEN (ts - s) * ln((ts - s) * tn / ((tn - n) * ts)) ELSE 0 END
    + CASE WHEN tn - n - ts + s > 0 THEN (tn - n - ts + s) * ln((tn - n - ts + s) * tn / ((tn - n) * (tn - ts))) ELSE 0 END) AS score, tn, ts
  FROM sc, st WHERE n >= 5) WHERE s * tn > n * ts AND round(score, 6) >= 30""")
def q_sentence_starters(spark, sf):
    """The words that start sentences more often than chance."""
    d = TD.read(spark, sf, "documents")
    tokens = SE.token_counts(d)
    return SE.starters(d, SE.abbreviations(d, tokens=tokens), tokens=tokens).select("word", "n", F.col("n_start").cast("long").alias("n_start"))


@register("index_fragments", TD.sql_with("line_chunks") + """
SELECT context_id, document_id, fragment_index, chunk_index, value FROM line_chunks""")
def q_index_fragments(spark, sf):
    d = TD.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"),
                                                F.col("source").alias("context_id"),
                                                F.split("text", "\n").alias("pieces"))
    return IG.index_fragments(d).select("context_id", "document_id", "fragment_index", "chunk_index", "value")


@register("embedding_input", TD.sql_with("line_chunks") + """
SELECT lc.id, 'lang: ' || d.lang || chr(10) || 'source: ' || d.source || chr(10) || lc.value AS embedding_input
FROM line_chunks lc JOIN documents d ON d.doc_id = lc.document_id""")
def q_embedding_input(spark, sf):
    lc = TD.line_chunks(spark, sf).drop("metadata")
    d = TD.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    rows = lc.join(d, "document_id").withColumn(
        "metadata", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")))
    return IG.embedding_inputs(rows).select("id", "embedding_input")


@register("embed_chunks", TD.sql_with("line_chunks") + ",\n" + TD._vectors_sql("made", "line_chunks", "id", "value", f"""
  SELECT id, CAST(len(embedding) AS INTEGER) AS dim, {_DIGEST_SQL} FROM made_vec""").strip() + " SELECT * FROM made")
def q_embed_chunks(spark, sf):
    out = V.embed_chunks(TD.line_chunks(spark, sf), dim=64)
    return out.select("id", F.size("embedding").alias("dim"), _digest())


@register("embed_fitted", TD.sql_with("line_chunks") + r"""
SELECT id, CAST(64 AS INTEGER) AS dim, regexp_matches(lower(value), '[\p{L}\p{N}]') AS has_direction FROM line_chunks""")
def q_embed_fitted(spark, sf):
    """Vectors of all fragments by an embedder that was fitted to them."""
    chunks = TD.line_chunks(spark, sf)
    model = LS.fit(chunks, dim=64)
    out = V.embed_texts(chunks.select("id", "value"), "value", model.embedder())
    return out.select("id", F.size("embedding").alias("dim"), F.exists("embedding", lambda x: x != 0).alias("has_direction"))


def _uploaded(spark, sf, claimed: bool = False):
    """The whole upload path: all files, checked, read by their MIME type, into tables that
    hold the labelled documents already. With ``claimed`` every document is sent once more
    under another type."""
    labelled = TD.read(spark, sf, "labels").select(F.col("doc_id").alias("document_id")).distinct()
    have = TD.documents_table(spark, sf).join(labelled, "document_id", "left_semi")
    emb = V.embed_chunks(TD.labelled_chunks(spark, sf), dim=64)
    files = TD.upload_files(spark, sf)
    files = files.unionByName(TD.claimed_files(spark, sf)) if claimed else files
    sent = TB.admit_uploads(files).where("valid").select(
        F.col("file_id").alias("document_id"), "context_id", F.concat(F.lit("doc-"), F.col("file_id").cast("string")).alias("name"), "content", "mime")
    return IG.ingest(IG.ingest_if_absent(sent, emb), have, emb, max_chars=512, dim=64, now=_now())


_UPLOADED_SQL = f"""
WITH RECURSIVE extra(doc_id, mime, size, text) AS (VALUES {", ".join(f"({i}, '{m}', {n}, " + ("NULL" if t is None else f"'{t}'") + ")" for i, m, n, t in TD.EXTRA_FILES)}),
files AS (SELECT doc_id, source AS context_id, 'text/plain' AS mime, octet_length(encode(text)) AS size, text FROM documents
          UNION ALL SELECT doc_id, 'extra', mime, size, text FROM extra),
held AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
sent AS (SELECT * FROM files WHERE list_contains({_ALLOWED_SQL}, mime) AND NOT (size > {K.MAX_UPLOAD_BYTES})
           AND doc_id NOT IN (SELECT doc_id FROM held)),
new AS (SELECT doc_id, text FROM sent WHERE mime <> 'application/pdf' AND text IS NOT NULL)"""


@register("ingest", _UPLOADED_SQL + "," + TD.chunks_sql("new", 512) + """
SELECT doc_id AS document_id, md5(text) AS digest, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n, true AS in_documents, true AS ids_follow FROM held
UNION ALL
SELECT doc_id, md5(string_agg(value, chr(10) ORDER BY fragment_index)), count(value), true, true FROM new LEFT JOIN chunks USING (doc_id) GROUP BY doc_id""")
def q_ingest(spark, sf):
    """Both tables after the upload of every document, per document: digest of its fragments
    in order, their number, a document row, and new ids that follow the largest old one."""
    docs, emb, _rej = _uploaded(spark, sf)
    labelled = TD.read(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.lit(True).alias("old")).distinct()
    top = TD.labelled_chunks(spark, sf).agg(F.max("id").alias("m")).scalar()
    ids = emb.groupBy("document_id").agg(F.min("id").alias("first"), F.max("id").alias("last")).join(labelled, "document_id", "left")
    follow = F.when(F.col("old"), F.col("last") <= top).otherwise(F.col("first") > top)
    out = _document_digest(emb).join(docs.select("document_id", F.lit(True).alias("in_documents")), "document_id", "full")
    return out.join(ids.select("document_id", follow.alias("ids_follow")), "document_id", "left").select(
        "document_id", "digest", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("in_documents", F.lit(False)).alias("in_documents"),
        F.coalesce("ids_follow", F.lit(True)).alias("ids_follow"))


_CLAIMED_SQL = _UPLOADED_SQL.replace("UNION ALL SELECT doc_id, 'extra'", """UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents), source,
            ['application/pdf', 'text/plain', 'text/html', 'image/png', ''][CAST(doc_id % 5 AS INTEGER) + 1], octet_length(encode(text)), text FROM documents
          UNION ALL SELECT doc_id, 'extra'""")


@register("ingest_rejects", _CLAIMED_SQL + """
SELECT doc_id AS document_id, context_id, CASE WHEN text IS NULL THEN 'no content' ELSE 'no parser for ' || mime END AS error
FROM sent WHERE mime = 'application/pdf' OR text IS NULL""")
def q_ingest_rejects(spark, sf):
    """Uploads that were admitted and could not be parsed: of all documents under their own
    type and under that of ``uploads``, and of the files added by hand."""
    return _uploaded(spark, sf, claimed=True)[2].select("document_id", "context_id", "error")


_SENT_SQL = _UPLOADED_SQL.replace("AND doc_id NOT IN (SELECT doc_id FROM held)", "")


@register("ingest_stream", _SENT_SQL + "," + TD.chunks_sql("new", 512) + """
SELECT doc_id AS document_id, 'doc-' || CAST(doc_id AS VARCHAR) AS name, md5(string_agg(value, chr(10) ORDER BY fragment_index)) AS digest,
       count(value) AS n, (SELECT count(*) FROM chunks) AS n_ids
FROM new LEFT JOIN chunks USING (doc_id) GROUP BY doc_id""")
def q_ingest_stream(spark, sf):
    """Every document as a file that arrives in a stream of several micro-batches: both tables
    afterwards, per document, and the number of distinct ids (1 to n_ids)."""
    base = f"{ensure_checkpoint_dir(spark)}/arriving-{uuid.uuid4().hex}"
    sent = TB.admit_uploads(TD.upload_files(spark, sf)).where("valid").select(
        F.col("file_id").alias("document_id"), "context_id", F.concat(F.lit("doc-"), F.col("file_id").cast("string")).alias("name"), "content", "mime")
    sent.repartition(4, "document_id").write.parquet(f"{base}/files")
    files = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/files")
    store = SI.Store(spark, f"{base}/tables")
    SI.ingest_stream(files, store, f"{base}/progress", now=_now()).awaitTermination()
    emb = store.embeddings()
    ids = emb.agg(F.when(F.min("id") >= 1, F.countDistinct("id")).alias("n")).where(F.col("n") == F.lit(store.manifest()["max_id"]))
    return store.documents().select("document_id", "name").join(_document_digest(emb), "document_id", "left").select(
        "document_id", "name", "digest", F.coalesce("n", F.lit(0)).alias("n"), ids.select("n").scalar().alias("n_ids"))


@register("ingest_if_absent", TD.sql_with("docs", "labelled_chunks") + """
SELECT document_id, context_id FROM docs d
WHERE NOT EXISTS (SELECT 1 FROM labelled_chunks c WHERE c.context_id = d.context_id AND c.document_id = d.document_id)""")
def q_ingest_if_absent(spark, sf):
    out = IG.ingest_if_absent(TD.documents_table(spark, sf), TD.labelled_chunks(spark, sf))
    return out.select("document_id", "context_id")


# --------------------------------------------------------------------------
# Prompt and chat (D)
# --------------------------------------------------------------------------



def _context_text(spark, sf):
    return PR.assemble_context(_stages(spark, sf)["retrieved"], TD.queries(spark, sf).select("query_id", "context_id", "query"))


_CTX_TEXT_SQL = """,
ctx_text AS (
  SELECT q.query_id, q.context_id, q.query, COALESCE(a.context_text, '') AS context_text
  FROM queries q LEFT JOIN (
    SELECT query_id, string_agg(chr(10) || value, chr(10) ORDER BY document_id, fragment_index, chunk_index) AS context_text
    FROM retrieved GROUP BY query_id) a USING (query_id)),
rendered AS (
  SELECT t.query_id, c.n,
         c.task_context || chr(10) || COALESCE(c.tone_context, '') || chr(10) || COALESCE(c.task_description, '') AS system,
         COALESCE(replace(c.query_context_template, '{{context}}', t.context_text), '') || chr(10) ||
         COALESCE(replace(c.query_template, '{{query}}', t.query), '') || chr(10) ||
         COALESCE(c.precognition, '') || chr(10) || COALESCE(c.output_formatting, '') AS "user",
         c.prefill AS assistant
  FROM ctx_text t JOIN ctx c USING (context_id))"""


@register("assemble_context", retrieval_with() + _CTX_TEXT_SQL + "\nSELECT query_id, context_text FROM ctx_text")
def q_assemble_context(spark, sf):
    return _context_text(spark, sf).select("query_id", "context_text")


def _rendered(spark, sf):
    t = _context_text(spark, sf)
    c = TD.contexts(spark, sf).select("context_id", "prompt_template")
    return PR.render_prompt(t.join(c, "context_id"))


@register("render_prompt", retrieval_with() + _CTX_TEXT_SQL + '\nSELECT query_id, system, "user", assistant FROM rendered')
def q_render_prompt(spark, sf):
    r = _rendered(spark, sf)
    return r.select("query_id", "rendered.system", "rendered.user", "rendered.assistant")


@register("build_messages", retrieval_with() + _CTX_TEXT_SQL + """
SELECT query_id, CAST(0 AS BIGINT) AS pos, 'system' AS role, system AS content FROM rendered
UNION ALL SELECT query_id, 1, 'user', 'Hi' FROM rendered WHERE n % 2 = 1
UNION ALL SELECT query_id, 2, 'assistant', 'Hello!' FROM rendered WHERE n % 2 = 1
UNION ALL SELECT query_id, CASE WHEN n % 2 = 1 THEN 3 ELSE 1 END, 'user', "user" FROM rendered
UNION ALL SELECT query_id, 4, 'assistant', assistant FROM rendered WHERE assistant IS NOT NULL""")
def q_build_messages(spark, sf):
    return PR.build_messages(_rendered(spark, sf))


@register("complete_chat", retrieval_with() + _CTX_TEXT_SQL + r"""
SELECT query_id, CASE WHEN t = '' THEN 'I don''t know.' ELSE t END AS answer
FROM (SELECT query_id, trim(regexp_replace(regexp_extract("user", '(?s)<context>\s*(.*?)\s*</context>', 1), '\s+', ' ', 'g')) AS t FROM rendered)""")
def q_complete_chat(spark, sf):
    return CH.complete_chat(PR.build_messages(_rendered(spark, sf)))


@register("response_events", retrieval_with() + r""",
ans AS (SELECT query_id, regexp_extract_all(query, '(\s*\S+)', 1) AS parts FROM queries),
frag AS (SELECT query_id, document_id, count(*) AS n, list({'fragment_index': fragment_index, 'chunk_index': chunk_index, 'value': value} ORDER BY fragment_index, chunk_index) AS fragments
         FROM retrieved GROUP BY query_id, document_id),
cnt AS (SELECT query_id, sum(n) AS n, CAST(to_json(list({'document_id': document_id, 'fragments': fragments} ORDER BY document_id)) AS VARCHAR) AS grouped
        FROM frag GROUP BY query_id)
SELECT a.query_id, CAST(0 AS BIGINT) AS seq, 'Retrieval' AS type, COALESCE(c.grouped, '[]') AS content,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n_fragments
FROM ans a LEFT JOIN cnt c USING (query_id)
UNION ALL SELECT query_id, CAST(generate_subscripts(parts, 1) AS BIGINT), 'Partial', unnest(parts), NULL FROM ans
UNION ALL SELECT query_id, CAST(len(parts) + 1 AS BIGINT), 'Finished', NULL, NULL FROM ans""")
def q_response_events(spark, sf):
    ans = TD.queries(spark, sf).select("query_id", F.col("query").alias("answer"))
    return CH.response_events(ans, _stages(spark, sf)["retrieved"])


@register("answer_stream", retrieval_with() + _CTX_TEXT_SQL + r""",
ans AS (SELECT query_id, regexp_extract_all(CASE WHEN t = '' THEN 'I don''t know.' ELSE t END, '(\s*\S+)', 1) AS parts
  FROM (SELECT query_id, trim(regexp_replace(regexp_extract("user", '(?s)<context>\s*(.*?)\s*</context>', 1), '\s+', ' ', 'g')) AS t FROM rendered)),
frag AS (SELECT query_id, count(*) AS n FROM retrieved GROUP BY query_id)
SELECT a.query_id, CAST(0 AS BIGINT) AS seq, 'Retrieval' AS type, CAST(NULL AS VARCHAR) AS part, CAST(COALESCE(f.n, 0) AS BIGINT) AS n_fragments
FROM ans a LEFT JOIN frag f USING (query_id)
UNION ALL SELECT query_id, CAST(generate_subscripts(parts, 1) AS BIGINT), 'Partial', unnest(parts), NULL FROM ans
UNION ALL SELECT query_id, CAST(len(parts) + 1 AS BIGINT), 'Finished', NULL, NULL FROM ans""")
def q_answer_stream(spark, sf):
    """Every question as a stream of several micro-batches against the stored fragments and
    index: the events in the log afterwards."""
    base = f"{ensure_checkpoint_dir(spark)}/questions-{uuid.uuid4().hex}"
    q = TD.queries(spark, sf)
    q.repartition(3, "query_id").write.parquet(f"{base}/asked")
    asked = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/asked")
    log = SC.EventLog(spark, f"{base}/log")
    SC.answer_stream(asked, log, f"{base}/progress", _fragments(spark, sf), TD.contexts(spark, sf), _index(spark, sf)).awaitTermination()
    return log.table().select("query_id", "seq", "type", F.when(F.col("type") == K.EVENT_PARTIAL, F.col("content")).alias("part"), "n_fragments")


_SUBS_SQL = """,
subs AS (SELECT query_id, min(ts) AS start_ts FROM event_stream GROUP BY query_id),
subscribed AS (
  SELECT e.* FROM event_stream e JOIN subs s USING (query_id)
  WHERE e.ts >= s.start_ts AND e.ts < s.start_ts + INTERVAL 300 SECOND)"""


def _subscribed(spark, sf):
    ev = TD.event_stream(spark, sf)
    return CH.subscribe_responses(ev, CH.first_event_subscriptions(ev))


@register("subscribe_responses", TD.sql_with("event_stream") + _SUBS_SQL + """
SELECT query_id, seq, type, content, epoch_us(ts) AS ts_us FROM subscribed""")
def q_subscribe_responses(spark, sf):
    return _with_micros(_subscribed(spark, sf))


def _with_micros(s: DataFrame) -> DataFrame:
    # microseconds of the original wall-clock time (independent of the session zone)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return s.select("query_id", "seq", "type", "content",
                    F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz")).alias("ts_us"))


def _answers_sql(src: str, stop: str) -> str:
    return f""",
b AS (SELECT query_id, min(CASE WHEN {stop} THEN seq END) AS stop,
             max(CASE WHEN type = 'Finished' THEN 1 ELSE 0 END) AS fin FROM {src} GROUP BY query_id),
p AS (SELECT e.query_id, string_agg(COALESCE(e.content, ''), '' ORDER BY e.seq) AS answer
      FROM {src} e JOIN b USING (query_id)
      WHERE e.type = 'Partial' AND (b.stop IS NULL OR e.seq < b.stop) GROUP BY e.query_id),
answers AS (
  SELECT b.query_id, COALESCE(p.answer, '') AS answer,
         CASE WHEN b.fin = 1 THEN 'finished' ELSE 'timeout' END AS status
  FROM b LEFT JOIN p USING (query_id))"""


@register("assemble_answers", TD.sql_with("chat_events") + _answers_sql("chat_events", "type = 'Finished'")
          + "\nSELECT query_id, answer, status FROM answers")
def q_assemble_answers(spark, sf):
    return CH.assemble_answers(TD.chat_events(spark, sf))


@register("assemble_answers_leading", TD.sql_with("chat_events") + _answers_sql("chat_events", "type <> 'Partial'")
          + "\nSELECT query_id, answer, status FROM answers")
def q_assemble_answers_leading(spark, sf):
    return CH.assemble_answers(TD.chat_events(spark, sf), mode="leading")


@register("answers_in_window", TD.sql_with("event_stream") + _SUBS_SQL + _answers_sql("subscribed", "type = 'Finished'")
          + "\nSELECT query_id, answer, status FROM answers")
def q_answers_in_window(spark, sf):
    return CH.assemble_answers(_subscribed(spark, sf))


def _html_escape_sql(x: str) -> str:
    s = x
    for a, b in K.HTML_ESCAPES:
        a_sql = "chr(10)" if a == "\n" else "'" + a.replace("'", "''") + "'"
        s = f"replace({s}, {a_sql}, '{b.replace(chr(39), chr(39) * 2)}')"
    return s


@register("retrieval_report", retrieval_with() + f"""
SELECT q.query_id, r.document_id, r.fragment_index, r.chunk_index, r.matched_fragment_index, r.rrf_score,
       r.semantic_score, r.full_text_score, {_html_escape_sql('r.value')} AS chunk_html,
       CASE WHEN r.document_id IS NULL THEN '{K.NO_DOCUMENTS_RETRIEVED}' ELSE 'Document fragments:' END AS message
FROM queries q LEFT JOIN retrieved r USING (query_id)""")
def q_retrieval_report(spark, sf):
    return PR.retrieval_report(_stages(spark, sf)["retrieved"], TD.queries(spark, sf))


@register("escape_html", f"SELECT doc_id, {_html_escape_sql('text')} AS html FROM documents")
def q_escape_html(spark, sf):
    d = TD.read(spark, sf, "documents").select("doc_id", "text")
    return PR.escape_html(d, "text", "html").select("doc_id", "html")


# --------------------------------------------------------------------------
# Commands (E)
# --------------------------------------------------------------------------



def _raw_commands(spark, sf):
    s = TD.slash_texts(spark, sf)
    cid = F.col("command_id").cast("string")
    rows = s.select(
        "command_id", F.lit("A0APP").alias("api_app_id"), F.lit("T001").alias("team_id"),
        F.lit("example").alias("team_domain"), F.lit(None).cast("string").alias("enterprise_id"),
        F.lit(None).cast("string").alias("enterprise_name"), F.concat(F.lit("C"), cid).alias("channel_id"),
        F.lit("general").alias("channel_name"), F.concat(F.lit("U"), cid).alias("user_id"),
        F.lit("/ask").alias("command"), "text",
        F.concat(F.lit("https://hooks.example/"), cid).alias("response_url"),
        F.concat(F.lit("trig-"), cid).alias("trigger_id"), F.lit("false").alias("is_enterprise_install"))
    body = CM.encode_form(rows, K.COMMAND_FIELDS)
    # every third body repeats a field (the first value counts) and has an encoded name
    again = F.concat(F.regexp_replace("body", "user_id=", "user%5Fid="), F.lit("&text=again&channel_id=again"))
    return body.select("command_id", F.when(F.col("command_id") % 3 == 0, again).otherwise(F.col("body")).alias("body"))


def _commands(spark, sf):
    ok, _bad = CM.decode_commands(_raw_commands(spark, sf))
    return ok


def _routed(spark, sf):
    parsed = CM.parse_command(_commands(spark, sf))
    return CM.route_commands(CM.resolve_context(parsed, TD.contexts(spark, sf)))


_CMD_SQL = r""",
cmds AS (SELECT command_id, text FROM slash WHERE trim(text) <> ''),
parsed AS (
  SELECT command_id, text, t,
         CASE WHEN instr(t, ' ') > 0 THEN split_part(t, ' ', 1) ELSE t END AS context_name,
         CASE WHEN instr(t, ' ') > 0 THEN substr(t, instr(t, ' ') + 1) ELSE '' END AS user_query
  FROM (SELECT command_id, text,
               regexp_replace(regexp_replace(text, '^[\x00-\x20]+', ''), '[\x00-\x20]+\z', '') AS t FROM cmds)),
byname AS (
  SELECT name AS context_name, context_id, name AS context_label FROM ctx
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at, context_id) = 1),
resolved AS (SELECT p.*, b.context_id, b.context_label FROM parsed p LEFT JOIN byname b USING (context_name)),
routed AS (
  SELECT *,
         CASE WHEN t IS NULL THEN 'unparsed' WHEN context_id IS NULL THEN 'unknown_context' ELSE 'query' END AS route,
         CASE WHEN t IS NULL THEN 'I''m sorry, I didn''t understand that. Your query was `' || text || '`'
              WHEN context_id IS NULL THEN 'I''m sorry, I couldn''t find any context for ' || context_name || '. Your query was `' || text || '`'
              ELSE 'Querying the ' || context_label || ' context with `' || user_query || '` ...' END AS reply
  FROM resolved)"""

_MSGS_SQL = """,
msgs AS (
  SELECT command_id, 'https://hooks.example/' || command_id AS response_url, CAST(0 AS BIGINT) AS pos, 'plain' AS kind, reply AS text FROM routed
  UNION ALL
  SELECT r.command_id, 'https://hooks.example/' || r.command_id, 1, 'markdown', COALESCE(a.answer, '') FROM routed r
  LEFT JOIN answers a ON a.query_id = CASE WHEN r.command_id >= 0 THEN r.command_id // 100 END
  WHERE r.route = 'query')"""


@register("decode_commands", TD.sql_with("slash") + """
SELECT command_id, text, 'C' || CAST(command_id AS VARCHAR) AS channel_id, 'U' || CAST(command_id AS VARCHAR) AS user_id,
       false AS is_enterprise_install, CAST(NULL AS VARCHAR) AS enterprise_id
FROM slash WHERE trim(text) <> ''""")
def q_decode_commands(spark, sf):
    return _commands(spark, sf).select("command_id", "text", "channel_id", "user_id", "is_enterprise_install",
                                       "enterprise_id")


@register("decode_commands_rejects", TD.sql_with("slash") + """
SELECT command_id, 'missing or invalid: text' AS error FROM slash WHERE trim(text) = ''""")
def q_decode_commands_rejects(spark, sf):
    _ok, bad = CM.decode_commands(_raw_commands(spark, sf))
    return bad.select("command_id", "error")


@register("parse_command", TD.sql_with("slash", "ctx") + _CMD_SQL + "\nSELECT command_id, context_name, user_query FROM parsed")
def q_parse_command(spark, sf):
    return CM.parse_command(_commands(spark, sf)).select("command_id", "context_name", "user_query")


@register("resolve_context", TD.sql_with("slash", "ctx") + _CMD_SQL + "\nSELECT command_id, context_name, context_id FROM resolved")
def q_resolve_context(spark, sf):
    parsed = CM.parse_command(_commands(spark, sf))
    return CM.resolve_context(parsed, TD.contexts(spark, sf)).select("command_id", "context_name", "context_id")


@register("route_commands", TD.sql_with("slash", "ctx") + _CMD_SQL + "\nSELECT command_id, route, reply FROM routed")
def q_route_commands(spark, sf):
    return _routed(spark, sf).select("command_id", "route", "reply")


def _command_messages(spark, sf):
    routed = _routed(spark, sf).withColumn(
        "query_id", F.when(F.col("command_id") >= 0, F.expr("command_id div 100")))
    answers = CH.assemble_answers(TD.chat_events(spark, sf))
    return CM.answer_commands(routed, answers)


@register("answer_commands", TD.sql_with("slash", "ctx", "chat_events") + _CMD_SQL
          + _answers_sql("chat_events", "type = 'Finished'") + _MSGS_SQL
          + "\nSELECT command_id, response_url, pos, kind, text FROM msgs")
def q_answer_commands(spark, sf):
    return _command_messages(spark, sf)


@register("message_payload", TD.sql_with("slash", "ctx", "chat_events") + _CMD_SQL
          + _answers_sql("chat_events", "type = 'Finished'") + _MSGS_SQL + """
SELECT command_id, pos,
       CAST(json_object('text', text, 'blocks', json_array(json_object('type', 'section', 'text',
            CASE WHEN kind = 'plain' THEN json_object('type', 'plain_text', 'text', text, 'emoji', true)
                 ELSE json_object('type', 'mrkdwn', 'text', text) END))) AS VARCHAR) AS payload
FROM msgs""")
def q_message_payload(spark, sf):
    return CM.message_payload(_command_messages(spark, sf)).select("command_id", "pos", "payload")


# --------------------------------------------------------------------------
# Settings, models, evaluation (F, G)
# --------------------------------------------------------------------------



def _settings_rows(spark, sf):
    ok = CF.render_settings(TD.contexts(spark, sf)).select("context_id", F.col("retrieval_settings_json").alias("j"))
    variants = [
        ("ok", F.col("j")),
        ("bad_type", F.regexp_replace("j", r'"rrfLimit":[0-9]+', '"rrfLimit":"five"')),
        ("missing", F.regexp_replace("j", r',"fragmentLookupRange":\{[^}]*\}', "")),
        ("malformed", F.substring("j", 1, 20)),
    ]
    out = None
    for name, expr in variants:
        part = ok.select("context_id", F.lit(name).alias("variant"), expr.alias("settings_json"))
        out = part if out is None else out.unionByName(part)
    return out


_SETTINGS_JSON_SQL = f"""
'{{"fullTextSearchLimit":' || fts_limit || ',"semanticSearchLimit":' || sem_limit || ',"rrfLimit":' || rrf_limit ||
',"fragmentLookupRange":{{"lookBack":' || look_back || ',"lookAhead":' || look_ahead || '}}}}'"""


@register("render_settings", TD.sql_with("ctx") + f"\nSELECT context_id, {_SETTINGS_JSON_SQL} AS retrieval_settings_json FROM ctx")
def q_render_settings(spark, sf):
    return CF.render_settings(TD.contexts(spark, sf)).select("context_id", "retrieval_settings_json")


def _field_check(path: str, label: str) -> str:
    return (f"CASE WHEN json_extract(settings_json, '{path}') IS NULL THEN '{label}: missing' "
            f"WHEN json_type(settings_json, '{path}') NOT IN ('BIGINT', 'UBIGINT') THEN '{label}: expected an integer' END")


_SETTINGS_ROWS_SQL = TD.sql_with("ctx") + f""",
base AS (SELECT context_id, {_SETTINGS_JSON_SQL} AS j FROM ctx),
rows AS (
  SELECT context_id, 'ok' AS variant, j AS settings_json FROM base
  UNION ALL SELECT context_id, 'bad_type', regexp_replace(j, '"rrfLimit":[0-9]+', '"rrfLimit":"five"') FROM base
  UNION ALL SELECT context_id, 'missing', regexp_replace(j, ',"fragmentLookupRange":\\{{[^}}]*\\}}', '') FROM base
  UNION ALL SELECT context_id, 'malformed', substr(j, 1, 20) FROM base),
checked AS (
  SELECT context_id, variant, settings_json,
         CASE WHEN NOT json_valid(settings_json) THEN '$: malformed JSON'
              ELSE concat_ws(', ', {_field_check('$.fullTextSearchLimit', 'fullTextSearchLimit')},
                                   {_field_check('$.semanticSearchLimit', 'semanticSearchLimit')},
                                   {_field_check('$.rrfLimit', 'rrfLimit')},
                                   {_field_check('$.fragmentLookupRange.lookBack', 'fragmentLookupRange.lookBack')},
                                   {_field_check('$.fragmentLookupRange.lookAhead', 'fragmentLookupRange.lookAhead')}) END AS errors
  FROM rows)"""


@register("parse_settings", _SETTINGS_ROWS_SQL + """
SELECT context_id, variant, errors = '' AS valid, errors,
       CASE WHEN errors = '' THEN CAST(json_extract(settings_json, '$.rrfLimit') AS BIGINT) END AS rrf_limit
FROM checked""")
def q_parse_settings(spark, sf):
    ok, bad = CF.parse_settings(_settings_rows(spark, sf))
    a = ok.select("context_id", "variant", F.lit(True).alias("valid"), F.lit("").alias("errors"),
                  F.col("retrieval_settings.rrfLimit").cast("long").alias("rrf_limit"))
    b = bad.select("context_id", "variant", F.lit(False).alias("valid"), "errors",
                   F.lit(None).cast("long").alias("rrf_limit"))
    return a.unionByName(b)


def _forms(spark, sf):
    """Context forms with their three JSON columns: as rendered, and with one fault each."""
    ok = CF.render_settings(TD.contexts(spark, sf)).select(
        "context_id", *[f"{k}_json" for k in ("retrieval_settings", "prompt_template", "chat_completion_settings")])
    faults = {
        "ok": {}, "hot": {"chat_completion_settings_json": F.lit('{"temperature":"hot","n":2}')},
        "no_template": {"prompt_template_json": F.regexp_replace("prompt_template_json", r',"queryTemplate":"[^"]*"', "")},
        "two": {"prompt_template_json": F.lit('{"taskContext":'), "retrieval_settings_json": F.lit('{"rrfLimit":1}')},
    }
    out = None
    for name, new in faults.items():
        part = ok.select("context_id", F.lit(name).alias("variant"), *[new.get(c, F.col(c)).alias(c) for c in ok.columns[1:]])
        out = part if out is None else out.unionByName(part)
    return out


@register("parse_context_settings", TD.sql_with("ctx") + """
SELECT context_id, variant, errors, CASE WHEN errors = '' THEN rrf_limit END AS rrf_limit, CASE WHEN errors = '' THEN tone_context END AS tone
FROM (SELECT context_id, CAST(rrf_limit AS BIGINT) AS rrf_limit, tone_context, unnest(['ok', 'hot', 'no_template', 'two']) AS variant, unnest([
        '', 'chat_completion_settings.temperature: expected a number', 'prompt_template.queryTemplate: missing',
        'retrieval_settings.fullTextSearchLimit: missing, retrieval_settings.semanticSearchLimit: missing, ' ||
        'retrieval_settings.fragmentLookupRange.lookBack: missing, retrieval_settings.fragmentLookupRange.lookAhead: missing, ' ||
        'prompt_template: malformed JSON']) AS errors FROM ctx)""")
def q_parse_context_settings(spark, sf):
    ok, bad = CF.parse_context_settings(_forms(spark, sf))
    a = ok.select("context_id", "variant", F.lit("").alias("errors"), F.col("retrieval_settings.rrfLimit").cast("long").alias("rrf_limit"),
                  F.col("prompt_template.toneContext").alias("tone"))
    return a.unionByName(bad.select("context_id", "variant", "errors", F.lit(None).cast("long").alias("rrf_limit"), F.lit(None).cast("string").alias("tone")))


_MODELS_SQL = "(VALUES " + ", ".join(f"('{n}', {c})" for n, c in K.MODELS) + ") m(name, context_length)"


@register("resolve_models", TD.sql_with("ctx") + f""",
r AS (SELECT context_id AS row_id, chat_model, embeddings_model FROM ctx
      UNION ALL SELECT context_id || '-x', name || '-chat', embeddings_model FROM ctx)
SELECT r.row_id, r.chat_model,
       CAST(mc.context_length AS INTEGER) AS chat_model_context_length,
       CAST(me.context_length AS INTEGER) AS embeddings_model_context_length,
       CASE WHEN mc.name IS NULL THEN 'chat_model: unknown model ' || r.chat_model END AS error
FROM r LEFT JOIN {_MODELS_SQL.replace(' m(', ' mc(')} ON mc.name = r.chat_model
LEFT JOIN {_MODELS_SQL.replace(' m(', ' me(')} ON me.name = r.embeddings_model""")
def q_resolve_models(spark, sf):
    c = TD.contexts(spark, sf)
    r = c.select(F.col("context_id").alias("row_id"), "chat_model", "embeddings_model").unionByName(
        c.select(F.concat("context_id", F.lit("-x")).alias("row_id"),
                 F.concat("name", F.lit("-chat")).alias("chat_model"), "embeddings_model"))
    return CF.resolve_models(r).select("row_id", "chat_model", "chat_model_context_length",
                                       "embeddings_model_context_length", "error")


@register("format_file_size", "WITH " + _UPLOADS_SQL.strip() + f"""
SELECT u.file_id, {_fmt_sql('u.size')} AS size_text, {_fmt_sql('d.n_chars')} AS chars_text
FROM uploads u JOIN documents d ON d.doc_id = u.file_id""")
def q_format_file_size(spark, sf):
    u = TD.uploads(spark, sf)
    d = TD.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "n_chars")
    j = CF.format_file_size(CF.format_file_size(u.join(d, "file_id"), "size", "size_text"), "n_chars", "chars_text")
    return j.select("file_id", "size_text", "chars_text")


_EVAL_SQL = TD.sql_with("eval_cases") + r""",
toks AS (
  SELECT case_id,
         list_distinct(list_filter(regexp_extract_all(lower(actual_output), '[\p{L}\p{N}]+'), lambda t: length(t) <= 255)) AS a,
         list_distinct(list_filter(regexp_extract_all(lower(expected_output), '[\p{L}\p{N}]+'), lambda t: length(t) <= 255)) AS e
  FROM eval_cases),
ov AS (SELECT case_id, CAST(len(list_intersect(a, e)) AS DOUBLE) AS o, len(a) AS la, len(e) AS le FROM toks),
scored AS (
  SELECT case_id,
         round(CASE WHEN o > 0 AND la > 0 AND le > 0 THEN 2.0 * (o / la) * (o / le) / ((o / la) + (o / le)) ELSE 0.0 END, 9) AS score
  FROM ov)"""


@register("eval_correctness", _EVAL_SQL + f"\nSELECT case_id, score, score >= {K.EVAL_THRESHOLD} AS passed FROM scored")
def q_eval_correctness(spark, sf):
    return EV.eval_correctness(TD.eval_cases(spark, sf)).select("case_id", "score", "passed")


@register("eval_pass_rate", _EVAL_SQL + f"""
SELECT count(*) AS n_cases, CAST(sum(CASE WHEN score >= {K.EVAL_THRESHOLD} THEN 1 ELSE 0 END) AS BIGINT) AS n_passed,
       CAST(round(avg(CASE WHEN score >= {K.EVAL_THRESHOLD} THEN 1.0 ELSE 0.0 END), 9) AS DOUBLE) AS pass_rate
FROM scored""")
def q_eval_pass_rate(spark, sf):
    return EV.pass_rate(EV.eval_correctness(TD.eval_cases(spark, sf)))


# --------------------------------------------------------------------------
# Streaming
# --------------------------------------------------------------------------



@register("assemble_answers_stream", TD.sql_with("event_stream") + _SUBS_SQL + _answers_sql("subscribed", "type = 'Finished'") + """
SELECT query_id, answer, status FROM answers JOIN subs USING (query_id)
WHERE status = 'finished' OR start_ts + INTERVAL 300 SECOND <= (SELECT max(ts) - INTERVAL 60 SECOND FROM event_stream)
   OR EXISTS (SELECT 1 FROM event_stream e WHERE e.query_id = answers.query_id AND e.ts >= start_ts + INTERVAL 300 SECOND)""")
def q_assemble_answers_stream(spark, sf):
    return ST.run_to_table(ST.assemble_answers_stream(TD.event_file_stream(spark, sf)), "answers")


_ANSWERS_STREAM_SQL = ORACLES["assemble_answers_stream"]


@register("assemble_answers_by_bucket", _ANSWERS_STREAM_SQL)
def q_assemble_answers_by_bucket(spark, sf):
    """The answers with a state in small entries by query and bucket of sequence numbers."""
    return SA.run(SA.assemble_answers_by_bucket(TD.event_file_stream(spark, sf)), "answers")


@register("subscribe_streams", TD.sql_with("event_stream") + _SUBS_SQL + """
SELECT query_id, seq, type, content, epoch_us(ts) AS ts_us FROM subscribed""")
def q_subscribe_streams(spark, sf):
    """Events and subscriptions (at each query's first event) both arrive as streams."""
    path = f"{ensure_checkpoint_dir(spark)}/subscriptions-{uuid.uuid4().hex}"
    subs = CH.first_event_subscriptions(TD.event_stream(spark, sf))
    subs.write.parquet(path)
    arriving = spark.readStream.schema(subs.schema).parquet(path)
    return _with_micros(ST.run_to_table(SA.subscribe_streams(TD.event_file_stream(spark, sf), arriving), "subscribed"))


@register("subscribe_responses_stream", TD.sql_with("event_stream") + _SUBS_SQL + """
SELECT query_id, seq, type, content, epoch_us(ts) AS ts_us FROM subscribed""")
def q_subscribe_responses_stream(spark, sf):
    subs = CH.first_event_subscriptions(TD.event_stream(spark, sf))
    s = ST.subscribe_stream(TD.event_file_stream(spark, sf), subs)
    return _with_micros(ST.run_to_table(s.select("query_id", "seq", "type", "content", "ts"), "subscribed"))
