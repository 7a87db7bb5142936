"""DuckDB SQL equivalents of the retrieval operators (C1-C16), written as one
chain of CTEs over the derived views of ``sources.testdata``. Each registered
query selects from the CTE of its stage."""

from __future__ import annotations

from ragframe import constants as K
from ragframe.sources.testdata import SQL_VIEWS

_TOK = r"[\p{L}\p{N}]+"


def _fts_chain(corpus: str = "corpus", scope: str = "global") -> str:
    """BM25 stats + search over ``corpus`` for ``qs`` (queries with settings)."""
    return f"""
qs AS (
  SELECT q.query_id, q.context_id, q.query, q.embedding,
         COALESCE(c.fts_limit, {K.DEFAULT_FULL_TEXT_SEARCH_LIMIT}) AS fts_limit,
         COALESCE(c.sem_limit, {K.DEFAULT_SEMANTIC_SEARCH_LIMIT}) AS sem_limit,
         COALESCE(c.rrf_limit, {K.DEFAULT_RRF_LIMIT}) AS rrf_limit,
         COALESCE(c.look_back, {K.DEFAULT_LOOK_BACK}) AS look_back,
         COALESCE(c.look_ahead, {K.DEFAULT_LOOK_AHEAD}) AS look_ahead
  FROM queries q LEFT JOIN ctx c ON q.context_id = c.context_id),
ftoks AS (
  SELECT id, context_id, document_id, fragment_index,
         list_filter(regexp_extract_all(lower(value), '{_TOK}'), lambda t: length(t) <= {K.MAX_TOKEN_CHARS}) AS toks
  FROM {corpus}),
postings AS (
  SELECT id, context_id, document_id, fragment_index, len(toks) AS dl, token, count(*) AS tf
  FROM (SELECT id, context_id, document_id, fragment_index, toks, unnest(toks) AS token FROM ftoks)
  GROUP BY ALL),
doc_freq AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avgdl FROM ftoks),
qtoks AS (
  SELECT DISTINCT query_id, context_id AS q_context_id, fts_limit, token
  FROM (SELECT query_id, context_id, fts_limit,
               unnest(list_filter(regexp_extract_all(lower(query), '{_TOK}'), lambda t: length(t) <= {K.MAX_TOKEN_CHARS})) AS token
        FROM qs)),
qidf AS (
  SELECT qt.*, ln(1.0 + (t.n_docs - d.df + 0.5) / (d.df + 0.5)) AS idf
  FROM qtoks qt JOIN doc_freq d USING (token), totals t),
fts_scored AS (
  SELECT qi.query_id, qi.q_context_id, qi.fts_limit, p.id, p.context_id, p.document_id, p.fragment_index,
         round(sum(qi.idf * p.tf * {K.BM25_K1 + 1.0} / (p.tf + {K.BM25_K1} * ({1.0 - K.BM25_B} + {K.BM25_B} * p.dl / t.avgdl))), {K.TEXT_SCORE_DIGITS}) AS full_text_score
  FROM postings p JOIN qidf qi USING (token), totals t
  GROUP BY qi.query_id, qi.q_context_id, qi.fts_limit, p.id, p.context_id, p.document_id, p.fragment_index),
fts_top AS (
  SELECT * FROM fts_scored {"WHERE context_id = q_context_id" if scope == "context" else ""}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY full_text_score DESC, id) <= fts_limit),
fts_ctx AS (SELECT * FROM fts_top WHERE context_id = q_context_id),
fts_ranked AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY full_text_score DESC) AS full_text_rank FROM fts_ctx),
sem_scored AS (
  SELECT q.query_id, q.sem_limit, e.id, e.context_id, e.document_id, e.fragment_index,
         round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), {K.DISTANCE_DIGITS}) AS semantic_score
  FROM {corpus} e JOIN qs q ON e.context_id = q.context_id),
sem_top AS (
  SELECT * FROM sem_scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY semantic_score ASC NULLS LAST, id) <= sem_limit),
sem_ranked AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY semantic_score ASC NULLS LAST) AS semantic_rank FROM sem_top),
fused_all AS (
  SELECT COALESCE(s.query_id, f.query_id) AS query_id, COALESCE(s.id, f.id) AS id,
         COALESCE(s.context_id, f.context_id) AS context_id,
         COALESCE(s.document_id, f.document_id) AS document_id,
         COALESCE(s.fragment_index, f.fragment_index) AS matched_fragment_index,
         COALESCE(f.full_text_score, 0.0) AS full_text_score,
         COALESCE(s.semantic_score, 0.0) AS semantic_score,
         s.semantic_rank, f.full_text_rank,
         round(COALESCE(1.0 / ({K.RRF_K}.0 + s.semantic_rank), 0.0) + COALESCE(1.0 / ({K.RRF_K}.0 + f.full_text_rank), 0.0), {K.RRF_DIGITS}) AS rrf_score
  FROM sem_ranked s FULL OUTER JOIN fts_ranked f ON s.query_id = f.query_id AND s.id = f.id),
fused AS (
  SELECT fa.* FROM fused_all fa JOIN qs USING (query_id)
  QUALIFY row_number() OVER (PARTITION BY fa.query_id ORDER BY fa.rrf_score DESC, fa.id) <= qs.rrf_limit),
matches AS (
  SELECT * FROM fused
  QUALIFY row_number() OVER (PARTITION BY query_id, document_id, matched_fragment_index ORDER BY rrf_score ASC, id) = 1),
expanded AS (
  SELECT m.query_id, ae.context_id, ae.document_id, ae.fragment_index, ae.chunk_index, ae.id, ae.value,
         m.id AS match_id, m.matched_fragment_index, m.full_text_score, m.semantic_score, m.rrf_score,
         m.semantic_rank, m.full_text_rank
  FROM matches m JOIN qs USING (query_id)
  JOIN {corpus} ae ON ae.context_id = m.context_id AND ae.document_id = m.document_id
   AND ae.fragment_index BETWEEN m.matched_fragment_index - qs.look_back AND m.matched_fragment_index + qs.look_ahead),
retrieved AS (
  SELECT * EXCLUDE (match_id) FROM expanded
  QUALIFY row_number() OVER (PARTITION BY query_id, document_id, fragment_index
                             ORDER BY chunk_index, rrf_score DESC, matched_fragment_index, match_id, id) = 1)"""


def retrieval_with(corpus: str = "corpus", scope: str = "global") -> str:
    views = ["ctx", "line_chunks", "corpus", "queries"] + ([corpus] if corpus != "corpus" else [])
    return "WITH " + ",\n".join(SQL_VIEWS[v].strip() for v in views) + "," + _fts_chain(corpus, scope)


RETRIEVED_COLS = ("query_id, context_id, document_id, fragment_index, chunk_index, id, value, "
                  "matched_fragment_index, full_text_score, semantic_score, rrf_score, "
                  "semantic_rank, full_text_rank")
