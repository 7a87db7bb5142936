"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.llm import decontaminate as DC
from ragframe.llm import embdedup as ED
from ragframe.llm import html as HT
from ragframe.llm import langid as LI
from ragframe.llm import merkle as MK
from ragframe.llm import packing as PK
from ragframe.llm import paragraphs as PG
from ragframe.llm import periodic as PR
from ragframe.llm import pii as PI
from ragframe.llm import simhash as SH
from ragframe.llm import tokens as TK
from ragframe.llm import urlfilter as UF
from ragframe.llm import warc as WA
from ragframe.llm.common import prepare, table, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        query.__name__, query.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = query
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return query
    return deco


@register()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    found = LI.identify(docs.select("doc_id", "text"), LI.fit(known))
    return found.select("doc_id", LI.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@register()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values were."""
    key = spark.conf.get("spark.ragframe.pii.key", None) or "key of the registered query"
    return PI.pseudonymize(table(spark, sf_dir, "documents"), key=key).select("doc_id", "text", "n_replaced")


@register()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return SH.simhash_near_dedup(table(spark, sf_dir, "documents"))


@register()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written files."""
    return TK.tokenized(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


@register()
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return HT.extract_pages(table(spark, sf_dir, "pages"))


@register()
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that a document shares with others; all but the first are removals."""
    return PG.repeated_passages(table(spark, sf_dir, "documents"))


@register()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return PK.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@register(r"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
         AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(m, vec_id)) AS BIGINT) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id""")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return ED.near_duplicates(table(spark, sf_dir, "embeddings"))


@register()
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its edit distance."""
    return DC.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rule list of op10: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register(f"""
WITH rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
          FROM (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) = 1""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return UF.judge_urls(table(spark, sf_dir, "pages"), rules)


#: crc32 of a decimal number, unsigned, as a DuckDB expression over ``crc_table(t)``.
_CRC_TABLE_SQL = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
         lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)) AS t)"""


def _crc_sql(number: str) -> str:
    return f"""xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@register(f"""
WITH RECURSIVE {_CRC_TABLE_SQL},
d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
             CASE WHEN {_crc_sql("doc_id")} % 5 = 0
                  THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claimed
      FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
lev(source, lvl, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM lev WHERE n > 1 GROUP BY source, lvl, pos // 16, n),
sub AS (SELECT source, lvl, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lev WHERE n = 1),
toplev(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM sub
  UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM toplev WHERE n > 1 GROUP BY lvl, pos // 16, n),
walk AS (
  SELECT p.doc_id, p.leaf, l.lvl AS step, p.pos // CAST(pow(16, l.lvl) AS BIGINT) AS mine, l.pos AS sib, l.h
  FROM placed p JOIN lev l ON l.source IS NOT DISTINCT FROM p.source AND l.n > 1
   AND l.pos // 16 = p.pos // CAST(pow(16, l.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, s.lvl + l.lvl, s.pos // CAST(pow(16, l.lvl) AS BIGINT), l.pos, l.h
  FROM placed p JOIN sub s ON s.source IS NOT DISTINCT FROM p.source JOIN toplev l ON l.n > 1
   AND l.pos // 16 = s.pos // CAST(pow(16, l.lvl + 1) AS BIGINT)),
seg AS (SELECT doc_id, leaf, step, coalesce(string_agg(h, '' ORDER BY sib) FILTER (WHERE sib < mine), '') AS l,
               coalesce(string_agg(h, '' ORDER BY sib) FILTER (WHERE sib > mine), '') AS r FROM walk GROUP BY doc_id, leaf, step),
fold(doc_id, leaf, step, h) AS (
  SELECT doc_id, leaf, 0, coalesce(claimed, leaf) FROM d
  UNION ALL SELECT f.doc_id, f.leaf, f.step + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN seg s USING (doc_id, leaf, step)),
folded AS (SELECT doc_id, leaf, arg_max(h, step) AS folded_root FROM fold GROUP BY doc_id, leaf),
proof AS (SELECT doc_id, leaf, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM seg GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
       f.folded_root = t.h AS verified
FROM placed p JOIN sub s ON s.source IS NOT DISTINCT FROM p.source JOIN (SELECT h FROM toplev WHERE n = 1) t ON true
JOIN folded f USING (doc_id, leaf) LEFT JOIN proof q USING (doc_id, leaf)""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    return MK.tampered_manifest(table(spark, sf_dir, "documents"))


@register()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the longest one, digests of all and of the collapsed text."""
    return PR.run_report(table(spark, sf_dir, "documents"))


@register("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, min(page_id) AS lead FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lead <> page_id THEN lead END AS refers_to,
       row_number() OVER (ORDER BY url_key, pmod, page_id) - 1 AS position
FROM (SELECT p.*, lead, u.url_key, u.page_id % 4294967296 AS pmod FROM p LEFT JOIN first USING (payload_digest) JOIN (
  SELECT page_id, list_aggregate(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[0-9]*[.]', ''), '.')), 'string_agg', ',')
         || ')' || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END AS url_key
  FROM (SELECT page_id, url, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS tail FROM pages)) u USING (page_id))""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the capture's
    position in the merged index, of every page, read back from the archives. Pages have
    no capture time, so they count as captured one second apart by page_id."""
    found = WA.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")
