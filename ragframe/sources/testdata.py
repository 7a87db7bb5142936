"""Inputs derived from the driver tables (see FIXTURES.md §2).

Each derived view exists twice: as a Spark DataFrame builder and as a DuckDB SQL
snippet (``SQL_VIEWS``) used by the oracles. Both read the whole tables; nothing
is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragframe import constants as K
from ragframe import schemas as S
from ragframe.operators.vectors import embed_chunks, embed_queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str, names=tuple(TABLES)) -> tuple:
    """(name, bytes, modification time) of the tables' files as they are now, read
    through Spark's file system so that any store works."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            files = [f for f in fs.listStatus(path)]
            out.append((name, sum(f.getLen() for f in files), max([f.getModificationTime() for f in files], default=0)))
    return tuple(out)


def _src_num(col: str = "source"):
    return F.regexp_extract(F.col(col), r"(\d+)", 1).cast("int")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ctx``: one context per distinct ``documents.source``. Settings are the
    defaults except ``rrfLimit = 5 + n % 3``; odd contexts get a tone, one example
    pair and a prefill; every fourth gets a precognition line."""
    src = read(spark, sf_dir, "documents").select("source").distinct()
    n = _src_num()
    odd = (n % 2) == 1
    template = F.struct(
        F.lit(K.DEFAULT_TASK_CONTEXT).alias("taskContext"),
        F.when(odd, F.lit("Be friendly.")).alias("toneContext"),
        F.lit(None).cast("string").alias("taskDescription"),
        F.when(odd, F.array(F.struct(F.lit("user").alias("role"), F.lit("Hi").alias("text")),
                            F.struct(F.lit("assistant").alias("role"), F.lit("Hello!").alias("text"))))
         .otherwise(F.array().cast("array<struct<role:string,text:string>>")).alias("examples"),
        F.lit(K.DEFAULT_QUERY_TEMPLATE).alias("queryTemplate"),
        F.lit(K.DEFAULT_QUERY_CONTEXT_TEMPLATE).alias("queryContextTemplate"),
        F.when(n % 4 == 3, F.lit("Think step by step.")).alias("precognition"),
        F.lit(None).cast("string").alias("outputFormatting"),
        F.when(odd, F.lit("Answer:")).alias("prefill"),
    )
    settings = F.struct(
        F.lit(K.DEFAULT_FULL_TEXT_SEARCH_LIMIT).alias("fullTextSearchLimit"),
        F.lit(K.DEFAULT_SEMANTIC_SEARCH_LIMIT).alias("semanticSearchLimit"),
        (F.lit(K.DEFAULT_RRF_LIMIT) + n % 3).cast("int").alias("rrfLimit"),
        F.struct(F.lit(K.DEFAULT_LOOK_BACK).alias("lookBack"),
                 F.lit(K.DEFAULT_LOOK_AHEAD).alias("lookAhead")).alias("fragmentLookupRange"),
    )
    return src.select(
        F.col("source").alias("context_id"),
        F.col("source").alias("name"),
        F.concat(F.lit("Context "), F.col("source")).alias("description"),
        template.cast(S.PROMPT_TEMPLATE).alias("prompt_template"),
        settings.cast(S.RETRIEVAL_SETTINGS).alias("retrieval_settings"),
        F.lit(None).cast(S.CHAT_COMPLETION_SETTINGS).alias("chat_completion_settings"),
        F.lit(K.DEFAULT_CHAT_MODEL).alias("chat_model"),
        F.lit(K.DEFAULT_EMBEDDINGS_MODEL).alias("embeddings_model"),
        # wall-clock literal plus an offset: renders the same in any session time zone
        F.timestamp_add("MINUTE", n, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("updated_at"),
    )


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs``: the documents table of the data model."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("context_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("").alias("description"),
        F.lit(K.DEFAULT_DOCUMENT_TYPE).alias("type"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.timestamp_add("SECOND", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("updated_at"),
    )


def _claimed_type():
    mimes = F.array(F.lit("application/pdf"), F.lit("text/plain"), F.lit("text/html"),
                    F.lit("image/png"), F.lit(""))
    return F.element_at(mimes, (F.pmod(F.col("doc_id"), F.lit(5)) + 1).cast("int"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names' types and sizes for the admission check alone: every fifth is of each type."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.select(
        F.col("doc_id").alias("file_id"),
        _claimed_type().alias("mime"),
        (F.col("n_chars") * 50000).alias("size"),
    )


#: Files added by hand: (id, MIME type, size, content).
EXTRA_FILES = [(-1, "application/pdf", 9, "no magic "), (-2, "image/png", 3, "png"), (-3, "text/plain", 1 << 40, "too large"),
               (-4, "text/plain", 0, None), (-5, "text/plain", 8, "an extra"), (-6, "application/pdf", 4, "text")]


def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files``: every document as an uploaded file of its own type and size, and the files added by hand."""
    d = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("context_id"), F.lit("text/plain").alias("mime"),
        F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))
    extra = spark.createDataFrame(EXTRA_FILES, "file_id long, mime string, size long, content string").select(
        "file_id", F.lit("extra").alias("context_id"), "mime", "size", F.encode("content", "UTF-8").alias("content"))
    return d.unionByName(extra)


def claimed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file once more, under the type that ``uploads`` gives it and an id
    that follows the largest one."""
    d = read(spark, sf_dir, "documents")
    top = d.agg(F.max("doc_id").alias("m")).scalar()
    return d.select(
        (F.col("doc_id") + top + 1).alias("file_id"), F.col("source").alias("context_id"), _claimed_type().alias("mime"),
        F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_chunks``: each document line is one fragment (chunk 0). Ids are
    document * (most lines of a document) + line, so they never collide."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    most = d.agg(F.coalesce(F.max(F.size("lines")), F.lit(1)).cast("long").alias("m")).scalar()
    return d.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("context_id"), "doc_id",
        F.posexplode("lines").alias("fragment_index", "value"),
    ).select(
        (F.col("document_id") * most + F.col("fragment_index")).alias("id"),
        "context_id", "document_id", F.col("fragment_index").cast("long").alias("fragment_index"),
        F.lit(0).cast("long").alias("chunk_index"), "value",
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def labelled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of the documents that have a label: a table that holds a
    part of all documents."""
    keys = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")).distinct()
    return line_chunks(spark, sf_dir).join(keys, "document_id", "left_semi")


def corpus(spark: SparkSession, sf_dir: str, copy_index: int | None = None, arrange=None,
           embedded: bool = True) -> DataFrame:
    """``corpus``: every fragment of every document with a vector: the given
    embedding of the document's id for its first fragment, where there is one,
    else the default embedder's. With ``copy_index`` each row is there once more, as
    that chunk, under an id that follows the largest one.

    Given vectors meet the texts of first fragments alone, before any vector is made.
    ``arrange`` (DataFrame -> DataFrame) deals the texts out to the tasks that embed them.
    With ``embedded`` false the same rows come without their vectors."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("given"))
    lines = line_chunks(spark, sf_dir)
    first = lines.where(F.col("fragment_index") == 0).join(e, "document_id", "left")
    rows = first.unionByName(lines.where(F.col("fragment_index") != 0).withColumn("given", F.lit(None).cast(e.schema["given"].dataType)))
    rows = arrange(rows) if arrange else rows
    made = embed_chunks(rows, dim=64) if embedded else rows
    if copy_index is not None:
        top = lines.agg(F.max("id").alias("m")).scalar()
        made = made.withColumn("_copy", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
        copied = F.col("_copy") == 1
        made = made.withColumn("chunk_index", F.when(copied, F.lit(copy_index).cast("long")).otherwise(F.col("chunk_index"))).withColumn(
            "id", F.when(copied, F.col("id") + top + 1).otherwise(F.col("id")))
    return made.select(
        "id", "context_id", "document_id", "fragment_index", "chunk_index", "value", "metadata",
        *([F.coalesce("given", "embedding").alias("embedding")] if embedded else []))


def corpus2(spark: SparkSession, sf_dir: str, arrange=None) -> DataFrame:
    """``corpus`` with a second chunk in every fragment."""
    return corpus(spark, sf_dir, 1, arrange)


def dup_corpus(spark: SparkSession, sf_dir: str, arrange=None) -> DataFrame:
    """``corpus`` with every row twice."""
    return corpus(spark, sf_dir, 0, arrange)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries``: every benchmark item; its vector is the given embedding with
    the same id, else the default embedder's; its context ``src(item_id % 5)``."""
    b = read(spark, sf_dir, "benchmark")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("given"))
    made = embed_queries(b.select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string")).alias("context_id"),
        F.col("text").alias("query")), dim=64)
    return made.join(e, "query_id", "left").select("query_id", "context_id", "query", F.coalesce("given", "embedding").alias("embedding"))


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chat_events``: conversation turns as response events."""
    c = read(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return c.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", F.lit(K.EVENT_RETRIEVAL))
         .when((F.col("role") == "user") & (F.col("turn") == last), F.lit(K.EVENT_FINISHED))
         .otherwise(F.lit(K.EVENT_PARTIAL)).alias("type"),
        F.col("text").alias("content"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_stream`` (batch form): web events as response events with time."""
    return as_response_events(read(spark, sf_dir, "events"))


def slash_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slash``: one command per user turn, ``src{conv_id % 25} <turn text>``
    (contexts src20..src24 do not exist), plus hand-made edge rows."""
    c = read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    base = c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("command_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string"), F.lit(" "), F.col("text")).alias("text"),
    )
    edge = spark.createDataFrame(
        [(-1, ""), (-2, " "), (-3, "src1"), (-4, "src1  two  spaces"), (-5, "\tsrc2 tabbed query")],
        "command_id long, text string")
    return base.unionByName(edge)


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual_output"))
    return (u.join(a, ["conv_id", "turn"])
            .join(d, F.col("conv_id") == F.col("doc_id"))
            .select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), "input",
                    "actual_output", F.col("text").alias("expected_output")))


# --------------------------------------------------------------------------
# The same views in DuckDB SQL, as CTE bodies (``name AS (...)``).
# --------------------------------------------------------------------------

_TASK = K.DEFAULT_TASK_CONTEXT.replace("'", "''")


def _vectors_sql(name: str, src: str, key: str, text: str, body: str) -> str:
    """The view ``name`` with the default embedder's vectors of ``src`` beside it."""
    return f"""
{name}_bucket AS (
  SELECT id, CAST(CAST('0x' || substr(md5(token), 1, 8) AS UBIGINT) % 64 AS INTEGER) AS b,
         sum(CASE WHEN substr(md5(token), 9, 1) >= '8' THEN 1 ELSE -1 END) AS c
  FROM (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {src})
  GROUP BY 1, 2),
{name}_vec AS (
  SELECT s.{key} AS id,
         list_transform(range(64), lambda i: CAST(CASE WHEN n.norm > 0 THEN COALESCE(n.m[i], 0) / n.norm ELSE 0 END AS FLOAT)) AS embedding
  FROM {src} s LEFT JOIN (
    SELECT id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS norm, map_from_entries(list((CAST(b AS BIGINT), CAST(c AS DOUBLE)))) AS m
    FROM {name}_bucket GROUP BY id) n ON n.id = s.{key}),
{name} AS ({body})"""


def chunks_sql(src: str, max_chars: int, overlap: int = K.CHUNK_OVERLAP_CHARS) -> str:
    """Views that end with ``chunks`` (doc_id, fragment_index, value): the pieces of the
    texts of ``src`` (doc_id, text) by the splitter's rule. Needs ``WITH RECURSIVE``. A
    text is split at the coarsest separator, pieces that are too long at the next one, and
    neighbours are packed greedily; each piece then begins with the whole last sentences of
    the one before it that fit in ``overlap``."""
    room = max_chars - overlap - 1 if 0 < overlap < max_chars // 2 else max_chars
    sentences = "string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""
whole AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM {src}),
node(doc_id, path, lvl, t) AS (
  SELECT doc_id, CAST([] AS BIGINT[]), -1, t FROM whole WHERE length(t) > {max_chars}
  UNION ALL
  SELECT doc_id, list_append(path, i), lvl + 1, parts[i]
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM (
    SELECT doc_id, path, lvl, CASE lvl
        WHEN -1 THEN regexp_split_to_array(t, '\\s*\\n\\s*\\n\\s*') WHEN 0 THEN regexp_split_to_array(t, '\\s*\\n\\s*')
        WHEN 1 THEN {sentences.format(t="t")} WHEN 2 THEN regexp_split_to_array(t, '\\s+')
        ELSE list_transform(range(0, length(t), {room}), lambda k: substr(t, k + 1, {room})) END AS parts
    FROM node WHERE length(t) > {room} AND lvl < 4)) WHERE parts[i] <> ''),
sib AS (SELECT *, path[:-2] AS parent, path[-1] AS i, length(t) > {room} AS big, CASE lvl WHEN 0 THEN 2 ELSE 1 END AS jl FROM node WHERE lvl >= 0),
atom AS (SELECT * FROM (SELECT *, sum(CAST(big AS INTEGER)) OVER (PARTITION BY doc_id, parent ORDER BY i) AS box FROM sib) WHERE NOT big),
placed AS (SELECT *, row_number() OVER w AS k, sum(length(t) + jl) OVER w AS upto FROM atom
           WINDOW w AS (PARTITION BY doc_id, parent, box ORDER BY i)),
jump AS (SELECT a.doc_id, a.parent, a.box, a.k, min(b.k) AS nxt FROM placed a LEFT JOIN placed b
           ON b.doc_id = a.doc_id AND b.parent = a.parent AND b.box = a.box AND b.k > a.k
          AND (a.lvl = 4 OR b.upto - (a.upto - length(a.t) - a.jl) - a.jl > {room})
         GROUP BY a.doc_id, a.parent, a.box, a.k),
start(doc_id, parent, box, k, nxt) AS (
  SELECT * FROM jump WHERE k = 1
  UNION ALL SELECT j.* FROM start s JOIN jump j ON j.doc_id = s.doc_id AND j.parent = s.parent AND j.box = s.box AND j.k = s.nxt),
packed AS (
  SELECT s.doc_id, min(p.path) AS path, string_agg(CASE WHEN p.k = s.k THEN '' WHEN p.lvl = 0 THEN chr(10) || chr(10) WHEN p.lvl = 1 THEN chr(10) ELSE ' ' END || p.t, '' ORDER BY p.k) AS t
  FROM start s JOIN placed p ON p.doc_id = s.doc_id AND p.parent = s.parent AND p.box = s.box AND p.k >= s.k AND (s.nxt IS NULL OR p.k < s.nxt)
  GROUP BY s.doc_id, s.parent, s.box, s.k),
pieces AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS fragment_index, t, CAST(NULL AS VARCHAR) AS prev FROM whole WHERE t <> '' AND length(t) <= {max_chars}
  UNION ALL
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1, t, lag(t) OVER (PARTITION BY doc_id ORDER BY path) FROM packed),
tails AS (
  SELECT *, list_filter(list_transform(range(1, len(s)), lambda k: array_to_string(s[-k:], ' ')), lambda x: length(x) <= {overlap}) AS fit
  FROM (SELECT *, list_filter({sentences.format(t="coalesce(prev, '')")}, lambda x: x <> '') AS s FROM pieces)),
chunks AS (
  SELECT doc_id, fragment_index, CASE WHEN len(fit) > 0 AND length(fit[-1]) + 1 + length(t) <= {max_chars} THEN fit[-1] || ' ' || t ELSE t END AS value
  FROM tails)"""


SQL_VIEWS: dict[str, str] = {
    "ctx": f"""
ctx AS (
  SELECT source AS context_id, source AS name, 'Context ' || source AS description,
         CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS n,
         '{_TASK}' AS task_context,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 1 THEN 'Be friendly.' END AS tone_context,
         CAST(NULL AS VARCHAR) AS task_description,
         '{K.DEFAULT_QUERY_TEMPLATE}' AS query_template,
         '{K.DEFAULT_QUERY_CONTEXT_TEMPLATE}' AS query_context_template,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 4 = 3 THEN 'Think step by step.' END AS precognition,
         CAST(NULL AS VARCHAR) AS output_formatting,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 1 THEN 'Answer:' END AS prefill,
         {K.DEFAULT_FULL_TEXT_SEARCH_LIMIT} AS fts_limit, {K.DEFAULT_SEMANTIC_SEARCH_LIMIT} AS sem_limit,
         {K.DEFAULT_RRF_LIMIT} + CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 3 AS rrf_limit,
         {K.DEFAULT_LOOK_BACK} AS look_back, {K.DEFAULT_LOOK_AHEAD} AS look_ahead,
         '{K.DEFAULT_CHAT_MODEL}' AS chat_model, '{K.DEFAULT_EMBEDDINGS_MODEL}' AS embeddings_model,
         TIMESTAMP '2024-01-01 00:00:00' + TO_SECONDS(CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) * 60) AS updated_at
  FROM (SELECT DISTINCT source FROM documents))""",
    "docs": """
docs AS (
  SELECT doc_id AS document_id, source AS context_id, 'doc-' || CAST(doc_id AS VARCHAR) AS name,
         '' AS description, 'PDF' AS type,
         TIMESTAMP '2024-01-01 00:00:00' + TO_SECONDS(doc_id) AS updated_at
  FROM documents)""",
    "corpus": _vectors_sql("corpus", "line_chunks", "id", "value", """
  SELECT l.id, l.context_id, l.document_id, l.fragment_index, l.chunk_index, l.value,
         COALESCE(e.embedding, v.embedding) AS embedding
  FROM line_chunks l JOIN corpus_vec v USING (id)
  LEFT JOIN embeddings e ON e.vec_id = l.document_id AND l.fragment_index = 0"""),
    "corpus2": """
corpus2 AS (
  SELECT * FROM corpus
  UNION ALL
  SELECT id + (SELECT max(id) + 1 FROM corpus), context_id, document_id, fragment_index, CAST(1 AS BIGINT), value, embedding FROM corpus)""",
    "dup_corpus": """
dup_corpus AS (
  SELECT * FROM corpus
  UNION ALL
  SELECT id + (SELECT max(id) + 1 FROM corpus), context_id, document_id, fragment_index, chunk_index, value, embedding FROM corpus)""",
    "kept_corpus": """
kept_corpus AS (
  SELECT * FROM corpus WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "line_chunks": """
line_chunks AS (
  SELECT document_id * (SELECT max(len(string_split(text, chr(10)))) FROM documents) + fragment_index AS id,
         context_id, document_id, fragment_index, CAST(0 AS BIGINT) AS chunk_index, value
  FROM (SELECT doc_id AS document_id, source AS context_id,
               unnest(string_split(text, chr(10))) AS value,
               CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS fragment_index
        FROM documents))""",
    "labelled_chunks": """
labelled_chunks AS (SELECT * FROM line_chunks WHERE document_id IN (SELECT doc_id FROM labels))""",
    "queries": _vectors_sql("queries", "benchmark", "item_id", "text", """
  SELECT b.item_id AS query_id, 'src' || CAST(b.item_id % 5 AS VARCHAR) AS context_id, b.text AS query,
         COALESCE(e.embedding, v.embedding) AS embedding
  FROM benchmark b JOIN queries_vec v ON v.id = b.item_id LEFT JOIN embeddings e ON b.item_id = e.vec_id"""),
    "chat_events": """
chat_events AS (
  SELECT conv_id AS query_id, turn AS seq,
         CASE WHEN role = 'system' THEN 'Retrieval'
              WHEN role = 'user' AND turn = max(turn) OVER (PARTITION BY conv_id) THEN 'Finished'
              ELSE 'Partial' END AS type,
         text AS content
  FROM conversations)""",
    "event_stream": """
event_stream AS (
  SELECT user_id AS query_id, event_id AS seq, ts,
         CASE WHEN event_type = 'signup' THEN 'Retrieval' WHEN event_type = 'error' THEN 'Finished'
              ELSE 'Partial' END AS type,
         props AS content
  FROM events)""",
    "slash": """
slash AS (
  SELECT conv_id * 100 + turn AS command_id,
         'src' || CAST(conv_id % 25 AS VARCHAR) || ' ' || text AS text
  FROM conversations WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES (-1, ''), (-2, ' '), (-3, 'src1'), (-4, 'src1  two  spaces'),
                                  (-5, chr(9) || 'src2 tabbed query')) t(command_id, text))""",
    "eval_cases": """
eval_cases AS (
  SELECT u.conv_id * 100 + u.turn AS case_id, u.text AS input, a.text AS actual_output,
         d.text AS expected_output
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  JOIN documents d ON d.doc_id = u.conv_id
  WHERE u.role = 'user')""",
}

# dependencies between SQL views
_SQL_DEPS = {"corpus": ["line_chunks"], "corpus2": ["corpus"], "dup_corpus": ["corpus"], "labelled_chunks": ["line_chunks"]}


def sql_with(*names: str) -> str:
    """``WITH`` clause defining the given derived views (and their dependencies)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _SQL_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL_VIEWS[n].strip() for n in order)


def as_response_events(raw_events: DataFrame) -> DataFrame:
    """Map the raw ``events`` columns to response events (batch or stream)."""
    return raw_events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", F.lit(K.EVENT_RETRIEVAL))
         .when(F.col("event_type") == "error", F.lit(K.EVENT_FINISHED))
         .otherwise(F.lit(K.EVENT_PARTIAL)).alias("type"),
        F.col("props").alias("content"),
    )


def event_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_stream`` as a real file stream over ``events.parquet``."""
    schema = read(spark, sf_dir, "events").schema
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
           .parquet(sf_dir))
    return as_response_events(raw)
