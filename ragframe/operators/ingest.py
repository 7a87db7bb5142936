"""Ingestion: parse -> split -> index -> embed -> upsert/append.

Everything is row- or batch-local (no shuffle) until the final upsert/append:
parsing, splitting and embedding run over Arrow batches of the documents' partitions
(``mapInArrow``), the first two in slices of bounded bytes. Both outputs of :func:`ingest` derive from one
checkpointed ``fragments`` DataFrame so they agree even if a task is retried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe import constants as K
from ragframe.functions import plugins
from ragframe.functions.text import embedding_input
from ragframe.operators import maintenance as M
from ragframe.operators.filetypes import check_types
from ragframe.operators.vectors import embed_chunks
from ragframe.session import broadcast_if_small, checkpoint

# --------------------------------------------------------------------------
# B1 parse
# --------------------------------------------------------------------------

SLICE_BYTES = 1 << 20  # texts or contents that are parsed or split at once

# the first element of an HTML document, after comments, a prolog and white space
_HTML_START = re.compile(r"\ufeff?(?:\s|<!--.*?-->|<\?.*?\?>)*<(?:!doctype\s+html|html|head|body)\b", re.S | re.I)


def _slices(batch: pa.RecordBatch, of: str):
    """Runs of rows of a batch whose values of ``of`` take at most ``SLICE_BYTES`` (at least
    one row), so that a task's Python objects don't grow with the rows of a batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(of))), 0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < batch.num_rows:
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def detect_type(content: bytes) -> str:
    """HTML when the first element of the text is HTML's, however much comes before it."""
    return "text/html" if _HTML_START.match(content.decode("utf-8", errors="replace")) else "text/plain"


def parse_documents(files: DataFrame, parsers: dict | None = None, content_col: str = "content",
                    mime_col: str | None = "mime", out_col: str = "text", error_col: str = "parse_error",
                    verify_types: bool = False) -> DataFrame:
    """B1: bytes -> plain text with a pluggable ``mime -> parser`` map. Without a
    MIME type it is detected from the content (HTML or text). A file that cannot
    be parsed -- no content, no parser for its type, or a parser that fails -- has
    NULL text and the reason in ``error_col``; it never fails the job. With
    ``verify_types`` a file whose content contradicts its MIME type is one of these."""
    parsers = parsers or plugins.default_parsers()

    def _parse(batches):
        for batch in batches:
            for part in _slices(batch, "_content"):
                texts, errors = [], []
                for b, m in zip(part.column(-2).to_pylist(), part.column(-1).to_pylist()):
                    text, error = None, None
                    if b is None:
                        error = "no content"
                    else:
                        m = m or detect_type(b)
                        if m not in parsers:
                            error = f"no parser for {m}"
                        else:
                            try:
                                text = parsers[m](b)
                            except Exception as e:  # noqa: BLE001 - a broken file is a reject
                                error = f"{m}: {type(e).__name__}: {e}"
                    texts.append(text)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                                                 [*part.schema.names[:-2], "_text", "_error"])

    mime = F.col(mime_col) if mime_col and mime_col in files.columns else F.lit(None).cast("string")
    wrong = F.lit(None).cast("string")
    if verify_types and mime_col and mime_col in files.columns:
        files, wrong = check_types(files, content_col, mime_col, "_detected", "_wrong"), F.col("_wrong")
    asked = files.withColumn("_content", F.when(wrong.isNull(), F.col(content_col))).withColumn("_mime", mime)
    schema = T.StructType(files.schema.fields + [T.StructField("_text", T.StringType()), T.StructField("_error", T.StringType())])
    out = asked.mapInArrow(_parse, schema)
    return (out.withColumn(out_col, F.col("_text")).withColumn(error_col, F.coalesce(wrong, F.col("_error")))
            .drop("_text", "_error", "_detected", "_wrong"))


# --------------------------------------------------------------------------
# B2 split
# --------------------------------------------------------------------------

# fixed values: separators of the recursive splitter, coarse to fine, and the
# string used to re-join pieces of each level
_LEVELS = [
    (re.compile(r"\s*\n\s*\n\s*"), "\n\n"),   # paragraphs
    (re.compile(r"\s*\n\s*"), "\n"),           # lines
    (re.compile(r"(?<=[.!?])\s+"), " "),       # sentences
    (re.compile(r"\s+"), " "),                 # words
]
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
SENTENCES = 2  # the level of sentences


def _split_level(text: str, level: int, max_chars: int, sentences=None) -> list[str]:
    if len(text) <= max_chars:
        return [text] if text else []
    if level >= len(_LEVELS):
        return [text[i:i + max_chars] for i in range(0, len(text), max_chars)]
    sep_re, joiner = _LEVELS[level]
    parts = sentences(text) if sentences is not None and level == SENTENCES else [p for p in sep_re.split(text) if p]
    out: list[str] = []
    cur: list[str] = []
    cur_len = 0
    for p in parts:
        if len(p) > max_chars:
            if cur:
                out.append(joiner.join(cur))
                cur, cur_len = [], 0
            out.extend(_split_level(p, level + 1, max_chars, sentences))
            continue
        add = len(p) + (len(joiner) if cur else 0)
        if cur and cur_len + add > max_chars:
            out.append(joiner.join(cur))
            cur, cur_len = [p], len(p)
        else:
            cur.append(p)
            cur_len += add
    if cur:
        out.append(joiner.join(cur))
    return out


def _with_overlap(pieces: list[str], max_chars: int, overlap: int, sentences=None) -> list[str]:
    """Prefix each piece with the whole trailing sentences of the previous piece
    that fit in ``overlap`` characters; pieces are packed with room for them."""
    if overlap <= 0 or len(pieces) < 2:
        return pieces
    out = [pieces[0]]
    for prev, cur in zip(pieces, pieces[1:]):
        sents = sentences(prev) if sentences is not None else [s for s in _SENTENCE.split(prev) if s]
        tail: list[str] = []
        size = 0
        for s in reversed(sents[1:]):  # never the whole previous piece
            extra = len(s) + (1 if tail else 0)
            if size + extra > overlap:
                break
            tail.insert(0, s)
            size += extra
        pre = " ".join(tail)
        out.append(f"{pre} {cur}" if pre and len(pre) + 1 + len(cur) <= max_chars else cur)
    return out


def split_text(text: str | None, max_chars: int, overlap: int = K.CHUNK_OVERLAP_CHARS, sentences=None) -> list[str]:
    """Recursive split (paragraph, line, sentence, word, character), greedy
    packing of each level's pieces, with their overlap, up to ``max_chars``. Pure
    helper; linear in the text length. ``sentences``: text -> its sentences (None: by
    white space behind a mark)."""
    if text is None:
        return []
    max_chars, text = max(int(max_chars), 1), text.strip()
    if len(text) <= max_chars:
        return [text] if text else []
    room = max_chars - overlap - 1 if 0 < overlap < max_chars // 2 else max_chars
    return _with_overlap(_split_level(text, 0, room, sentences), max_chars, overlap, sentences)


def split_documents(docs: DataFrame, max_chars, overlap: int = K.CHUNK_OVERLAP_CHARS,
                    text_col: str = "text", out_col: str = "pieces", model=None) -> DataFrame:
    """B2: add ``pieces`` array<string> per document. ``max_chars`` is an int or a
    column (e.g. the embedding model's context length x 1 char per token).
    Partitioned by document; no shuffle. ``model``: a learned ``SentenceModel``."""
    sentences = None if model is None else model.split

    def _split(batches):
        for batch in batches:
            for part in _slices(batch, "_text"):
                pieces = [split_text(t, m, overlap, sentences) for t, m in zip(part.column(-2).to_pylist(), part.column(-1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(pieces, pa.list_(pa.string()))], [*part.schema.names[:-2], out_col])

    m = max_chars if isinstance(max_chars, Column) else F.lit(int(max_chars))
    asked = docs.withColumn("_text", F.col(text_col)).withColumn("_most", m.cast("long"))
    kept = [f for f in docs.schema.fields if f.name != out_col]
    return asked.select(*[f.name for f in kept], "_text", "_most").mapInArrow(
        _split, T.StructType(kept + [T.StructField(out_col, T.ArrayType(T.StringType()))]))


def index_fragments(split: DataFrame, pieces_col: str = "pieces",
                    keep=("context_id", "document_id")) -> DataFrame:
    """One fragment per piece: fragment_index = position, chunk_index = 0,
    empty metadata."""
    return split.select(*keep, F.posexplode(pieces_col).alias("fragment_index", "value")).select(
        *keep, F.col("fragment_index").cast("long").alias("fragment_index"),
        F.lit(0).cast("long").alias("chunk_index"), "value",
        F.create_map().cast("map<string,string>").alias("metadata"))


def chunk_documents(docs: DataFrame, max_chars, overlap: int = K.CHUNK_OVERLAP_CHARS,
                    text_col: str = "text", keep=("context_id", "document_id"), model=None) -> DataFrame:
    """B2 + B3: documents -> indexed fragments."""
    return index_fragments(split_documents(docs, max_chars, overlap, text_col, model=model), keep=keep)


def embedding_inputs(chunks: DataFrame) -> DataFrame:
    """The text sent to the embedder for each chunk."""
    return chunks.withColumn("embedding_input", embedding_input("metadata", "value"))


# --------------------------------------------------------------------------
# B6 / B7
# --------------------------------------------------------------------------

def ingest(docs: DataFrame, documents: DataFrame, embeddings: DataFrame, max_chars=None,
           embedder=None, dim: int = 64, now: Column | None = None, replace: bool = False,
           model: str | None = None, parsers: dict | None = None,
           overlap: int = K.CHUNK_OVERLAP_CHARS):
    """parse/split/embed new documents and add them to the tables.

    ``docs``: document_id, context_id, name and either ``text`` or raw file
    bytes ``content`` [+ ``mime``] (parsed with ``parsers``) [, description,
    type, metadata]. The chunk size is ``max_chars``, else the context length
    of the embedding ``model`` x 1 char per token (default model: 512).
    Returns (documents', embeddings', rejects). Rejects are documents that could
    not be parsed (they enter neither table) and fragments without a vector of
    the right length: document_id, context_id, fragment_index (NULL: the whole
    document) and error. Documents with no fragment still get a document row
    (and no embedding). With ``replace=True`` previous embeddings of the same
    keys are deleted first (otherwise they are appended again, like the
    original)."""
    if max_chars is None:
        lengths = dict(K.MODELS)
        name = model or K.DEFAULT_EMBEDDINGS_MODEL
        if name not in lengths:
            raise ValueError(f"unknown embedding model {name!r}")
        max_chars = lengths[name] * K.CHARS_PER_TOKEN
    d = docs
    if "text" not in d.columns and "content" in d.columns:
        d = parse_documents(d, parsers).drop("content")
    else:
        d = d.withColumn("parse_error", F.when(F.col("text").isNull(), F.lit("no content")))
    for c, v in [("description", F.lit("")), ("type", F.lit(K.DEFAULT_DOCUMENT_TYPE)),
                 ("metadata", F.create_map().cast("map<string,string>"))]:
        if c not in d.columns:
            d = d.withColumn(c, v)
    d = checkpoint(d)  # parsed once; both tables and the rejects read it
    unparsed = d.where(F.col("parse_error").isNotNull())
    d = d.where(F.col("parse_error").isNull())
    frags = chunk_documents(d, max_chars, overlap)
    vec = checkpoint(embed_chunks(frags, embedder, dim, expected_dim=dim))
    good = vec.where(F.col("dim_ok")).drop("dim_ok")
    rejects = unparsed.select("document_id", "context_id", F.lit(None).cast("long").alias("fragment_index"),
                              F.col("parse_error").alias("error")).unionByName(
        vec.where(~F.col("dim_ok")).select("document_id", "context_id", "fragment_index", F.when(
            F.col("embedding").isNull(), F.lit("no embedding")).otherwise(F.concat(
                F.lit("embedding of length "), F.size("embedding").cast("string"))).alias("error")))
    emb_base = embeddings
    if replace:
        emb_base = M.delete_embeddings(embeddings, d.select("context_id", "document_id"))
    emb_new, _ = M.append_embeddings(emb_base, good.select(*[c for c in emb_base.columns if c != "id"]))
    doc_changes = d.select("document_id", "context_id", "name", "description", "type", "metadata")
    docs_new = M.upsert_documents(documents, doc_changes, now, seq_col=None)
    return docs_new, emb_new, rejects


def ingest_if_absent(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Keep only documents that have no embeddings yet for (context,
    document). The incoming batch is the small side: its keys are broadcast
    (size-checked) to filter the embeddings scan map-side."""
    keys = ["context_id", "document_id"]
    batch = broadcast_if_small(docs.select(*keys).distinct(), 1_000_000)
    # the big embeddings table is only scanned and filtered by the (small) batch
    have = embeddings.select(*keys).join(batch, keys, "left_semi").distinct()
    return docs.join(have, keys, "left_anti")
