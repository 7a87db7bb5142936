"""Full-text retrieval: analyzer, BM25 statistics and per-query BM25 top-k
(C1-C6).

Distributed form
----------------
* ``bm25_stats`` builds an inverted index once per corpus version: postings
  ``(id, token, tf, dl, keys...)`` computed inside each fragment's row (sorted
  tokens, run lengths: no shuffle at all), document frequencies (partial
  aggregation, so a token that occurs in a third of all rows is combined
  map-side) and a one-row total.
* ``bm25_search`` meets the forward rows (a fragment's tokens and counts) with the
  *query tokens* of a batch. The query side is bounded by (queries x distinct tokens
  per query); while that bound is small it is sent to the tasks, and a numpy kernel
  over Arrow batches adds up the scores of each (query, fragment) where the
  fragment's row is: a pair of a query and a fragment becomes a Spark row only if it
  can be among the task's best ``limit``. Beyond the bound, and for an index of
  postings alone, postings are joined with the query tokens and summed by a grouping.
  The per-query limit is a ``row_number <= literal`` filter, which Spark turns into a
  partial ``WindowGroupLimit`` before the only exchange.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ragframe import constants as K
from ragframe.functions.text import escape_query as _escape_expr
from ragframe.functions.text import tokens
from ragframe.session import checkpoint, ensure_checkpoint_dir, fits

FRAGMENT_KEYS = ["context_id", "document_id", "fragment_index"]
BROADCAST_MAX_ROWS = 2_000_000
SCORE_CELLS = 2_000_000  # scores of (query, fragment) pairs, and matches of tokens, held at once


def escape_query(queries: DataFrame, text_col: str = "query", out_col: str = "escaped") -> DataFrame:
    """Add the backslash-escaped form of the query text."""
    return queries.withColumn(out_col, _escape_expr(text_col))


def analyze_text(rows: DataFrame, text_col: str = "value", keep=("id",),
                 out_col: str = "token", with_position: bool = False) -> DataFrame:
    """One row per token occurrence (lower-cased letter/digit runs, tokens
    longer than 255 characters dropped)."""
    if with_position:
        return rows.select(*keep, F.posexplode(tokens(text_col)).alias("position", out_col))
    return rows.select(*keep, F.explode(tokens(text_col)).alias(out_col))


@dataclass
class Bm25Index:
    """Corpus statistics. ``postings``: id, keys, dl, token, tf. ``doc_freq``:
    token, df. ``totals``: one row n_docs, avgdl. ``stored``: the frequencies
    are a stored table, so a search reads them instead of counting postings.
    ``forward``: id, keys, dl and the fragment's tokens, a row a fragment: ``_toks``
    array<string>, repeats included, or ``_tf`` array<struct<token, tf>> sorted by
    token; None: the index has postings alone."""
    postings: DataFrame
    doc_freq: DataFrame
    totals: DataFrame
    stored: bool = False
    forward: DataFrame | None = None
    _repeated: list = field(default_factory=list, repr=False)

    def repeated(self) -> DataFrame | None:
        """The ids that more than one forward row has; None if every id is unique."""
        if not self._repeated:
            ids = checkpoint(self.forward.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col("id").alias("_id")))
            self._repeated.append(ids if ids.take(1) else None)
        return self._repeated[0]

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Persist the index: postings clustered by fragment (one fragment's rows
        lie together, sorted by token), frequencies sorted by token."""
        self.postings.repartition("id").sortWithinPartitions("id", "token").write.mode(mode).parquet(f"{path}/postings")
        self.doc_freq.sortWithinPartitions("token").write.mode(mode).parquet(f"{path}/doc_freq")
        self.totals.write.mode(mode).parquet(f"{path}/totals")

    @staticmethod
    def read(spark, path: str) -> "Bm25Index":
        """A stored index. Its postings are distributed by fragment once, so that
        searches of any number of batches score them without an exchange."""
        postings = by_fragment(spark.read.parquet(f"{path}/postings"))
        return Bm25Index(postings, spark.read.parquet(f"{path}/doc_freq"),
                         spark.read.parquet(f"{path}/totals"), stored=True)


def _stored(rows: DataFrame) -> DataFrame:
    """``rows`` as Parquet in the shared checkpoint folder, written by the tasks that have them."""
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/ragframe_index_{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def by_fragment(rows: DataFrame) -> DataFrame:
    """``rows`` stored in the shared checkpoint folder as a table bucketed by ``id``:
    Spark knows that a fragment's rows lie together, so grouping by keys that
    include ``id`` needs no exchange, in any number of searches."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"ragframe_index_{uuid.uuid4().hex}"
    (rows.repartition(n, "id").write.bucketBy(n, "id").format("parquet")
     .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def term_frequencies(rows: DataFrame, toks_col: str = "_toks") -> DataFrame:
    """Per-row term counts without a shuffle: a fragment's tokens live in one
    row, so they are sorted in place and counted by run boundaries (linear
    native expressions). Adds ``_tf`` array<struct<token, tf>>."""
    s, n = F.col("_s"), F.col("_n")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: (i <= n) & F.when(i == 1, F.lit(True)).otherwise(
                          F.element_at(s, i) != F.element_at(s, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.greatest(n, F.lit(1))), F.array(n + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(s, a).alias("token"),
                                                          (b - a).cast("long").alias("tf")))
    return (rows.withColumn("_s", F.sort_array(toks_col)).withColumn("_n", F.size("_s"))
            .withColumn("_tf", runs).drop("_s", "_n"))


def bm25_stats(fragments: DataFrame, id_col: str = "id", text_col: str = "value",
               keys=tuple(FRAGMENT_KEYS), materialize: bool = False) -> Bm25Index:
    """Term frequencies, document lengths, document frequencies, N, avgdl.

    The index is built map-side (no shuffle): a *forward index* row per
    fragment holds its length and tokens; postings count and explode them.
    With ``materialize=True`` (the index build) the forward index is stored in the
    shared checkpoint folder by the tasks that made it, and the frequencies are
    checkpointed: the text is tokenized once, and a search scores a fragment's row
    where it lies, so tokens are never moved. N counts every fragment
    (also those without tokens), as a BM25 index does."""
    toks = fragments.select(F.col(id_col).alias("id"), *keys, tokens(text_col).alias("_toks"))
    fwd = toks.select("id", *keys, F.size("_toks").cast("long").alias("dl"), "_toks")
    if materialize:
        fwd = _stored(fwd)
    postings = _postings(fwd, keys)
    doc_freq = fwd.select(F.explode(F.array_distinct("_toks")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # one-row totals (partial aggregation map-side)
    totals = fwd.agg(F.count(F.lit(1)).alias("n_docs"),
                     F.try_divide(F.sum("dl").cast("double"), F.count(F.lit(1))).alias("avgdl"))
    if materialize:
        doc_freq, totals = checkpoint(doc_freq), checkpoint(totals)
    return Bm25Index(postings, doc_freq, totals, stored=materialize, forward=fwd)


def _postings(forward: DataFrame, keys=tuple(FRAGMENT_KEYS)) -> DataFrame:
    """One row per token of each forward row."""
    if "_tf" not in forward.columns:
        forward = term_frequencies(forward)
    # explode_outer: a plain explode makes the optimizer infer size(_tf) > 0 and
    # push it below the projection, re-sorting the tokens inside the lambdas
    return (forward.select("id", *keys, "dl", F.explode_outer("_tf").alias("p"))
            .where(F.col("p").isNotNull())
            .select("id", *keys, "dl", "p.token", "p.tf"))


def max_limit(queries: DataFrame, limit_col: str) -> int:
    """The batch's largest limit (one row), at least 1."""
    return max(1, int(queries.agg(F.max(limit_col)).first()[0] or 0))


def query_tokens(queries: DataFrame, text_col: str = "query", carry=()) -> DataFrame:
    """Distinct tokens of each query (a repeated query token counts once)."""
    return queries.select("query_id", F.col("context_id").alias("q_context_id"), *carry,
                          F.explode(F.array_distinct(tokens(text_col))).alias("token"))


def _token_table(weighted: DataFrame, carry: list[str]) -> dict:
    """The batch's queries (query_id, q_context_id and settings, one row each) and, by
    token, who asks for it with which weight: ``owners`` and ``idf`` of a token's matches
    begin at ``first``. Called only on a batch whose bytes were checked."""
    rows = weighted.select("query_id", "q_context_id", *carry, "token", "idf").toArrow().combine_chunks()
    keys = rows.select(["query_id", "q_context_id", *carry])
    number, owner, firsts = {}, np.empty(rows.num_rows, np.int64), []
    for i, key in enumerate(zip(*(keys.column(c).to_pylist() for c in keys.column_names))):
        if key not in number:
            number[key] = len(number)
            firsts.append(i)
        owner[i] = number[key]
    asked = rows.column("token").to_pylist()
    words = sorted(set(asked), key=lambda t: t.encode("utf-8", "surrogatepass"))  # Spark's order of strings
    place = {t: i for i, t in enumerate(words)}
    vocabulary, codes = pa.array(words, pa.string()), np.array([place[t] for t in asked], np.int64)
    order = np.argsort(codes, kind="stable")
    return {"queries": keys.take(pa.array(firsts, pa.int64())), "vocabulary": vocabulary, "owners": owner[order],
            "idf": rows.column("idf").to_numpy()[order] if rows.num_rows else np.empty(0),
            "first": np.searchsorted(codes[order], np.arange(len(vocabulary) + 1))}


def _steps(hits: np.ndarray, n_queries: int):
    """Runs of rows with at most ``SCORE_CELLS`` scores and token matches (at least one row)."""
    most, upto, lo = max(1, SCORE_CELLS // max(n_queries, 1)), np.cumsum(hits), 0
    while lo < len(hits):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + most, int(np.searchsorted(upto, before + SCORE_CELLS, side="right"))))
        yield lo, hi
        lo = hi


def _score_kernel(bc, avgdl: float, keys: list[str], carry: list[str], cap: int, same_context: bool, tokens_col: str):
    """Scores of every forward row for every query of the batch. Of each query the rows are
    kept whose score is within the rounding of the ``cap``-th best of a step seen before or
    now, and of equal scores the ``cap`` smallest ids: a superset of the task's share of the
    top ``cap`` (the final cut, on rounded scores, is Spark's)."""
    slack = 2 * 10.0 ** -K.TEXT_SCORE_DIGITS

    def run(batches):
        table = bc.value
        queries, first, owners, idf = table["queries"], table["first"], table["owners"], table["idf"]
        n_queries, degree = queries.num_rows, np.diff(table["first"])
        best = np.full(n_queries, -np.inf)
        asked = queries.column("q_context_id").combine_chunks() if same_context else None
        for batch in batches:
            if not n_queries:
                continue
            lists = batch.column(batch.schema.get_field_index(tokens_col))
            dl = batch.column(batch.schema.get_field_index("dl")).to_numpy(zero_copy_only=False).astype(np.float64)
            norm = K.BM25_K1 * ((1.0 - K.BM25_B) + K.BM25_B * dl / avgdl)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            counted = pa.types.is_struct(flat.type)
            token = pc.index_in(flat.field("token") if counted else flat, value_set=table["vocabulary"])
            known = np.nonzero(token.is_valid().to_numpy(zero_copy_only=False))[0]
            token, row = token.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64), row[known]
            if counted:
                tf = flat.field("tf").to_numpy(zero_copy_only=False)[known].astype(np.float64)
            else:  # a row's tokens in their order, each with its count
                both, tf = np.unique(row * len(table["vocabulary"]) + token, return_counts=True)
                row, token, tf = both // len(table["vocabulary"]), both % len(table["vocabulary"]), tf.astype(np.float64)
            hits = np.bincount(row, weights=degree[token], minlength=batch.num_rows).astype(np.int64)
            for lo, hi in _steps(hits, n_queries):
                a, b = np.searchsorted(row, [lo, hi])
                t, r, n = token[a:b], row[a:b], hi - lo
                d = degree[t]
                each = np.repeat(np.arange(len(t)), d)
                at = np.arange(len(each)) - np.repeat(np.cumsum(d) - d, d) + first[t][each]
                f, m = tf[a:b], norm[r]
                term = idf[at] * f[each] * (K.BM25_K1 + 1.0) / (f + m)[each]
                cell = owners[at] * n + (r - lo)[each]
                score = np.bincount(cell, weights=term, minlength=n_queries * n).reshape(n_queries, n)
                keep = np.zeros(n_queries * n, bool)
                keep[cell] = True
                keep = keep.reshape(n_queries, n)
                if same_context:
                    here = batch.column(batch.schema.get_field_index("context_id")).slice(lo, n).dictionary_encode()
                    place = pc.fill_null(pc.index_in(asked, value_set=here.dictionary, skip_nulls=True), -2).to_numpy(zero_copy_only=False)
                    place = np.where(asked.is_null().to_numpy(zero_copy_only=False), -2, place)
                    keep &= place[:, None] == pc.fill_null(here.indices, -1).to_numpy(zero_copy_only=False)[None, :]
                keep &= score >= best[:, None] - slack
                full = np.nonzero(keep.sum(axis=1) > cap)[0]
                if len(full):
                    kth = np.partition(np.where(keep[full], score[full], -np.inf), n - cap, axis=1)[:, n - cap]
                    best[full] = np.maximum(best[full], kth)
                    keep[full] &= score[full] >= best[full, None] - slack
                cols, rows = np.nonzero(keep)
                if not len(rows):
                    continue
                found = score[cols, rows]
                ids = batch.column(batch.schema.get_field_index("id")).slice(lo, n)
                rank = np.empty(n, np.int64)
                rank[pc.sort_indices(ids, null_placement="at_start").to_numpy(zero_copy_only=False)] = np.arange(n)
                order = np.lexsort((rank[rows], found, cols))
                cols, rows, found = cols[order], rows[order], found[order]
                start = np.nonzero(np.r_[True, (cols[1:] != cols[:-1]) | (found[1:] != found[:-1])])[0]
                nth = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
                cols, rows, found = cols[nth < cap], rows[nth < cap] + lo, found[nth < cap]
                part = queries.take(pa.array(cols)).combine_chunks()
                out = [part.column(c).chunk(0) for c in ("query_id", "q_context_id", *carry)]
                out += [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in keys]
                yield pa.RecordBatch.from_arrays([*out, pa.array(found)], ["query_id", "q_context_id", *carry, *keys, "full_text_score"])
    return run


def _kernel_scores(sc, weighted: DataFrame, rows: DataFrame, avgdl: float, carry: list[str], cap: int, scope: str) -> DataFrame:
    """Each task's best scores of forward ``rows`` (see :func:`_score_kernel`)."""
    keys = ["id", *FRAGMENT_KEYS]
    qschema = weighted.select("query_id", "q_context_id", *carry).schema
    schema = T.StructType([*qschema.fields, *[rows.schema[k] for k in keys], T.StructField("full_text_score", T.DoubleType())])
    bc = sc.broadcast(_token_table(weighted, carry))
    tokens_col = "_tf" if "_tf" in rows.columns else "_toks"
    kernel = _score_kernel(bc, avgdl, keys, carry, max(int(cap), 1), scope == "context", tokens_col)
    return rows.select(*keys, "dl", tokens_col).mapInArrow(kernel, schema).withColumn(
        "full_text_score", F.round("full_text_score", K.TEXT_SCORE_DIGITS))


def bm25_search(queries: DataFrame, index: Bm25Index, limit_col: str = "_fts_limit",
                limit_cap: int | None = None, scope: str = "global",
                broadcast_tokens: bool | None = None, text_col: str = "query", carry=(),
                use_index_df: bool | None = None) -> DataFrame:
    """C4: fragments matching any query token, BM25-scored, top ``limit`` per
    query. ``scope='global'`` ranks over all contexts (the limit runs before the
    context filter, S1); ``scope='context'`` filters the postings first.
    ``use_index_df`` reads document frequencies from the index instead of
    counting them from the postings (default: if they are stored). ``limit_cap``
    is the batch's largest limit, a literal that Spark needs to cut each task's
    rows before the exchange; None: read from ``limit_col``.

    Forward rows are scored where they lie: only each task's best ``limit`` rows of a
    query move. The scores of rows that share an id are added up by a grouping, as are
    those of an index of postings alone and of a batch that can't be broadcast.

    Output: query_id, q_context_id, id, keys, full_text_score, limit column and
    the ``carry`` columns of the query (its settings)."""
    carry = [limit_col] + [c for c in carry if c != limit_col]
    if limit_cap is None:
        limit_cap = max_limit(queries, limit_col)
    if use_index_df is None:
        use_index_df = index.stored
    qt = query_tokens(queries, text_col, carry=carry)
    if broadcast_tokens is None:  # standalone call: check the size (retrieve passes a proven bound)
        broadcast_tokens = fits(qt, BROADCAST_MAX_ROWS)
    # one scalar subquery (reused): the corpus totals
    tot = index.totals.select(F.struct("n_docs", "avgdl").alias("t")).scalar()
    n_docs, avgdl = tot["n_docs"], tot["avgdl"]
    # Document frequencies are only needed for the batch's query vocabulary:
    # postings are filtered map-side by the (broadcast) vocabulary and counted
    # with partial aggregation, so a hot token costs one row per task.
    vocab = qt.select("token").distinct()
    if index.doc_freq is not None and use_index_df:
        dfq = index.doc_freq.join(F.broadcast(vocab) if broadcast_tokens else vocab, "token")
    else:
        dfq = (index.postings.select("token").join(F.broadcast(vocab) if broadcast_tokens else vocab, "token")
               .groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    weighted = qt.join(F.broadcast(dfq) if broadcast_tokens else dfq, "token").withColumn(
        "idf", F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))))
    side = F.broadcast(weighted) if broadcast_tokens else weighted
    post, scored = index.postings, None
    sc = _spark_context(queries) if index.forward is not None and broadcast_tokens else None
    if sc is not None:
        rows, repeated = index.forward, index.repeated()
        post = None
        if repeated is not None:
            side_ids = F.broadcast(repeated) if fits(repeated, BROADCAST_MAX_ROWS) else repeated
            same = F.col("id").eqNullSafe(F.col("_id"))
            post, rows = _postings(rows.join(side_ids, same, "left_semi")), rows.join(side_ids, same, "left_anti")
        avgdl_now = index.totals.select("avgdl").first()[0] or 1.0
        scored = _kernel_scores(sc, weighted, rows, avgdl_now, carry, limit_cap, scope)
    if post is not None:
        summed = _summed(post, side, avgdl, carry, scope)
        scored = summed if scored is None else scored.unionByName(summed)
    w = Window.partitionBy("query_id").orderBy(F.col("full_text_score").desc_nulls_first(),
                                               F.col("id").asc())
    rn = F.row_number().over(w)
    return (scored.withColumn("_rn", rn)
            .where((F.col("_rn") <= F.col(limit_col)) & (F.col("_rn") <= F.lit(limit_cap)))
            .drop("_rn"))


def _spark_context(df: DataFrame):
    try:
        return df.sparkSession.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (Connect): the grouping
        return None


def _summed(post: DataFrame, side: DataFrame, avgdl, carry: list[str], scope: str) -> DataFrame:
    """Scores by joining postings with the weighted query tokens and a grouping."""
    cond = ["token"]
    if scope == "context":
        post = post.withColumnRenamed("context_id", "q_context_id")
        cond = ["token", "q_context_id"]
    hits = post.join(side, cond)
    if scope == "context":
        hits = hits.withColumn("context_id", F.col("q_context_id"))
    tf = F.col("tf").cast("double")
    norm = F.lit(K.BM25_K1) * (F.lit(1.0 - K.BM25_B) + F.lit(K.BM25_B) * F.col("dl") / avgdl)
    term = F.col("idf") * tf * F.lit(K.BM25_K1 + 1.0) / (tf + norm)
    return (hits.groupBy("query_id", "q_context_id", *carry, "id", *FRAGMENT_KEYS)
            .agg(F.round(F.sum(term), K.TEXT_SCORE_DIGITS).alias("full_text_score")))


def context_post_filter(hits: DataFrame) -> DataFrame:
    """Keep the hits that belong to the query's own context (after the limit)."""
    return hits.where(F.col("context_id") == F.col("q_context_id"))


def fulltext_rank(hits: DataFrame) -> DataFrame:
    """``RANK() OVER (ORDER BY full_text_score DESC)`` per query; ties share a
    rank and leave gaps."""
    w = Window.partitionBy("query_id").orderBy(F.col("full_text_score").desc_nulls_first())
    return hits.withColumn("full_text_rank", F.rank().over(w).cast("long"))
