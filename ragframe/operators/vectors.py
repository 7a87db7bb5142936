"""Vector retrieval: cosine distance, exact per-context top-k, ranks, IVF
approximate search, and embedding of chunks/queries (B5, C7-C10, C17).

Distributed form of ``semantic_search``: the query batch is sent to the fragment
table in blocks of checked size and met with it by ``context_id``, so the
fragment table -- the big side -- is only scanned, never shuffled, and a
context holding a third of all fragments is spread over all scan tasks. The
distances are computed map-side (numpy on Arrow batches, or native
higher-order functions), the per-query limit becomes a partial
``WindowGroupLimit`` before the only exchange, which moves at most
``limit`` rows per query per task.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ragframe import constants as K
from ragframe.functions import plugins
from ragframe.functions.text import embedding_input
from ragframe.functions.vector import cosine_distance_batch, cosine_distance_expr, stack
from ragframe.operators.fulltext import max_limit
from ragframe.session import checkpoint, ensure_checkpoint_dir, measured

FRAGMENT_KEYS = ["context_id", "document_id", "fragment_index"]
MAX_BLOCK_CELLS = 4_000_000   # distance-matrix cells per numpy product (~32 MB)
BLOCK_BYTES = 32 * 1024 * 1024  # query vectors and settings sent to every task at once
MAX_IVF_CELLS = 4096
TRAIN_ROWS = 100_000          # fragments that cells are fitted to, at most or so
ASSIGN_ROWS = 1024            # rows met with all centers at once


def _distance_kernel(left: str, right: str, out: str):
    def run(batches):
        for pdf in batches:
            lv, rv = pdf[left], pdf[right]
            ok = (lv.notna() & rv.notna()).to_numpy()
            dist = np.full(len(pdf), np.nan)
            zero = np.zeros(len(pdf), dtype=bool)
            if ok.any():
                d = cosine_distance_batch(stack(lv[ok]), stack(rv[ok]))
                zero[ok] = np.isnan(d)
                dist[ok] = np.where(np.isnan(d), 0.0, d)
            res = pdf.drop(columns=[left, right])
            res[out] = dist
            res["_zero"] = zero
            res["_null"] = ~ok
            yield res
    return run


def cosine_distance(pairs: DataFrame, left: str = "q_vec", right: str = "embedding",
                    out: str = "semantic_score", method: str = "arrow") -> DataFrame:
    """``1 - cos`` between two array columns, double. NaN when a vector has
    zero norm, NULL when a vector is NULL. ``method='arrow'`` runs a numpy kernel
    over Arrow batches (``mapInPandas``); ``'sql'`` uses native expressions."""
    if method == "sql":
        return pairs.withColumn(out, cosine_distance_expr(left, right)).drop(left, right)
    keep = [f for f in pairs.schema.fields if f.name not in (left, right)]
    schema = T.StructType(keep + [T.StructField(out, T.DoubleType()),
                                  T.StructField("_zero", T.BooleanType()),
                                  T.StructField("_null", T.BooleanType())])
    res = pairs.mapInPandas(_distance_kernel(left, right, out), schema)
    # NaN must survive the trip back from pandas (Arrow maps NaN to null).
    return res.withColumn(out, F.when(F.col("_null"), F.lit(None).cast("double"))
                          .when(F.col("_zero"), F.lit(float("nan")))
                          .otherwise(F.col(out))).drop("_zero", "_null")


def _vectors(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(float64 matrix of the usable rows, mask of usable rows) of an array
    column: one reshape of its flattened values. NULL vectors and vectors of
    another length are not usable (their distance is NULL)."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    ok = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False).astype(bool)
    flat = col.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim), ok


def _block_kernel(bc, keys: list[str], carry: list[str], cap: int, group_col: str = "context_id",
                  max_cells: int = MAX_BLOCK_CELLS):
    """numpy block product: for each group present in an Arrow batch, distances =
    1 - (E @ Q^T) / (|E| |Q|); keep, per query, the rows whose raw distance is
    within 1e-8 of the batch's k-th smallest (a superset of the batch's share of
    the exact, rounded top-k; the final cut is Spark's). Undefined (NaN) and NULL
    distances rank last, so of each the ``cap`` smallest ids are kept."""
    def run(batches):
        table = bc.value
        for batch in batches:
            coded = batch.column(batch.schema.get_field_index(group_col)).dictionary_encode()
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                if name not in table:
                    continue
                part = batch.take(pa.array(np.nonzero(codes == code)[0]))
                part = part.take(pc.sort_indices(part.column(part.schema.get_field_index("id"))))
                # bound the distance matrix: rows x queries <= max_cells
                step = max(1, max_cells // max(len(table[name][1]), 1))
                for lo in range(0, part.num_rows, step):
                    yield _score_block(part.slice(lo, step), *table[name], keys, carry, cap)
    return run


def _score_block(part, queries, qmat, qok, keys, carry, cap):
    """Distances of one slice of fragments (by id) to one group's queries; keeps
    the slice's share of each query's top-``cap``."""
    n, dim = part.num_rows, qmat.shape[1]
    e, ok = _vectors(part.column(part.schema.get_field_index("embedding")), dim)
    q = qmat.astype(np.float64)
    dist = np.full((n, len(q)), np.nan)
    if ok.any() and dim:
        norms = np.outer(np.sqrt(np.einsum("ij,ij->i", e, e)), np.sqrt(np.einsum("ij,ij->i", q, q)))
        with np.errstate(divide="ignore", invalid="ignore"):
            dist[ok] = np.where(norms == 0, np.nan, 1.0 - (e @ q.T) / norms)
    null = ~ok[:, None] | ~qok[None, :]
    finite = ~np.isnan(dist) & ~null
    keep = finite
    if n > cap:
        ranked = np.where(finite, dist, np.inf)
        keep = finite & (ranked <= np.partition(ranked, cap - 1, axis=0)[cap - 1] + 1e-8)
    for last in (~finite & ~null, null):
        keep = keep | (last & (np.cumsum(last, axis=0) <= cap))
    rows, cols = np.nonzero(keep)
    out = [part.column(part.schema.get_field_index(k)).take(pa.array(rows)) for k in keys]
    out.append(queries.column("query_id").combine_chunks().take(pa.array(cols)))
    out.append(pa.array(dist[rows, cols], pa.float64(), mask=null[rows, cols], from_pandas=False))
    out += [queries.column(c).combine_chunks().take(pa.array(cols)) for c in carry]
    return pa.RecordBatch.from_arrays(out, [*keys, "query_id", "semantic_score", *carry])


def _query_table(queries: DataFrame, carry: list[str], group_col: str = "context_id") -> dict:
    """Per group (context, or context and cell): the queries' ids and settings
    (Arrow), their float32 matrix and which of them have a vector. Called only
    on a block whose bytes were checked."""
    rows = queries.select("query_id", group_col, "embedding", *carry).toArrow().combine_chunks()
    sizes = pc.max(pc.list_value_length(rows.column("embedding"))).as_py() or 0
    table = {}
    groups = np.array(rows.column(group_col).to_pylist(), dtype=object)
    for name in dict.fromkeys(groups.tolist()):
        if name is None:
            continue
        part = rows.take(pa.array(np.nonzero(groups == name)[0]))
        found, ok = _vectors(part.column("embedding"), sizes)
        mat = np.zeros((part.num_rows, sizes), dtype=np.float32)
        mat[ok] = found
        table[name] = (part.select(["query_id", *carry]), mat, ok)
    return table


def _spark_context(df: DataFrame):
    try:
        return df.sparkSession.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (Connect): row-wise kernel
        return None


def _block_scores(sc, queries: DataFrame, frags: DataFrame, carry: list[str], cap: int,
                  group_col: str, max_cells: int = MAX_BLOCK_CELLS) -> DataFrame:
    """Distances of every fragment to the queries of its group, per Arrow batch,
    keeping each batch's share of the top-``cap`` (see :func:`_block_kernel`)."""
    bc = sc.broadcast(_query_table(queries, carry, group_col))
    qschema = queries.select("query_id", *carry).schema
    keys = ["id", *FRAGMENT_KEYS]
    schema = T.StructType([frags.schema[k] for k in keys] + [qschema["query_id"], T.StructField("semantic_score", T.DoubleType())]
                          + [qschema[c] for c in carry])
    return frags.mapInArrow(_block_kernel(bc, keys, carry, max(int(cap), 1), group_col, max_cells), schema)


def _nearest(scored: DataFrame, limit_col: str, cap: int) -> DataFrame:
    """The ``limit`` nearest rows of each query: NULLs last, ties by id."""
    scored = scored.withColumn("semantic_score", F.round("semantic_score", K.DISTANCE_DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.col("semantic_score").asc_nulls_last(), F.col("id").asc())
    return (scored.withColumn("_rn", F.row_number().over(w))
            .where((F.col("_rn") <= F.col(limit_col)) & (F.col("_rn") <= F.lit(cap))).drop("_rn"))


def query_blocks(queries: DataFrame, max_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that the batch is cut into so that one block's vectors and settings
    take at most ``max_bytes``, from one measuring aggregate."""
    small = queries.select(*[c for c in queries.columns if c not in ("query", "retrieval_settings")])
    return max(1, -(-measured(small)[1] // max_bytes))


def semantic_search(queries: DataFrame, fragments: DataFrame, limit_col: str = "_sem_limit",
                    limit_cap: int | None = None, blocks: int | None = None, method: str = "block", carry=(),
                    block_cells: int = MAX_BLOCK_CELLS) -> DataFrame:
    """The ``limit`` nearest fragments of the query's context.

    The fragment table is only scanned, never shuffled: queries are sent to it in
    ``blocks`` of checked size (None: measured), one scan for each. With more than
    one, each block's result is stored before the next block is sent, so the
    driver and the tasks hold one block at a time.

    ``method='block'`` (default) ships the query matrix of each context to the
    tasks and multiplies every Arrow batch of fragment vectors against it -- each
    fragment vector crosses to Python once, whatever the number of queries.
    ``'arrow'`` joins fragments to the broadcast block on context and computes
    row-wise distances; ``'sql'`` does the same with native expressions.

    A query with a NULL vector, or a fragment with one, has NULL distance and
    ranks last, on every path. ``limit_cap`` is the batch's largest limit (None:
    read from ``limit_col``).

    Output: query_id, id, context_id, document_id, fragment_index,
    semantic_score (rounded distance), limit column, ``carry`` columns."""
    carry = [limit_col] + [c for c in carry if c != limit_col]
    if limit_cap is None:
        limit_cap = max_limit(queries, limit_col)
    if blocks is None:
        blocks = query_blocks(queries)
    f = fragments.select("id", *FRAGMENT_KEYS, "embedding")
    sc = _spark_context(queries) if method == "block" else None
    results = []
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        if sc is not None:
            scored = _block_scores(sc, block, f, carry, limit_cap, "context_id", block_cells)
        else:
            q = block.select("query_id", "context_id", F.col("embedding").alias("q_vec"), *carry)
            scored = cosine_distance(f.join(F.broadcast(q), "context_id"), "q_vec", "embedding", "semantic_score",
                                     "sql" if method == "sql" else "arrow")
        top = _nearest(scored, limit_col, limit_cap)
        results.append(top if blocks == 1 else checkpoint(top))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def semantic_rank(hits: DataFrame) -> DataFrame:
    """``RANK() OVER (ORDER BY semantic_score)`` per query, nulls last."""
    w = Window.partitionBy("query_id").orderBy(F.col("semantic_score").asc_nulls_last())
    return hits.withColumn("semantic_rank", F.rank().over(w).cast("long"))


# --------------------------------------------------------------------------
# Embedding
# --------------------------------------------------------------------------

def _embed_kernel(embedder, text_col: str, out_col: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            vecs = embedder(pd.Series(texts, dtype=object)) if texts else []
            if len(vecs) != len(texts):  # no telling which vector is whose: the batch has none
                vecs = [None] * len(texts)
            made = pd.Series([None if v is None else np.asarray(v, dtype=np.float32) for v in vecs], dtype=object)
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.Array.from_pandas(made, type=pa.list_(pa.float32()))],
                                             [*[batch.schema.names[i] for i in rest], out_col])
    return run


def embed_texts(rows: DataFrame, text_col: str, embedder=None, out_col: str = "embedding",
                dim: int = 64) -> DataFrame:
    """Run a batch embedder over a text column (Arrow batches, no shuffle).
    The text column is replaced by ``out_col`` array<float>; every other column
    (the keys) travels with its row as it is, so no positional re-zipping is needed."""
    embedder = embedder or plugins.hashed_embedder(dim)
    keep = [f for f in rows.schema.fields if f.name != text_col]
    schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.FloatType()))])
    return rows.select(*[f.name for f in keep], text_col).mapInArrow(_embed_kernel(embedder, text_col, out_col), schema)


def embed_chunks(chunks: DataFrame, embedder=None, dim: int = 64,
                 expected_dim: int | None = None) -> DataFrame:
    """Vectors for chunks; the embedding input is the metadata lines plus
    ``"\\n" + text``. With ``expected_dim`` a ``dim_ok`` flag marks vectors of
    the wrong length (the caller sends them to a rejects output)."""
    inp = chunks.withColumn("_input", embedding_input("metadata", "value"))
    out = embed_texts(inp, "_input", embedder, "embedding", dim)
    if expected_dim is not None:
        out = out.withColumn("dim_ok", F.coalesce(F.size("embedding") == F.lit(expected_dim), F.lit(False)))
    return out


def embed_queries(queries: DataFrame, embedder=None, dim: int = 64) -> DataFrame:
    """C17: a query is embedded as a single chunk with empty metadata, i.e. the
    input is ``"\\n" + query``."""
    inp = queries.withColumn("_input", F.concat(F.lit("\n"), F.col("query")))
    if "embedding" in inp.columns:
        inp = inp.drop("embedding")
    return embed_texts(inp, "_input", embedder, "embedding", dim)


# --------------------------------------------------------------------------
# Approximate search (C10): inverted-file cells
# --------------------------------------------------------------------------

def _unit(col: str):
    from ragframe.functions.vector import norm_expr
    # the norm is a variable of the outer function: inside the inner one it would be
    # computed again for each element
    scaled = F.transform(F.array(norm_expr(col)), lambda n: F.when(n > 0, F.transform(F.col(col), lambda x: x.cast("double") / n)))
    return F.element_at(scaled, 1)


def ivf_train(fragments: DataFrame, n_cells: int = 16, seed: int = 7, max_iter: int = 20):
    """Train IVF centroids with distributed k-means (``pyspark.ml``) over the
    unit vectors of a sample: at most ``TRAIN_ROWS`` fragments or so, chosen by the hash
    of their id (a smaller table is used whole). Every row gets a cell; what is
    searched doesn't depend on the sample. Many cells start from random rows.
    Returns the fitted model."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = -(-fragments.count() // TRAIN_ROWS)
    if share > 1:
        fragments = fragments.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    units = fragments.select(_unit("embedding").alias("u")).where(F.col("u").isNotNull())
    data = units.select(array_to_vector("u").alias("features"))
    return KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cell",
                  initMode="random" if share > 1 else "k-means||").fit(data)


def ivf_assign(model, rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Add the nearest cell of every row (a map-side block product)."""
    centers = np.array(model.clusterCenters())
    size, at = (centers * centers).sum(axis=1), rows.columns.index(vec_col)
    schema = T.StructType(rows.schema.fields + [T.StructField("cell", T.IntegerType())])

    def run(batches):
        for batch in batches:
            found, ok = _vectors(batch.column(at), centers.shape[1])
            norm = np.linalg.norm(found, axis=1)
            good = (norm > 0) & np.isfinite(norm)
            # a vector without a direction has a cell like any other, and is found in it
            unit = np.zeros((batch.num_rows, centers.shape[1]))
            unit[np.nonzero(ok)[0][good]] = found[good] / norm[good, None]
            cell = np.empty(batch.num_rows, np.int32)
            for lo in range(0, batch.num_rows, ASSIGN_ROWS):
                cell[lo:lo + ASSIGN_ROWS] = (size - 2 * (unit[lo:lo + ASSIGN_ROWS] @ centers.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, schema)


@dataclass
class IvfIndex:
    """Stored cells. ``centers``: k x d unit centroids. ``cells``: fragments with
    their ``cell``, stored partitioned by cell. ``sizes``: rows by context and cell."""
    centers: np.ndarray
    cells: DataFrame
    sizes: DataFrame


def ivf_build(fragments: DataFrame, path: str | None = None, n_cells: int | None = None, max_iter: int = 10) -> IvfIndex:
    """Train on and store the cells of a fragment table, once per version of it.
    ``n_cells`` None: the square root of the number of fragments."""
    spark = fragments.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/ivf-{uuid.uuid4().hex}"
    n_cells = n_cells or max(1, min(MAX_IVF_CELLS, math.isqrt(fragments.count())))
    model = ivf_train(fragments, n_cells, max_iter=max_iter)
    placed = ivf_assign(model, fragments.select("id", *FRAGMENT_KEYS, "embedding"))
    placed.repartition("cell").sortWithinPartitions("context_id").write.partitionBy("cell").parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    cells.groupBy("context_id", "cell").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/sizes")
    return IvfIndex(np.array(model.clusterCenters()), cells, spark.read.parquet(f"{path}/sizes"))


def _probed(table: dict, index: IvfIndex, sizes: pa.Table, n_probe: int, limit_col: str) -> dict:
    """By context of the block, which cells each of its queries searches (queries x cells):
    the ``n_probe`` nearest ones with rows of the context, and as many more as hold the
    query's limit. A query without a direction searches all of them."""
    k = len(index.centers)
    held = {c: np.zeros(k, np.int64) for c in table}
    for c, cell, n in zip(*(sizes.column(x).to_pylist() for x in ("context_id", "cell", "n"))):
        held[c][cell] = n
    out = {}
    for name, (queries, mat, ok) in table.items():
        full = held[name] > 0
        norm = np.sqrt(np.einsum("ij,ij->i", mat, mat, dtype=np.float64))
        plain = ~ok | (norm == 0)
        if mat.shape[1] != index.centers.shape[1]:
            out[name] = np.repeat(full[None], len(mat), axis=0)
            continue
        near = np.where(full, mat.astype(np.float64) @ index.centers.T / np.where(plain, 1, norm)[:, None], -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.cumsum(held[name][order], axis=1) - held[name][order]
        limit = np.array([n or 0 for n in queries.column(limit_col).to_pylist()])
        take = (np.arange(k) < n_probe) | (before < limit[:, None])
        mask = np.zeros((len(mat), k), bool)
        np.put_along_axis(mask, order, take, axis=1)
        out[name] = (mask | plain[:, None]) & full
    return out


def _cell_kernel(bc, keys: list[str], carry: list[str], cap: int):
    """:func:`_block_kernel` over stored cells: the rows of a (context, cell) meet the
    queries of the context that search this cell."""
    def run(batches):
        table, probed = bc.value
        for batch in batches:
            ctx = batch.column(batch.schema.get_field_index("context_id")).dictionary_encode()
            cell = batch.column(batch.schema.get_field_index("cell")).to_numpy(zero_copy_only=False).astype(np.int64)
            names = ctx.dictionary.to_pylist()
            codes = pc.fill_null(ctx.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.where(codes < 0, -1, codes * (cell.max(initial=0) + 1) + cell)
            for g in np.unique(group[group >= 0]):
                name, c = names[g // (cell.max() + 1)], g % (cell.max() + 1)
                if name not in table:
                    continue
                asked = np.nonzero(probed[name][:, c])[0]
                if not len(asked):
                    continue
                queries, mat, ok = table[name]
                part = batch.take(pa.array(np.nonzero(group == g)[0]))
                part = part.take(pc.sort_indices(part.column(part.schema.get_field_index("id"))))
                chosen = queries.take(pa.array(asked)), mat[asked], ok[asked]
                step = max(1, MAX_BLOCK_CELLS // len(asked))
                for lo in range(0, part.num_rows, step):
                    yield _score_block(part.slice(lo, step), *chosen, keys, carry, cap)
    return run


def ann_search(queries: DataFrame, index: IvfIndex, n_probe: int | None = None, limit_col: str = "_sem_limit",
               limit_cap: int | None = None, blocks: int | None = None) -> DataFrame:
    """C10 over stored cells. A query searches the ``n_probe`` nearest cells that hold rows
    of its context (None: two thirds of all, for a recall over 0.95 on vectors that are
    hardly clustered), and more until they hold its limit, so it gets min(limit, rows of its
    context) rows; with all cells the result is exactly ``semantic_search``'s. The scan reads
    the partitions of the probed cells only. A block's vectors go to the tasks once, with a
    bit for each query and cell."""
    if limit_cap is None:
        limit_cap = max_limit(queries, limit_col)
    if blocks is None:
        blocks = query_blocks(queries)
    n_probe = n_probe or max(8, 2 * len(index.centers) // 3)
    sc, out = queries.sparkSession.sparkContext, None
    keys = ["id", *FRAGMENT_KEYS]
    schema = T.StructType([index.cells.schema[k] for k in keys] + [queries.schema["query_id"], T.StructField("semantic_score", T.DoubleType()),
                                                                   queries.schema[limit_col]])
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        table = _query_table(block, [limit_col])
        wanted = F.broadcast(block.select("context_id").distinct())
        probed = _probed(table, index, index.sizes.join(wanted, "context_id").toArrow(), n_probe, limit_col)
        cells = np.nonzero(np.any([m.any(axis=0) for m in probed.values()], axis=0))[0].tolist() if probed else []
        rows = index.cells.where(F.col("cell").isin(cells or [-1]))
        kernel = _cell_kernel(sc.broadcast((table, probed)), keys, [limit_col], max(int(limit_cap), 1))
        top = _nearest(rows.select(*keys, "embedding", "cell").mapInArrow(kernel, schema), limit_col, limit_cap)
        top = top if blocks == 1 else checkpoint(top)
        out = top if out is None else out.unionByName(top)
    return out


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per-query recall of an approximate result against the exact one."""
    e = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"))
    hit = approx.join(exact.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hit"))
    return (e.join(hit, "query_id", "left")
            .select("query_id", (F.coalesce(F.col("n_hit"), F.lit(0)) / F.col("n_exact")).alias("recall")))
