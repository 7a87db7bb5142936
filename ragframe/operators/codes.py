"""Approximate vector search by binary codes.

A vector's code is the signs of its coordinates under a few fixed random rotations,
packed into longs. A search counts differing bits (``bit_count`` of ``xor``) of every
code of the query's context, takes the nearest ``shortlist`` rows and ranks them by the
exact distance. The codes are an eighth of the vectors' bytes or less, and only the
shortlist's vectors are compared.

The shortlist is found without sorting the pairs: one pass counts the rows of each query
by distance (at most bits + 3 counters a query, combined in each task), which gives the
distance where the shortlist ends; a second pass sorts only the rows up to it, of which
each task keeps no more than the shortlist's size. So a large group of equal vectors costs
what any other rows cost. Both passes are native."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ragframe.operators.fulltext import max_limit
from ragframe.operators.vectors import FRAGMENT_KEYS, _nearest, _vectors, cosine_distance, query_blocks
from ragframe.session import checkpoint, ensure_checkpoint_dir

BITS = 512
#: Rows of the shortlist for each row asked for.
OVERSAMPLE = 8
SHORTLIST_MAX_ROWS = 2_000_000


def rotations(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """dim x bits: random orthonormal bases side by side."""
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)[:, :bits]


def _words(bits: int) -> list[str]:
    return [f"code{i}" for i in range(bits // 64)]


def _codes(col: pa.Array, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as longs, state) of an array column: state 0, or 1 for a vector without a
    direction (all zero), 2 for none (NULL, or of another length); their codes are 0."""
    found, ok = _vectors(col, len(planes))
    packed = np.zeros((len(col), planes.shape[1] // 64), np.int64)
    packed[ok] = np.packbits(found @ planes >= 0, axis=1, bitorder="little").view(np.int64)
    state = np.full(len(col), 2, np.int32)
    state[ok] = np.where((found != 0).any(axis=1), 0, 1)
    packed[state > 0] = 0
    return packed, state


def encode(rows: DataFrame, dim: int, bits: int = BITS, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with the longs of their codes and ``state`` (see :func:`_codes`).
    ``bits`` is a multiple of 64."""
    names = _words(bits)
    schema = T.StructType(rows.schema.fields + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("state", T.IntegerType())])
    at, planes = rows.columns.index(vec_col), rotations(dim, bits)

    def run(batches):
        for batch in batches:
            packed, state = _codes(batch.column(at), planes)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in packed.T], pa.array(state)],
                                             [*batch.schema.names, *names, "state"])

    return rows.mapInArrow(run, schema)


@dataclass
class CodeIndex:
    """``codes``: id, keys and code of every fragment. ``vectors``: id and vector. Both
    stored by context."""
    codes: DataFrame
    vectors: DataFrame
    dim: int
    bits: int


def code_build(fragments: DataFrame, path: str | None = None, dim: int | None = None, bits: int = BITS) -> CodeIndex:
    """Codes of a fragment table, stored partitioned by context (once per version of it).
    ``dim`` None: the longest vector's length, by one aggregate."""
    spark = fragments.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    if dim is None:
        dim = max(1, fragments.agg(F.max(F.size("embedding"))).first()[0] or 1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = encode(fragments.select("id", *FRAGMENT_KEYS, "embedding"), dim, bits)
    placed = coded.repartitionByRange(n, "context_id", "id").sortWithinPartitions("context_id", "id")
    placed.write.partitionBy("context_id").parquet(f"{path}/index")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/index")
    return CodeIndex(stored.drop("embedding"), stored.select("context_id", "id", "embedding"), dim, bits)


def _distance(bits: int) -> Column:
    """Differing bits; bits + 1 where a vector has no direction, bits + 2 where there is none."""
    out = F.lit(0)
    for n in _words(bits):
        out = out + F.bit_count(F.col(n).bitwiseXOR(F.col(f"q_{n}")))
    worst = F.greatest("state", "q_state")
    return F.when(worst == 0, out).otherwise(F.lit(bits) + worst)


def shortlist(asked: DataFrame, index: CodeIndex, size_col: str, cap: int) -> DataFrame:
    """(query_id, id, keys) of the ``size_col`` rows of each query's context with the
    fewest differing bits (ties: smallest ids). ``asked``: query_id, context_id, the
    query's code (``q_`` columns) and ``size_col``, which is ``cap`` at most; a block of
    checked size, broadcast."""
    names = [f"q_{n}" for n in _words(index.bits)] + ["q_state"]
    q = F.broadcast(asked.select("query_id", "context_id", *names, size_col))
    pairs = index.codes.join(q, "context_id").withColumn("_d", _distance(index.bits))
    counts = pairs.groupBy("query_id", size_col, "_d").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("query_id").orderBy("_d")
    whole = F.col("upto") >= F.col(size_col)
    ends = (counts.withColumn("upto", F.sum("n").over(upto)).groupBy("query_id", size_col).agg(
        F.coalesce(F.min(F.when(whole, F.col("_d"))), F.max("_d")).alias("_end")).select("query_id", "_end").toArrow())  # one row a query of the block
    near = pairs.join(F.broadcast(asked.sparkSession.createDataFrame(ends)), "query_id").where(F.col("_d") <= F.col("_end"))
    w = Window.partitionBy("query_id").orderBy("_d", "id")
    return (near.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= F.col(size_col)) & (F.col("_rn") <= F.lit(cap)))
            .select("query_id", "id", *FRAGMENT_KEYS))


def code_search(queries: DataFrame, index: CodeIndex, limit_col: str = "_sem_limit", limit_cap: int | None = None,
                oversample: int = OVERSAMPLE, blocks: int | None = None) -> DataFrame:
    """The ``limit`` nearest rows of each query's context among its ``oversample`` x
    ``limit`` nearest ones by code, so min(limit, rows of its context) rows. With a shortlist
    of all rows the result is ``semantic_search``'s. A query without a direction is as far
    from all rows and gets the smallest ids, as there. Queries go in ``blocks`` of checked
    size (None: measured); with more than one, each block's result is stored before the next."""
    if limit_cap is None:
        limit_cap = max_limit(queries, limit_col)
    if blocks is None:
        blocks = query_blocks(queries)
    spark, names, planes, out = queries.sparkSession, [*_words(index.bits), "state"], rotations(index.dim, index.bits), None
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = block.select("query_id", "context_id", "embedding", limit_col).toArrow().combine_chunks()
        packed, state = _codes(pa.concat_arrays(rows.column("embedding").chunks) if rows.num_rows else pa.array([], pa.list_(pa.float32())), planes)
        for n, c in zip(names, [*packed.T, state]):
            rows = rows.append_column(f"q_{n}", pa.array(c))
        rows = rows.append_column("_short", pa.array([(n or 0) * oversample for n in rows.column(limit_col).to_pylist()], pa.int64()))
        asked = spark.createDataFrame(rows)
        found = shortlist(asked.drop("embedding"), index, "_short", limit_cap * oversample)
        if rows.num_rows * limit_cap * oversample <= SHORTLIST_MAX_ROWS:
            found = F.broadcast(found)
        vectors = index.vectors.where(F.col("context_id").isin(sorted(c for c in set(rows.column("context_id").to_pylist()) if c is not None)))
        def usable(c):  # a vector of another length is none
            return F.when(F.size(c) == index.dim, F.col(c))

        q = F.broadcast(asked.select("query_id", usable("embedding").alias("q_vec"), limit_col))
        pairs = vectors.select("id", usable("embedding").alias("embedding")).join(found, "id").join(q, "query_id")
        top = _nearest(cosine_distance(pairs, "q_vec", "embedding", "semantic_score"), limit_col, limit_cap)
        top = top if blocks == 1 else checkpoint(top)
        out = top if out is None else out.unionByName(top)
    return out
