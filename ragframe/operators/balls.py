"""Exact nearest-neighbour search that skips what can't hold a neighbour.

The fragments of a context are cut into balls: fragments near one of a few pivots (by
angle) are stored as files of their own, and a table has each ball's pivot and radius. By
the triangle inequality of angles no fragment of a ball is nearer to a query than
``angle(query, pivot) - radius``. A search first asks each query's most promising balls, which
gives it a bound (its limit-th best distance); balls beyond the bound are then skipped for
this query, and files that no query needs aren't read. What is left is searched exactly, so
the rows are those of ``semantic_search``.

Vectors without a direction, of another length or NULL are in a ball without a radius bound,
which is never skipped, and so are queries of that kind not pruned. A ball holds at most
``ROWS`` fragments or so: large ones are dealt to several files with one pivot."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe import constants as K
from ragframe.operators.fulltext import max_limit
from ragframe.operators.vectors import (ASSIGN_ROWS, FRAGMENT_KEYS, _cell_kernel, _nearest, _query_table, _unit, _vectors, ivf_train,
                                        query_blocks)
from ragframe.session import checkpoint, ensure_checkpoint_dir

#: Rows of a ball, on average, and pivots at most.
ROWS = 1000
MAX_PIVOTS = 4096
#: Balls that a query asks first, beyond as many as hold its limit.
FIRST = 2
#: Added to every bound: above the rounding of distances and angles.
SLACK = 1e-6


@dataclass
class BallIndex:
    """``pivots``: k x d unit vectors. ``rows``: fragments with their ``cell`` (k for those
    without a direction), stored by it. ``balls``: context, cell, n and radius (angle)."""
    pivots: np.ndarray
    rows: DataFrame
    balls: DataFrame


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the nearest pivot's number and the angle to it (k and NULL without a direction)."""
    k, at = len(pivots), rows.columns.index("embedding")
    schema = T.StructType(rows.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches):
        for batch in batches:
            found, ok = _vectors(batch.column(at), pivots.shape[1])
            norm = np.linalg.norm(found, axis=1)
            good = (norm > 0) & np.isfinite(norm)
            cell, angle = np.full(batch.num_rows, k, np.int32), np.full(batch.num_rows, np.nan)
            place = np.nonzero(ok)[0][good]
            unit = found[good] / norm[good, None]
            for lo in range(0, len(place), ASSIGN_ROWS):
                cos, some = np.clip(unit[lo:lo + ASSIGN_ROWS] @ pivots.T, -1, 1), place[lo:lo + ASSIGN_ROWS]
                cell[some] = cos.argmax(axis=1)
                angle[some] = np.arccos(cos.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle, from_pandas=True)], [*batch.schema.names, "cell", "angle"])

    return rows.mapInArrow(run, schema)


def ball_build(fragments: DataFrame, path: str | None = None, n_pivots: int | None = None, max_iter: int = 10) -> BallIndex:
    """Fits pivots (k-means over unit vectors) and stores the fragments by ball, once per
    version of the table. ``n_pivots`` None: one for ``ROWS`` fragments."""
    spark = fragments.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/balls-{uuid.uuid4().hex}"
    rows = fragments.select("id", *FRAGMENT_KEYS, "embedding")
    directed = rows.where(F.exists("embedding", lambda x: x != 0))
    lengths = directed.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is not None:  # vectors of another length than most are as if they had no direction
        dim, n = lengths
        directed = directed.where(F.size("embedding") == dim)
        units = directed.select(_unit("embedding").alias("u")).where(F.col("u").isNotNull())
        one = units.first()
        if one is None:
            pivots = np.zeros((1, dim))
        elif not units.where(F.col("u") != F.lit(list(one["u"]))).take(1):  # k-means wants two different vectors
            pivots = np.array([one["u"]])
        else:
            model = ivf_train(directed, max(2, n_pivots or min(MAX_PIVOTS, -(-n // ROWS))), max_iter=max_iter)
            pivots = np.array(model.clusterCenters())
        norm = np.linalg.norm(pivots, axis=1, keepdims=True)
        pivots = pivots / np.where(norm > 0, norm, 1)
    else:
        pivots = np.zeros((1, max(1, fragments.agg(F.max(F.size("embedding"))).first()[0] or 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _assign(rows, pivots)
    (placed.repartitionByRange(parts, "cell", "context_id", "id").sortWithinPartitions("cell", "context_id", "id")
     .write.partitionBy("cell").parquet(f"{path}/rows"))
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    balls = stored.groupBy("context_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    balls.write.parquet(f"{path}/balls")
    return BallIndex(pivots, stored.drop("angle"), spark.read.schema(balls.schema).parquet(f"{path}/balls"))


def _nearest_possible(table: dict, index: BallIndex, balls: pa.Table) -> dict:
    """By context: (queries x balls) the least distance that a fragment of each ball can
    have (infinite where the context has none), and the balls' rows."""
    k, out = len(index.pivots) + 1, {}
    held = {c: (np.zeros(k, np.int64), np.zeros(k)) for c in table}
    for c, cell, n, radius in zip(*(balls.column(x).to_pylist() for x in ("context_id", "cell", "n", "radius"))):
        held[c][0][cell], held[c][1][cell] = n, np.pi if radius is None else radius
    for name, (_, mat, ok) in table.items():
        n, radius = held[name]
        q = mat.astype(np.float64)
        norm = np.linalg.norm(q, axis=1)
        plain = ~ok | (norm == 0) | (mat.shape[1] != index.pivots.shape[1])
        least = np.zeros((len(q), k))
        if not plain.all():
            cos = np.clip(q[~plain] @ index.pivots.T / norm[~plain, None], -1, 1)
            least[~plain, :-1] = 1 - np.cos(np.maximum(np.arccos(cos) - radius[:-1] - SLACK, 0))
        out[name] = np.where(n > 0, least, np.inf), n
    return out


def ball_search(queries: DataFrame, index: BallIndex, limit_col: str = "_sem_limit", limit_cap: int | None = None,
                blocks: int | None = None, report: list | None = None) -> DataFrame:
    """The rows of ``semantic_search``. ``report`` gets a row for each block of queries:
    (files of balls that exist, files read, distances of all rows of the contexts, distances
    computed).

    Queries go in blocks of checked size, each block's result is stored before the next."""
    cap = max_limit(queries, limit_col) if limit_cap is None else max(int(limit_cap), 1)
    blocks = query_blocks(queries) if blocks is None else blocks
    sc, keys, out = queries.sparkSession.sparkContext, ["id", *FRAGMENT_KEYS], None
    schema = T.StructType([index.rows.schema[k] for k in keys] + [queries.schema["query_id"], T.StructField("semantic_score", T.DoubleType()),
                                                                  queries.schema[limit_col]])

    def found(table, masks):
        cells = np.nonzero(np.any([m.any(axis=0) for m in masks.values()], axis=0))[0].tolist() if masks else []
        contexts = [c for c, m in masks.items() if m.any()]
        rows = index.rows.where(F.col("cell").isin(cells or [-1]) & F.col("context_id").isin(contexts))
        kernel = _cell_kernel(sc.broadcast((table, masks)), keys, [limit_col], cap)
        return _nearest(rows.select(*keys, "embedding", "cell").mapInArrow(kernel, schema), limit_col, cap), cells

    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        table = _query_table(block, [limit_col])
        wanted = F.broadcast(block.select("context_id").distinct())
        least = _nearest_possible(table, index, index.balls.join(wanted, "context_id").toArrow())
        first = {}
        for name, (d, n) in least.items():
            limit = np.array([x or 0 for x in table[name][0].column(limit_col).to_pylist()])
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            mask = np.zeros(d.shape, bool)
            np.put_along_axis(mask, order, (np.arange(d.shape[1]) < FIRST) | (before < limit[:, None]), axis=1)
            first[name] = mask & np.isfinite(d)
        near, read = found(table, first)
        near = checkpoint(near)  # at most limit rows a query of the block
        worst = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("semantic_score").alias("d"), F.max(limit_col).alias("k"))
        bound = {r["query_id"]: r["d"] for r in worst.collect() if r["n"] >= r["k"] and r["d"] is not None and math.isfinite(r["d"])}
        rest = {}
        for name, (d, _) in least.items():
            upto = np.array([bound.get(q, np.inf) for q in table[name][0].column("query_id").to_pylist()]) + 10.0**-K.DISTANCE_DIGITS
            rest[name] = (d <= upto[:, None]) & np.isfinite(d) & ~first[name]
        more, again = found(table, rest)
        top = checkpoint(_nearest(near.unionByName(more), limit_col, cap))
        out = top if out is None else out.unionByName(top)
        if report is not None:
            sizes = {name: n for name, (_, n) in least.items()}
            report.append((sum(int((n > 0).sum()) for n in sizes.values()),
                           sum(int(((first[c] | rest[c]).any(axis=0) & (n > 0)).sum()) for c, n in sizes.items()),
                           sum(int(n.sum()) * len(table[c][1]) for c, n in sizes.items()),
                           sum(int(((first[c] | rest[c]) * n).sum()) for c, n in sizes.items())))
    return out
