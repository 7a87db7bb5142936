"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products.

Equal vectors of a label are collapsed first. Centroids are fitted on a bounded sample
by spherical k-means; every distinct vector is at home in the cell of its nearest
centroid. Two unit vectors with cosine >= c are at most r = sqrt(2 - 2c) apart, so a
vector whose near copy may be at home in another cell lies within r of the plane that
parts the two cells; it is a guest there. Every home vector therefore meets all its near
copies in its own cell: cells lose no link.

Within (label, cell) the vectors are dealt into blocks of bounded size, and each pair of
blocks is one product of matrices in double precision. A pair of blocks gives a count
for each home vector and edges of a spanning forest, never its pairs, so a cell that
holds a third of all vectors is spread over many tasks and its output stays linear.
The representative of a component is its smallest id."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import broadcast_up_to, components, grouped, join_group, shared_table

#: The sample that centroids are fitted on: rows for each cell, and bytes at most.
SAMPLE_PER_CELL, SAMPLE_BYTES = 32, 32 << 20
MAX_CELLS = 4096
BLOCK = 512
MAX_BROADCAST_ROWS = 200_000


def fit_cells(unit: np.ndarray, cells: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Spherical k-means: unit centroids of the rows of ``unit``."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(unit))
    centre = unit[rng.choice(len(unit), cells, replace=False)]
    for _ in range(rounds):
        near = (unit @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centre)
    return centre


def cells_of(unit: np.ndarray, centre: np.ndarray, reach: float):
    """For each row its home cell, and a matrix of the cells it belongs to at all."""
    dots = unit @ centre.T
    home = dots.argmax(1)
    gap = dots[np.arange(len(unit)), home][:, None] - dots
    apart = np.sqrt(np.maximum(2 - 2 * (centre @ centre.T), 0))[home]
    return home, gap <= reach * apart + 1e-9


def _unit(vec: np.ndarray) -> np.ndarray:
    return vec / np.linalg.norm(vec, axis=-1, keepdims=True)


def _settle(near: np.ndarray, home_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest member column reachable in the graph of home rows and member columns;
    ``home_of`` is the column of a home row's own vector, or -1."""
    n = near.shape[1]
    cols = np.arange(n)
    rows = np.full(len(near), n)
    while True:
        new_rows = np.minimum(rows, np.where(near, cols[None, :], n).min(1, initial=n))
        own = home_of >= 0
        new_rows[own] = np.minimum(new_rows[own], cols[home_of[own]])
        new_cols = np.minimum(cols, np.where(near, new_rows[:, None], n).min(0, initial=n))
        np.minimum.at(new_cols, home_of[own], new_rows[own])
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    min_cosine: float = 0.98, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, itself included) and kept (vec_id =
    component_id).

    Rows link if their labels are equal and not null, their vectors have equal length
    and the cosine in double precision is at least ``min_cosine`` (above 0). Vectors
    that are null, empty, zero or hold null or non-finite components, and rows with a
    null label, link with nothing. A null vec_id links but names no component (its rows
    are kept if no other id does). Repeated rows link with each other and are returned
    as often as given; an empty table gives no rows."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0)
    plain = F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x))  # one zero
    node = F.concat(F.lpad(F.hex(F.xxhash64("label", "vec")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "vec", "label")), 16, "0"))
    rows = rows.withColumn("vec", plain).withColumn("node", F.when(F.coalesce(usable, F.lit(False)), node))
    linkable = rows.where("node IS NOT NULL").withColumn("dim", F.size("vec"))
    classes = shared_table(linkable.groupBy("node").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"),
                                                        F.count("*").alias("weight"), F.min("vec_id").alias("first_id")), "vectors")
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    cells = cells or max(1, min(MAX_CELLS, math.isqrt(n) // 4))
    most = max(cells, min(SAMPLE_PER_CELL * cells, SAMPLE_BYTES // (8 * dim)))
    some = classes.orderBy(F.xxhash64("node"), "node").limit(most).select("vec").collect()
    sample = np.zeros((len(some), dim))
    for i, r in enumerate(some):
        sample[i, :len(r.vec)] = np.array(r.vec) / np.abs(r.vec).max()
    centre = fit_cells(_unit(sample), cells)
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine))

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column("vec").to_pylist()
                unit = np.zeros((len(raw), dim))
                for i, v in enumerate(raw):
                    unit[i, :len(v)] = np.array(v) / np.abs(v).max()
                home, member = cells_of(_unit(unit), centre, reach)
                row, cell = np.nonzero(member)
                took = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[row])],
                                                 [*took.schema.names, "cell", "home"])

    placed = shared_table(classes.select("node", "label", "dim", "weight", "vec").mapInArrow(
        assign, f"node string, label {classes.schema['label'].dataType.simpleString()}, dim int, weight long, vec array<double>, cell int, home boolean"), "cells")
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("members"), F.count_if("home").alias("homes")).where("members > 1 AND homes > 0")
    sizes = shared_table(sizes.select(*key, F.ceil(F.col("homes") / block).cast("int").alias("rows"), F.ceil(F.col("members") / block).cast("int").alias("cols")), "cell-sizes")
    dealt = placed.join(broadcast_up_to(sizes, MAX_BROADCAST_ROWS), key)
    row_at, col_at = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node"), F.col("cols")).cast("int")
    units = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("j", col_at).withColumn("as_row", F.lit(False))
    units = units.unionByName(dealt.where("home").withColumn("i", row_at).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("as_row", F.lit(True)))

    def compare(_, group):
        as_row = group.column("as_row").to_numpy(zero_copy_only=False).astype(bool)
        names = np.array(group.column("node").to_pylist(), object)
        weight = group.column("weight").to_numpy()
        vecs = np.array(group.column("vec").to_pylist(), np.float64)
        vecs = _unit(vecs / np.abs(vecs).max(1, keepdims=True))
        homes, cols = names[as_row], names[~as_row]
        near = vecs[as_row] @ vecs[~as_row].T >= min_cosine
        at = {x: i for i, x in enumerate(cols)}
        own = np.array([at.get(x, -1) for x in homes], np.int64)
        near[np.arange(len(homes))[own >= 0], own[own >= 0]] = False
        links = near @ weight[~as_row]
        row_root, col_root = _settle(near, own)
        u, v, k = list(homes), list(homes), links.tolist()  # a loop carries the count
        linked = near.any(1)
        for i in np.nonzero(linked)[0]:
            u.append(homes[i]), v.append(cols[row_root[i]]), k.append(0)
        for j in np.nonzero(near.any(0))[0]:
            u.append(cols[j]), v.append(cols[col_root[j]]), k.append(0)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(k, pa.int64())], ["u", "v", "links"])

    found = shared_table(grouped(units.select("label", "dim", "cell", "i", "j", "node", "weight", "vec", "as_row"),
                                 [*key, "i", "j"], compare, "u string, v string, links long"), "embedding-links")
    roots = components(found.select("u", "v"))
    links = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("node", "weight", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = shared_table(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "embedding-least")
    named = join_group(named, least, "root", "members").join(links, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", "weight")
    return join_group(rows.select("vec_id", "node"), shared_table(named, "embedding-named"), "node", "weight", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
