"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.session import ensure_checkpoint_dir, measured, ship_package


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors, make sure a shared folder is known, and let
    Arrow batches hold fewer rows (whole texts are wide) unless the session says how many."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name`` with as many underscores behind it as no column needs."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; ``RAGFRAME_TOKENIZERS`` names another folder."""
    folder = os.environ.get("RAGFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: cuts
    lineage, survives executor loss, and is read as often as needed."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(stored: DataFrame, max_rows: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint for a stored table of at most ``max_rows`` rows and ``max_bytes``
    bytes, both measured; a larger one is left to a shuffle join (AQE splits its hot keys)."""
    rows, size = measured(stored)
    return F.broadcast(stored) if rows <= max_rows and size <= max_bytes else stored


def release_memory() -> None:
    """Gives what a finished task no longer uses back to the system: idle Python workers
    stay beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def text_batches(batches: Iterator[pa.RecordBatch], text_at: int, max_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose texts have about ``max_chars`` bytes at
    most (a longer text is a slice of its own), so memory follows the longest
    text and not the batch."""
    for batch in batches:
        col, start, used = batch.column(text_at), 0, 0
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        for i, n in enumerate(sizes):
            if used and used + n > max_chars:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if start < batch.num_rows:
            yield batch.slice(start)
    release_memory()


def grouped(df: DataFrame, keys: list[str], fn: Callable, schema: str, order: list[str] | None = None) -> DataFrame:
    """``fn(key_tuple, table) -> record batch or None`` for each group of ``keys``.
    Groups must be bounded by the caller. One shuffle, then a pass over the sorted
    partition that holds one group at a time."""
    out = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(order or []))

    def run(batches):
        key, parts = None, []

        def flush():
            if parts:
                got = fn(key, pa.Table.from_batches(parts))
                if got is not None and got.num_rows:
                    yield got

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            rows = list(zip(*cols))
            start = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i] != rows[start]:
                    if rows[start] != key:
                        yield from flush()
                        key, parts = rows[start], []
                    parts.append(batch.slice(start, i - start))
                    start = i
        yield from flush()

    return out.mapInArrow(run, schema)


#: Rows from which a group is joined by broadcast, and into how many keys the rows of such groups are spread.
HOT_ROWS, SPREAD = 1000, 4096


def join_group(rows: DataFrame, groups: DataFrame, key: str, size_col: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row for each ``key``, stored;
    ``size_col``, the group's number of rows, is left out). Large groups, of which there are
    few, are broadcast behind a size check; their rows are spread over all tasks of the join
    that serves the others, so no group's rows meet in one task."""
    values = [c for c in groups.columns if c not in (key, size_col)]
    packed = groups.select(key, F.struct(*values).alias("_group"), F.col(size_col).alias("_size"))
    hot = broadcast_up_to(packed.where(F.col("_size") >= hot_rows).select(key, F.col("_group").alias("_hot")), 1_000_000)
    cold = packed.where(F.col("_size") < hot_rows).select(key, "_group", F.lit(0).alias("_spread"))
    names = rows.columns
    out = rows.join(hot, key, "left").withColumn("_spread", F.when(F.col("_hot").isNull(), 0).otherwise(
        1 + F.pmod(F.xxhash64(*[c for c in names if c != key] or [key]), F.lit(SPREAD)).cast("int")))
    out = out.join(cold, [key, "_spread"], "left").withColumn("_group", F.coalesce("_hot", "_group"))
    if how == "inner":
        out = out.where(F.col("_group").isNotNull())
    return out.select(*names, *[F.col("_group")[c].alias(c) for c in values])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (u, v): one row (node, root)
    for each node of an edge, ``root`` the smallest node reachable.

    Large-star and small-star rounds: each node's neighbours hook onto the smallest
    one. Minima are partial aggregates and the rest are joins by :func:`join_group`, so the
    edges of a node with a third of all don't meet in one task. Each round is stored in the shared folder;
    the driver only sees a count and a checksum. Edges with a null end and loops
    are left out; no edges give no rows."""
    def stored(df):
        t = shared_table(df.distinct(), "edges")
        s = t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return t, tuple(s)

    now, state = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    if not state[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def hooked(rows, least):
        """``rows`` with ``m``, the smallest of each node's neighbours (and ``least``)."""
        low = rows.groupBy("u").agg(least.alias("m"), F.count("*").alias("_n"))
        return join_group(rows, shared_table(low, "least"), "u", "_n")

    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = hooked(both, F.least(F.min("v"), F.first("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = shared_table(star.where("u <> v").distinct(), "star")
        near = hooked(star, F.min("v"))
        new = near.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        now, after = stored(new)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
