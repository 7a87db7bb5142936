"""Packing along a space-filling curve.

A document's token ids are counted in hashed buckets, the unit vector of the counts is
projected to few dimensions, and its place on a Hilbert curve through them is the
document's key: documents with near keys use alike tokens. Documents are range-sorted
by key, in ranges of equal bytes, and laid end to end; sequences of ``length`` tokens are cut from that line, so
neighbours on the curve share sequences and only the last sequence of a partition can
be short. That rest is cut at powers of two, which need no padding.

The order within a partition is total (key, doc_id, hash of the ids), so a lost task
gives the same pieces again."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import shared_table, text_batches
from ragframe.llm.tokens import encoder

LENGTH = 2048
BUCKETS, DIMS, CURVE_BITS = 512, 3, 10
#: Bytes of ids that one packing task gets, and the leading bits of the curve's keys by
#: which they are counted: a task's range ends at such a stretch.
TASK_BYTES = 16 << 20
CELL_BITS = 16
_SEED = 7


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each id (a multiplicative hash, so no table over the vocabulary) and
    the projection's columns."""
    rng = np.random.default_rng(_SEED)
    return rng.standard_normal((BUCKETS, DIMS)), np.uint32(2654435761)


def curve_point(ids: np.ndarray) -> np.ndarray:
    """The grid point of one document; the origin's cell for a document without ids."""
    projection, factor = _tables()
    bucket = (ids.astype("<u4") * factor) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.sqrt(np.bincount(bucket, minlength=BUCKETS))
    p = counts @ projection / max(np.linalg.norm(counts), 1e-12)
    u = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in p])
    return np.minimum((u * (1 << CURVE_BITS)).astype(np.int64), (1 << CURVE_BITS) - 1)


def hilbert_key(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place of each grid point (rows) on the Hilbert curve; by the axes-to-transpose
    method, over all rows at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= np.where(high, 0, swap) if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


class Packer:
    """Cuts a line of documents into sequences; yields (doc_id, start, ids, doc_tokens,
    sequence number, offset) for each piece."""

    def __init__(self, length: int):
        self.length, self.seq, self.used = length, 0, 0
        self.open: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            take = min(self.length - self.used, len(ids) - start)
            self.open.append((doc_id, start, ids[start:start + take], len(ids)))
            self.used += take
            start += take
            if self.used == self.length:
                yield from self._close(self.open)

    def _close(self, pieces) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, n in pieces:
            yield doc_id, start, ids, n, self.seq, at
            at += len(ids)
        self.seq, self.used, self.open = self.seq + 1, 0, []

    def end(self) -> Iterator[tuple]:
        """The rest, in sequences whose sizes are powers of two."""
        rest, left = self.open, self.used
        while left:
            size = 1 << (left.bit_length() - 1)
            taken, need = [], size
            while need:
                doc_id, start, ids, n = rest[0]
                taken.append((doc_id, start, ids[:need], n))
                if len(ids) > need:
                    rest = [(doc_id, start + need, ids[need:], n), *rest[1:]]
                else:
                    rest = rest[1:]
                need -= len(taken[-1][2])
            left -= size
            yield from self._close(taken)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset, with ``with_ids`` also ids (little-endian unsigned 32-bit).

    Null and empty texts are documents of the end id only. Repeated rows are packed as
    often as given, null ids as other ids. An empty table gives no rows."""
    def encode(batches):
        enc = encoder(vocabulary)
        wide = "<u2" if enc.bits <= 16 and end_id < 1 << 16 else "<u4"
        for batch in text_batches(batches, 1, 2 << 20):
            found = [np.append(i, np.uint32(end_id)) for i in enc.encode_many(batch.column(1).to_pylist())]
            keys = hilbert_key(np.array([curve_point(i) for i in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys), pa.array([wide == "<u2"] * len(found)), pa.array([i.astype(wide).tobytes() for i in found])],
                ["doc_id", "curve", "narrow", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stored = shared_table(rows.mapInArrow(encode, f"doc_id {kind}, curve long, narrow boolean, ids binary"), "packing-ids")
    # bytes by stretch of the curve: at most 65,536 rows, whatever the number of documents
    cell = F.shiftright("curve", DIMS * CURVE_BITS - CELL_BITS)
    held = sorted(map(tuple, stored.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("ids") + F.lit(32))).collect()))
    ranges, before = [], 0
    for c, n in held:
        ranges.append((c, before // TASK_BYTES, max(1, -(-n // TASK_BYTES))))
        before += n
    tasks = max([1, *[first + parts for _, first, parts in ranges]])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def cut(batches):
        packer, base = Packer(length), TaskContext.get().partitionId() << 32

        def batch_of(pieces, id_type):
            raw = [p[2].tobytes() for p in pieces]
            cols = [pa.array([p[0] for p in pieces], id_type), pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([len(p[2]) for p in pieces], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([p[3] for p in pieces], pa.int64()), pa.array([base + p[4] for p in pieces], pa.int64()),
                    pa.array([p[5] for p in pieces], pa.int64())]
            return pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names)

        id_type = None
        for batch in text_batches(batches, 2, 4 << 20):
            id_type, pieces = batch.schema.field(0).type, []
            for doc_id, narrow, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
                pieces += packer.add(doc_id, np.frombuffer(raw, "<u2" if narrow else "<u4").astype("<u4"))
            if pieces:
                yield batch_of(pieces, id_type)
        pieces = list(packer.end())
        if pieces:
            yield batch_of(pieces, id_type)

    # a stretch with more than a task's bytes is dealt to several tasks by hash
    cells = F.broadcast(stored.sparkSession.createDataFrame(ranges, "cell long, first int, parts int"))
    line = stored.withColumn("tie", F.xxhash64("ids")).join(cells, cell.cast("long") == F.col("cell"))
    line = line.withColumn("part", F.col("first") + F.pmod(F.xxhash64("doc_id", "tie"), F.col("parts")).cast("int"))
    line = line.repartitionById(tasks, "part").sortWithinPartitions("curve", "doc_id", "tie").select("doc_id", "narrow", "ids")
    return line.mapInArrow(cut, schema)
