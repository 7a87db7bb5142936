"""Continuous ingestion (A12, B6): a stream of files into the two stored tables.

Each micro-batch is parsed, split and embedded like a batch ingestion and written into
folders of its own, named by the batch id; a manifest, written last, makes it part of the
tables. A batch that failed or whose commit was lost is replayed by the stream: it
overwrites its own folders, or is already in the manifest and does nothing, so both tables
are what one pass over every file gives. New ids follow the manifest's largest one; of old
rows only the document ids are read.

The tables are logs that :meth:`Store.documents` and :meth:`Store.embeddings` read:
a document sent again keeps its first name, context and time and takes the latest
description, type and metadata (A7), and its earlier fragments are left out. ``compact``
writes what is left as one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe import constants as K
from ragframe.operators import ingest as IG
from ragframe.operators import maintenance as M
from ragframe.operators.vectors import embed_chunks
from ragframe.session import broadcast_if_small, checkpoint, ship_package
from ragframe.sources import versions

DOCUMENTS = "document_id {}, context_id string, name string, description string, type string, metadata map<string,string>, updated_at timestamp"
EMBEDDINGS = ("id long, context_id string, document_id {}, fragment_index long, chunk_index long, value string, "
              "metadata map<string,string>, embedding array<float>")


def scan_stream(spark: SparkSession, path: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A12 as a stream: the files that arrive in a folder (path, modificationTime, length,
    content, name), each once."""
    schema = T._parse_datatype_string("path string, modificationTime timestamp, length long, content binary")
    r = spark.readStream.format("binaryFile").schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))


class Store:
    """The document and embedding tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        return versions.latest(self.spark, self.path) or {"version": 0, "batches": [], "done": [], "max_id": 0}

    def _folder(self, table: str, name: str) -> str:
        return f"{self.path}/{table}/{name}"

    def _log(self, table: str, batches: list[str]) -> DataFrame | None:
        out = None
        for place, name in enumerate(batches):
            t = self.spark.read.parquet(self._folder(table, name)).withColumn("_place", F.lit(place))
            out = t if out is None else out.unionByName(t)
        return out

    def documents(self) -> DataFrame | None:
        """The documents table now; None before the first batch."""
        log = self._log("documents", self.manifest()["batches"])
        if log is None:
            return None
        first, last = ["context_id", "name", "updated_at"], M.DOCUMENT_UPDATABLE
        g = log.groupBy("document_id").agg(F.min_by(F.struct(*first), "_place").alias("f"), F.max_by(F.struct(*last), "_place").alias("l"))
        return g.select("document_id", *[F.col("f")[c].alias(c) for c in ("context_id", "name")],
                        *[F.col("l")[c].alias(c) for c in last], F.col("f")["updated_at"].alias("updated_at"))

    def embeddings(self) -> DataFrame | None:
        """The embeddings table now, without the fragments of documents that came again."""
        batches = self.manifest()["batches"]
        log = self._log("embeddings", batches)
        if log is None:
            return None
        again = self._log("replaced", batches).groupBy("document_id").agg(F.max("_place").alias("_since"))
        return log.join(broadcast_if_small(again, 1_000_000), "document_id", "left").where(
            F.col("_since").isNull() | (F.col("_place") >= F.col("_since"))).drop("_place", "_since")

    def rejects(self) -> DataFrame | None:
        log = self._log("rejects", self.manifest()["batches"])
        return None if log is None else log.drop("_place")

    def apply(self, files: DataFrame, batch: str, max_chars: int = 512, embedder=None, dim: int = 64, parsers: dict | None = None,
              now: Column | None = None, overlap: int = K.CHUNK_OVERLAP_CHARS) -> None:
        """One batch of ``files``: document_id, context_id, name and ``text`` or ``content``
        [+ ``mime``] [, description, type, metadata]. Of files with one id the last by name
        counts. Idempotent by ``batch``."""
        m = self.manifest()
        if batch in m["done"]:
            return
        ship_package(self.spark)
        body = "text" if "text" in files.columns else "content"
        one = M._last_change(files.withColumn("_seq", F.struct("name", F.xxhash64(body))), "document_id", "_seq")
        kind = files.schema["document_id"].dataType.simpleString()
        docs, have = (self.spark.createDataFrame([], columns.format(kind)) for columns in (DOCUMENTS, EMBEDDINGS))
        changed, made, rejects = IG.ingest(one, docs, have, max_chars=max_chars, embedder=embedder, dim=dim, now=now, parsers=parsers, overlap=overlap)
        changed = checkpoint(changed)
        changed.write.mode("overwrite").parquet(self._folder("documents", batch))
        made.withColumn("id", F.col("id") + F.lit(m["max_id"])).write.mode("overwrite").parquet(self._folder("embeddings", batch))
        rejects.write.mode("overwrite").parquet(self._folder("rejects", batch))
        known, again = self._log("documents", m["batches"]), changed.select("document_id")
        if known is None:
            again = again.limit(0)
        else:
            again = again.join(known.select("document_id").join(broadcast_if_small(again, 1_000_000), "document_id", "left_semi").distinct(),
                               "document_id", "left_semi")
        again.write.mode("overwrite").parquet(self._folder("replaced", batch))
        top = self.spark.read.parquet(self._folder("embeddings", batch)).agg(F.max("id")).first()[0]
        versions.commit(self.spark, self.path, {**m, "batches": [*m["batches"], batch], "done": [*m["done"], batch], "max_id": max(m["max_id"], top or 0)})

    def compact(self) -> None:
        """What is left of all batches, as one."""
        m = self.manifest()
        if len(m["batches"]) < 2:
            return
        name = f"compacted-{m['version']}"
        self.documents().write.mode("overwrite").parquet(self._folder("documents", name))
        left = self.embeddings()
        left.write.mode("overwrite").parquet(self._folder("embeddings", name))
        left.limit(0).select("document_id").write.mode("overwrite").parquet(self._folder("replaced", name))
        self.rejects().write.mode("overwrite").parquet(self._folder("rejects", name))
        versions.commit(self.spark, self.path, {**m, "batches": [name]})


def ingest_stream(files: DataFrame, store: Store, checkpoint_path: str, available_now: bool = True, **options):
    """Starts the ingestion of a stream of ``files`` (see :meth:`Store.apply`) into ``store``;
    returns the streaming query."""
    def one(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, f"{batch_id:09d}", **options)

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
