"""A text index that is kept up to date, and a BM25 search that reads few of its postings
(C3, C4, with the table changes A8 and A9).

**Segments.** An append writes one segment: the forward rows of the new fragments (tokens
and counts), their postings, and what they add to document frequencies and totals. A delete
writes tombstones (ids) and negative frequencies. Searches merge all of them; nothing old
is read by an append, and a delete reads the forward rows of the deleted documents.
``compact`` folds everything into one segment, from forward rows, not from texts. A version
of the index is a small manifest that is written last, so a failed change leaves no trace
and a change with a ``batch`` name happens once however often it is tried.

**Blocks.** The postings of a token are cut into blocks by impact (the part of the score
that depends on frequency and length, in ``LEVELS`` levels), and a header table has each
block's rows and largest impact. A query with a threshold (its limit-th best score is at
least that) needs only so many top blocks of each token that what it left unread can't
reach the threshold any more; the cheapest such choice is a walk along the convex hulls of
the tokens' (rows, bound) curves. Fragments whose read part and the bounds of the unread
one stay below the threshold are dropped, the rest is scored in full from the forward
rows. The threshold comes from the same steps with a budget of rows instead of a bound.
The result equals the exhaustive search's.

**Layout.** Forward rows and postings of a segment are tables bucketed by fragment: the
texts are dealt out once, before they are tokenized, and neither the postings, nor the
sums of a fragment's read parts, nor the rows scored in full are moved again. In a bucket
postings lie by the token's frequency class and level, so stretches that no query
needs are skipped by their statistics."""

from __future__ import annotations

import itertools
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragframe import constants as K
from ragframe.functions.text import tokens
from ragframe.operators.fulltext import (BROADCAST_MAX_ROWS, FRAGMENT_KEYS, Bm25Index, _kernel_scores, _spark_context, max_limit,
                                         query_tokens)
from ragframe.session import broadcast_if_small, checkpoint, fits
from ragframe.sources import versions

LEVELS = 32
#: Tokens in fewer fragments of a segment than this are one class.
COMMON_DF = 1024
#: Bytes of text that a bucket of a segment gets, or so.
BUCKET_BYTES = 16 << 20
#: Postings that a query may read for its threshold, for each row of its limit.
BUDGET = 256
#: Fragments scored in full for the threshold, for each row of the limit.
TRIED = 4
#: The bounds of unread blocks may sum up to this share of the threshold: the less, the
#: more is read and the fewer fragments are scored in full.
SHARE = 0.6
_TOP = K.BM25_K1 + 1.0
SLACK = 1e-6  # above the rounding of scores


def _impact(tf: Column, dl: Column, avgdl) -> Column:
    tf = tf.cast("double")
    return tf * F.lit(_TOP) / (tf + F.lit(K.BM25_K1) * (F.lit(1.0 - K.BM25_B) + F.lit(K.BM25_B) * dl / avgdl))


def _count_kernel(batches):
    """The lists of tokens in the last column as lists of (token, tf), sorted by token."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        order = pc.sort_indices(words).to_numpy()  # bytewise, as Spark sorts strings
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        both, tf = np.unique(row * max(len(words), 1) + place[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        row, token = both // max(len(words), 1), words.take(pa.array(order[both % max(len(words), 1)], pa.int64()))
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([token, pa.array(tf.astype(np.int64))], ["token", "tf"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pairs)], batch.schema.names)


def _counted(rows: DataFrame) -> DataFrame:
    """Forward rows of rows whose ``tf`` holds their tokens: their length and the tokens' counts."""
    rows = rows.select("id", *FRAGMENT_KEYS, F.size("tf").cast("long").alias("dl"), F.col("tf"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_count_kernel, kinds + ", tf array<struct<token string, tf long>>")


class TextIndex:
    """A stored index under ``path``. One writer at a time; readers see whole versions."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    # -- versions ---------------------------------------------------------

    @staticmethod
    def create(spark: SparkSession, path: str, fragments: DataFrame | None = None, batch: str | None = None) -> "TextIndex":
        """A new index, of ``fragments`` (id, keys, value) if given."""
        index = TextIndex(spark, path.rstrip("/"), {"version": 0, "next": 0, "segments": [], "deletes": [], "batches": []})
        if fragments is not None:
            return index.append(fragments, batch)
        index._commit({})
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> "TextIndex":
        """The latest whole version under ``path``."""
        found = versions.latest(spark, path.rstrip("/"))
        if found is None:
            raise FileNotFoundError(f"no text index under {path}")
        return TextIndex(spark, path.rstrip("/"), found)

    def _commit(self, changes: dict, batch: str | None = None) -> "TextIndex":
        done = {**self.manifest, **changes}
        if batch is not None:
            done["batches"] = [*self.manifest["batches"], batch]
        self.manifest = versions.commit(self.spark, self.path, done)
        return self

    def done(self, batch: str | None) -> bool:
        return batch is not None and batch in self.manifest["batches"]

    def _table(self, kind: str, seq: int) -> DataFrame:
        made = next((s for s in self.manifest["segments"] if s["seq"] == seq and "buckets" in s), None)
        table = self._bucketed(kind, made) if made and kind in _SORTED else self.spark.read.parquet(f"{self.path}/{kind}/{seq:06d}")
        return table.withColumn("seq", F.lit(seq))

    def _bucketed(self, kind: str, made: dict) -> DataFrame:
        """A segment's bucketed table; a session that hasn't written it learns where it lies."""
        name = f"ragframe_{kind}_{made['name']}"
        if not self.spark.catalog.tableExists(name):
            where = f"{self.path}/{kind}/{made['seq']:06d}-{made['name']}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({made['columns'][kind]}) USING parquet CLUSTERED BY (id) "
                           f"INTO {made['buckets']} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _store(self, rows: DataFrame, kind: str, made: dict) -> DataFrame:
        """``rows``, which lie by ``id`` in the tasks, as a bucketed table of a segment."""
        made["columns"][kind] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        # sorted by one whole number before the writer's sort by bucket: both are radix sorts
        (rows.sortWithinPartitions(_SORTED[kind]).write.mode("overwrite").format("parquet").bucketBy(made["buckets"], "id")
         .option("path", f"{self.path}/{kind}/{made['seq']:06d}-{made['name']}").saveAsTable(f"ragframe_{kind}_{made['name']}"))
        return self._bucketed(kind, made)

    def _all(self, kind: str, of=("segments", "deletes")) -> DataFrame | None:
        out = None
        for s in [s for k in of for s in self.manifest[k]]:
            t = self._table(kind, s["seq"])
            out = t if out is None else out.unionByName(t)
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, seq) without those that a later delete removed."""
        gone = self._all("tombstones", ("deletes",))
        if gone is None:
            return rows
        gone = broadcast_if_small(gone.select(F.col("id").alias("_id"), F.col("seq").alias("_seq")), BROADCAST_MAX_ROWS)
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("_seq") > F.col("seq")), "left_anti")

    # -- changes ----------------------------------------------------------

    def _counts(self, forward: DataFrame, seq: int, sign: int) -> None:
        """What the fragments of ``forward`` add to the frequencies and totals."""
        df = forward.select(F.explode("tf").alias("p")).groupBy(F.col("p.token").alias("token")).agg((F.count(F.lit(1)) * sign).alias("df"))
        df.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/frequencies/{seq:06d}")
        totals = forward.agg((F.count(F.lit(1)) * sign).alias("n_docs"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("sum_dl"))
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/{seq:06d}")

    def _write(self, fragments: DataFrame, seq: int, size, forward) -> dict:
        """The tables of one segment from ``fragments``, which have an ``id`` and are dealt out by
        it before ``forward`` makes the forward rows (id, keys, dl, tf) of them. ``size``: bytes
        of a row's text, or so."""
        whole = fragments.agg(F.sum(size).cast("long")).first()[0] or 0
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // BUCKET_BYTES))
        made = {"seq": seq, "name": uuid.uuid4().hex, "buckets": n, "columns": {}}
        rows = self._store(forward(fragments.repartition(n, "id")), "forward", made)
        self._counts(rows, seq, 1)
        n_docs, sum_dl = (self._table("totals", seq).select("n_docs", "sum_dl").first())
        avgdl = sum_dl / n_docs if n_docs and sum_dl else 1.0
        post = rows.select("id", "dl", F.explode("tf").alias("p")).select("id", "dl", "p.token", "p.tf")
        level = F.least(F.lit(LEVELS - 1), F.floor((F.lit(_TOP) - _impact(F.col("tf"), F.col("dl"), F.lit(avgdl))) / F.lit(_TOP) * LEVELS)).cast("int")
        # classes of common tokens: as many of the commonest as may be broadcast
        least, df = COMMON_DF, self._table("frequencies", seq).select("token", "df")
        while not fits(df.where(F.col("df") >= least), BROADCAST_MAX_ROWS):
            least *= 4
        kinds = df.where(F.col("df") >= least).select("token", (F.floor(F.log2(F.col("df") / least) / 2) + 1).cast("int").alias("_c"))
        post = post.withColumn("level", level).join(F.broadcast(kinds), "token", "left").withColumn(
            "cls", F.coalesce("_c", F.lit(0)) * LEVELS + F.col("level"))
        post = self._store(post.select("token", "level", "id", "dl", "tf", "cls"), "postings", made)
        heads = post.groupBy("token", "level", "cls").agg(
            F.count(F.lit(1)).alias("n"), F.max(_impact(F.col("tf"), F.col("dl"), F.lit(avgdl))).alias("max_f"))
        heads.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/heads/{seq:06d}")
        return {**made, "avgdl": avgdl}

    def append(self, fragments: DataFrame, batch: str | None = None) -> "TextIndex":
        """Adds ``fragments`` (id, keys, value) as a segment; only they are read."""
        if self.done(batch):
            return self
        seq = self.manifest["next"]
        made = self._write(fragments.select("id", *FRAGMENT_KEYS, "value"), seq, F.octet_length("value"), lambda texts: _counted(
            texts.select("id", *FRAGMENT_KEYS, tokens("value").alias("tf"))))
        return self._commit({"next": seq + 1, "segments": [*self.manifest["segments"], made]}, batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> "TextIndex":
        """Removes every fragment of the (context, document) keys."""
        if self.done(batch):
            return self
        seq, on = self.manifest["next"], ["context_id", "document_id"]
        rows = self.forward()
        if rows is None:
            return self._commit({}, batch)
        gone = checkpoint(rows.join(broadcast_if_small(keys.select(*on).distinct(), 1_000_000), on, "left_semi"))
        gone.select("id").write.mode("overwrite").parquet(f"{self.path}/tombstones/{seq:06d}")
        self._counts(gone, seq, -1)
        return self._commit({"next": seq + 1, "deletes": [*self.manifest["deletes"], {"seq": seq}]}, batch)

    def compact(self) -> "TextIndex":
        """One segment without tombstones, from the forward rows."""
        rows = self.forward()
        if rows is None:
            return self
        seq = self.manifest["next"]
        made = self._write(rows.drop("seq"), seq, F.col("dl") * 8, lambda kept: kept)
        return self._commit({"next": seq + 1, "segments": [made], "deletes": []})

    # -- reading ----------------------------------------------------------

    def forward(self) -> DataFrame | None:
        """The forward rows of all fragments that the index has now; None for a new one."""
        rows = self._all("forward", ("segments",))
        return None if rows is None else self._live(rows)

    def bm25(self) -> Bm25Index:
        """Postings, frequencies and totals as the exhaustive search takes them."""
        rows = self.forward()
        post = rows.select("id", *FRAGMENT_KEYS, "dl", F.explode("tf").alias("p")).select("id", *FRAGMENT_KEYS, "dl", "p.token", "p.tf")
        df = self._all("frequencies").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") > 0)
        total = self._all("totals").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("s"))
        return Bm25Index(post, df, total.select("n_docs", F.try_divide(F.col("s").cast("double"), F.col("n_docs")).alias("avgdl")), stored=True,
                         forward=rows.withColumnRenamed("tf", "_tf"))

    def search(self, queries: DataFrame, limit_col: str = "_fts_limit", limit_cap: int | None = None, text_col: str = "query",
               carry=()) -> DataFrame:
        """C4 with the result of ``bm25_search(scope='global')``; see the module's text. An
        index without a segment finds nothing."""
        if not self.manifest["segments"]:
            kept = [limit_col] + [c for c in carry if c != limit_col]
            none = queries.limit(0).select("query_id", F.col("context_id").alias("q_context_id"), *kept)
            return none.selectExpr("*", "CAST(NULL AS LONG) AS id", "CAST(NULL AS STRING) AS context_id", "CAST(NULL AS LONG) AS document_id",
                                   "CAST(NULL AS LONG) AS fragment_index", "CAST(NULL AS DOUBLE) AS full_text_score")
        return BlockSearch(self, queries, limit_col, limit_cap, text_col, carry).result()


#: The bucketed tables of a segment and their order in a bucket.
_SORTED = {"forward": "id", "postings": "cls"}
_CHOSEN = "query_id {kind}, token string, level int, cls int, rest double, rests double"


def _choose(by_query: pd.DataFrame, budget: int | None) -> pd.DataFrame:
    """For one query, the blocks to read: ``level`` and ``cls`` of each, ``rest`` the bound
    of the token's unread blocks and ``rests`` the sum of these. With a ``budget`` the best
    blocks of so many rows, else until the bounds' sum is below ``SHARE`` of ``theta``."""
    theta = float(by_query["theta"].iloc[0])
    merged: dict = {}  # token -> level -> [rows, bound], over all segments
    for token, level, n, bound in zip(*(by_query[c].tolist() for c in ("token", "level", "n", "bound"))):
        cell = merged.setdefault(token, {}).setdefault(level, [0, 0.0])
        cell[0] += n
        cell[1] = max(cell[1], bound)
    steps, lists, total = [], {}, 0.0
    for token in sorted(merged):
        levels = sorted(merged[token])
        rows = list(itertools.accumulate((merged[token][v][0] for v in levels), initial=0))
        # what the levels from the i-th on may add
        bound = list(itertools.accumulate((merged[token][v][1] for v in reversed(levels)), max, initial=0.0))[::-1]
        hull = [0]
        for i in range(1, len(rows)):
            while len(hull) > 1 and (bound[hull[-1]] - bound[hull[-2]]) * (rows[i] - rows[hull[-2]]) >= \
                    (bound[i] - bound[hull[-2]]) * (rows[hull[-1]] - rows[hull[-2]]):
                hull.pop()
            hull.append(i)
        lists[token] = [0, levels, bound]
        total += bound[0]
        for x, y in zip(hull, hull[1:]):
            steps.append((-(bound[x] - bound[y]) / (rows[y] - rows[x]), token, y, rows[y] - rows[x], bound[x] - bound[y]))
    steps.sort()
    used = 0
    for _, token, upto, rows, drop in steps:
        if total < SHARE * theta - SLACK if budget is None else used >= budget:
            break
        lists[token][0] = upto
        total -= drop
        used += rows
    # a sum of bounds that doesn't depend on the order of the walk
    rests = math.fsum(bound[i] for i, _, bound in lists.values())
    out = [(query, t, v, c, lists[t][2][lists[t][0]], rests)
           for query, t, v, c in zip(*(by_query[k].tolist() for k in ("query_id", "token", "level", "cls")))
           if lists[t][0] and v <= lists[t][1][lists[t][0] - 1]]
    return pd.DataFrame(out, columns=["query_id", "token", "level", "cls", "rest", "rests"])


class BlockSearch:
    """One batch of queries against one version of an index."""

    def __init__(self, index: TextIndex, queries: DataFrame, limit_col: str, limit_cap: int | None, text_col: str, carry):
        self.index, self.limit_col = index, limit_col
        self.cap = limit_cap if limit_cap is not None else max_limit(queries, limit_col)
        self.carry = [limit_col] + [c for c in carry if c != limit_col]
        self.asked = checkpoint(query_tokens(queries, text_col, carry=self.carry))
        self.small = fits(self.asked, BROADCAST_MAX_ROWS)
        self.stats = stats = index.bm25()
        n_docs, avgdl = stats.totals.first()
        self.n_docs, self.avgdl = n_docs, avgdl or 1.0
        vocab = self._side(self.asked.select("token").distinct())
        df = stats.doc_freq.join(vocab, "token")
        idf = F.log(F.lit(1.0) + (F.lit(n_docs) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
        #: query_id, token, idf and settings: one row for each distinct token of a query
        self.terms = checkpoint(self.asked.join(self._side(df), "token").withColumn("idf", idf))
        heads = None
        for s in index.manifest["segments"]:
            t = index._table("heads", s["seq"]).withColumn("bound", F.col("max_f") * F.lit(max(1.0, self.avgdl / s["avgdl"])))
            heads = t if heads is None else heads.unionByName(t)
        #: query_id, token, level, cls, n, bound: the blocks of each query's tokens
        self.heads = checkpoint(heads.join(self._side(self.terms.select("query_id", "token", "idf")), "token").select(
            "query_id", "token", "level", "cls", "n", (F.col("bound") * F.col("idf")).alias("bound")))
        self.kind = queries.schema["query_id"].dataType.simpleString()

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def chosen(self, theta: DataFrame | None, budget: int | None = None) -> DataFrame:
        """The blocks that each query reads; at most tokens x levels x segments rows a query."""
        heads = self.heads.withColumn("theta", F.lit(0.0)) if theta is None else self.heads.join(
            self._side(theta), "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
        return checkpoint(heads.groupBy("query_id").applyInPandas(lambda g: _choose(g, budget), _CHOSEN.format(kind=self.kind)))

    def read(self, chosen: DataFrame) -> dict[int, DataFrame]:
        """By segment (query_id, seq, id, score, over): the read part of each fragment's score, and
        how far that is above the bounds of the tokens that it was read from."""
        classes = sorted(r[0] for r in chosen.select("cls").distinct().collect())  # at most levels x classes
        want = checkpoint(chosen.select("query_id", "token", "level", "rest").distinct().join(self.terms.select("query_id", "token", "idf"), ["query_id", "token"]))
        part = F.col("idf") * _impact(F.col("tf"), F.col("dl"), F.lit(self.avgdl))
        out = {}
        for s in self.index.manifest["segments"]:
            post = self.index._live(self.index._table("postings", s["seq"]).where(F.col("cls").isin(classes)))
            out[s["seq"]] = post.join(self._side(want), ["token", "level"]).groupBy("query_id", "seq", "id").agg(
                F.sum(part).alias("score"), F.sum(part - F.col("rest")).alias("over"))
        return out

    def full(self, found: dict[int, DataFrame]) -> DataFrame:
        """The whole scores of the (query_id, seq, id) in ``found``, with keys and settings. While
        the batch can be sent to the tasks and no id repeats, the found forward rows are scored
        where they lie, by the kernel of ``bm25_search`` and for all queries (whole scores too:
        none is wrong)."""
        sc = _spark_context(self.terms) if self.small else None
        if sc is None or self.stats.repeated() is not None:
            return self._grouped(found)
        rows = None
        for seq, pairs in found.items():
            ids = broadcast_if_small(checkpoint(pairs.select("id").distinct()), BROADCAST_MAX_ROWS)
            part = self.index._table("forward", seq).join(ids.hint("shuffle_hash"), "id", "left_semi")
            rows = part if rows is None else rows.unionByName(part)
        return _kernel_scores(sc, self.terms, rows.withColumnRenamed("tf", "_tf"), self.avgdl, self.carry, self.cap, "global")

    def _grouped(self, found: dict[int, DataFrame]) -> DataFrame:
        """:meth:`full` by a join of the found pairs with their rows' tokens and a grouping, which
        adds up rows that share an id. Bounds are those of single rows: of repeated ids fragments
        may be missed that only their sum brings above the threshold."""
        rows = None
        for seq, pairs in found.items():
            part = self.index._table("forward", seq).join(pairs.select("query_id", "id"), "id")
            rows = part if rows is None else rows.unionByName(part)
        each = rows.select("query_id", "id", *FRAGMENT_KEYS, "dl", F.explode("tf").alias("p")).select(
            "query_id", "id", *FRAGMENT_KEYS, "dl", "p.token", "p.tf")
        term = F.col("idf") * _impact(F.col("tf"), F.col("dl"), F.lit(self.avgdl))
        each = each.join(self._side(self.terms), ["query_id", "token"])
        return each.groupBy("query_id", "q_context_id", *self.carry, "id", *FRAGMENT_KEYS).agg(
            F.round(F.sum(term), K.TEXT_SCORE_DIGITS).alias("full_text_score"))

    def threshold(self) -> DataFrame:
        """(query_id, theta): a score that at least ``limit`` fragments reach; none: no row."""
        read = None
        for part in self.read(self.chosen(None, budget=BUDGET * self.cap)).values():
            read = part if read is None else read.unionByName(part)
        limits = self._side(self.terms.groupBy("query_id").agg(F.first(self.limit_col).alias("_k")))
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        best = checkpoint(read.join(limits, "query_id").withColumn("_rn", F.row_number().over(w)).where(
            (F.col("_rn") <= F.col("_k") * TRIED) & (F.col("_rn") <= F.lit(TRIED * self.cap))))
        w = Window.partitionBy("query_id").orderBy(F.col("full_text_score").desc(), "id")
        tried = self.full({s["seq"]: best.where(F.col("seq") == s["seq"]) for s in self.index.manifest["segments"]})
        tried = tried.withColumn("_rn", F.row_number().over(w))
        return checkpoint(tried.where((F.col("_rn") == F.col(self.limit_col)) & (F.col("_rn") <= F.lit(self.cap))).select(
            "query_id", F.col("full_text_score").alias("theta")))

    def result(self) -> DataFrame:
        theta = self.threshold()
        chosen = self.chosen(theta)
        need = checkpoint(chosen.groupBy("query_id").agg(F.first("rests").alias("rests")).join(theta, "query_id", "left"))
        kept = {seq: part.join(self._side(need), "query_id").where(
            F.col("theta").isNull() | (F.col("over") + F.col("rests") >= F.col("theta") - F.lit(SLACK))) for seq, part in self.read(chosen).items()}
        self.last = chosen, kept
        w = Window.partitionBy("query_id").orderBy(F.col("full_text_score").desc_nulls_first(), F.col("id").asc())
        return (self.full(kept).withColumn("_rn", F.row_number().over(w))
                .where((F.col("_rn") <= F.col(self.limit_col)) & (F.col("_rn") <= F.lit(self.cap))).drop("_rn"))

    def report(self) -> DataFrame:
        """After :meth:`result`, per query: postings of its tokens, postings read, and
        fragments scored in full."""
        chosen, kept = self.last
        whole = self.heads.groupBy("query_id").agg(F.sum("n").alias("postings"))
        read = self.heads.join(chosen.select("query_id", "token", "level", "cls").distinct(), ["query_id", "token", "level", "cls"]).groupBy(
            "query_id").agg(F.sum("n").alias("postings_read"))
        full = None
        for part in kept.values():
            full = part.select("query_id") if full is None else full.unionByName(part.select("query_id"))
        full = full.groupBy("query_id").agg(F.count(F.lit(1)).alias("fragments_scored"))
        return whole.join(read, "query_id", "left").join(full, "query_id", "left").select(
            "query_id", "postings", F.coalesce("postings_read", F.lit(0)).alias("postings_read"), F.coalesce("fragments_scored", F.lit(0)).alias("fragments_scored"))
