"""An embedder fitted to the corpus (B5, C17): TF-IDF and a randomised low-rank
factorisation.

Tokens are hashed to ``features`` columns. The matrix of TF-IDF rows is factorised by
subspace iteration: each pass multiplies the rows of a task with a thin matrix (features x
(dim + extra)) and adds up the task's part of the product with the transposed rows; the
parts are summed by feature. The driver holds thin matrices only, whose size is a parameter
and doesn't grow with the corpus. A text's vector is its TF-IDF row times the right
singular vectors, at unit length, so texts are near whose words occur in the same texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.plugins import _WORD
from ragframe.functions.text import tokens
from ragframe.session import checkpoint

FEATURES, EXTRA, PASSES, SEED = 1 << 14, 16, 3, 5
AT_ONCE = 1 << 15  # matrix entries that are multiplied at once


def _feature(token: str, n: int) -> int:
    h = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % n


@dataclass
class LsaModel:
    """``idf`` by feature, ``basis`` (features x dim, float32) and singular values."""
    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def write(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"feature": np.arange(len(self.idf)), "idf": self.idf, "basis": list(self.basis)})
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/features")
        spark.createDataFrame([(self.values.tolist(),)], "values array<double>").write.mode("overwrite").parquet(f"{path}/values")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "LsaModel":
        t = spark.read.parquet(f"{path}/features").orderBy("feature").toArrow()
        basis = np.array(t.column("basis").to_pylist(), np.float32)
        return LsaModel(t.column("idf").to_numpy(), basis, np.array(spark.read.parquet(f"{path}/values").first()[0]))

    def embedder(self):
        """Batch embedder for ``embed_texts``: unit vectors; zero for a text of which no word is known."""
        idf, basis = self.idf, self.basis

        def embed(texts: pd.Series) -> list:
            known: dict[str, int] = {}
            out = np.zeros((len(texts), basis.shape[1]), np.float32)
            for i, t in enumerate(texts):
                f = [known.setdefault(w, _feature(w, len(idf))) if w not in known else known[w] for w in _WORD.findall((t or "").lower())]
                if f:
                    f, tf = np.unique(f, return_counts=True)
                    v = ((1 + np.log(tf)) * idf[f]) @ basis[f]
                    norm = np.linalg.norm(v)
                    out[i] = v / norm if norm > 1e-9 else 0
            return list(out)

        return embed


def _rows(batch, idf):
    """(row of each entry, feature, weight, rows): the batch's TF-IDF entries; rows have unit length."""
    lists = batch.column(0)
    sizes = np.diff(lists.offsets.to_numpy())
    feature = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    w = (1 + np.log(batch.column(1).flatten().to_numpy())) * idf[feature]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(sizes)))
    return row, feature, w / np.where(norm > 0, norm, 1)[row], len(sizes)


def _times(row, feature, w, n, thin) -> np.ndarray:
    out = np.zeros((n, thin.shape[1]))
    for lo in range(0, len(row), AT_ONCE):
        s = slice(lo, lo + AT_ONCE)
        starts = np.nonzero(np.diff(row[s], prepend=-1))[0]
        if len(starts):
            out[row[s][starts]] += np.add.reduceat(thin[feature[s]] * w[s, None], starts)
    return out


def _sum(stored: DataFrame, idf: np.ndarray, thin: np.ndarray, square: bool) -> np.ndarray:
    """X'(X thin), or with ``square`` (X thin)'(X thin), over all rows."""
    width = thin.shape[1]
    bc = stored.sparkSession.sparkContext.broadcast((idf, thin))

    def run(batches):
        idf, thin = bc.value
        total = np.zeros((width if square else len(idf), width))
        for batch in batches:
            row, feature, w, n = _rows(batch, idf)
            y = _times(row, feature, w, n, thin)
            if square:
                total += y.T @ y
                continue
            order = np.argsort(feature, kind="stable")
            row, feature, w = row[order], feature[order], w[order]
            for lo in range(0, len(row), AT_ONCE):
                s = slice(lo, lo + AT_ONCE)
                starts = np.nonzero(np.diff(feature[s], prepend=-1))[0]
                total[feature[s][starts]] += np.add.reduceat(y[row[s]] * w[s, None], starts)
        used = np.nonzero(total.any(axis=1))[0]
        for lo in range(0, len(used), 1024):
            some = used[lo:lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(total[some, j]) for j in range(width)]],
                                             ["at", *[f"c{j}" for j in range(width)]])

    cols = [f"c{j}" for j in range(width)]
    parts = stored.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in cols))
    t = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()  # at most one row a feature
    out = np.zeros((width if square else len(idf), width))
    out[t.column("at").to_numpy()] = np.stack([t.column(c).to_numpy() for c in cols], axis=1)
    return out


def fit(rows: DataFrame, text_col: str = "value", dim: int = 64, features: int = FEATURES, passes: int = PASSES, seed: int = SEED) -> LsaModel:
    """The model of a text column. Null texts and texts without a token have no entries; a
    corpus without any gives a basis of zeros."""
    hashed = F.sort_array(F.transform(tokens(text_col), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int")))
    starts = F.filter(F.transform("h", lambda x, i: F.when((i == 0) | (x != F.element_at("h", F.greatest(i, F.lit(1)).cast("int"))), i)), lambda i: i.isNotNull())
    forward = rows.select(hashed.alias("h")).where(F.size("h") > 0).withColumn("s", starts)
    ends = F.concat(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), F.array(F.size("h")))
    stored = checkpoint(forward.select(F.transform("s", lambda i: F.element_at("h", (i + 1).cast("int"))).alias("feature"),
                                       F.zip_with("s", ends, lambda a, b: (b - a).cast("double")).alias("tf")))
    n = stored.count()
    counts = stored.select(F.explode("feature").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).toArrow()
    df = np.zeros(features)
    df[counts.column("f").to_numpy()] = counts.column("n").to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1
    width = min(dim + EXTRA, features)
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    for _ in range(passes):
        thin = np.linalg.qr(_sum(stored, idf, thin, False))[0]
    values, turn = np.linalg.eigh(_sum(stored, idf, thin, True))
    order = np.argsort(-values)[:dim]
    values = np.sqrt(np.maximum(values[order], 0))
    basis = (thin @ turn[:, order]) * (values > 1e-9)
    return LsaModel(idf, basis.astype(np.float32), values)
