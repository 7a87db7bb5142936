"""The fitted embedder against numpy's SVD, and paraphrases against the hashed embedder."""

import random
import tempfile

import numpy as np

from ragframe.functions.plugins import hashed_embedder
from ragframe.operators import lsa as LS
from ragframe.operators import vectors as V


def topics(n=600, n_topics=12, seed=3):
    rng = random.Random(seed)
    words = [[f"t{t}w{i}" for i in range(40)] for t in range(n_topics)]
    common = [f"c{i}" for i in range(60)]
    return [(i, i % n_topics, " ".join(rng.sample(words[i % n_topics], 9) + rng.sample(common, 9))) for i in range(n)], words, common, rng


def matrix(texts, model):
    x = np.zeros((len(texts), len(model.idf)))
    for r, t in enumerate(texts):
        f, tf = np.unique([LS._feature(w, len(model.idf)) for w in t.split()], return_counts=True) if t.split() else ([], [])
        if len(f):
            x[r, f] = (1 + np.log(tf)) * model.idf[f]
            x[r] /= np.linalg.norm(x[r])
    return x


def test_factorisation_against_numpy(spark):
    rows, *_ = topics(300)
    texts = [t + (" " + t.split()[0]) * (i % 3) for i, _, t in rows] + [""]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "value string").repartition(5)
    model = LS.fit(df, dim=10, features=512, passes=4)
    x = matrix(texts, model)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, s[:10], rtol=0.01)
    best = np.linalg.norm(x - x @ vt[:10].T @ vt[:10])
    b = model.basis.astype(np.float64)
    assert np.allclose(b.T @ b, np.eye(10), atol=1e-4)
    assert np.linalg.norm(x - x @ b @ b.T) < 1.005 * best
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/model"
    model.write(spark, path)
    again = LS.LsaModel.read(spark, path)
    assert np.array_equal(again.basis, model.basis) and np.allclose(again.idf, model.idf) and np.allclose(again.values, model.values)


def test_paraphrases_beat_the_hashed_embedder(spark):
    """Questions share the topic of their texts but hardly a word of it."""
    rows, words, common, rng = topics()
    df = spark.createDataFrame([(i, "c", i, 0, t) for i, _, t in rows], "id long, context_id string, document_id long, fragment_index long, value string")
    asked = [(k, "c", " ".join(rng.sample(words[k % 12], 4) + rng.sample(common, 8))) for k in range(36)]
    q = spark.createDataFrame(asked, "query_id long, context_id string, query string")
    topic = {i: t for i, t, _ in rows}

    def precision(embedder):
        f = V.embed_texts(df.withColumn("text", df.value), "text", embedder)
        e = V.embed_texts(q.withColumn("text", q.query), "text", embedder).selectExpr("*", "10 AS _sem_limit")
        got = V.semantic_search(e, f).collect()
        return sum(topic[r["id"]] == r["query_id"] % 12 for r in got) / len(got)

    fitted = LS.fit(df, dim=32, features=4096).embedder()
    assert precision(fitted) > 0.9 and precision(fitted) > precision(hashed_embedder(32)) + 0.2


def test_odd_texts(spark):
    model = LS.fit(spark.createDataFrame([(None,), ("",), (" ,. ",)], "value string"), dim=4, features=64)
    assert not model.basis.any() and not model.values.any()
    import pandas as pd
    assert all(not v.any() for v in model.embedder()(pd.Series([None, "", "x y"], dtype=object)))
