"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from ragframe.llm import embdedup as ED
from ragframe.llm.catalog import ORACLES, QUERIES


def slow(rows, least=0.98):
    """rows: (vec_id, vector, label) with unique ids."""
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {i: set() for i, _, _ in rows}
    use = [(i, np.array(v, np.float64), label) for i, v, label in rows if good(v, label)]
    for n, (i, v, a) in enumerate(use):
        for j, w, b in use[:n]:
            if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i].add(j), links[j].add(i)
    root = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        root[i] = min(seen)
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("cells, block", [(1, 512), (12, 7), (40, 16)])
def test_chains_copies_and_odd_vectors(spark, cells, block):
    rng = np.random.default_rng(cells)
    rows, i = [], 0
    for _ in range(25):
        v = rng.standard_normal(6)
        for _ in range(rng.integers(1, 9)):
            v = v / np.linalg.norm(v) + rng.standard_normal(6) * 0.055
            rows.append((i, v.tolist(), int(rng.integers(0, 2)) if i % 5 == 0 else 1))
            i += 1
            if rng.random() < 0.3:
                rows.append((i, (v * 3).tolist() if i % 2 else v.tolist(), 1))
                i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 6, 1), (i + 2, [float("nan")] * 6, 1), (i + 3, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (i + 4, [], 1),
             (i + 5, [1.0, 1.0], 1), (i + 6, [1.0, 1.0], None), (i + 7, [2.0, 2.0], 1), (i + 8, [float("inf"), 1.0], 1), (i + 9, [1e-300, 1e-300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("x", "node")
    assert result(ED.near_duplicates(df, cells=cells, block=block)) == slow(rows)


def test_hot_label_against_all_pairs(spark):
    """One label holds most rows: a large group of equal vectors, one of near copies, and singles."""
    rng = np.random.default_rng(8)
    base, near = rng.standard_normal(64), rng.standard_normal(64)
    vectors = [base] * 400 + [near + rng.standard_normal(64) * 0.05 for _ in range(300)] + list(rng.standard_normal((800, 64)))
    rows = [(i, np.float32(v).tolist(), 1 if i % 9 else 2) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    assert result(ED.near_duplicates(df, block=64)) == slow(rows)


def test_registered_query(spark, tmp_path):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLES['op8_embedding_dedup']})").fetchall()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in QUERIES["op8_embedding_dedup"](spark, sf).collect()) == sorted(want)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = ED.near_duplicates(df.withColumn("node", df.label)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
    assert ED.near_duplicates(df.limit(0)).count() == 0
