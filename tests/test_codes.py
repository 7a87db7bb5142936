"""Binary-code search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe.operators import codes as BC
from ragframe.operators import vectors as V

FRAGMENTS = "id long, context_id string, document_id long, fragment_index long, embedding array<float>"


def fragments(spark, rows):
    return spark.createDataFrame([(i, c, i // 7, i % 7, None if v is None else np.float32(v).tolist()) for i, (c, v) in enumerate(rows)], FRAGMENTS)


def asked(spark, rows, limit=20):
    return spark.createDataFrame([(i, c, None if v is None else np.float32(v).tolist(), limit) for i, (c, v) in enumerate(rows)],
                                 "query_id long, context_id string, embedding array<float>, _sem_limit int")


def rows(df):
    return sorted((r["query_id"], r["id"], str(r["semantic_score"])) for r in df.select("query_id", "id", "semantic_score").collect())


def test_recall_with_a_tenth_of_the_vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((60, 64))
    made = [(f"c{i % 2}", centers[rng.integers(60)] + rng.standard_normal(64) * 1.5 if i % 3 else rng.standard_normal(64)) for i in range(12_000)]
    f = fragments(spark, made)
    q = asked(spark, [(f"c{i % 2}", centers[i] + rng.standard_normal(64)) if i % 4 else (f"c{i % 2}", rng.standard_normal(64)) for i in range(40)])
    index = BC.code_build(f)
    exact = V.semantic_search(q, f)
    got = BC.code_search(q, index)
    recall = V.recall_at_k(got, exact).agg(F.avg("recall")).first()[0]
    assert recall >= 0.95
    assert BC.OVERSAMPLE * 20 <= 6000 / 10 and got.count() == 40 * 20


def test_shortlist_is_native_and_bounded(spark):
    """A third of a context are equal vectors: the shortlist holds no more of them than fit."""
    rng = np.random.default_rng(5)
    one = rng.standard_normal(16)
    f = fragments(spark, [("a", one if i % 3 == 0 else rng.standard_normal(16)) for i in range(900)])
    index = BC.code_build(f, bits=128)
    q = asked(spark, [("a", one), ("a", -one), ("b", one)], limit=5)
    coded = BC.encode(q, 16, 128).select("query_id", "context_id", F.lit(20).cast("long").alias("size"),
                                         *[F.col(c).alias(f"q_{c}") for c in ("code0", "code1", "state")])
    short = BC.shortlist(spark.createDataFrame(coded.collect(), coded.schema), index, "size", 20)
    assert {r["query_id"]: r["count"] for r in short.groupBy("query_id").count().collect()} == {0: 20, 1: 20}
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("MapIn", "ArrowEval", "BatchEval", "Python"))
    assert rows(BC.code_search(q, index)) == [r for r in rows(V.semantic_search(q, f)) if r[0] == 0] + [r for r in rows(BC.code_search(q, index)) if r[0] == 1]


@pytest.mark.parametrize("blocks", [1, 3])
def test_all_rows_give_the_exact_result(spark, blocks):
    """Ties, copies, vectors without a direction or of another length, none, and such queries."""
    rng = np.random.default_rng(6)
    base = [rng.standard_normal(8) for _ in range(30)]
    made = [("a" if i % 3 else "b", base[rng.integers(30)]) for i in range(150)]
    made += [("a", None), ("a", np.zeros(8)), ("b", np.zeros(8)), ("a", rng.standard_normal(5)), ("b", None), (None, base[0])]
    f = fragments(spark, made)
    q = asked(spark, [("a", base[0]), ("b", base[1] * 3), ("a", None), ("b", np.zeros(8)), ("none", base[2]), (None, base[3]), ("a", np.ones(8))], limit=200)
    index = BC.code_build(f, dim=8, bits=64)
    assert rows(BC.code_search(q, index, oversample=10, blocks=blocks)) == rows(V.semantic_search(q, f))
    small = q.withColumn("_sem_limit", F.lit(7))
    assert rows(BC.code_search(small, index, oversample=30, blocks=blocks)) == rows(V.semantic_search(small, f))


def test_empty_tables(spark):
    f, q = fragments(spark, [("a", np.ones(4))]), asked(spark, [("a", np.ones(4))])
    assert BC.code_search(q.limit(0), BC.code_build(f)).count() == 0
    assert BC.code_search(q, BC.code_build(f.limit(0), dim=4)).count() == 0
