"""Pruned exact search: identical rows, and less read on clustered vectors."""

import numpy as np
import pytest

from ragframe.operators import balls as BA
from ragframe.operators import vectors as V
from test_codes import asked, fragments, rows


def test_identical_rows_and_skipped_files(spark):
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((24, 32)) * 3
    made = [(f"c{i % 2}", centers[rng.integers(24)] + rng.standard_normal(32) * 0.3) for i in range(6000)]
    made += [("c0", None), ("c0", np.zeros(32)), ("c1", rng.standard_normal(7))]
    f = fragments(spark, made)
    q = asked(spark, [(f"c{i % 2}", centers[i % 24] + rng.standard_normal(32) * 0.3) for i in range(12)])
    index = BA.ball_build(f, n_pivots=24)
    report = []
    assert rows(BA.ball_search(q, index, report=report)) == rows(V.semantic_search(q, f))
    (files, read, whole, computed), = report
    assert read < files and computed < whole / 4
    assert rows(BA.ball_search(q, index, blocks=3)) == rows(V.semantic_search(q, f))


@pytest.mark.parametrize("n_pivots", [1, 5])
def test_vectors_without_clusters_ties_and_odd_ones(spark, n_pivots):
    rng = np.random.default_rng(8)
    base = [rng.standard_normal(8) for _ in range(30)]
    made = [("a" if i % 3 else "b", base[rng.integers(30)] * (1 + i % 4)) for i in range(200)]
    made += [("a", None), ("a", np.zeros(8)), ("b", np.zeros(8)), ("a", rng.standard_normal(5)), ("b", None), (None, base[0])]
    f = fragments(spark, made)
    asks = [("a", base[0]), ("b", base[1] * 3), ("a", -base[2]), ("a", None), ("b", np.zeros(8)), ("none", base[2]), (None, base[3]), ("a", np.ones(8))]
    index = BA.ball_build(f, n_pivots=n_pivots)
    for limit in (1, 7, 400):
        q = asked(spark, asks, limit=limit)
        assert rows(BA.ball_search(q, index)) == rows(V.semantic_search(q, f))


def test_empty_tables(spark):
    f, q = fragments(spark, [("a", np.ones(4))]), asked(spark, [("a", np.ones(4))])
    assert BA.ball_search(q.limit(0), BA.ball_build(f)).count() == 0
    assert BA.ball_search(q, BA.ball_build(f.limit(0))).count() == 0
