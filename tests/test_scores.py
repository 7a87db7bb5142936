"""C4 by the scoring kernel: the rows and scores of the grouping, odd rows included."""
from __future__ import annotations

import pytest

from ragframe.operators import fulltext as FT

WORDS = "red green blue sky sea stone".split()


def _tables(spark, repeated: bool):
    rows = [(i, f"c{i % 3}", i // 2, i % 2, " ".join(WORDS[(i * j) % 6] for j in range(1, 2 + i % 5))) for i in range(60)]
    rows += [(100 + i, "c1", 50 + i, 0, "blue sea blue") for i in range(30)]  # equal scores
    rows += [(200, None, 80, 0, "sky"), (201, "c1", None, 0, "stone sky"), (202, "c2", 90, 0, None), (203, "c2", 91, 0, "...")]
    if repeated:
        rows += [(5, "c2", 2, 1, "green stone"), (None, "c0", 95, 0, "red red"), (None, "c0", 95, 0, "red sea"), (104, "c1", 54, 0, "blue sea blue")]
    fragments = spark.createDataFrame(rows, "id long, context_id string, document_id long, fragment_index long, value string")
    queries = spark.createDataFrame([(1, "c1", "blue sea", 5), (2, None, "red red sky", 3), (3, "c0", "nothing", 4), (4, "c2", "stone green sky", 200),
                                     (4, "c2", "stone green sky", 200), (5, "c1", None, 2), (None, "c1", "blue", 7)],
                                    "query_id long, context_id string, query string, _fts_limit int")
    return queries, fragments


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("scope", ["global", "context"])
def test_kernel_equals_grouping(spark, monkeypatch, scope, repeated):
    queries, fragments = _tables(spark, repeated)
    index = FT.bm25_stats(fragments, materialize=True)
    want = FT.bm25_search(queries, index, scope=scope, broadcast_tokens=False)
    monkeypatch.setattr(FT, "SCORE_CELLS", 40)  # many steps
    got = FT.bm25_search(queries, index, scope=scope, broadcast_tokens=True)
    assert got.dtypes == want.dtypes
    rows = [sorted(map(repr, df.collect())) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 10


def test_no_row_per_match(spark):
    """A match of a query's token and a fragment is no Spark row, so it isn't grouped or spilled."""
    queries, fragments = _tables(spark, False)
    plan = FT.bm25_search(queries, FT.bm25_stats(fragments, materialize=True))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan and "Aggregate" not in plan


def test_index_build_moves_no_tokens(spark):
    """Forward rows are stored by the tasks that tokenize them: a file a task, not one a shuffle partition."""
    queries, fragments = _tables(spark, False)
    index = FT.bm25_stats(fragments.coalesce(3), materialize=True)
    assert len(index.forward.inputFiles()) <= 3 < int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert index.forward.count() == fragments.count() and index.repeated() is None


def test_cells_fitted_to_a_sample(spark, monkeypatch):
    """k-means gets a bounded sample; every row has a cell and the search of all cells is exact."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from ragframe.operators import balls as BA
    from ragframe.operators import vectors as V
    rng = np.random.default_rng(3)
    rows = [(i, "c0", i, 0, rng.standard_normal(8).tolist()) for i in range(400)] + [(900, "c0", 900, 0, None), (901, "c0", 901, 0, [0.0] * 8)]
    frags = spark.createDataFrame(rows, "id long, context_id string, document_id long, fragment_index long, embedding array<float>")
    q = spark.createDataFrame([(1, "c0", rows[7][4], 12), (2, "c0", rows[9][4], 402)], "query_id long, context_id string, embedding array<float>, _sem_limit int")
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(V, "TRAIN_ROWS", 100)
    monkeypatch.setattr(KMeans, "fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    index, balls = V.ivf_build(frags, n_cells=10), BA.ball_build(frags, n_pivots=10)
    assert len(seen) == 2 and max(seen) < 200
    cols = ["query_id", "id", "semantic_score"]
    want = sorted(map(repr, V.semantic_search(q, frags).select(*cols).collect()))
    assert index.cells.count() == 402
    assert sorted(map(repr, V.ann_search(q, index, n_probe=len(index.centers)).select(*cols).collect())) == want
    assert sorted(map(repr, BA.ball_search(q, balls).select(*cols).collect())) == want
