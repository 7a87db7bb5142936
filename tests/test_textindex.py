"""The kept-up text index against a fresh build, and its search against the exhaustive one."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ragframe.operators import fulltext as FT
from ragframe.operators import textindex as TI

SCHEMA = "id long, context_id string, document_id long, fragment_index long, value string"


def corpus(n, seed=1, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    weight = [1 / (i + 1) for i in range(words)]
    return [(i, f"c{i % 3}", i // 4, i % 4, " ".join(rng.choices(vocab, weight, k=rng.choice([1, 3, 8, 20, 60])))) for i in range(n)]


def questions(spark, n=25, seed=2, size=(1, 2, 4, 9)):
    rng = random.Random(seed)
    rows = [(i, f"c{i % 3}", " ".join(f"w{min(int(rng.expovariate(0.05)), 140)}" for _ in range(rng.choice(size))), rng.choice([1, 5, 20])) for i in range(n)]
    rows += [(n, "c0", "", 5), (n + 1, "c0", "nowhere at all", 5), (n + 2, "c1", "w0 w0 W1", 400)]
    return spark.createDataFrame(rows, "query_id long, context_id string, query string, _fts_limit int")


def rows(df):
    return sorted((r["query_id"], r["id"], r["context_id"], r["document_id"], r["fragment_index"], round(r["full_text_score"], 8)) for r in df.collect())


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/index"


def same(spark, index, live, q):
    """Search by blocks, exhaustive search over the merged index, and over a fresh build."""
    fresh = rows(FT.bm25_search(q, FT.bm25_stats(spark.createDataFrame(live, SCHEMA))))
    assert rows(FT.bm25_search(q, index.bm25())) == fresh
    assert rows(index.search(q)) == fresh
    return fresh


def test_search_by_blocks_equals_the_exhaustive_one(spark, path):
    live = corpus(1500)
    index = TI.TextIndex.create(spark, path, spark.createDataFrame(live, SCHEMA).repartition(5))
    q = questions(spark)
    found = same(spark, index, live, q)
    assert len(found) > 100
    search = TI.BlockSearch(index, q, "_fts_limit", None, "query", ())
    search.result().count()
    total = search.report().agg(F.sum("postings"), F.sum("postings_read")).first()
    assert 0 < total[1] < total[0]


def test_appends_deletes_and_compaction(spark, path):
    """Any order of changes equals a build of what is left; an id that was freed is used again."""
    made = corpus(700)
    q = questions(spark, 12)
    index = TI.TextIndex.create(spark, path, spark.createDataFrame(made[:300], SCHEMA))
    index.append(spark.createDataFrame(made[300:500], SCHEMA))
    same(spark, index, made[:500], q)
    gone = spark.createDataFrame([("c0", 3), ("c1", 3), ("c2", 90), ("c9", 1), ("c0", 3)], "context_id string, document_id long")
    keys = {("c0", 3), ("c1", 3), ("c2", 90)}
    live = [r for r in made[:500] if (r[1], r[2]) not in keys]
    assert len(live) < 500
    index.delete(gone)
    same(spark, index, live, q)
    index.delete(gone)  # nothing is left of them: no effect
    again = [(*r[:4], "w1 w2 again") for r in made[:500] if (r[1], r[2]) in keys]
    index.append(spark.createDataFrame(again + made[500:], SCHEMA))
    live = live + again + made[500:]
    same(spark, index, live, q)
    opened = TI.TextIndex.open(spark, path)
    assert opened.manifest == index.manifest
    opened.compact()
    assert len(opened.manifest["segments"]) == 1 and not opened.manifest["deletes"]
    same(spark, TI.TextIndex.open(spark, path), live, q)


def test_a_batch_happens_once_and_a_failed_change_not_at_all(spark, path):
    made = corpus(120)
    index = TI.TextIndex.create(spark, path)
    assert index.forward() is None
    index.append(spark.createDataFrame(made[:60], SCHEMA), batch="a")
    index.append(spark.createDataFrame(made[:60], SCHEMA), batch="a")
    bad = spark.createDataFrame(made[60:], SCHEMA).withColumn("value", F.when(F.col("id") == 90, F.raise_error(F.lit("x"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        index.append(bad, batch="b")
    index = TI.TextIndex.open(spark, path)
    assert index.bm25().totals.first()["n_docs"] == 60
    index.append(spark.createDataFrame(made[60:], SCHEMA), batch="b")
    same(spark, TI.TextIndex.open(spark, path), made, questions(spark, 6))


def test_an_append_reads_no_old_text(spark, path, monkeypatch):
    """Plans of an append name the new rows and the new segment's own tables only."""
    made = corpus(100)
    index = TI.TextIndex.create(spark, path, spark.createDataFrame(made[:80], SCHEMA))
    old = "/000000"
    plans, read = [], type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p: plans.append(p) or read(self, *p))
    index.append(spark.createDataFrame(made[80:], SCHEMA))
    assert plans and not [p for p in plans if any(old in x for x in p)]


def test_empty_fragments_and_no_queries(spark, path):
    none = spark.createDataFrame([], SCHEMA)
    q = questions(spark, 3)
    bare = TI.TextIndex.create(spark, path + "-bare")
    assert bare.search(q).count() == 0 and set(rows(bare.search(q))) == set() and bare.compact() is bare
    index = TI.TextIndex.create(spark, path, none)
    assert index.search(q).count() == 0
    index.append(spark.createDataFrame([(1, "c0", 1, 0, None), (2, "c0", 1, 1, ""), (3, "c0", 1, 2, "w1"), (4, None, None, None, "w1 w1")], SCHEMA))
    assert rows(index.search(q)) == rows(FT.bm25_search(q, index.bm25()))
    assert index.search(q.limit(0)).count() == 0


def test_a_search_moves_no_forward_rows_nor_postings(spark, path):
    """Postings are summed by fragment, and found rows scored, where they lie."""
    index = TI.TextIndex.create(spark, path, spark.createDataFrame(corpus(600), SCHEMA))
    search = TI.BlockSearch(index, questions(spark, 5), "_fts_limit", None, "query", ())
    parts = search.read(search.chosen(None, budget=200)).values()
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in parts]
    assert plans and not any("Exchange hashpartitioning" in p or "Exchange rangepartitioning" in p for p in plans)


def test_repeated_ids_are_added_up(spark, path):
    """Found rows that share an id and keys count as one fragment's, as in the exhaustive search."""
    made = corpus(200)
    index = TI.TextIndex.create(spark, path, spark.createDataFrame(made + made[:40], SCHEMA))
    q = questions(spark, 6).where("_fts_limit < 400")
    found = rows(index.search(q))
    assert found and set(found) <= set(rows(FT.bm25_search(q.withColumn("_fts_limit", F.lit(500)), index.bm25())))
    assert len({r[:2] for r in found}) == len(found) and any(r[1] < 40 for r in found)


def test_another_session_reads_a_stored_index(spark, path):
    made = corpus(150)
    index = TI.TextIndex.create(spark, path, spark.createDataFrame(made, SCHEMA))
    q = questions(spark, 4)
    found = rows(index.search(q))
    for kind in ("forward", "postings"):
        spark.sql(f"DROP TABLE ragframe_{kind}_{index.manifest['segments'][0]['name']}")
    assert rows(TI.TextIndex.open(spark, path).search(q)) == found
