"""Invariants: partition-count invariance, rank/limit properties, purge
integrity, streaming = batch, and plan shape (no single-partition exchange,
partial top-k before the shuffle, pushed-down scans)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ragframe.operators import chat as CH
from ragframe.operators import maintenance as M
from ragframe.plans import catalog
from ragframe.plans.retrieve import retrieval_stages
from ragframe.sources import testdata as TD
from ragframe.streaming import responses as ST


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_count_invariance(spark, sf):
    cols = ["query_id", "document_id", "fragment_index", "chunk_index", "id", "rrf_score"]
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        catalog._STAGE_CACHE.clear()
        out.append(sorted(tuple(r) for r in catalog.QUERIES["retrieve"](spark, sf).select(*cols).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    catalog._STAGE_CACHE.clear()
    assert out[0] == out[1]


def test_stage_properties(spark, sf):
    st = retrieval_stages(TD.queries(spark, sf), TD.corpus(spark, sf), TD.contexts(spark, sf))
    sem = st["sem_ranked"]
    assert sem.agg(F.min("semantic_rank")).first()[0] == 1
    # limits respected per query
    assert sem.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 20
    fused = st["fused"]
    cand = st["sem_top"].select("query_id", "id").union(st["fts_ctx"].select("query_id", "id"))
    assert fused.select("query_id", "id").subtract(cand).count() == 0          # fused ⊆ candidates
    ret = st["retrieved"]
    m = st["matches"].select("query_id", "document_id", F.col("matched_fragment_index").alias("fragment_index"))
    assert m.subtract(ret.select("query_id", "document_id", "fragment_index")).count() == 0  # ⊇ matches
    assert ret.groupBy("query_id", "document_id", "fragment_index").count().where("count > 1").count() == 0


def test_plan_shape(spark, sf):
    df = catalog.QUERIES["retrieve"](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # only one-row (keyless) aggregates may gather into one partition
            assert "HashAggregate(keys=[]" in lines[i + 1], lines[i + 1]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "WindowGroupLimit" in formatted


def test_scan_pruning(spark, sf):
    q = catalog.QUERIES["bm25_search"](spark, sf)
    formatted = q._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # the documents scan reads only the columns it needs (no lang/n_chars)
    for line in formatted.splitlines():
        if line.strip().startswith("ReadSchema") and "text" in line:
            assert "n_chars" not in line and "lang" not in line


def test_purge_leaves_no_orphans(spark, sf):
    ctx, docs, emb = M.purge_contexts(TD.contexts(spark, sf), TD.documents_table(spark, sf),
                                      TD.line_chunks(spark, sf),
                                      TD.contexts(spark, sf).where(F.col("context_id").isin("src1", "src2")))
    rep = M.integrity_report(ctx, docs, emb).first()
    assert rep.orphan_embeddings == 0 and rep.orphan_documents == 0
    assert emb.where(F.col("context_id").isin("src1", "src2")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Answers do not depend on how the events are cut into micro-batches: five
    files, one per trigger, give exactly the batch's answers, also when events of
    an answered query keep coming."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for q in range(40):
        at = t0 + dt.timedelta(seconds=7 * q)
        rows.append((q, 0, at, "Retrieval", "r"))
        for k in range(1, 9):
            kind = "Finished" if q % 3 and k == 2 + q % 6 else "Partial"
            rows.append((q, k, at + dt.timedelta(seconds=k * 20), kind, f"{q}.{k} "))
        rows.append((q, 20, at + dt.timedelta(seconds=900), "Partial", "late"))
    rows.append((999, 0, t0 + dt.timedelta(seconds=5000), "Partial", "moves the watermark"))
    rows.sort(key=lambda r: (r[2], r[0]))
    schema = "query_id long, seq long, ts timestamp, type string, content string"
    src = str(tmp_path / "events")
    for i in range(5):
        part = rows[i * len(rows) // 5:(i + 1) * len(rows) // 5]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    ev = spark.createDataFrame(rows, schema)
    inside = CH.subscribe_responses(ev, CH.first_event_subscriptions(ev)).where("query_id <> 999")
    for mode in ("until_finished", "leading"):
        want = sorted((r.query_id, r.answer, r.status) for r in CH.assemble_answers(inside, mode=mode).collect())
        stream = ST.assemble_answers_stream(ST.event_source(spark, src, max_files_per_trigger=1), mode=mode)
        got = sorted((r.query_id, r.answer, r.status) for r in ST.run_to_table(stream, path=str(tmp_path / mode)).collect())
        assert got == want and len(got) == 40


def test_bm25_scores_in_place(spark, sf):
    """C4 over a built index: nothing is exchanged between the postings and the
    partial limit of each task."""
    df = catalog.QUERIES["bm25_search"](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    # from the partial limit down the streamed side (the build sides are broadcasts)
    spine, skip = [], None
    for line in lines[at + 1:]:
        depth = len(line) - len(line.lstrip(" :+-*("))
        if skip is not None and depth > skip:
            continue
        skip = depth if "Broadcast" in line and ("Exchange" in line or "QueryStage" in line) else None
        if skip is None and "Subquery" not in line:
            spine.append(line)
    assert any("bucketed" in line.lower() or "FileScan" in line or "Scan parquet" in line for line in spine)
    assert not any("Exchange hashpartitioning(query_id" in line for line in spine), plan


def test_stored_table_scans_are_pruned(spark, sf, tmp_path):
    """On a fragment table stored partitioned by context and sorted by
    document, the vector scan reads only the batch's contexts and the expansion
    scan only the matched documents (pushed into the Parquet scan)."""
    from ragframe.plans.retrieve import retrieve
    path = str(tmp_path / "fragments")
    from ragframe.sources.tables import write_fragments
    write_fragments(TD.corpus(spark, sf), path)
    frags = spark.read.parquet(path)
    q = TD.queries(spark, sf).where(F.col("context_id").isin("src1", "src2"))
    import re
    st = retrieval_stages(q, frags, TD.contexts(spark, sf))
    out = st["retrieved"]

    def fmt(df):
        return df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # both scans are pruned by the batch's keys at run time, not by a list of literals
    assert re.search(r"PartitionFilters: \[.*context_id#\d+.*dynamicpruning", fmt(st["sem_top"]).replace("\n", " ")) or "LeftSemi" in fmt(st["sem_top"])
    assert "LeftSemi" in fmt(out)
    expected = retrieve(q, TD.corpus(spark, sf), TD.contexts(spark, sf))
    cols = ["query_id", "document_id", "fragment_index", "id", "rrf_score"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, expected.select(*cols).collect()))


def test_persisted_index_roundtrip(spark, sf, tmp_path):
    """An index written to storage and read back scores exactly like the in-plan one, also with the stored
    document frequencies."""
    from ragframe.operators import fulltext as FT
    from ragframe.plans.retrieve import with_settings
    ix = FT.bm25_stats(TD.corpus(spark, sf))
    ix.write(str(tmp_path / "bm25"))
    back = FT.Bm25Index.read(spark, str(tmp_path / "bm25"))
    q = with_settings(TD.queries(spark, sf), TD.contexts(spark, sf))
    cols = ["query_id", "id", "full_text_score"]
    a = sorted(map(tuple, FT.bm25_search(q, ix, "_fts_limit", 20).select(*cols).collect()))
    b = sorted(map(tuple, FT.bm25_search(q, back, "_fts_limit", 20).select(*cols).collect()))
    assert a == b and len(a) > 0


def test_entry_from_foreign_cwd(tmp_path):
    """The driver imports __spark_entry__ from elsewhere: Python workers must
    still import the package (shipped with addPyFile)."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.entry(s).count())\n"
        "print('ING', E.queries()['chunk_documents'](s, '/root/testdata/sf0.001').count())\n" % root)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         timeout=600, env=env)
    assert "ROWS" in out.stdout and "ING" in out.stdout, out.stderr[-2000:]


import pytest  # noqa: E402


@pytest.mark.parametrize("name", ["append_embeddings", "assemble_answers", "upsert_documents",
                                  "bm25_search", "group_by_document", "eval_correctness",
                                  "answer_commands"])
def test_partition_invariance_more(spark, sf, name):
    """Same rows with 1 and 8 shuffle partitions (ids of A8 included)."""
    from helpers import spark_rows
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        catalog._STAGE_CACHE.clear()
        out.append(spark_rows(catalog.QUERIES[name](spark, sf))[0])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    catalog._STAGE_CACHE.clear()
    assert out[0] == out[1]
