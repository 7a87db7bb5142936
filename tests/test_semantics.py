"""Hand-built cases for the semantics that must be matched."""
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe.functions.text import escape_html, escape_query, format_file_size, java_trim
from ragframe.operators import chat as CH
from ragframe.operators import commands as CM
from ragframe.operators import evals as EV
from ragframe.operators import fusion as FU
from ragframe.operators import ingest as IG
from ragframe.operators import maintenance as M
from ragframe.operators import prompt as PR
from ragframe.operators import vectors as V
from ragframe.plans.retrieve import retrieve
from ragframe.sources import tables as TB
from ragframe.sources import testdata as TD


def test_escape_table(spark):
    """Each of the 18 characters alone maps to backslash + itself."""
    rows = [(c,) for c in K.ESCAPED_QUERY_CHARS] + [("a",)]
    df = spark.createDataFrame(rows, "c string").select("c", escape_query("c").alias("e"))
    got = {r.c: r.e for r in df.collect()}
    for c in K.ESCAPED_QUERY_CHARS:
        assert got[c] == "\\" + c
    assert got["a"] == "a"


def test_escape_html_order(spark):
    df = spark.createDataFrame([("a&b<c>\"'/\nx",)], "t string")
    assert df.select(escape_html("t")).first()[0] == "a&amp;b&lt;c&gt;&quot;&#x27;&#x2F;<br />x"


def test_java_trim(spark):
    df = spark.createDataFrame([("\t\n a b \x01",)], "t string")
    assert df.select(java_trim("t")).first()[0] == "a b"


@pytest.mark.parametrize("n,text", [(0, "0 Bytes"), (1, "1 Bytes"), (1536, "1.5 KB"),
                                    (1048576, "1 MB"), (1073741824, "1 GB"), (1234567, "1.18 MB"),
                                    (1152, "1.13 KB"), (1664, "1.63 KB"), (1023, "1023 Bytes")])
def test_format_file_size(spark, n, text):
    assert spark.range(1).select(format_file_size(F.lit(n))).first()[0] == text


def _frags(spark, rows):
    return spark.createDataFrame(
        rows, "id long, context_id string, document_id long, fragment_index long, chunk_index long, "
              "value string, embedding array<float>").withColumn(
        "metadata", F.create_map().cast("map<string,string>"))


def test_zero_and_null_vectors(spark):
    """Distance to a zero vector is NaN, to a NULL vector NULL, both methods."""
    pairs = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0]), (2, [1.0, 0.0], None),
                                   (3, [1.0, 0.0], [1.0, 1.0])],
                                  "k int, q_vec array<float>, embedding array<float>")
    for method in ("arrow", "sql"):
        got = {r.k: r.d for r in V.cosine_distance(pairs, out="d", method=method).collect()}
        assert math.isnan(got[1])
        assert got[2] is None
        assert abs(got[3] - 0.2928932188134524) < 1e-9


def test_text_only_hit_scores_zero_and_ranks(spark):
    """A hit found only by full text gets semantic_score 0 and a NULL
    semantic rank; ranks start at 1."""
    frags = _frags(spark, [
        (1, "c", 10, 0, 0, "apple banana", [1.0, 0.0]),
        (2, "c", 10, 1, 0, "cherry", [0.0, 1.0]),
        (3, "other", 20, 0, 0, "apple", [1.0, 0.0]),
    ])
    q = spark.createDataFrame([(1, "c", "apple", [1.0, 0.0])],
                              "query_id long, context_id string, query string, embedding array<float>")
    r = retrieve(q, frags).collect()
    assert {x.fragment_index for x in r} == {0, 1}
    by_match = {x.id: x for x in r}
    # id 1 matched by both lists, rank 1 in each
    assert by_match[1].semantic_rank == 1 and by_match[1].full_text_rank == 1
    # the other context's 'apple' is cut by the context post-filter
    assert all(x.context_id == "c" for x in r)


def test_neighbour_clamp_and_lowest_chunk(spark):
    """Negative lower bound matches nothing; lowest chunk wins."""
    matches = spark.createDataFrame(
        [(1, 5, "c", 10, 0, 0.03)],
        "query_id long, id long, context_id string, document_id long, matched_fragment_index long, rrf_score double")
    frags = _frags(spark, [(i, "c", 10, i, 0, f"f{i}", [1.0]) for i in range(0, 4)]
                   + [(100 + i, "c", 10, i, 1, f"g{i}", [1.0]) for i in range(0, 4)])
    ex = FU.expand_neighbors(matches.withColumn("_look_back", F.lit(5)).withColumn("_look_ahead", F.lit(2)), frags)
    out = FU.dedupe_fragments(ex).collect()
    assert sorted(r.fragment_index for r in out) == [0, 1, 2]
    assert all(r.chunk_index == 0 for r in out)


def test_dedupe_matches_keeps_lowest(spark):
    """S3: DISTINCT ON ordered by rrf ascending keeps the lowest score."""
    m = spark.createDataFrame([(1, 1, 10, 3, 0.03), (1, 2, 10, 3, 0.01), (1, 3, 11, 3, 0.02)],
                              "query_id long, id long, document_id long, matched_fragment_index long, rrf_score double")
    got = {(r.document_id, r.id) for r in FU.dedupe_matches(m).collect()}
    assert got == {(10, 2), (11, 3)}
    best = {(r.document_id, r.id) for r in FU.dedupe_matches(m, keep="best").collect()}
    assert best == {(10, 1), (11, 3)}


def test_render_prompt_default(spark):
    """Absent parts become '' but keep their newline."""
    from ragframe.sources.tables import default_context
    ctx = default_context(TD.contexts(spark, "/root/testdata/sf0.001").limit(0), now=F.current_timestamp())
    rows = ctx.select("prompt_template").crossJoin(
        spark.createDataFrame([("q?", "CTX")], "query string, context_text string")).withColumn("query_id", F.lit(1))
    r = PR.render_prompt(rows).select("rendered.*").first()
    assert r.system == K.DEFAULT_TASK_CONTEXT + "\n\n"
    assert r.user == "<context> CTX </context>\n<query> q? </query>\n\n"
    assert r.assistant is None
    msgs = PR.build_messages(PR.render_prompt(rows)).collect()
    assert [m.role for m in sorted(msgs, key=lambda m: m.pos)] == ["system", "user"]


def test_embedding_input_leading_newline(spark):
    """Empty metadata -> input starts with a newline; keys sorted."""
    df = spark.createDataFrame([({}, "t"), ({"b": "2", "a": "1"}, "t")], "metadata map<string,string>, value string")
    got = [r.embedding_input for r in IG.embedding_inputs(df).collect()]
    assert got == ["\nt", "a: 1\nb: 2\nt"]


@pytest.mark.parametrize("text,ctx,query", [
    ("", "", ""), ("src1", "src1", ""), ("src1  two  spaces", "src1", " two  spaces"),
    ("\tsrc2 tabbed query", "src2", "tabbed query"), ("src1 hello world ", "src1", "hello world")])
def test_parse_command(spark, text, ctx, query):
    """JVM trim, single-space split, tail re-joined."""
    df = spark.createDataFrame([(1, text)], "command_id long, text string")
    r = CM.parse_command(df).first()
    assert (r.context_name, r.user_query) == (ctx, query)


def test_commands_twenty_queries(spark):
    """The command service case: 20 commands -> 40 messages; queries hello 0..19;
    answers are the concatenated Partials ('res' + 'ponse')."""
    cmds = spark.createDataFrame([(i, f"ctx-name hello {i}") for i in range(20)], "command_id long, text string")
    contexts = spark.createDataFrame([("00000000-0000-0000-0000-000000000000", "ctx-name", "test")],
                                     "context_id string, name string, description string").withColumn(
        "updated_at", F.current_timestamp())
    routed = CM.route_commands(CM.resolve_context(CM.parse_command(cmds), contexts)).withColumn(
        "query_id", F.col("command_id"))
    assert {r.user_query for r in routed.collect()} == {f"hello {i}" for i in range(20)}
    events = spark.createDataFrame(
        [(i, s, t, c) for i in range(20) for s, t, c in [(1, "Partial", "res"), (2, "Partial", "ponse"),
                                                          (3, "Finished", None)]],
        "query_id long, seq long, type string, content string")
    answers = CH.assemble_answers(events)
    msgs = CM.answer_commands(routed, answers)
    assert msgs.count() == 40
    assert {r.text for r in msgs.where("pos = 1").collect()} == {"response"}
    payloads = CM.message_payload(msgs).collect()
    import json
    for p in payloads:
        j = json.loads(p.payload)
        assert j["blocks"][0]["type"] == "section"


def test_unknown_context_reply(spark):
    cmds = spark.createDataFrame([(1, "nope hi")], "command_id long, text string")
    ctx = spark.createDataFrame([("c1", "known")], "context_id string, name string").withColumn(
        "updated_at", F.current_timestamp())
    r = CM.route_commands(CM.resolve_context(CM.parse_command(cmds), ctx)).first()
    assert r.route == "unknown_context"
    assert r.reply == "I'm sorry, I couldn't find any context for nope. Your query was `nope hi`"


def test_assemble_modes(spark):
    """S17: 'leading' stops at the first non-Partial (Retrieval first -> ''),
    'until_finished' joins every Partial before Finished; no Finished -> timeout."""
    ev = spark.createDataFrame([(1, 0, "Retrieval", None), (1, 1, "Partial", "a"), (1, 2, "Partial", "b"),
                                (1, 3, "Finished", None), (1, 4, "Partial", "late"),
                                (2, 1, "Partial", "x")],
                               "query_id long, seq long, type string, content string")
    u = {r.query_id: (r.answer, r.status) for r in CH.assemble_answers(ev).collect()}
    l_ = {r.query_id: (r.answer, r.status) for r in CH.assemble_answers(ev, mode="leading").collect()}
    assert u == {1: ("ab", "finished"), 2: ("x", "timeout")}
    assert l_[1] == ("", "finished")


def test_upload_checks(spark):
    """Exact membership by default; compat keeps the substring rule."""
    files = spark.createDataFrame([("", 1), ("text/plain", 2 * 1024 ** 3), ("image/png", 1), ("text/plain", 5)],
                                  "mime string, size long")
    exact = [(r.valid, r.error) for r in TB.admit_uploads(files).collect()]
    assert exact[0] == (False, "File type  is not allowed.")
    assert exact[1] == (False, "File size 2 GB exceeds maximum size of 1 GB")
    assert exact[2][0] is False and exact[3] == (True, None)
    compat = [r.valid for r in TB.admit_uploads(files, compat=True).collect()]
    assert compat[0] is True


def test_default_context_on_empty(spark):
    """An empty table yields the stored default context."""
    empty = TD.contexts(spark, "/root/testdata/sf0.001").limit(0)
    rows = TB.default_context(empty).collect()
    assert len(rows) == 1 and rows[0].name == K.DEFAULT_CONTEXT_NAME and rows[0].is_default


def test_assign_ids_dense(spark):
    """Ids are max+1.. in key order, consecutive, without a global window."""
    rows = spark.createDataFrame([(d, f) for d in range(7) for f in range(13)], "document_id long, fragment_index long")
    out = M.assign_ids(rows.withColumn("chunk_index", F.lit(0)), ["document_id", "fragment_index", "chunk_index"],
                       F.lit(100).cast("long"), num_partitions=5).collect()
    ids = sorted((r.document_id, r.fragment_index, r.id) for r in out)
    assert [i for _, _, i in ids] == list(range(101, 101 + 91))


def test_upserts(spark):
    cur = spark.createDataFrame([(1, "c", "n1", "d1", "PDF")],
                                "document_id long, context_id string, name string, description string, type string") \
        .withColumn("metadata", F.create_map().cast("map<string,string>")) \
        .withColumn("updated_at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    ch = spark.createDataFrame([(1, "x", "renamed", "d2", "TXT", 1), (1, "x", "renamed", "d3", "TXT", 2),
                                (2, "c", "n2", "d", "PDF", 1)],
                               "document_id long, context_id string, name string, description string, type string, "
                               "change_seq int").withColumn("metadata", F.create_map().cast("map<string,string>"))
    out = {r.document_id: r for r in M.upsert_documents(cur, ch, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert out[1].name == "n1" and out[1].context_id == "c" and out[1].description == "d3"
    assert str(out[1].updated_at).startswith("2020-01-01")
    assert out[2].name == "n2"


def test_chunk_invariants(spark, sf):
    """B2: every piece <= max, order kept, nothing lost but whitespace."""
    docs = TD.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"),
                                                   F.col("source").alias("context_id"), "text")
    for max_chars in (40, 512):
        split = IG.split_documents(docs, max_chars, overlap=0).collect()
        for r in split:
            assert all(len(p) <= max_chars for p in r.pieces)
            assert "".join("".join(p.split()) for p in r.pieces) == "".join(r.text.split())


def test_eval_f1(spark):
    cases = spark.createDataFrame([("i", "a b c", "a b c"), ("i", "a", "b"), ("i", "a b", "a c")],
                                  "input string, actual_output string, expected_output string")
    got = [(r.score, r.passed) for r in EV.eval_correctness(cases).collect()]
    assert got == [(1.0, True), (0.0, False), (0.5, True)]


def test_parse_settings_errors(spark):
    from ragframe.operators import config as CF
    raw = spark.createDataFrame([
        ('{"fullTextSearchLimit":1,"semanticSearchLimit":2,"rrfLimit":3,"fragmentLookupRange":{"lookBack":1,"lookAhead":2}}',),
        ('{"fullTextSearchLimit":1,"semanticSearchLimit":2,"rrfLimit":"x","fragmentLookupRange":{"lookBack":1,"lookAhead":2}}',),
        ('{"fullTextSearchLimit":1',)], "settings_json string")
    ok, bad = CF.parse_settings(raw)
    assert ok.count() == 1
    assert sorted(r.errors for r in bad.collect()) == ["$: malformed JSON", "rrfLimit: expected an integer"]


def test_semantic_methods_agree(spark, sf):
    """Block product, row-wise Arrow kernel and native expressions give the same
    top-k (including a zero query vector: NaN distances, ranked last)."""
    from ragframe.plans.retrieve import with_settings
    q = with_settings(TD.queries(spark, sf), TD.contexts(spark, sf))
    zero = q.limit(1).withColumn("query_id", F.lit(-1).cast("long")).withColumn(
        "embedding", F.array_repeat(F.lit(0.0).cast("float"), 64))
    q = q.unionByName(zero)
    frags = TD.corpus(spark, sf)
    res = {}
    for m, cells in (("block", 4_000_000), ("block_sliced", 50), ("arrow", 0), ("sql", 0)):
        df = V.semantic_search(q, frags, "_sem_limit", 20, method=m.split("_")[0], block_cells=cells or 1)
        res[m] = sorted((r.query_id, r.id, "nan" if r.semantic_score != r.semantic_score else r.semantic_score)
                        for r in df.collect())
    assert res["block"] == res["block_sliced"] == res["arrow"] == res["sql"]
    assert any(x[0] == -1 and x[2] == "nan" for x in res["block"])


def test_binary_files_parse(spark, tmp_path):
    """A12 + B1: files -> rows -> text (type detected from the content)."""
    (tmp_path / "a.txt").write_text("hello world\nsecond line")
    (tmp_path / "b.html").write_text("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head>"
                                     "<body><p>Hi &amp; bye</p><script>x()</script></body></html>")
    files = TB.scan_documents(spark, str(tmp_path))
    got = {r.name: r.text for r in IG.parse_documents(files).collect()}
    assert got["a.txt"] == "hello world\nsecond line"
    assert got["b.html"] == "Hi & bye"
    late = b"<?xml version='1.0'?><!-- " + b"x" * 2000 + b" --><html><body><p>late</p></body></html>"
    rows = spark.createDataFrame([(1, late, None), (2, b"caf&eacute; &mdash; <b>x</b>", "text/html"), (3, b"%PDF", "application/pdf"),
                                  (4, None, "text/plain"), (5, b"a < b", None)], "id int, content binary, mime string")
    by = {r.id: (r.text, r.parse_error) for r in IG.parse_documents(rows).collect()}
    assert by == {1: ("late", None), 2: ("caf\u00e9 \u2014 x", None), 3: (None, "no parser for application/pdf"),
                  4: (None, "no content"), 5: ("a < b", None)}
    broken = IG.parse_documents(rows, {"text/plain": lambda b: 1 / 0, "text/html": lambda b: "ok"}).where("id = 5").first()
    assert broken.text is None and "ZeroDivisionError" in broken.parse_error


def test_ann_all_cells_equals_exact(spark, sf):
    """Probing every cell is the exact search (recall 1)."""
    from ragframe.plans.retrieve import with_settings
    q = with_settings(TD.queries(spark, sf), TD.contexts(spark, sf))
    frags = TD.corpus(spark, sf)
    exact = V.semantic_search(q, frags, "_sem_limit", 20)
    approx = V.ann_search(q, V.ivf_build(frags, n_cells=4), n_probe=4)
    assert V.recall_at_k(approx, exact).agg(F.min("recall")).first()[0] == 1.0


def test_ingest_roundtrip(spark):
    """An empty document still gets its document row and no embedding;
    re-ingesting appends again unless replace=True; ids stay dense."""
    docs = spark.createDataFrame([(1, "c", "doc-1", "First line.\\nSecond line."), (2, "c", "doc-2", "   ")],
                                 "document_id long, context_id string, name string, text string")
    empty_docs = TD.documents_table(spark, "/root/testdata/sf0.001").where(F.lit(False))
    empty_emb = TD.corpus(spark, "/root/testdata/sf0.001").where(F.lit(False))
    d1, e1, rej = IG.ingest(docs, empty_docs, empty_emb, max_chars=12, dim=8)
    assert sorted(r.document_id for r in d1.collect()) == [1, 2]
    rows = e1.collect()
    assert {r.document_id for r in rows} == {1} and rej.count() == 0
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    assert all(len(r.value) <= 12 and len(r.embedding) == 8 for r in rows)
    _, e2, _ = IG.ingest(docs, d1, e1, max_chars=12, dim=8)
    assert e2.count() == 2 * len(rows)
    _, e3, _ = IG.ingest(docs, d1, e1, max_chars=12, dim=8, replace=True)
    assert e3.count() == len(rows)
    assert IG.ingest_if_absent(docs, e1).collect()[0].document_id == 2


@pytest.mark.parametrize("mode", ["until_finished", "leading"])
def test_assemble_buckets_brute_force(spark, monkeypatch, mode):
    """D7 two-level assembly equals a direct per-query computation, with tiny
    buckets so stops fall inside later buckets."""
    import random
    monkeypatch.setattr(CH, "SEQ_BUCKET", 3)
    rnd = random.Random(7)
    rows = []
    for q in range(40):
        for seq in rnd.sample(range(60), rnd.randint(0, 25)):
            t = rnd.choices(["Partial", "Finished", "Retrieval"], [8, 1, 1])[0]
            rows.append((q, seq, t, f"<{q}.{seq}>" if t == "Partial" else None))
    ev = spark.createDataFrame(rows, "query_id long, seq long, type string, content string")
    got = {r.query_id: (r.answer, r.status) for r in CH.assemble_answers(ev, mode=mode).collect()}
    want = {}
    for q in {r[0] for r in rows}:
        evs = sorted(r for r in rows if r[0] == q)
        stops = [s for _, s, t, _ in evs if (t == "Finished" if mode == "until_finished" else t != "Partial")]
        stop = min(stops) if stops else None
        text = "".join(c for _, s, t, c in evs if t == "Partial" and (stop is None or s < stop))
        want[q] = (text, "finished" if any(t == "Finished" for _, _, t, _ in evs) else "timeout")
    assert got == want


def test_upsert_paths_agree(spark, sf, monkeypatch):
    """The broadcast path and the full-outer-join path give the same table."""
    from ragframe.plans import catalog
    out = []
    for bound in (1_000_000, 0):
        monkeypatch.setattr(M, "CHANGES_BROADCAST_MAX_ROWS", bound)
        rows = []
        for name in ("upsert_contexts", "upsert_documents"):
            rows.append(sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect())))
        out.append(rows)
    assert out[0] == out[1]


def test_retrieval_report_empty_and_escaped(spark):
    """A query without hits gets one 'No documents retrieved.' row; chunks
    are HTML-escaped."""
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    r = spark.createDataFrame([(1, 10, 0, 0, 0, 0.03, 0.1, 1.5, "a<b")],
                              "query_id long, document_id long, fragment_index long, chunk_index long, "
                              "matched_fragment_index long, rrf_score double, semantic_score double, "
                              "full_text_score double, value string")
    rows = {x.query_id: x for x in PR.retrieval_report(r, q).collect()}
    assert rows[2].message == K.NO_DOCUMENTS_RETRIEVED and rows[2].document_id is None
    assert rows[1].message == "Document fragments:" and rows[1].chunk_html == "a&lt;b"


def test_ingest_from_files_with_model(spark, tmp_path):
    """B6 from raw files: A12 scan -> B1 parse -> split at the model's context
    length (snowflake-arctic-embed: 512 chars)."""
    (tmp_path / "a.txt").write_text(("word " * 300).strip())
    files = TB.scan_documents(spark, str(tmp_path)).select(
        F.lit(1).cast("long").alias("document_id"), F.lit("c").alias("context_id"), "name", "content")
    empty_docs = TD.documents_table(spark, "/root/testdata/sf0.001").where(F.lit(False))
    empty_emb = TD.corpus(spark, "/root/testdata/sf0.001").where(F.lit(False))
    docs, emb, _ = IG.ingest(files, empty_docs, empty_emb, model="snowflake-arctic-embed", dim=8)
    vals = [r.value for r in emb.orderBy("fragment_index").collect()]
    assert len(vals) == 3 and all(len(v) <= 512 for v in vals)
    assert docs.first().name == "a.txt"


def test_retrieve_edge_batches(spark, sf):
    """Empty batch -> no rows; unknown context -> no rows; a query without
    tokens still gets its vector matches (text-side empty)."""
    q = TD.queries(spark, sf)
    frags, ctx = TD.corpus(spark, sf), TD.contexts(spark, sf)
    assert retrieve(q.where(F.lit(False)), frags, ctx).count() == 0
    assert retrieve(q.limit(3).withColumn("context_id", F.lit("nowhere")), frags, ctx).count() == 0
    r = retrieve(q.limit(3).withColumn("query", F.lit("!!! ...")), frags, ctx).collect()
    assert r and all(x.full_text_rank is None and x.full_text_score == 0.0 for x in r)


def test_ann_fills_the_limit(spark, sf):
    """Whatever is probed, every query gets min(limit, rows of its context)
    rows, in one block or several, and the scan is pruned to the probed cells."""
    import re

    from ragframe.plans.retrieve import with_settings
    q = with_settings(TD.queries(spark, sf), TD.contexts(spark, sf)).withColumn("_sem_limit", F.lit(50))
    frags = TD.corpus(spark, sf)
    index = V.ivf_build(frags, n_cells=40)
    a = V.ann_search(q, index, n_probe=1)
    sizes = {r.context_id: r["count"] for r in frags.groupBy("context_id").count().collect()}
    want = {r.query_id: min(50, sizes.get(r.context_id, 0)) for r in q.collect()}
    assert {r.query_id: r["count"] for r in a.groupBy("query_id").count().collect()} == {k: v for k, v in want.items() if v}
    cols = ["query_id", "id", "semantic_score"]
    b = V.ann_search(q, index, n_probe=1, blocks=3)
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    plan = a._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN", plan)


def test_limits_and_null_vectors(spark, sf):
    """Limits above the defaults hold, and a query without a vector gets its limit
    of rows with NULL distance, on every path and for any number of blocks."""
    from ragframe.operators import fulltext as FT
    from ragframe.operators import fusion as FU
    from ragframe.plans.retrieve import with_settings
    q = with_settings(TD.queries(spark, sf), TD.contexts(spark, sf)).limit(6)
    q = q.withColumn("_sem_limit", F.lit(40)).withColumn("_fts_limit", F.lit(35)).withColumn("_rrf_limit", F.lit(30))
    null = q.limit(1).withColumn("query_id", F.lit(-1).cast("long")).withColumn("embedding", F.lit(None).cast("array<float>"))
    both = q.unionByName(null)
    frags = TD.corpus(spark, sf)
    res = {}
    for m, blocks in (("block", 1), ("block", 4), ("arrow", 2), ("sql", 1)):
        rows = V.semantic_search(both, frags, blocks=blocks, method=m).collect()
        res[m, blocks] = sorted((r.query_id, r.id, r.semantic_score) for r in rows if r.query_id >= 0), sorted(
            (r.id, r.semantic_score) for r in rows if r.query_id == -1)
    first = res["block", 1]
    assert all(x == first for x in res.values())
    assert len(first[1]) == 40 and all(s is None for _, s in first[1]) and len(first[0]) == 40 * 6
    fts = FT.bm25_search(q, FT.bm25_stats(frags))
    assert fts.groupBy("query_id").count().agg(F.max("count")).first()[0] == 35
    fused = FU.rrf_fuse(V.semantic_rank(V.semantic_search(q, frags, carry=["_rrf_limit"])), FT.fulltext_rank(FT.context_post_filter(FT.bm25_search(q, FT.bm25_stats(frags), carry=["_rrf_limit"]))))
    assert fused.groupBy("query_id").count().agg(F.max("count")).first()[0] == 30


def test_corpus_holds_every_fragment(spark, sf):
    docs = TD.read(spark, sf, "documents")
    lines = docs.select(F.sum(F.size(F.split("text", "\n")))).first()[0]
    c = TD.corpus(spark, sf)
    n = c.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count("embedding"), F.count_distinct("document_id")).first()
    assert tuple(n) == (lines, lines, lines, docs.count())


def test_repeated_form_fields(spark):
    """The first value of a repeated field counts; names are decoded."""
    from ragframe import constants as K
    body = "&".join(f"{f}=x%20{f}" for f in K.COMMAND_FIELDS if f != "is_enterprise_install") + "&is_enterprise%5Finstall=true&text=b&text=c&novalue"
    ok, bad = CM.decode_commands(spark.createDataFrame([(1, body)], "command_id int, body string"))
    row = ok.first()
    assert row.text == "x text" and row.is_enterprise_install and bad.count() == 0


def test_chat_with_settings_column(spark):
    """Settings with a map travel with their prompt."""
    from ragframe import schemas as S
    m = spark.createDataFrame([(1, 0, "user", "<context> a  b\nc </context>")], "query_id long, pos long, role string, content string")
    m = m.withColumn("settings", F.from_json(F.lit('{"logitBias":{"x":1.0},"n":1}'), S.CHAT_COMPLETION_SETTINGS))
    assert CH.complete_chat(m, settings_col="settings").first().answer == "a b c"


def test_rejects_of_ingest(spark):
    """Unparseable files and vectors of the wrong kind are rejects; the rest enters."""
    files = spark.createDataFrame([(1, "c", "doc-1", b"one two", "text/plain"), (2, "c", "doc-2", b"%PDF", "application/pdf"), (3, "c", "doc-3", b"bad", "text/plain")],
                                  "document_id long, context_id string, name string, content binary, mime string")
    empty = "/root/testdata/sf0.001"
    docs, emb, rej = IG.ingest(files, TD.documents_table(spark, empty).where("false"), TD.corpus(spark, empty).where("false"), dim=2,
                               embedder=lambda texts: [[1.0] if "bad" in t else [1.0, 2.0] for t in texts])
    assert sorted(r.document_id for r in docs.collect()) == [1, 3] and [r.document_id for r in emb.collect()] == [1]
    assert sorted((r.document_id, r.error) for r in rej.collect()) == [(2, "no parser for application/pdf"), (3, "embedding of length 1")]
    short = IG.ingest(files.where("document_id = 1"), TD.documents_table(spark, empty).where("false"), TD.corpus(spark, empty).where("false"), dim=2,
                      embedder=lambda texts: [])
    assert [r.error for r in short[2].collect()] == ["no embedding"] and short[1].count() == 0


def test_no_scratch_folder_on_a_cluster(monkeypatch):
    """Only a local session may fall back to a scratch checkpoint folder."""
    import pytest

    from ragframe import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_hashed_embedder_stable():
    """The default embedder is deterministic, unit-norm, and independent of the
    batch it is called in."""
    import numpy as np
    import pandas as pd

    from ragframe.functions.plugins import hashed_embedder
    emb = hashed_embedder(16)
    texts = pd.Series(["the cat sat", "The Cat sat on the mat", "", None])
    together = emb(texts)
    alone = [emb(pd.Series([t]))[0] for t in texts]
    for a, b in zip(together, alone):
        assert np.array_equal(a, b)
    assert abs(np.linalg.norm(together[0]) - 1.0) < 1e-6 and not together[2].any()
