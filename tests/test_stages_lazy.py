"""Stages that need no text search build no text index."""

from ragframe.plans.retrieve import retrieval_stages


def test_an_index_is_built_when_a_text_search_needs_it(spark):
    q = spark.createDataFrame([(1, "c0", "w1", [1.0, 0.0])], "query_id long, context_id string, query string, embedding array<float>")
    f = spark.createDataFrame([(1, "c0", 1, 0, 0, "w1", {}, [1.0, 0.0])], "id long, context_id string, document_id long, fragment_index long, "
                              "chunk_index long, value string, metadata map<string,string>, embedding array<float>")
    made = []

    def index():
        from ragframe.operators.fulltext import bm25_stats
        made.append(1)
        return bm25_stats(f)

    st = retrieval_stages(q, f, None, index)
    assert st["queries"].count() == 1 and st["sem_ranked"].count() == 1 and not made
    assert st["fts_top"].count() == 1 and len(made) == 1
