"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query is executed in full with the ``noop`` sink (all rows computed, none
collected). Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "retrieve",            # flagship: hybrid retrieval, every query, whole corpus
    "bm25_search",
    "semantic_search",
    "rrf_fuse",
    "ann_search",
    "chunk_documents",
    "ingest",
    "assemble_context",
    "build_messages",
    "answer_commands",
    "answers_in_window",
    "assemble_answers_stream",
    "eval_correctness",
    "parse_documents",
]
# measured again at a smaller scale factor, so growth (not only a point) is visible
GROWTH = ["chunk_documents", "bm25_search", "semantic_search", "ann_search", "rrf_fuse", "retrieve"]


def run(qs, name, spark, sf_dir):
    """A headline query; the approximate search without the exact one that the
    registered query compares it with."""
    if name == "ann_search":
        from ragframe.operators.codes import code_search
        from ragframe.plans import catalog
        return code_search(catalog._stages(spark, sf_dir)["queries"], catalog._codes(spark, sf_dir))
    return qs[name](spark, sf_dir)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    os.environ["BENCH_CPUS"] = cpus
    only = [a for a in sys.argv[1:] if not a.startswith("-")]

    from ragframe.plans import catalog
    from ragframe.session import get_spark

    spark = get_spark(master=f"local[{cpus}]")
    qs = catalog.QUERIES
    # warm-up (JVM, code generation, Python workers) on the smallest scale
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        qs["retrieve"](spark, warm).write.format("noop").mode("overwrite").save()
        catalog._STAGE_CACHE.clear()

    catalog._STAGE_CACHE.clear()
    times: dict[str, float] = {}
    extra: dict = {}
    if not only:
        # the builds that searches read from, apart from the searches
        build = {}
        for name, make in (("fragments", catalog._fragments), ("text_index", catalog._index), ("codes", catalog._codes)):
            t0 = time.perf_counter()
            make(spark, sf_dir)
            build[name] = round(time.perf_counter() - t0, 3)
        extra["build"] = build
    for name in only or HEADLINE:
        # nothing that an earlier query computed is read; only the builds are
        for key in [k for k in catalog._STAGE_CACHE if k[0] == "stages"]:
            del catalog._STAGE_CACHE[key]
        t0 = time.perf_counter()
        df = run(qs, name, spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)

    if not only:
        # recall@k of the search by codes against the exact search (not timed)
        from pyspark.sql import functions as F
        rec = qs["ann_search"](spark, sf_dir).groupBy("query_id").agg(F.first("recall").alias("r"))
        extra["ann_recall_at_k"] = round(float(rec.agg(F.avg("r")).first()[0] or 0.0), 4)
        # growth: the core retrieval operators at a second, smaller size
        small = os.environ.get("BENCH_SMALL_SF_DIR", "/root/testdata/sf0.01")
        if os.path.isdir(small) and os.path.abspath(small) != os.path.abspath(sf_dir):
            grow = {}
            for make in (catalog._fragments, catalog._index, catalog._codes):
                make(spark, small)
            for name in GROWTH:
                t0 = time.perf_counter()
                run(qs, name, spark, small).write.format("noop").mode("overwrite").save()
                grow[name] = round(time.perf_counter() - t0, 3)
            extra["growth"] = {"small_sf_dir": small, "queries": grow}

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
