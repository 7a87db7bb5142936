"""Scale rules checked on the physical plan of every registered query."""
from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from ragframe.plans import catalog

QUERIES = {name: q for name, q in E.queries().items() if name in catalog.QUERIES}
STREAMING = {"assemble_answers_stream", "subscribe_responses_stream", "ingest_stream",
             "assemble_answers_by_bucket", "subscribe_streams", "answer_stream"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_plan_rules(spark, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            # only one-row (keyless) aggregates, or a literal-bounded LIMIT, may gather
            assert re.search(r"Aggregate\(keys?=\[\]", nxt) or "LocalLimit" in nxt, (name, nxt)
