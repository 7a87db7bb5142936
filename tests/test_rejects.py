"""Rejects grow with the documents, and parsing and splitting hold bounded slices."""
from __future__ import annotations

import pyarrow as pa

from ragframe.operators import ingest as IG
from ragframe.plans import catalog
from ragframe.sources import testdata as TD


def test_a_fifth_of_all_documents_is_rejected(spark, sf):
    found = catalog.QUERIES["ingest_rejects"](spark, sf).collect()
    ids = [r[0] for r in TD.read(spark, sf, "documents").select("doc_id").collect()]
    pdf = {i + max(ids) + 1 for i in ids if i % 5 == 0}
    assert pdf <= {r.document_id for r in found if r.error == "no parser for application/pdf"}
    assert {-1, -4, -6} <= {r.document_id for r in found}


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(IG, "SLICE_BYTES", 10)
    texts = ["abc", None, "defg", "hijklmnopqrstuvw", "", "x" * 10, "y"]
    batch = pa.record_batch({"t": pa.array(texts)})
    parts = [p.column(0).to_pylist() for p in IG._slices(batch, "t")]
    assert sum(parts, []) == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in parts) and len(parts) > 2


def test_parse_and_split_of_odd_rows(spark):
    rows = [(1, b"plain", "text/plain"), (2, None, "text/plain"), (3, b"<html><body>x</body></html>", None), (4, b"?", "application/x")]
    out = {r.i: (r.text, r.parse_error) for r in IG.parse_documents(spark.createDataFrame(rows, "i int, content binary, mime string")).collect()}
    assert out[1] == ("plain", None) and out[2] == (None, "no content") and out[3][1] is None and out[4][1] == "no parser for application/x"
    split = IG.split_documents(spark.createDataFrame([(1, "a. b"), (2, None), (3, "")], "i int, text string"), 3, 0)
    assert {r.i: r.pieces for r in split.collect()} == {1: ["a.", "b"], 2: [], 3: []}
