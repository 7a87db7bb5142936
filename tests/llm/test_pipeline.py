"""The pipeline: columns, effects of each stage, whole result, odd tables."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as CP
from ragframe.llm import decontaminate as DC
from ragframe.llm import langid as LI
from ragframe.llm import pii as PI
from ragframe.llm import simhash as SH
from ragframe.llm.common import vocabulary
from ragframe.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = [n for n, _ in CP.STAGES], {}
    assert len(names) == 5
    for n, stage in CP.STAGES:
        docs = stage(spark, docs, SF)
        if n != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[n] = docs.collect()
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    one, two, three, four, five = kept.values()
    model = LI.Model(LI.fit(spark.read.parquet(f"{SF}/documents.parquet")))
    assert {r.doc_id for r in one} == {d for d, r in start.items() if model.predict(r.text)[1] >= LI.MIN_MARGIN}
    fps = {r.doc_id: SH.fingerprint(r.text) for r in one}
    groups = {r.doc_id: r.component_id for r in SH.simhash_near_dedup(spark.createDataFrame(one)).collect()}
    assert {r.doc_id for r in two} == set(groups.values())
    left = [r.doc_id for r in two]
    assert all(bin(fps[a] ^ fps[b]).count("1") > 2 for i, a in enumerate(left) for b in left[:i])
    items = DC.Items([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    assert {r.doc_id for r in three} == {r.doc_id for r, hits in zip(two, items.find([r.text for r in two])) if not hits}
    masked = {r.doc_id: r.text for r in PI.pseudonymize(spark.createDataFrame(three), key="key of the pipeline").collect()}
    assert {r.doc_id: r.text for r in four} == masked and masked != {r.doc_id: r.text for r in three}
    enc, got = Encoder(vocabulary("word_bpe_49k.json")), {}
    for r in five:
        got.setdefault(r.doc_id, []).append(r)
    for r in four:
        ids = np.append(enc.encode(r.text), np.uint32(1))
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in got[r.doc_id])
        assert sum(p.length for p in got[r.doc_id]) == len(ids)
    assert set(got) == {r.doc_id for r in four}


def test_run_matches_the_stages(spark):
    rows = CP.run(spark, SF)
    assert rows.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100


@pytest.mark.parametrize("n", range(5))
def test_stages_on_odd_tables(spark, n):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the house and the garden of the king 10.0.0.1", "en", "s", 5), (3, "the house and the garden of the king 10.0.0.1", "en", "s", 5),
            (None, "das haus und der garten", "de", None, 1), (5, "das haus und der garten des " * 20_000, "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = CP.STAGES[n][1](spark, docs, SF)
    assert out.count() <= 10_000 and (n == 4 or out.columns == docs.columns)
    empty = CP.STAGES[n][1](spark, docs.limit(0), SF)
    assert empty.count() == 0 and (n == 4 or empty.columns == docs.columns)
