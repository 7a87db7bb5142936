"""Packing: exact cover, sequence sizes, neighbourhoods, odd rows."""

import zlib
from collections import defaultdict

import numpy as np

from ragframe.llm import packing as PK
from ragframe.llm.catalog import QUERIES
from ragframe.llm.common import vocabulary
from ragframe.llm.tokens import Encoder

SF = "/root/testdata/sf0.01"


def covers(spans):
    at = 0
    for start, size in sorted(spans):
        assert start == at
        at += size
    return at


def check(rows, ids, length=2048):
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= length
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert {d: covers(s) for d, s in pieces.items()} == {d: len(i) for d, i in ids.items()}
    sizes = [covers(s) for s in seqs.values()]
    assert all(s & (s - 1) == 0 for s in sizes) and sum(s == length for s in sizes) >= len(sizes) - 12 * 50
    return seqs


def test_documents(spark):
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    ids = {r.doc_id: np.append(enc.encode(r.text), np.uint32(1)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(QUERIES["op7_packing"](spark, SF).collect(), ids)


def test_hilbert_curve_steps():
    """Neighbours on the curve are neighbours in space, and every cell is met once."""
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = PK.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        line = grid[np.argsort(key)]
        assert (np.abs(np.diff(line, axis=0)).sum(1) == 1).all()


def test_alike_documents_are_packed_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = sorted(PK.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in rows))
    same = sum(lang[a] == lang[b] for a, b in zip(order, order[1:])) / len(order)
    mixed = sum(v ** 2 for v in np.unique(list(lang.values()), return_counts=True)[1] / len(lang))
    assert same > mixed + 0.2


def test_odd_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (2, "", 3), (3, "word " * 30_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, curve int")
    got = PK.pack_documents(docs, vocabulary("word_bpe_49k.json"), length=512, with_ids=True)
    by = got.collect()
    assert len(got.columns) == 8 and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in by)
    assert sum(r.length for r in by) == 3 + 30_001 and sum(r.doc_id == 2 for r in by) == 2
    assert PK.pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0
    null = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert PK.pack_documents(null, vocabulary("word_bpe_49k.json")).first().doc_id is None
