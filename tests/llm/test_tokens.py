"""Token files: exact round trip, random access, bit widths, odd rows."""

import functools
import zlib

import duckdb
import numpy as np
import pytest

from ragframe.llm import tokens as TK
from ragframe.llm.common import vocabulary
from ragframe.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def whole(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_documents_round_trip(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op4_token_files"](spark, SF).collect()}
    assert len(got) == len(rows)
    at = 0
    for r in rows:
        ids = np.array(whole(vocabulary("byte_bpe_50k.json"), r.text) + [2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name):
    enc = TK.Encoder(vocabulary(name))
    texts = ["", " ", "  a", "a  b", "a \n b", "a\n b", "a\t b", "a ", "\n", "don't we'll 's", "x<|endoftext|>y <|endoftext|>", "İstanbul ΑΣ ÉÑ", "a\u00a0 b", "!\x1c! \x1c", "naïve 你好 world  ",
             "a\u3000 b", "e\u0301 \u0301x", " ".join(str(i) for i in range(3000)), "Wörter, Größe. Ñandú;\nÉté. x.\ny z,\nÎle I\u0307x ŉ ſt ÅÅ ﬁn", "word.\n\nNext a.\n b ,. x., y,\nz.",
             "<|startoftext|>, a <|endoftext|>.", "a <|endoftext|> b", "<|ENDOFTEXT|> x <|StartOfText|>", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endof text|>"]
    for t in texts:
        assert enc.encode(t).tolist() == whole(vocabulary(name), t), repr(t)
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()]
    assert all(enc.encode(t).tolist() == whole(vocabulary(name), t) for t in texts)
    many = TK.Encoder(vocabulary(name)).encode_many([None, *texts, "", None])
    assert [m.tolist() for m in many] == [whole(vocabulary(name), t) for t in [None, *texts, "", None]]
    assert TK.Encoder(vocabulary(name)).encode_many([]) == [] and len(TK.Encoder(vocabulary(name)).encode_many([None])[0]) == 0


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(TK, "REMEMBERED", 100)
    enc = TK.Encoder(vocabulary("byte_bpe_50k.json"))
    for k in range(20):
        t = " ".join(f"w{(k * 37 + i) % 500}" for i in range(60))
        assert enc.encode(t).tolist() == whole(vocabulary("byte_bpe_50k.json"), t)
        assert len(enc.pieces) <= 100 and len(enc.pieces.old) <= 100


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, np.uint64).astype("<u4")
    packed = TK.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (TK.unpack(packed, 1001, bits) == ids).all()


def test_random_access(monkeypatch):
    monkeypatch.setattr(TK, "BLOCK_TOKENS", 64)
    out, every = TK.FileWriter(3, 17), []
    data = b""
    for d in range(30):
        ids = np.arange(d * 1000, d * 1000 + d * 11, dtype="<u4")
        every.append(ids)
        for b in out.add(d if d else None, ids):
            data += b + b"\n"
    for b in out.end():
        data += b + b"\n"
    reader, line = TK.FileReader(data), np.concatenate(every)
    for a, b in ((0, 1), (63, 65), (100, 1000), (0, len(line)), (len(line) - 1, len(line)), (5, 5)):
        assert (reader.tokens(a, b) == line[a:b]).all()
    docs = list(reader.documents())
    assert [d[0] for d in docs] == [None, *range(1, 30)] and [d[2] for d in docs] == [len(x) for x in every]
    assert [d[3] for d in docs] == [zlib.crc32(x.tobytes()) for x in every]


def test_odd_rows(spark, monkeypatch):
    rows = [(5, None, 1), (3, "", 1), (None, "a b", 1), (3, "", 1), (-7, "long text " * 60_000, 1), (5, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie int")
    got = sorted(TK.tokenized(docs, vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -7, 3, 3, 5, 5]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert sum(r.n_tokens == 1 for r in got) == 3
    assert TK.tokenized(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
