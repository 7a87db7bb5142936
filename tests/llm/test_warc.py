"""Archives are read back by other readers too; the index against plain sorting."""

import glob
import gzip
import hashlib
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragframe.llm import warc as WA
from ragframe.llm.common import shared_path

SCHEMA = "page_id long, url string, html string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    got = list(WA.LoserTree(runs))
    assert [runs[r][i] for r, i in got] == sorted(x for r in runs for x in r)
    assert got == sorted(got, key=lambda g: (runs[g[0]][g[1]], g))  # ties: by run, then place


@pytest.mark.parametrize("n", [0, 1, -1, 2**63 - 1, -(2**63), 123456789012])
def test_record_ids(n):
    assert WA.page_of(WA.record_id(n)) == n
    assert WA.page_of(WA.record_id(None, "x")) is None and WA.page_of(None) is None


def test_url_keys():
    keys = {"http://www.Example.org:80/a?b=1#c": "org,example)/a?b=1", "https://u:p@a.b.example.org?q": "org,example,b,a)/?q",
            None: "-", "no scheme": "no scheme", "http://": ")/", "https://x.org:80/": "org:80,x)/"}
    assert {u: WA.url_key(u) for u in keys} == keys


def brute(rows):
    firsts = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            firsts[data] = min(firsts.get(data, page_id), page_id)
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        lead = firsts.get(data)
        again = lead is not None and lead != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=repr)


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def rows_of(found):
    return sorted((tuple(r[c] for c in COLS) for r in found), key=repr)


def odd_pages():
    long = "<p>" + "x" * 200 + "</p>"
    return [(3, "http://a.org/", long), (1, "http://b.org/ x\r\ny", long), (2, None, long), (None, "http://a.org/", long), (1, "http://b.org/", long),
            (4, "", "short"), (5, "u", "short"), (6, "http://a.org/", None), (7, "http://a.org/", ""), (8, "http://é.org/ü", "é\r\n\r\nWARC/1.1\r\n\x00" * 30),
            (9, "http://a.org/", "\x1f\u008b" + "z" * 3_000_000), (None, None, None), (-5, "http://a.org/", "n" * 100), (-4, "http://a.org/", "n" * 100),
            (10, "http://a.org/", "n" * 99), (11, "http://a.org/", "n" * 99), (None, "p", "q" * 150), (None, "p", "q" * 150)]


def test_odd_rows(spark):
    rows = odd_pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"digest": F.lit(1), "archive": F.lit("x"), "pid": F.lit(2)})
    found = WA.archived(df).collect()
    assert rows_of(found) == brute(rows) and all(r["intact"] for r in found)
    assert sorted(r["position"] for r in found) == list(range(len(rows)))
    assert WA.archived(df.limit(0)).collect() == []


def test_archives_are_plain_warc(spark):
    """Whole files and single records by offset, without this module's reader."""
    rows, path = odd_pages(), shared_path(spark, "warc-test")
    found = WA.archived(spark.createDataFrame(rows, SCHEMA).coalesce(2), path=path).collect()
    files = {f.rsplit("/", 1)[1]: open(f, "rb").read() for f in glob.glob(f"{path.removeprefix('file:')}/part-*")}
    whole = b"".join(gzip.decompress(b) for b in files.values())
    assert whole.count(b"WARC-Record-ID: <urn:uuid:") == len(rows)
    for r in found:
        one = gzip.decompress(files[r["archive"]][r["offset"]:r["offset"] + r["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
        assert (b"WARC-Type: " + r["record_type"].encode()) in one and r["payload_digest"].encode() in one


def test_index_is_globally_ordered(spark):
    """A third of all captures have one URL; ranges are small, so it spans many of them."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(i, "http://hot.org/" if i % 3 == 0 else f"http://h{rng.randrange(40)}.org/{rng.randrange(9)}",
             f"<p>{rng.randrange(60)}</p>" * 20, start + timedelta(seconds=rng.randrange(50))) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA + ", at timestamp").repartition(13)
    path = shared_path(spark, "warc-test")
    WA.write_archives(df, path, F.col("at"))
    captures = WA.read_archives(spark, path)
    merged = WA.merge_runs(captures, range_rows=100).orderBy("position").collect()
    assert [r["position"] for r in merged] == list(range(3000))
    assert [r["page_id"] for r in merged] == [r[0] for r in sorted(rows, key=lambda r: (WA.url_key(r[1]), r[3], r[0]))]
    assert [r["page_id"] for r in WA.merge_runs(captures, range_rows=10**6).orderBy("position").collect()] == [r["page_id"] for r in merged]
    assert rows_of(merged) == brute([r[:3] for r in rows])


def test_hot_and_cold_payloads_by_shuffle(spark, monkeypatch):
    """No broadcast: pages with a hot payload find their lead as well."""
    monkeypatch.setattr(WA, "broadcast_up_to", lambda df, *a: df)
    monkeypatch.setattr(WA, "HOT_COPIES", 50)
    rows = [(i, f"http://a.org/{i}", ("hot" if i % 3 else f"cold{i % 30}") * 50) for i in range(600)]
    assert rows_of(WA.archived(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
