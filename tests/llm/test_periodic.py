"""Runs against a quadratic search, and the extensions against plain comparison."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragframe.llm import periodic as PR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_length=6, min_exponent=4):
    found, n = {}, len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - i
            if e > i and length >= max(min_length, min_exponent * q):
                found.setdefault((i, length), q)
            i = max(e, i + 1) if e > i else i + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def numbers(docs):
    sizes = np.array([len(d) for d in docs], np.int64)
    flat, marks = [], 10_000
    for d in docs:
        flat += [*d, marks]
        marks += 1
    return np.array(flat, np.int64), np.cumsum(sizes + 1) - sizes - 1, sizes


def fast_runs(docs, **kw):
    seq, starts, sizes = numbers(docs)
    out = [[] for _ in docs]
    for s, n, q in PR.find_runs(seq, starts, sizes, **kw).tolist():
        d = int(np.searchsorted(starts, s, "right")) - 1
        out[d].append((s - int(starts[d]), n, q))
    return out


def test_cover_reaches_every_pair():
    assert {(a - b) % PR.MODULUS for a in PR.COVER for b in PR.COVER} == set(range(PR.MODULUS))


def test_extensions():
    rng = random.Random(5)
    docs = [[rng.randrange(2) for _ in range(300)], [7] * 400, list(range(50)) * 9, [], [1]]
    docs.append(docs[2])
    seq, starts, sizes = numbers(docs)
    lce = PR.Extensions(seq, np.repeat(np.arange(len(docs)), sizes + 1))
    for d, words in enumerate(docs):
        if len(words) < 2:
            continue
        i, j = np.triu_indices(len(words), 1)
        got = lce(i + starts[d], j + starts[d])
        for a, b, n in list(zip(i, j, got))[:: 97]:
            want = next((k for k in range(len(words) - b) if words[a + k] != words[b + k]), len(words) - b)
            assert n == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=6))
def test_runs_random(docs):
    assert fast_runs(docs) == [brute_runs(d) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 39)), min_size=1, max_size=5),
       st.sampled_from([(6, 4), (1, 3), (10, 5)]))
def test_runs_planted(parts, limits):
    """Repeats of long and short periods end to end, cut anywhere."""
    words = [w for unit, times, cut in parts for w in unit * times + unit[:cut % len(unit)]]
    kw = dict(zip(("min_length", "min_exponent"), limits))
    assert fast_runs([words, words[::-1]], **kw) == [brute_runs(words, **kw), brute_runs(words[::-1], **kw)]


def test_runs_are_independent_of_chunks(monkeypatch):
    words = [list(range(60)) * 7, [1, 2, 3] * 50, [4] * 30]
    whole = fast_runs(words)
    monkeypatch.setattr(PR, "CHUNK", 7)
    assert fast_runs(words) == whole == [brute_runs(w) for w in words]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if crc % 10 == 0 and n:
        g = crc // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(w for i, w in enumerate(words) if i not in drop))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def test_query_against_brute_force(spark, sf):
    """All documents of up to 3,000 words, and the odd rows."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r[1]) < 18_000]
    odd = [(None, "a " * 9), (None, None), (-1, ""), (-2, " \t\n"), (-3, "x"), (-3, "x"), (-4, "a\x0bb\x0ca\x1cb c  \r\n" * 8),
           *[(-i, "la " * i) for i in range(5, 60)], (-70, "one two\n" * 40 + "x y z " * 30)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, PR.run_report(df).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows + odd), key=repr)
    assert sum(r[1] > 0 for r in got) > len(rows) / 20


def test_own_interface(spark):
    """Whole rows come back, clashing names get underscores, an empty table has no rows."""
    df = spark.createDataFrame([(1, "a b " * 10 + "c", "r"), (2, None, None)], "doc_id long, text string, runs string")
    got = {r["doc_id"]: r for r in PR.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1]["runs_"]] == [(0, 20, 2)] and got[1]["collapsed"] == "a b c" and got[1]["runs"] == "r"
    assert got[2]["runs_"] == [] and got[2]["collapsed"] == "" and got[2]["n_words"] == 0
    assert PR.periodic_runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("unit", [1, 17, 4000])
def test_very_long_text(spark, unit):
    """Half a million words that repeat: linear, not quadratic."""
    text = " ".join(f"w{i % unit}" for i in range(500_000))
    got = PR.run_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_runs"], got["start"], got["length"], got["period"]) == (1, 0, 500_000, unit)
