"""SimHash near-dedup against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from ragframe.llm import simhash as SH


def slow_fp(text):
    words = (text or "").encode().lower().split()
    n = len(words)
    grams = [b" ".join(words[i:i + 3]) for i in range(n - 2)] if n >= 3 else [b" ".join(words)] if n else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_groups(rows, k=2):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    items = sorted(rows)
    for i, (a, fa) in enumerate(items):
        for b, fb in items[:i]:
            if bin(fa ^ fb).count("1") <= k:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {a: find(a) for a, _ in items}


def test_fingerprint_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "Ünd", "c d", "É", "zz."]) + rng.choice(["", "\n", "\t"]) for _ in range(4000))
    whole = slow_fp(text)
    assert SH.fingerprint(text) == whole
    monkeypatch.setattr(SH, "PIECE", 50)
    assert SH.fingerprint(text) == whole
    assert SH.fingerprint(None) == SH.fingerprint("") == SH.fingerprint(" \n") == 0
    assert SH.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in SH.simhash_near_dedup(docs).collect()}
    rows = [(r.doc_id, slow_fp(r.text)) for r in docs.collect()]
    want = slow_groups(rows)
    assert len(got) == len(rows)
    assert all(got[d].fingerprint == f"{f:016x}" and got[d].component_id == want[d] for d, f in rows)


def test_links_on_clustered_fingerprints(spark):
    """Dense neighbourhoods, so that both ways of linking have work; odd distances too."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    df = spark.createDataFrame([(SH._signed(x),) for x in fps], "fp long")
    for k, limit in ((2, 8), (2, 1), (3, 1)):
        got = SH.components(SH.links(df, k, limit)).collect()
        root = {x: x for x in fps} | {r.node % (1 << 64): r.root % (1 << 64) for r in got}
        want = slow_groups([(x, x) for x in fps], k)
        groups = lambda m: sorted(sorted(a for a in m if m[a] == r) for r in set(m.values()))
        assert groups(root) == groups(want), (k, limit)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b c", "z"), (4, "a b c", None), (4, "a b c", None), (5, "w " * 50_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = SH.simhash_near_dedup(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 6 and by[1].fingerprint == "0" * 16 and by[2].component_id == 1
    assert by[None].component_id == by[4].component_id == 4
    kept = SH.drop_near_copies(df.withColumn("doc_id", F.col("doc_id")))
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5]
    assert SH.simhash_near_dedup(df.limit(0)).count() == 0
    assert SH.drop_near_copies(df.limit(0)).count() == 0


def test_groups_are_joined_alike_hot_or_not(spark, monkeypatch):
    """Large groups by broadcast, small ones by shuffle, both or neither: the same rows."""
    from pyspark.sql import functions as F

    from ragframe.llm import common as CO
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") < 300, 1).when(F.col("id") < 490, F.col("id") % 20).alias("g"), F.lit("x").alias("hot"))
    groups = CO.shared_table(rows.where("g IS NOT NULL AND g <> 7").groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("most")), "test-groups")
    want = sorted((r.id, r.g, r.most) for r in rows.join(groups, "g").collect())
    for bound in (1, 10, 200, 10**6):
        got = CO.join_group(rows, groups, "g", "n", hot_rows=bound)
        assert got.columns == ["id", "g", "hot", "most"] and sorted((r.id, r.g, r.most) for r in got.collect()) == want
    assert CO.join_group(rows, groups, "g", "n", "left", 100).where("most IS NULL").count() == 500 - len(want)
    monkeypatch.setattr(CO, "broadcast_up_to", lambda df, *a: df)
    assert sorted((r.id, r.g, r.most) for r in CO.join_group(rows, groups, "g", "n", hot_rows=100).collect()) == want
