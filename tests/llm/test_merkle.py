"""The manifest against plain Python."""

import hashlib
import zlib

from pyspark.sql import functions as F

from ragframe.llm import merkle as MK

SCHEMA = "doc_id long, source string, lang string, text string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, text, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // 16 * 16
            proofs[k].append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
            at[k] = i // 16
        level = [H(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], proofs


def brute(rows):
    groups, claimed = {}, {}
    for r in rows:
        h, text = leaf(*r), r[3]
        groups.setdefault(r[1], []).append((r[0], h))
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        claimed[h] = leaf(r[0], r[1], r[2], text, r[4])
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        leaves = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *tree([h for _, h in leaves])))
    root, over = tree([t[1] for t in trees])
    out = []
    for (leaves, subroot, own), up in zip(trees, over):
        for (doc_id, h), proof in zip(leaves, own):
            node = claimed[h]
            for left, right in proof + up:
                node = H(left, node, right)
            out.append((doc_id, h, subroot, root, H(*[a + b for a, b in proof + up]), node, node == root))
    return sorted(out, key=repr)


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "text", "n_chars").collect()]
    got = sorted(map(tuple, MK.tampered_manifest(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_documents(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_odd_rows(spark):
    """Null values, a null source, ties, repeated rows, non-ASCII and long texts, clashing columns."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a", "x", "T", 5), (7, "", "x", "É A", 5),
            (8, "é", "", "", 0), (9, "z", "en", "Word " * 200_000, 1_000_000), (9, "z", "en", "other", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df.withColumns({"leaf": F.lit("x"), "grp": F.lit(1), "pos": F.lit(2), "root": F.lit(None).cast("string")}))
    check(df.limit(1))


def test_empty_table(spark):
    assert MK.tampered_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_source_of_several_rounds_and_many_sources(spark):
    """A source of more than two blocks, beside 500 small ones."""
    name = F.when(F.col("id") < 9000, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string")))
    check(spark.range(10_000).select(F.col("id").alias("doc_id"), name.alias("source"), F.lit("en").alias("lang"),
                                     F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"), F.lit(3).alias("n_chars")))


def test_general_interface(spark):
    """Any columns, group and order; no claims: every row is verified."""
    df = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(100)], "k int, g int, v string")
    m = MK.build(df, ["v", "k"], "g", "k")
    got = MK.verify(MK.proofs(m)).collect()
    assert len(got) == 100 and all(r["verified"] for r in got) and {r["root"] for r in got} == {m.root}
    assert MK.build(df.withColumn("v", F.when(F.col("k") == 50, "x").otherwise(F.col("v"))), ["v", "k"], "g", "k").root != m.root
