"""Merkle manifest of a dataset by concatenated-level strings.

Leaves (hashes of rows) are numbered in their group's order and cut into aligned blocks
of ``BLOCK`` consecutive nodes. A block is one row that keeps each of its levels as one
hex string: fixed-width substrings of a level are the runs whose hashes are the next
level, and what flanks a node in its run are its siblings. Block roots are the nodes of
the next round, until a group has one block; the groups' subroots, ordered by group, are
the leaves of one more such tree. Everything is a native expression.

No group is ever in one task: numbering is a range sort on (group, order) with one count
for each group and partition, blocks are keyed by (group, block), and blocks meet their
upper proofs one to one. The driver sees the largest tree size of a round and the root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import broadcast_up_to, shared_path

FANOUT = 16
#: Levels that one block holds, and its nodes.
LEVELS = 3
BLOCK = FANOUT**LEVELS
HEX = 64
SIBLINGS = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value (numbers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' concatenation."""
    return F.sha2(F.concat(*values), 256)


def fold(siblings: Column, leaf: Column) -> Column:
    """The root that ``leaf`` has with these siblings, level by level upwards."""
    return F.aggregate(siblings, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_text(siblings: Column) -> Column:
    """All sibling digests, level by level, left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


def _part(level: Column, first: Column, nodes: int = FANOUT) -> Column:
    """``nodes`` digests of a level from node number ``first`` on."""
    return F.substr(level, first * HEX + 1, F.lit(nodes * HEX))


def _parents(level: Column) -> Column:
    runs = F.ceil(F.octet_length(level) / (FANOUT * HEX)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(_part(level, i * FANOUT))), "")


def _flanks(run: Column, place: Column) -> Column:
    """The siblings of the node at ``place`` in a run."""
    return F.array(F.struct(F.substr(run, F.lit(1), place * HEX).alias("left"),
                            F.substr(run, (place + 1) * HEX + 1, F.lit(FANOUT * HEX)).alias("right")))


@dataclass
class Manifest:
    """``rounds``: the blocks of the groups' trees, leaves first; ``top``: those of the
    tree over the groups. ``root`` is None for an empty dataset."""
    rounds: list[DataFrame]
    top: list[DataFrame]
    root: str | None


class _Store:
    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        where, self.n = f"{self.path}/{self.n:02d}-{name}", self.n + 1
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)


def _numbered(nodes: DataFrame, order: list[str], store: _Store) -> DataFrame:
    """``nodes`` with ``pos``, the place in its ``grp`` by ``order``, and ``n``, the
    group's size."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the partition
    ranged = (nodes.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
              .withColumn("pid", F.spark_partition_id()).withColumn("at", place))
    stored = store(ranged, "ordered")
    held = stored.groupBy("grp", "pid").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("grp")
    before = F.sum("k").over(whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    # at most one row a partition and one a group
    shift = store(held.select("grp", "pid", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                              F.sum("k").over(whole).alias("n")), "counts")
    return stored.join(broadcast_up_to(shift, 200_000), ["grp", "pid"]).withColumn("pos", F.col("at") + F.col("shift")).drop(
        "pid", "at", "shift")


def _blocks(nodes: DataFrame, store: _Store) -> DataFrame:
    """Rows (grp, n, blk, nodes, lv0, lv1, lv2, digest): the aligned blocks of ``nodes``
    (grp, n, pos, digest and whatever else is kept of a node)."""
    kept = [c for c in nodes.columns if c not in ("grp", "n", "pos", "digest")]
    g = nodes.groupBy("grp", "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *kept))).alias("held"))
    g = g.withColumn("lv0", F.array_join(F.transform("held", lambda x: x["digest"]), ""))
    g = g.withColumn("lv1", F.when(F.col("n") > 1, _parents(F.col("lv0"))))
    g = g.withColumn("lv2", F.when(F.col("n") > FANOUT, _parents(F.col("lv1"))))
    top = F.when(F.col("n") > FANOUT**2, _parents(F.col("lv2")))
    rest = F.transform("held", lambda x: F.struct(x["pos"].alias("pos"), *[x[c].alias(c) for c in kept]))
    return store(g.select("grp", "n", "blk", rest.alias("nodes"), "lv0", "lv1", "lv2",
                          F.coalesce(top, "lv2", "lv1", "lv0").alias("digest")), "blocks")


def _rounds(nodes: DataFrame, store: _Store) -> list[DataFrame]:
    """The blocks of ``nodes``, those of their roots, and so on up to one block a group."""
    out = [_blocks(nodes, store)]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        above = out[-1].where(F.col("n") > BLOCK).select(
            "grp", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("blk").alias("pos"), "digest")
        out.append(_blocks(above, store))
    return out


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(grp, digest) of every group, from the round in which it has one block."""
    found = [r.where(F.col("n") <= BLOCK).select("grp", "digest") for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def build(docs: DataFrame, columns: list[str], group_col: str, order_col: str, claimed: Column | None = None,
          path: str | None = None) -> Manifest:
    """Manifest of ``docs``, stored under ``path`` (None: a new shared folder).

    A leaf is the hash of ``columns`` in their order. Per ``group_col``, leaves ascend by
    ``order_col`` (null first, equal ones by their hash). ``claimed`` is a leaf hash that
    someone presents for the row (null: the row's own)."""
    spark = docs.sparkSession
    store = _Store(spark, path or shared_path(spark, "merkle"))
    group = F.col(group_col).cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("grp"), F.col(order_col).alias("key"),
                         digest(*[encoded(F.col(c)) for c in columns]).alias("digest"),
                         (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    rounds = _rounds(_numbered(store(leaves, "leaves"), ["key", "digest"], store), store)
    subroots = _roots(rounds).select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest")
    top = _rounds(_numbered(subroots, ["key"], store), store)
    root = top[-1].where(F.col("n") <= BLOCK).select("digest").first()
    return Manifest(rounds, top, root[0] if root else None)


def _nodes(blocks: DataFrame, extra: list[str]) -> DataFrame:
    """The nodes of ``blocks`` (which have the siblings of their root as ``up``), each
    with its digest and all its ``siblings`` up to the tree's root."""
    kept = blocks.schema["nodes"].dataType.elementType.names
    runs = F.ceil(F.size("nodes") / FANOUT).cast("int")
    none = F.array().cast(SIBLINGS)
    lv1, lv2 = F.col("lv1"), F.col("lv2")

    def run(i):
        above = F.floor(i / FANOUT).cast("int")
        return F.struct(
            _part(F.col("lv0"), i * FANOUT).alias("run"), F.slice("nodes", i * FANOUT + 1, FANOUT).alias("members"),
            F.when(F.col("n") > FANOUT, _flanks(_part(lv1, above * FANOUT), i % FANOUT)).otherwise(none).alias("s1"),
            F.when(F.col("n") > FANOUT**2, _flanks(lv2, above)).otherwise(none).alias("s2"))

    r = blocks.select("grp", "n", "up", *extra, F.explode(F.transform(F.sequence(F.lit(0), runs - 1), run)).alias("r"))
    r = r.select("grp", "n", *extra, "r.run", "r.members", F.concat("r.s1", "r.s2", "up").alias("above"))
    m = r.select("grp", "n", "run", "above", *extra, F.posexplode("members").alias("place", "m"))
    own = F.when(F.col("n") > 1, _flanks(F.col("run"), F.col("place"))).otherwise(none)
    return m.select("grp", *[F.col("m")[c].alias(c) for c in kept], *extra,
                    _part(F.col("run"), F.col("place"), 1).alias("digest"), F.concat(own, "above").alias("siblings"))


def _descend(rounds: list[DataFrame], ups: DataFrame, extra: list[str]) -> DataFrame:
    """All leaves of the trees of ``rounds``. ``ups``: grp, up and ``extra`` of each
    group. A block meets the siblings of its root by its own key, one to one."""
    nodes = None
    for blocks in reversed(rounds):
        found = blocks.where(F.col("n") <= BLOCK).join(ups, "grp")
        if nodes is not None:
            upper = nodes.select("grp", F.col("pos").alias("blk"), F.col("siblings").alias("up"), *extra)
            found = found.unionByName(blocks.where(F.col("n") > BLOCK).join(upper, ["grp", "blk"]))
        nodes = _nodes(found, extra)
    return nodes


def proofs(manifest: Manifest) -> DataFrame:
    """key, leaf, claimed, subroot, root and siblings of every row of the manifest."""
    root = F.lit(manifest.root).cast("string")
    over = manifest.top[0].select("grp").distinct().withColumn("up", F.array().cast(SIBLINGS))
    ups = _descend(manifest.top, over, []).select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), F.col("siblings").alias("up"))
    return _descend(manifest.rounds, ups, ["subroot"]).select(
        "key", F.col("digest").alias("leaf"), "claimed", "subroot", root.alias("root"), "siblings")


def verify(proven: DataFrame) -> DataFrame:
    """:func:`proofs` with the hash of each proof, the root that the claimed leaf folds
    to, and whether that is the root."""
    out = proven.withColumn("proof_sha256", F.sha2(proof_text(F.col("siblings")), 256)).withColumn(
        "folded_root", fold(F.col("siblings"), F.coalesce("claimed", "leaf")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_manifest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Manifest of ``documents`` rows by source, checked against rows of which a fifth (by
    the crc32 of doc_id) come back with the capital letters A-Z of their text in lower case.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row
    for each row of ``docs``. Null values have their own encoding; a null doc_id comes
    first and isn't tampered with; a null source is a group of its own, the first. Repeated
    rows are leaves of their own. Other columns have no part in it. An empty table has no rows."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    values = {c: F.col(c) for c in columns}
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values["text"] = F.translate(F.col("text"), capitals, capitals.lower())
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, digest(*[encoded(v) for v in values.values()]))
    found = verify(proofs(build(docs, columns, "source", "doc_id", claimed, path)))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
