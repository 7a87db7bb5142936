"""SimHash near-duplicates: fingerprints, pigeonring candidate filter, components.

**Fingerprint.** A-Z are lower-cased, words are runs of characters other than ASCII
white space, shingles are runs of ``shingle`` words joined by one space, repeats
included (fewer words: the whole sequence; none, empty or null text: fingerprint
zero). A bit is set if it is set in more than half of the shingles' XXH64 (seed 42).

**Pigeonring.** The 64 bits form a ring of m = k + 3 segments for a distance of at
most k. If two fingerprints differ in at most k bits, a chain of consecutive segments
starts somewhere on the ring whose first l segments differ in at most l*k/m bits, for
every l. Such a chain leaves three segments clean early; every (start, clean triple)
that the budgets allow is one equi-join key (k = 2: ten keys of 38 bits). Joined pairs
are accepted only at their first viable chain, which prunes and removes repeats at
once; the full Hamming distance is checked last.

**Hot keys.** Copies are collapsed first: only distinct fingerprints take part. In a
key with more than ``pair_limit`` of them no pairs are made: each fingerprint names the
values within k/2 bits of it among the key's free bits, and fingerprints that name the
same value hook onto its smallest one. Two fingerprints share such a value exactly if
they differ in at most k bits, so this is exact and linear in the key's members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import broadcast_up_to, components, join_group, shared_table, text_batches

SEED = 42
PIECE = 1 << 20
#: Ids of dropped documents that are broadcast at most (8 bytes each); more are joined by shuffle.
MAX_BROADCAST_IDS = 400_000


def _bit_sums(data: bytes, shingle: int) -> tuple[np.ndarray, int]:
    """How often each bit is set over the shingles, in pieces of about a megabyte."""
    total, n, at, carry = np.zeros(64, np.int64), 0, 0, []
    digest = xxhash.xxh64_intdigest
    while True:
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = carry + data[at:end].split()
        at = end
        last = end == len(data)
        if len(words) >= shingle:
            flat = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts, stops = (ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
        elif last and not n and words:
            flat = b" ".join(words)
            starts, stops = [0], [len(flat)]
        else:
            starts, stops = [], []
        if starts:
            h = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts))
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(starts)
        if last:
            return total, n
        carry = words[-(shingle - 1):] if shingle > 1 else []


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    total, n = _bit_sums((text or "").encode("utf-8", "replace").lower(), shingle)
    return sum(1 << i for i in range(64) if 2 * total[i] > n)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; ``fp`` is the fingerprint's bits as
    a signed long."""
    def run(batches):
        for batch in text_batches(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(k: int) -> tuple[list[int], list[tuple[int, tuple[int, ...]]]]:
    """Segment masks, and the keys (start, offsets of the three clean segments)."""
    m = k + 3
    cuts = [round(i * 64 / m) for i in range(m + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    fits = [(0, a, b) for a, b in combinations(range(1, m), 2)
            if all(n - sum(o < n for o in (0, a, b)) <= n * k // m for n in range(1, m + 1))]
    return masks, [(s, t) for s in range(m) for t in fits]


def links(fps: DataFrame, k: int = 2, pair_limit: int = 32) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) whose components are
    those of the graph "at most k differing bits"; see the module's text."""
    masks, keys = ring(k)
    m = len(masks)
    clean = [sum(masks[(s + o) % m] for o in t) for s, t in keys]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(c))) for c in clean])).alias("sid", "part"))
    sizes = shared_table(keyed.groupBy("sid", "part").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    member = shared_table(keyed.join(broadcast_up_to(sizes, MAX_BROADCAST_IDS), ["sid", "part"]), "simhash-members")

    few = member.where(F.col("n") <= pair_limit).drop("n")
    pairs = few.join(few.withColumnRenamed("fp", "other"), ["sid", "part"]).where("fp > other")
    x = F.col("fp").bitwiseXOR(F.col("other"))
    bits = [F.bit_count(x.bitwiseAND(F.lit(_signed(c)))) for c in masks]

    def viable(s):
        held, out = F.lit(0), F.lit(True)
        for n in range(1, m + 1):
            held = held + bits[(s + n - 1) % m]
            out = out & (held <= n * k // m)
        return out

    chains = [viable(s) for s in range(m)]
    accept = F.lit(False)
    for i, (s, t) in enumerate(keys):
        here = (F.col("sid") == i) & chains[s]
        for earlier in range(s):
            here = here & ~chains[earlier]
        for o in set(range(t[-1])) - set(t):
            here = here & (bits[(s + o) % m] > 0)
        accept = accept | here
    near = pairs.where(accept).where(F.bit_count(x) <= k).select(F.col("fp").alias("u"), F.col("other").alias("v"))

    def around(radius):
        flips = []
        for c in clean:
            free = [b for b in range(64) if not c >> b & 1]
            flips.append([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(free, r)])
        all_flips = F.array(*[F.array(*[F.lit(_signed(y)) for y in row]) for row in flips])
        return member.where(F.col("n") > pair_limit).select("sid", "part", "fp", F.explode(
            F.transform(F.element_at(all_flips, F.col("sid") + 1), lambda y: F.col("fp").bitwiseXOR(y))).alias("value"))

    first = around(k // 2).groupBy("sid", "part", "value").agg(F.min("fp").alias("v"))
    hooks = around((k + 1) // 2).join(first, ["sid", "part", "value"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(hooks.distinct())


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_distance: int = 2, pair_limit: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits) and
    component_id, the smallest doc_id reachable over links of at most
    ``max_distance`` differing bits, itself included.

    Null, empty and blank texts have fingerprint zero and link like any other. A null
    id is never a component's id (a component of such rows only has a null id).
    Repeated rows are returned as often as given. An empty table gives no rows. Other
    columns of ``docs`` are not read."""
    marked = shared_table(simhash(docs, id_col, text_col, shingle), "simhash")
    first = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-distinct")
    root = components(links(first.select("fp"), max_distance, pair_limit))
    with_root = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    least = shared_table(with_root.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "simhash-least")
    named = shared_table(join_group(with_root, least, "root", "members").select("fp", "component_id", "copies"), "simhash-named")
    return join_group(marked, named, "fp", "copies").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one whose doc_id is the
    component's id. Repeated rows of one id keep the one that sorts first by text and
    the other columns. Rows with a null doc_id cannot be named and all stay."""
    found = shared_table(simhash_near_dedup(docs, **options), "simhash-groups")
    gone = shared_table(found.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    left = docs.join(broadcast_up_to(gone, MAX_BROADCAST_IDS), "doc_id", "left_anti")
    twice = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    twice = shared_table(twice, "simhash-repeated")
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi")
    one = again.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("_row"))
    one = one.select(*[F.col("doc_id") if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns])
    return left.join(twice, "doc_id", "left_anti").unionByName(one)
