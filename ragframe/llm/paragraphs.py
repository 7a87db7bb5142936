"""Passages that repeat across documents: paragraph MinHash banding.

**Paragraphs.** Copied passages start and end anywhere in a line, so the unit is the
sentence, or a run of short ones; those of more than ``LONG`` words are cut on at places
that their words alone determine. Units of fewer than ``MIN_WORDS`` words are not compared. Cuts depend on
nearby words only, so a passage is cut alike wherever it stands.

**Banding.** A unit's shingles are its runs of five words. ``BANDS`` bands of one
MinHash value each collide with probability 1 - (1 - J)^BANDS: 0.992 at J = 0.8, and for
unrelated sentences, which share no five words, almost never. Keys of a single unit are
dropped by a partial count first; copies of a sentence are one member of a key.

**Verification.** Members of a key are compared by exact Jaccard similarity (0.8 or
more); in larger groups those alone that share one of their rarest shingles, as similar
ones must. Keys with many members are dealt into blocks, each pair of blocks is a group of
its own, and a group gives a spanning forest of its links, never its pairs.

**Removal.** Components of the links are clusters. A cluster that occurs in two documents
or more is repeated; all but its first occurrence are removals. Neighbouring repeated
units of a document form a passage, which is reported from ``MIN_PASSAGE`` words on.

**Edges.** A passage that starts or ends inside a unit is longer than its whole units. A
run of units that is too short is therefore a seed: the words before its first and behind
its last unit are compared with those around the first occurrence of these units (of the
first occurrence: with all others), word by word up to ``EDGE`` words, and the run is as
long as they agree."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import broadcast_up_to, components, fresh, join_group, shared_table, text_batches

SHINGLE, MIN_SIMILARITY = 5, 0.8
MIN_WORDS, LONG, CUT_MASK = 8, 40, 7
BANDS = 3
#: Words of a passage at least, and words between two of its units at most.
MIN_PASSAGE, GAP = 30, 7
BLOCK = 256
#: Pairs of a group up to which all are compared without looking for those that can be similar.
FEW_PAIRS = 64
#: Words compared at each edge of a short run of units; a unit is seldom longer.
EDGE = 48
#: Bytes of the places whose surroundings are read, up to which they are broadcast to the texts.
EDGE_BYTES = 4 << 20
#: Words that are hashed at once.
HASHES = 1 << 20

#: Where a sentence ends: a line's end, or a mark before white space.
_END = re.compile(r"[.!?\n](?:(?<=\n)|(?=\s))")
_WORD = re.compile(r"\w+")
_ASCII = {c: "\n" if c == 10 else " " for c in range(128) if not _WORD.match(chr(c))}
_ODD = np.random.default_rng(31).integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _digests(digest: Callable[[bytes], int], strings: pa.Array) -> np.ndarray:
    return np.fromiter(map(digest, strings.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(strings))


class _Hashes:
    """Hashes of words. Among ``HASHES`` words each different one is hashed once; none is kept
    behind a call, as a batch's different words are hashed sooner than looked up."""

    def __len__(self) -> int:
        return 0

    def of(self, words: list[str] | pa.Array) -> np.ndarray:
        words, out = pa.array(words, pa.string()), [np.zeros(0, np.uint64)]
        for at in range(0, len(words), HASHES):
            codes = words[at:at + HASHES].dictionary_encode()
            out.append(_digests(xxhash.xxh3_64_intdigest, codes.dictionary)[codes.indices.to_numpy()])
        return np.concatenate(out)


_HASHES = _Hashes()


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (as many as there are places with n words)."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for o in range(n):
        out = _mix(out * _MIX + h[o:len(h) - n + 1 + o])
    return out


@functools.cache
def _blanks() -> np.ndarray:
    """Each code point, or that of a blank if no word has it; line ends stay."""
    chars = np.arange(0x110000, dtype=np.uint32)
    kept = np.fromiter(map(str.isalnum, map(chr, range(len(chars)))), bool, len(chars))
    kept[[ord("_"), ord("\n")]] = True
    return np.where(kept, chars, np.uint32(32))


def _plain(text: str | None) -> str:
    """The text's words (``_WORD``, lower-cased) parted by blanks, its sentences by line ends."""
    text = "\n".join(_END.split((text or "").lower()))
    if text.isascii():
        return text.translate(_ASCII)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _blanks()[chars].tobytes().decode("utf-32-le", "surrogatepass")


def _words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the number of words of each sentence (some have none), and
    the number of sentences of each text."""
    lines = pc.split_pattern(pa.array([_plain(t) for t in texts], pa.string()), "\n")
    parts = pc.ascii_split_whitespace(lines.flatten())
    words = parts.flatten()
    held = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
    return words.filter(held), np.diff(before[parts.offsets.to_numpy()]), lines.value_lengths().to_numpy()


def _ranges(h: np.ndarray, sizes: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words of all units of some texts, first words of the texts), from the hashes of
    their words and the figures of ``_words``. Units are sentences, and neighbouring short ones
    as one; units that stay too short to be compared are included. A unit of more than ``LONG``
    words is parted at places that its words alone determine."""
    at, text = np.cumsum(sizes) - sizes, np.cumsum(sentences) - sentences
    long = sizes >= MIN_WORDS
    new = long | np.append(True, long[:-1])
    new[text] = True
    first = np.unique(np.append(at[new], len(h)))
    cuts, more = (_grams(h, 2) & np.uint64(CUT_MASK)) == 0, []
    for i in np.nonzero(np.diff(first) > LONG)[0].tolist():
        start, stop = first[i:i + 2].tolist()
        for cut in (np.nonzero(cuts[start:stop - 1])[0] + start + 2).tolist():
            if cut - start >= MIN_WORDS and cut < stop:
                more.append(cut)
                start = cut
    return np.sort(np.append(first[:-1], np.array(more, first.dtype))), at[text]


def units(text: str | None) -> list[tuple[int, list[str]]]:
    """(first word's place, words) of each unit of a text."""
    words, *sizes = _words([text])
    first, _ = _ranges(_HASHES.of(words), *sizes)
    held = words.to_pylist()
    return [(a, held[a:b]) for a, b in itertools.pairwise([*first.tolist(), len(held)])]


def _signatures(h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """MinHash values (units x bands) of units of at least ``SHINGLE`` words: ascending ranges
    of the words' hashes ``h``."""
    g = np.append(_grams(h, SHINGLE), np.uint64(0))
    pairs = np.stack([first, stop - SHINGLE + 1], 1).reshape(-1)
    return np.stack([np.minimum.reduceat(_mix(g * m), pairs)[::2] for m in _ODD], 1)


def all_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, n_words, hash, keys, words) of every unit that is compared."""
    def run(batches):
        for batch in text_batches(batches, 1, 4 << 20):
            words, *sizes = _words(batch.column(1).to_pylist())
            h = _HASHES.of(words)
            first, begin = _ranges(h, *sizes)
            ends = np.append(first, len(h))
            compared = np.diff(ends) >= MIN_WORDS
            if not compared.any():
                continue
            flat = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ").filter(pa.array(compared))
            first, stop = first[compared], ends[1:][compared]
            rows = np.searchsorted(begin, first, "right") - 1
            keys = _mix(_signatures(h, first, stop) + np.arange(BANDS, dtype=np.uint64) * _MIX).view(np.int64)
            hashes = _digests(xxhash.xxh64_intdigest, flat).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array((first - begin[rows]).astype(np.int32)),
                 pa.array((stop - first).astype(np.int32)), pa.array(hashes),
                 pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1))), flat],
                ["doc_id", "start", "n_words", "hash", "keys", "words"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL").mapInArrow(
        run, f"doc_id {kind}, start int, n_words int, hash long, keys array<long>, words string")


def _partners(sets: dict[int, set], left: dict[int, str], right: dict[int, str]):
    """Function from a left member to the right members, ascending, that can be similar to it.
    Similar members share ``MIN_SIMILARITY`` of either's shingles, so they share one of the
    others and one more: of those that are rarest in the group."""
    times = Counter(itertools.chain.from_iterable(sets.values()))
    rarest = {}
    for h in left | right:
        n = len(sets[h])
        rarest[h] = sorted(sets[h], key=lambda g: (times[g], g))[:n - math.ceil(MIN_SIMILARITY * n - 1e-9) + 1]
    holders = {}
    for h in right:
        for g in rarest[h]:
            holders.setdefault(g, []).append(h)
    return lambda a: sorted(set().union(*(holders.get(g, ()) for g in rarest[a])))


def _forest(left: dict[int, str], right: dict[int, str], u: list[int], v: list[int]) -> None:
    """Appends the links of a spanning forest between the left and the right members (hash: words)."""
    sets, root = {}, {}
    for h, text in (left | right).items():
        w = text.split(" ")
        sets[h], root[h] = set(zip(*(w[o:] for o in range(SHINGLE)))), h
    partners = _partners(sets, left, right) if len(left) * len(right) > FEW_PAIRS else None

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    others = sorted(right)
    for a in sorted(left):
        for b in others if partners is None else partners(a):
            x, y = find(a), find(b)
            if x == y:
                continue
            p, q = sets[a], sets[b]
            both = min(len(p), len(q))
            if both < MIN_SIMILARITY * max(len(p), len(q)):
                continue
            both = len(p & q)
            if both >= MIN_SIMILARITY * (len(p) + len(q) - both):
                root[max(x, y)] = min(x, y)
                u.append(a), v.append(b)


def _compared(dealt: DataFrame) -> DataFrame:
    """Links (u, v) of the groups (key, i, j) of ``dealt``. One shuffle, then a pass over the
    sorted partition that holds one group at a time; most groups have two members. In a
    group of one block (i = j) each member is on both sides."""
    def run(batches):
        key, sides = None, ({}, {})

        def links(u, v):
            if key is not None:
                _forest(sides[0], sides[0] if key[1] == key[2] else sides[1], u, v)

        for batch in batches:
            u, v = [], []
            for k, i, j, left, h, words in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (k, i, j) != key:
                    links(u, v)
                    key, sides = (k, i, j), ({}, {})
                sides[0 if left else 1].setdefault(h, words)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        u, v = [], []
        links(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    on = ["key", "i", "j"]
    return dealt.select(*on, "left", "hash", "words").repartition(*on).sortWithinPartitions(*on).mapInArrow(run, "u long, v long")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Units whose cluster occurs in two documents or more: doc_id, start, n_words,
    cluster, first_doc (smallest doc_id of the cluster) and first_start (in it)."""
    stored = shared_table(all_units(docs, id_col, text_col), "units")
    keyed = stored.select("hash", F.explode("keys").alias("key"))
    busy = shared_table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "busy-keys")
    # equal units have equal keys: only their hashes move until the clusters are known
    member = shared_table(keyed.join(busy, "key"), "busy-members")
    distinct = shared_table(member.groupBy("key", "hash").agg(F.count("*").alias("times")), "busy-units")

    several = shared_table(distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "mixed-keys")
    mixed = shared_table(distinct.drop("times").join(several, "key"), "mixed-members")
    wanted = shared_table(mixed.select("hash").distinct(), "mixed-units")
    # copies become one row in each task, before or (where the list is too long to broadcast) instead of
    # the filter, so those of a hot sentence don't meet in one task
    words, few = stored.select("hash", "words"), broadcast_up_to(wanted, 4_000_000)
    if few is not wanted:
        words = words.join(few, "hash", "left_semi").groupBy("hash").agg(F.first("words").alias("words"))
    else:
        words = words.groupBy("hash").agg(F.first("words").alias("words")).join(wanted, "hash", "left_semi")
    parts = F.ceil(F.col("n") / block).cast("int")
    mine, none = F.col("mine"), F.array().cast("array<int>")
    dealt = mixed.join(words, "hash").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("hash"), F.col("parts")).cast("int"))
    left = F.transform(F.sequence(mine, F.col("parts") - 1), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("left")))
    right = F.transform(F.when(mine > 0, F.sequence(F.lit(0), mine - 1)).otherwise(none),
                        lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("left")))
    dealt = dealt.select("key", "hash", "words", F.explode(F.concat(left, right)).alias("at")).select("key", "at.*", "hash", "words")
    links = shared_table(_compared(dealt), "unit-links")
    roots = components(links)

    info = distinct.groupBy("hash").agg(F.max("times").alias("members")).join(roots.withColumnRenamed("node", "hash"), "hash", "left")
    info = shared_table(info.select("hash", F.coalesce("root", "hash").alias("cluster"), "members"), "unit-clusters")
    # stored as joined: copies of a hot sentence stay dealt out, repeated rows of a document go in a pass of their own
    found = shared_table(join_group(stored.select("doc_id", "start", "n_words", "hash"), info, "hash", "members"), "busy-places")
    found = shared_table(found.distinct().drop("hash"), "clustered-units")
    first = found.groupBy("cluster").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last_doc"),
                                         F.count("*").alias("members")).where("first.doc_id <> last_doc")
    first = shared_table(first.select("cluster", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"), "members"), "clusters")
    return join_group(found, first, "cluster", "members")


def _slices(h: np.ndarray, at: np.ndarray, sizes: np.ndarray, step: int) -> pa.ListArray:
    """Elements of ``h`` from each place on, onward or backward."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    nth = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[np.repeat(at, sizes) + step * nth]))


def _surroundings(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``places`` (doc_id, start, n_words, ...) with ``before`` (hashes of the words before
    it, from the nearest on) and ``behind``. Of repeated rows of one doc_id each has its own."""
    rest = [c for c in places.columns if c != "doc_id"]
    by_doc = shared_table(places.groupBy("doc_id").agg(F.collect_set(F.struct(*rest)).alias("places")), "unit-places")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        broadcast_up_to(by_doc, 4_000_000, EDGE_BYTES), "doc_id")

    def run(batches):
        for batch in text_batches(batches, 1, 4 << 20):
            words, sizes, sentences = _words(batch.column(1).to_pylist())
            h = (_HASHES.of(words) & np.uint64(0xFFFFFFFF)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(sentences)])]
            places, held = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), held)
            start, stop = (places.field(c).to_numpy().astype(np.int64) for c in ("start", "n_words"))
            low, top = ends[row], ends[row + 1]
            start, stop = np.minimum(low + start, top), np.minimum(low + start + stop, top)
            before, behind = np.minimum(start - low, EDGE), np.minimum(top - stop, EDGE)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[places.field(c) for c in rest],
                                              _slices(h, start - 1, before, -1), _slices(h, stop, behind, 1)], ["doc_id", *rest, "before", "behind"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [places.schema[c] for c in ["doc_id", *rest]])
    return texts.select("doc_id", "text", "places").mapInArrow(run, kinds + ", before array<long>, behind array<long>")


def _agree(a: str, b: str):
    """How many of the first elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(same)).otherwise(at.cast("int") - 1)


def _edges(docs: DataFrame, rows: DataFrame, runs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, cluster, left, right): the words by which the units at the ends of
    ``runs`` go on alike around the first occurrence of their cluster, where they do."""
    wanted = shared_table(runs.select(F.explode(F.array("head.cluster", "tail.cluster")).alias("cluster")).distinct(), "edge-clusters")
    places = rows.select("doc_id", "start", "n_words", "cluster", "first_doc", "first_start").join(broadcast_up_to(wanted, 4_000_000), "cluster", "left_semi")
    around = shared_table(_surroundings(docs, places, id_col, text_col), "surroundings")
    is_first = (F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    first = shared_table(around.groupBy("cluster").agg(
        F.min(F.when(is_first, F.struct("before", "behind"))).alias("f"), F.count("*").alias("members")).select(
        "cluster", F.col("f.before").alias("f_before"), F.col("f.behind").alias("f_behind"), "members"), "first-surroundings")
    met = join_group(around, first, "cluster", "members").withColumn("left", _agree("before", "f_before")).withColumn("right", _agree("behind", "f_behind"))
    met = shared_table(met.select("doc_id", "start", "cluster", "first_doc", "left", "right", is_first.alias("is_first")), "edges")
    others = met.where("doc_id <> first_doc").groupBy("doc_id", "start", "cluster").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    widest = met.where("doc_id <> first_doc").groupBy("cluster").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    firsts = met.where("is_first").select("doc_id", "start", "cluster").distinct().join(widest, "cluster").select(*others.columns)
    return others.unionByName(firsts)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_PASSAGE) -> DataFrame:
    """One row per passage that a document shares with others: doc_id, start_word and
    n_words (words are runs of letters, digits and underscores), component_id (cluster
    of its first unit), first_doc_id (smallest doc_id that has it) and removed (false
    for the first occurrence, which stays).

    Passages repeated within one document only are not reported. Null and empty texts
    have none; rows with a null doc_id can't be named and are not compared. Repeated
    rows of one doc_id are one document. Texts of any length are read whole. An empty
    table gives no rows."""
    part = Window.partitionBy("doc_id", "removed").orderBy("start", "cluster")
    rows = repeated_units(docs, id_col, text_col).withColumn("removed", ~((F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))))
    gap = F.col("start") - F.lag(F.col("start") + F.col("n_words")).over(part)
    rows = rows.withColumn("new", F.when(gap <= GAP, 0).otherwise(1)).withColumn("run", F.sum("new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    rows = shared_table(rows.drop("new"), "unit-runs")
    head, tail = F.min(F.struct("start", "cluster", "first_doc")), F.max(F.struct("start", "cluster"))
    runs = rows.groupBy("doc_id", "removed", "run").agg(head.alias("head"), tail.alias("tail"), F.max(F.col("start") + F.col("n_words")).alias("stop"))
    runs = shared_table(runs.withColumn("n_words", F.col("stop") - F.col("head.start")), "passages")
    long, short = runs.where(F.col("n_words") >= min_words), runs.where(F.col("n_words") < min_words)
    edges = shared_table(_edges(docs, rows, short, id_col, text_col), "passage-edges")
    on = ["doc_id", "start", "cluster"]
    short = short.select("*", F.col("head.start").alias("start"), F.col("head.cluster").alias("cluster")).join(edges.drop("right"), on, "left")
    short = short.drop("start", "cluster").select("*", F.col("tail.start").alias("start"), F.col("tail.cluster").alias("cluster")).join(edges.drop("left"), on, "left")
    left, right = F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))
    whole = long.select("doc_id", F.col("head.start").alias("start_word"), "n_words", "head", "removed").unionByName(
        short.select("doc_id", (F.col("head.start") - left).alias("start_word"), (F.col("n_words") + left + right).alias("n_words"), "head", "removed"))
    return whole.where(F.col("n_words") >= min_words).select(
        "doc_id", "start_word", "n_words", F.col("head.cluster").alias("component_id"), F.col("head.first_doc").alias("first_doc_id"), "removed")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed passages cut out of ``text_col``; other rows unchanged."""
    spans = fresh(docs.columns, "_passages")
    gone = repeated_passages(docs, id_col, text_col).where("removed").groupBy(F.col("doc_id").alias(id_col)).agg(
        F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(spans))

    @F.pandas_udf("string")
    def cut(texts, passages):
        out = []
        for text, spans in zip(texts, passages):
            if text is not None and spans is not None and len(spans):
                words = list(_WORD.finditer(text.lower() if len(text.lower()) == len(text) else text))
                kept, at = [], 0
                for s in spans:
                    a, b = s["start_word"], s["start_word"] + s["n_words"]
                    if a < len(words):
                        kept.append(text[at:words[a].start()])
                        at = words[b].start() if b < len(words) else len(text)
                text = "".join(kept) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    names = docs.columns
    return docs.join(gone, id_col, "left").select(*[cut(text_col, spans).alias(c) if c == text_col else F.col(c) for c in names])
