"""Periodic runs of words by difference-cover longest common extensions.

The words of many documents stand in one number sequence, each document behind an end
mark of its own. Only suffixes at cover-sampled positions are sorted: ``COVER`` is a
difference cover modulo ``MODULUS``, so any two positions reach a sampled pair after the
same few words. A longest common extension compares these few words and then takes the
minimum over the sampled suffixes' common prefixes from a sparse table. The grid of each
period q (positions 0, q, 2q, ... of a document, n log n in all) asks for extensions
where the words agree; the rest of a run lies within one period before its first grid
position and is found by bisection on extensions.

Documents are independent: a task holds a few megabytes of text at a time (a longer
text is a slice of its own) and everything in it is vectorised."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.llm.common import fresh, text_batches

#: A perfect difference set; every remainder is a difference of two members.
MODULUS = 31
COVER = [0, 1, 3, 8, 12, 18]
#: Grid positions looked at at once.
CHUNK = 1 << 20
#: Bytes of text in one slice.
SLICE_BYTES = 4 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _shifts() -> np.ndarray:
    """``[a, b]``: the fewest words after which positions with remainders a and b are both sampled."""
    sampled = np.isin(np.arange(MODULUS), COVER)
    a, b, k = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(sampled[(a + k) % MODULUS] & sampled[(b + k) % MODULUS], axis=2).astype(np.int32)


_SHIFT = _shifts()
_PLACE = np.full(MODULUS, -1, np.int64)
_PLACE[COVER] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions of a number sequence. ``owner`` is each position's
    document, whose last number occurs nowhere else."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        # a whole number of moduli, and room to compare words past the end
        padded = -(-n // MODULUS) * MODULUS + 2 * MODULUS
        self.words = np.full(padded, -1, np.int64)
        self.words[:n] = words
        self.words[n:] = words.max(initial=0) + 1 + np.arange(padded - n)
        at = (np.arange(-(-n // MODULUS))[:, None] * MODULUS + np.array(COVER)).reshape(-1)
        doc = np.full(padded, owner.max(initial=0) + 1, np.int64)
        doc[:n] = owner
        self._sort(at, doc)

    def _index(self, at: np.ndarray) -> np.ndarray:
        """The number of a sampled position among the sampled ones."""
        return at // MODULUS * len(COVER) + _PLACE[at % MODULUS]

    def _sort(self, at: np.ndarray, doc: np.ndarray) -> None:
        m = len(at)
        bits = max(1, int(self.words.max(initial=0)).bit_length())
        packed = max(1, 62 // bits)
        rank, levels = np.zeros(m, np.int64), []
        order = np.argsort(doc[at], kind="stable")
        rank, tied = self._ranked(order, doc[at][order], m)
        done = 0
        while done < MODULUS and len(tied):  # by the first MODULUS words, a few packed in one key
            key = np.zeros(len(tied), np.int64)
            for t in range(done, min(done + packed, MODULUS)):
                key = (key << bits) | self.words[at[tied] + t]
            rank, tied = self._refine(rank, tied, key)
            done += packed
        step = MODULUS
        while len(tied):  # then by the ranks further on, twice as far each time
            levels.append((step, rank))
            on = self._index(at[tied]) + step // MODULUS * len(COVER)
            key = np.where(on < m, rank[np.minimum(on, m - 1)], -1)
            rank, tied = self._refine(rank, tied, key)
            step *= 2
        self.rank = rank.astype(np.int32)
        sorted_at = np.empty(m, np.int64)
        sorted_at[rank] = at
        self._prefixes(sorted_at, doc, levels)

    @staticmethod
    def _ranked(order, keys, m):
        """Ranks (the first place of equal keys) and the members of ties."""
        first = np.ones(m, bool)
        first[1:] = keys[1:] != keys[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(m), 0))
        rank = np.empty(m, np.int64)
        rank[order] = start
        alone = first & np.append(first[1:], True)
        return rank, order[~alone]

    @staticmethod
    def _refine(rank, tied, key):
        """Ranks by (rank, key); only tied members move."""
        order = np.lexsort((key, rank[tied]))
        members, key, old = tied[order], key[order], rank[tied][order]
        group = np.ones(len(members), bool)
        group[1:] = old[1:] != old[:-1]
        first = group.copy()
        first[1:] |= key[1:] != key[:-1]
        i = np.arange(len(members))
        start = np.maximum.accumulate(np.where(first, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        rank = rank.copy()
        rank[members] = old + start
        return rank, members[~(first & np.append(first[1:], True))]

    def _prefixes(self, at: np.ndarray, doc: np.ndarray, levels) -> None:
        """Common prefixes of neighbours in the sorted order, and their sparse table."""
        a, b = at[:-1].copy(), at[1:].copy()
        found = np.zeros(len(a), np.int64)
        live = np.nonzero(doc[a] == doc[b])[0]
        for step, rank in reversed(levels):
            pa_, pb = a[live] + found[live], b[live] + found[live]
            ia, ib = self._index(pa_), self._index(pb)
            inside = (ia < len(rank)) & (ib < len(rank))
            same = inside & (rank[np.minimum(ia, len(rank) - 1)] == rank[np.minimum(ib, len(rank) - 1)])
            found[live[same]] += step
        for _ in range(MODULUS):
            live = live[self.words[a[live] + found[live]] == self.words[b[live] + found[live]]]
            if not len(live):
                break
            found[live] += 1
        self.table, width = [found.astype(np.int32)], 1
        while 2 * width <= len(found):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on (i < j, in the same document)."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(MODULUS):  # the few words before both positions are sampled
            live = live[shift[live] > t]
            if not len(live):
                break
            same = self.words[i[live] + t] == self.words[j[live] + t]
            out[live[same]] = t + 1
            live = live[same]
        synced = np.nonzero(out == shift)[0]
        lo = self.rank[self._index(i[synced] + shift[synced])]
        hi = self.rank[self._index(j[synced] + shift[synced])]
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            of = np.nonzero(level == k)[0]
            row = self.table[k]
            out[synced[of]] += np.minimum(row[lo[of]], row[hi[of] - (1 << k)])
        return out


def _grid(starts, sizes, min_exponent):
    """Blocks of (grid position, period): for each document and period q with room for
    ``min_exponent`` periods, its positions 0, q, 2q, ... that leave room for that less one."""
    doc = np.repeat(np.arange(len(sizes)), sizes // min_exponent)
    first = np.cumsum(sizes // min_exponent) - sizes // min_exponent
    q = np.arange(len(doc)) - first[doc] + 1
    count = (sizes[doc] - (min_exponent - 1) * q - 1) // q + 1
    count = np.maximum(count, 0)
    total, lo = np.cumsum(count), 0
    while lo < len(doc):
        base = total[lo] - count[lo]
        hi = max(lo + 1, int(np.searchsorted(total, base + CHUNK, "right")))
        c = count[lo:hi]
        which = np.repeat(np.arange(lo, hi), c)
        k = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        yield starts[doc[which]] + k * q[which], q[which]
        lo = hi


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_length: int = 6,
              min_exponent: int = 4) -> np.ndarray:
    """Rows (start in the sequence, length, period) of all runs, by start and period.

    ``words`` holds each document's ``sizes`` numbers from ``starts`` on and a mark behind
    them that occurs nowhere else. A run has its smallest period, at least ``min_length``
    words and ``min_exponent`` (3 or more) periods, and no neighbour continues it."""
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    lce, found = Extensions(words, owner), []
    for g, q in _grid(starts, sizes, min_exponent):
        for t in range(min_exponent - 1):  # a run's first grid position and the next ones hold one word
            ok = words[g + t * q] == words[g + (t + 1) * q]
            g, q = g[ok], q[ok]
        size = lce(g, g + q)
        ok = size > (min_exponent - 2) * q
        found.append(np.stack([g[ok], q[ok], (g + q + size)[ok]]))
    if not found:
        return np.empty((0, 3), np.int64)
    g, q, end = np.concatenate(found, axis=1)
    order = np.lexsort((g, end, q))
    g, q, end = g[order], q[order], end[order]
    first = np.ones(len(g), bool)
    first[1:] = (q[1:] != q[:-1]) | (end[1:] != end[:-1])
    g, q, end = g[first], q[first], end[first]
    # the start is the first position from which period q holds up to g: less than q before it
    lo, hi = np.maximum(starts[owner[g]], g - q + 1), g.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        holds = lce(mid, mid + q) >= g - mid
        lo, hi = np.where(holds, lo, mid + 1), np.where(holds, mid, hi)
    size = end - lo
    ok = (size >= np.maximum(min_length, min_exponent * q))
    rows = np.stack([lo[ok], size[ok], q[ok]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # of one stretch the smallest period
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (runs of anything but ASCII white space), and each text's number of them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(before[ends])


def _batch_runs(texts: pa.Array, min_length: int, min_exponent: int):
    """(number of words, runs as list array, collapsed texts) of a slice of texts."""
    words, sizes = split_words(texts)
    ends = np.cumsum(sizes)
    starts = ends - sizes + np.arange(len(sizes))  # a mark behind each text
    codes = words.dictionary_encode()
    numbers = np.empty(int(ends[-1] if len(ends) else 0) + len(sizes), np.int64)
    marks = starts + sizes
    body = np.ones(len(numbers), bool)
    body[marks] = False
    numbers[body] = codes.indices.to_numpy()
    numbers[marks] = len(codes.dictionary) + np.arange(len(sizes))
    runs = find_runs(numbers, starts, sizes, min_length, min_exponent)
    of = np.searchsorted(starts, runs[:, 0], "right") - 1
    # of texts without words, which share no position, only the one before a mark counts
    counts = np.bincount(of, minlength=len(sizes))
    # words inside a run after its first period are dropped
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = (np.cumsum(change)[:-1] == 0)[body]
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    left = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep)))
    values = pa.StructArray.from_arrays([pa.array(runs[:, 0] - starts[of], pa.int64()), pa.array(runs[:, 1], pa.int64()),
                                         pa.array(runs[:, 2], pa.int64())], ["start", "length", "period"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values), pc.binary_join(left, " ")


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``docs`` with three columns more (a taken name gets underscores): ``n_words``;
    ``runs``, array of (start, length, period) in words, by start and period; ``collapsed``,
    the words outside all runs and the first period of each, joined by one space.

    A null or empty text has no words, no runs and an empty collapsed text. Rows are
    independent, so ties, repeated rows and order don't matter."""
    names = [fresh(docs.columns, n) for n in ("n_words", "runs", "collapsed")]
    types = [T.LongType(), RUNS, T.StringType()]
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in zip(names, types)])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in text_batches(batches, at, SLICE_BYTES):
            got = _batch_runs(batch.column(at).cast(pa.string()), min_length, min_exponent)
            yield pa.RecordBatch.from_arrays([*batch.columns, *got], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def repeating(text: Column, doc_id: Column) -> Column:
    """The text, of which every tenth document (by the crc32 of its id) repeats words: from
    word a = g % n on, with g = crc32 / 10, its words are those of a period of
    1 + (n - a) / (3 + g % 8) words. These texts are words joined by one space."""
    crc = F.crc32(doc_id.cast("string"))
    g = F.floor(crc / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def looped(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(
            w, (F.when(i >= a, a + (i - a) % p).otherwise(i) + 1).cast("int"))), " ")

    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, looped(w)).otherwise("")), 1)
    return F.when(text.isNotNull() & (crc % 10 == 0), made).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), whose texts :func:`repeating` changes first: the
    number of runs, the longest one (ties: smallest start, then period; none: null) and
    digests of all runs and of the collapsed text. A null text has no words; a null doc_id
    leaves the text as it is."""
    made = docs.select("doc_id", repeating(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(made).select("doc_id", "runs", "collapsed", F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / (-F.col("best.period"))).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
