"""Benchmark decontamination by edit distance.

Texts and items are sequences of lower-cased words; in scripts without spaces (Chinese,
Japanese, Thai, ...) each letter is a word. A document holds an item if some
run of its words is within ``max_edits = 0.2 n`` word edits of the item's n words.

1. **Windows.** n words with that few edits keep a run of q words unchanged (q = 4 for
   n >= 16, 3 from 8 on, 2 from 5 on; below 5 all n words, as no edit is allowed), by counting. Only places that share such a
   q-gram with an item can hold it; each gives a window of the item's size, laid so that
   the shared words coincide. Nothing is lost by this.
2. **CGK.** A random walk writes a window to 3n symbols: at step j the current word is
   written and the walk moves on if a random bit of (j, word) is set. Walks of two close
   sequences fall into step again after an edit, so edit distance becomes Hamming
   distance.
3. **Bit sampling.** A table samples ``SAMPLED`` of the written positions of one of
   ``WALKS`` walks; a window passes if it agrees with its item in all samples of some
   table. The number of tables is fitted so that copies of the items with the largest
   allowed number of random edits pass at the target recall; all windows of an item of
   which a copy failed all tables are verified.
4. **Verification.** The exact edit distance of the item to the best run of words around
   the window decides.

An item of more than ``LONG`` words is looked for by its segments: if the whole has at
most 0.2 n edits, some segment has at most 0.2 of its own; the exact distance of the whole
decides. So no walk is longer than a segment's, and items are embedded with others of like
size only.

Items are handled in blocks of bounded size; each block is one pass over the corpus whose
result is stored before the next one is collected."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ragframe.llm.common import fresh, shared_table, text_batches

MIN_SIMILARITY = 0.8
RECALL = 0.99
MIN_WORDS = 1
WALKS, SAMPLED, MAX_TABLES = 16, 2, 512
#: Words of an item from which it is looked for by segments, each of half as many words or more.
LONG = 512
#: Words of items that one pass over the corpus carries at most.
BLOCK_WORDS = 1 << 18
#: Edited copies of each item that the number of tables is fitted on, and copies or windows embedded at once.
FIT_COPIES, AT_ONCE = 8, 1 << 20
# ---- fixed values: letters of scripts that are written without spaces -------------------
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(r"\w+")
_UNSPACED = re.compile(f"[{UNSPACED}]")
_WORD_OR_LETTER = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
_SEED = 23


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_WORD if text.isascii() or not _UNSPACED.search(text) else _WORD_OR_LETTER).findall(text)


def gram_size(n: int) -> int:
    """Words in a row that must be unchanged in n words with 0.2 n edits."""
    d = int((1 - MIN_SIMILARITY) * n + 1e-9)
    return min(4, -(-(n - d) // (d + 1)))


def cgk(words: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """Random-walk embedding of each row of ``words`` (rows end in -1) in ``steps`` symbols."""
    rng = np.random.default_rng((_SEED, walk))
    mult = rng.integers(1, 1 << 63, steps, np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, steps, np.uint64)
    m, n = words.shape
    out, at, row = np.empty((m, steps), words.dtype), np.zeros(m, np.int64), np.arange(m)
    for j in range(steps):
        now = words[row, at]
        out[:, j] = now
        bit = (now.astype(np.uint64) * mult[j] + plus[j]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), n - 1)
    return out


def best_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Fewest edits that turn some run of ``words`` into ``item``, and where it ends."""
    row = np.zeros(len(words) + 1, np.int64)
    step = np.arange(len(words) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


def segments(n: int) -> list[tuple[int, int]]:
    """(start, size) of the parts that n words are looked for by."""
    parts = max(1, -(-n // LONG))
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def whole_distance(item: np.ndarray, words: np.ndarray, most: int) -> tuple[int, int] | None:
    """:func:`best_distance` if it is at most ``most``, else None; stops when it can't be."""
    row = np.zeros(len(words) + 1, np.int64)
    step = np.arange(len(words) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
        if not i % 64 and row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


class Items:
    """One block of benchmark items, ready to be looked for: classes of items (and segments
    of long ones) of like size."""

    def __init__(self, items: list[tuple], tables: int | None = None):
        self.words: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            seq = [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
            if len(seq) >= MIN_WORDS:
                self.items.append((item_id, np.array(seq, np.int64)))
        sized: dict[int, list] = {}
        for i, (_, seq) in enumerate(self.items):
            for at, n in segments(len(seq)):
                sized.setdefault(n.bit_length(), []).append(((i, at), seq[at:at + n]))
        self.classes = [ItemClass(sized[k], len(self.words), tables) for k in sorted(sized)]

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item_id, n_words, distance, start word) of each item it holds."""
        known = self.words
        seqs = [np.array([known.get(w, -1) for w in words_of(t)], np.int64) for t in texts]
        best: list[dict] = [{} for _ in texts]
        tried: dict[tuple[int, int], list[int]] = {}  # places of long items that were looked at
        for c in self.classes:
            for d, hits in enumerate(c.find(seqs)):
                for (i, at), n, edits, start in hits:
                    item = self.items[i][1]
                    if n == len(item):
                        best[d][i] = min(best[d].get(i, (edits, start)), (edits, start))
                    else:
                        self._whole(best[d], i, item, start - at, seqs[d], tried.setdefault((d, i), []))
        return [[(self.items[i][0], len(self.items[i][1]), edits, start) for i, (edits, start) in sorted(b.items())] for b in best]

    @staticmethod
    def _whole(best: dict, i: int, item: np.ndarray, start: int, seq: np.ndarray, tried: list[int]) -> None:
        """A long item around the place that one of its segments was found at. What is looked
        at holds all that a place within ``most`` words of it could show."""
        most = int((1 - MIN_SIMILARITY) * len(item) + 1e-9)
        if len(seq) < len(item) - most or any(abs(t - start) <= most for t in tried):
            return
        tried.append(start)
        left, right = max(0, start - 2 * most), min(len(seq), start + len(item) + 3 * most)
        got = whole_distance(item, seq[left:right], most)
        if got is not None:
            found = got[0], max(0, left + got[1] - len(item))
            best[i] = min(best.get(i, found), found)


class ItemClass:
    """Items of like size. ``items``: (name, words) of each."""

    def __init__(self, items: list[tuple], n_words: int, tables: int | None = None):
        self.n_words, self.items = n_words, items
        self.grams = {}
        for q in sorted({gram_size(len(s)) for _, s in self.items}):
            keys, who, at = [], [], []
            for i, (_, s) in enumerate(self.items):
                if gram_size(len(s)) == q:
                    k = self._hash(s, q)
                    keys.append(k), who.append(np.full(len(k), i)), at.append(np.arange(len(k)))
            keys, who, at = map(np.concatenate, (keys, who, at))
            order = np.argsort(keys, kind="stable")
            self.grams[q] = keys[order], who[order], at[order]
        self.sizes = np.array([len(x) for _, x in self.items], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        rng = np.random.default_rng(_SEED)
        # each table: a walk, and places as shares of the item's 3n written symbols
        self.places = [(t % WALKS, rng.random(SAMPLED)) for t in range(MAX_TABLES)]
        everyone = np.arange(len(self.items))
        padded = self._pad([x for _, x in self.items])
        self.samples = self._sample(padded, everyone)
        self.starts = np.pad(padded, ((0, 0), (0, 4)), constant_values=-1)[:, :4].copy()
        #: Items whose windows are all verified.
        self.direct = np.zeros(len(self.items), bool)
        self.places = self.places[:tables or self._fit()]
        self.samples = self.samples[:len(self.places)]

    def _pad(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(rows), self.longest + 1), -1, np.int64)
        for i, r in enumerate(rows):
            out[i, :len(r)] = r
        return out

    @staticmethod
    def _hash(seq: np.ndarray, q: int) -> np.ndarray:
        h = np.zeros(max(0, len(seq) - q + 1), np.uint64)
        for o in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + seq[o:len(seq) - q + 1 + o].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        return h

    def _sample(self, windows: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The sampled symbols of each table (tables x samples x windows)."""
        out, row = np.empty((len(self.places), SAMPLED, len(who)), np.int32), np.arange(len(who))
        for walk in range(min(WALKS, len(self.places))):
            embedded = cgk(windows, 3 * self.longest, walk)
            for t in range(walk, len(self.places), WALKS):
                for k, share in enumerate(self.places[t][1]):
                    out[t, k] = embedded[row, (share * 3 * self.sizes[who]).astype(np.int64)]
        return out

    def agree(self, windows: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Whether each window agrees with its item (tables x windows)."""
        return (self._sample(windows, who) == self.samples[:, :, who]).all(1)

    def _fit(self) -> int:
        """Tables needed for ``RECALL`` on randomly edited copies of the items. Items with a
        copy that passes none of them become direct."""
        rng = np.random.default_rng(_SEED + 1)
        who = np.repeat(np.nonzero(self.sizes * (1 - MIN_SIMILARITY) + 1e-9 >= 1)[0], FIT_COPIES)
        if not len(who):
            return 1
        first = np.empty(len(who), np.int64)  # table that a copy passes first
        step = max(1, min(8192, AT_ONCE // self.longest))
        for low in range(0, len(who), step):
            rows, some = [], who[low:low + step]
            for i in some:
                s = list(self.items[i][1])
                for _ in range(int((1 - MIN_SIMILARITY) * len(s) + 1e-9)):
                    at, kind = rng.integers(len(s)), rng.integers(3)
                    new = int(rng.integers(self.n_words, 2 * self.n_words + 9))
                    if kind == 0:
                        s[at] = new
                    elif kind == 1:
                        s.insert(at, new)
                    elif len(s) > 1:
                        del s[at]
                rows.append(np.array(s[:len(self.items[i][1])], np.int64))
            passed = self.agree(self._pad(rows), some)
            first[low:low + step] = np.where(passed.any(0), passed.argmax(0), MAX_TABLES)
        share = np.cumsum(np.bincount(first, minlength=MAX_TABLES + 1)[:MAX_TABLES]) / len(who)
        tables = int(np.argmax(share >= RECALL)) + 1 if share[-1] >= RECALL else MAX_TABLES
        self.direct[who[first >= tables]] = True
        return tables

    def find(self, seqs: list[np.ndarray]) -> list[list[tuple]]:
        """For each text, as word numbers, (name, n_words, distance, start word) of each place of an item in it."""
        held = [[] for _ in seqs]
        first = np.cumsum([0] + [len(x) + 1 for x in seqs])  # a word that no item has parts the texts
        seq = np.concatenate([x for y in seqs for x in (y, [-1])]) if seqs else np.empty(0, np.int64)
        who, start, home = [], [], []
        miss = np.cumsum(np.concatenate([[0], seq < 0]))
        for q, (keys, owner, at) in self.grams.items():
            if len(seq) < q:
                continue
            place = np.nonzero(miss[q:] == miss[:-q])[0]
            h = self._hash(seq, q)[place]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            some = high > low
            place, low, count = place[some], low[some], (high - low)[some]
            flat = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            who.append(owner[flat])
            start.append(np.repeat(place, count) - at[flat])
            home.append(np.searchsorted(first, np.repeat(place, count), "right") - 1)
        if not who or not sum(map(len, who)):
            return held
        triples = np.unique(np.stack([np.concatenate(home), np.concatenate(who), np.concatenate(start)], 1), axis=0)
        best: dict[tuple[int, int], set[tuple[int, int]]] = {}
        # items without an edit: all words equal, at the first such place
        whole = self.sizes[triples[:, 1]] * (1 - MIN_SIMILARITY) + 1e-9 < 1
        exact, triples = triples[whole], triples[~whole]
        for low in range(0, len(exact), 1 << 18):
            doc, item, at = exact[low:low + (1 << 18)].T
            same = (at >= first[doc]) & (at + self.sizes[item] < first[doc + 1])
            for o in range(int(self.sizes[item].max())):
                same &= (self.starts[item, o] == -1) | (seq[np.minimum(at + o, len(seq) - 1)] == self.starts[item, o])
            doc, item, at = doc[same], item[same], at[same]
            for r in np.unique(np.stack([doc, item], 1), axis=0, return_index=True)[1].tolist():
                best.setdefault((int(doc[r]), int(item[r])), {(0, int(at[r] + self.sizes[item[r]]))})
        col = np.arange(self.longest + 1)[None, :]
        step = max(1, min(8192, AT_ONCE // self.longest))
        for low in range(0, len(triples), step):
            doc, item, at = triples[low:low + step].T
            begin, end = np.maximum(at, first[doc]), np.minimum(at + self.sizes[item], first[doc + 1] - 1)
            place = begin[:, None] + col
            windows = np.where(place < end[:, None], seq[np.minimum(place, len(seq) - 1)], -1)
            for r in np.nonzero(self.direct[item] | self.agree(windows, item).any(0))[0].tolist():
                d, i, words = int(doc[r]), int(item[r]), self.items[item[r]][1]
                most = int((1 - MIN_SIMILARITY) * len(words) + 1e-9)
                left = max(int(first[d]), int(at[r]) - most)
                edits, stop = best_distance(words, seq[left:min(int(first[d + 1]) - 1, int(at[r]) + len(words) + most)])
                if edits <= most:
                    best.setdefault((d, i), set()).add((edits, left + stop))
        for (d, i), places in sorted(best.items()):
            n = int(self.sizes[i])
            held[d] += [(self.items[i][0], n, edits, max(0, stop - n - int(first[d]))) for edits, stop in sorted(places)]
        return held


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """The items in lists of at most about ``BLOCK_WORDS`` words."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.size(F.split("text", r"\W+")) + F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))), F.count("*")).first()
    n = max(1, (size[0] or 0) // (BLOCK_WORDS // 2) + 1)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        yield Items([tuple(r) for r in part.orderBy("item_id", "text").collect()])


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               hits_col: str = "hits") -> DataFrame:
    """``docs`` with the array ``hits_col`` of (item_id, n_words, distance, start_word),
    one entry per item that the text holds, by (block and) item; a column of that name
    is replaced. ``distance`` is in words, at most 0.2 of the item's.

    Null and empty texts hold nothing. Items with a null text or without a
    word are left out; those under five words are looked for exactly. Repeated items are looked for once, items
    of one text are each reported. Every row of ``docs`` gives one row."""
    kind = items.schema[item_id].dataType.simpleString()
    out = docs.drop(hits_col)
    hit = T._parse_datatype_string(f"array<struct<item_id:{kind},n_words:int,distance:int,start_word:int>>")
    hit_type = to_arrow_type(hit)
    at = out.columns.index(text_col)
    for number, block in enumerate(_blocks(items, item_id, item_text)):
        if number:  # the pass before is done when the next items come: the driver and the tasks hold one block
            out = shared_table(out, "items-found")
        schema = T.StructType([*[f for f in out.schema.fields if f.name != hits_col], T.StructField(hits_col, hit)])
        first = hits_col not in out.columns

        def run(batches, block=block, first=first):
            for batch in text_batches(batches, at):
                found = [[dict(zip(("item_id", "n_words", "distance", "start_word"), h)) for h in hits] for hits in block.find(batch.column(at).to_pylist())]
                cols, names = list(batch.columns), list(batch.schema.names)
                if not first:
                    found = [a + b for a, b in zip(cols.pop().to_pylist(), found)]
                    names.pop()
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, hit_type)], [*names, hits_col])

        out = out.mapInArrow(run, schema)
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item held in it: doc_id, item_id, n_words, distance,
    similarity and start_word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_items(rows, items).where(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("h"))
    return found.select("doc_id", "h.item_id", "h.n_words", "h.distance", (1 - F.col("h.distance") / F.col("h.n_words")).alias("similarity"), "h.start_word")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    name = fresh(docs.columns, "_hits")
    return find_items(docs, items, hits_col=name).where(F.size(name) == 0).drop(name)
