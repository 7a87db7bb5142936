"""Decontamination against brute force, recall at the edit limit, odd rows."""

import random

import numpy as np

from ragframe.llm import decontaminate as DC
from ragframe.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def slow_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(words):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_documents_hold_what_brute_force_finds(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, DC.words_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, DC.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:15]
    want = {}
    for d, words in docs[:80]:
        for i, item in items:
            x = slow_distance(item, words)
            if len(item) >= DC.MIN_WORDS and x <= int(0.2 * len(item) + 1e-9):
                want[d, i] = x
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op9_decontaminate"](spark, sf).collect()}
    ids, some = {d for d, _ in docs[:80]}, {i for i, _ in items}
    assert {k: v for k, v in got.items() if k[0] in ids and k[1] in some} == want


def test_exact_passages_are_all_found(spark):
    docs = {r.doc_id: " ".join(DC.words_of(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: " ".join(DC.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontaminate"](spark, SF).where("distance = 0").collect()}
    assert got == want and len(want) > 10


def test_recall_of_edited_passages():
    rng, vocabulary = random.Random(2), [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 80)))) for i in range(120)]
    block = DC.Items(items)
    texts, want = [], []
    for i, text in items:
        words = text.split()
        most = int(0.2 * len(words) + 1e-9)
        for _ in range(most):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        texts.append(" ".join(rng.choices(vocabulary, k=300) + words + rng.choices(vocabulary, k=200)))
        want.append(i)
    clean = [" ".join(rng.choices(vocabulary, k=800)) for _ in range(200)]
    found = block.find(texts + clean)
    hit = sum(any(h[0] == w for h in f) for w, f in zip(want, found))
    assert hit >= 0.97 * len(want)
    assert not any(found[len(texts):])


def test_distance_is_exact():
    rng = random.Random(4)
    for _ in range(200):
        a, b = rng.choices(range(5), k=rng.randint(1, 12)), rng.choices(range(5), k=rng.randint(0, 25))
        assert DC.best_distance(np.array(a), np.array(b, np.int64))[0] == slow_distance(a, b)


def test_texts_of_a_batch_are_apart():
    block = DC.Items([(1, "a b c d e f g h i j k l")])
    assert block.find(["x a b c d e f", "g h i j k l", None, "", "a b c d e f g h i j k l"]) == [[], [], [], [], [(1, 12, 0, 0)]]


def test_short_items_and_scripts_without_spaces():
    chinese = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u3002"
    block = DC.Items([(1, "one two"), (2, "Yes"), (3, "a b c d"), (4, chinese), (5, "!")])
    got = block.find(["x one two, one two", "one. yes a b c", "a b c d", "one", "two one", "\u4ed6\u8bf4" + chinese.replace("\u5f88", "\u771f") + "\u662f", "yes yes"])
    assert got == [[(1, 2, 0, 1)], [(2, 1, 0, 1)], [(3, 4, 0, 0)], [], [], [(4, 13, 1, 2)], [(2, 1, 0, 0)]]


def test_items_that_no_table_passes_are_verified(monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40))) for i in range(100)]
    monkeypatch.setattr(DC, "MAX_TABLES", 1)
    monkeypatch.setattr(DC, "SAMPLED", 12)
    block = DC.Items(items)
    texts = []
    for _, text in items:
        words = text.split()
        for at in range(0, 40, 5):
            words[at] = "w0"
        texts.append(" ".join(words))
    found = block.find(texts)
    assert sum(c.direct.sum() for c in block.classes) > 90 and sum(any(h[0] == i for h in f) for i, f in enumerate(found)) > 90


def test_odd_rows_and_blocks(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, None, 1), (2, "", 2), (3, f"x {passage.upper()}! y", 3), (3, f"x {passage.upper()}! y", 3), (None, passage, 4), (5, "word " * 200_000 + passage, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    items = spark.createDataFrame([(1, passage, 0), (1, passage, 0), (2, None, 0), (3, "too short", 0), (4, passage, 0)], "item_id int, text string, doc_id int")
    want = [(None, 1), (None, 4), (3, 1), (3, 1), (3, 4), (3, 4), (5, 1), (5, 4)]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.item_id) for r in DC.contaminated(docs, items).collect()], key=key) == want
    left = DC.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert DC.contaminated(docs, items.limit(0)).count() == 0 and DC.drop_contaminated(docs.limit(0), items).count() == 0
    monkeypatch.setattr(DC, "BLOCK_WORDS", 12)
    assert sorted([(r.doc_id, r.item_id) for r in DC.contaminated(docs, items).collect()], key=key) == want


def edited(rng, words, share):
    words = list(words)
    for _ in range(int(share * len(words))):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"new{rng.randrange(10**6)}")
        else:
            del words[at]
    return words


def test_long_items_beside_short_ones():
    """One item of 100,000 words among 1,000 is made ready and found in seconds; long ones
    with edits are found by their segments, ones with too many edits aren't."""
    import random
    import time
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(20_000)]
    short = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(1000)]
    long = rng.choices(vocab, k=100_000)
    middle = rng.choices(vocab, k=2_000)
    started = time.time()
    block = DC.Items([*short, (5000, " ".join(long)), (5001, " ".join(middle))])
    ready = time.time() - started
    assert ready < 30 and sum(len(c.items) for c in block.classes) == 1000 + 196 + 4
    filler = rng.choices(vocab, k=700)
    texts = [" ".join(filler + edited(rng, middle, 0.12) + filler), " ".join(filler + edited(rng, middle, 0.5) + filler), " ".join(middle[:512] * 2 + filler + edited(rng, middle, 0.15)),
             " ".join(middle[:1200]), short[7][1], " ".join(filler)]
    found = block.find(texts)
    assert [[h[0] for h in f] for f in found] == [[5001], [], [5001], [], [7], []]
    assert found[0][0][1] == 2000 and 0 < found[0][0][2] <= 400 and abs(found[0][0][3] - 700) < 60 and abs(found[2][0][3] - 1724) < 60
    assert [(h[0], h[2], h[3]) for h in block.find([" ".join(filler + long)])[0]] == [(5000, 0, 700)]
    assert time.time() - started < 150


def test_segments():
    for n in (1, 5, 512, 513, 1024, 1025, 100_000):
        parts = DC.segments(n)
        assert sum(size for _, size in parts) == n and parts[0][0] == 0 and max(size for _, size in parts) <= DC.LONG
        assert n <= DC.LONG or min(size for _, size in parts) >= DC.LONG // 2
