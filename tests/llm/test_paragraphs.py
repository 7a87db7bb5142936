"""Repeated passages against brute force and planted cases."""

import random
import re

import pytest

from ragframe.llm import paragraphs as PG


def prose(rng, n):
    out = []
    while n > 0:
        k = rng.randint(3, 18)
        out.append(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def test_planted_passages(spark):
    rng = random.Random(9)
    passages = [prose(rng, 55) for _ in range(8)]
    rows, planted = [], {}
    for d in range(160):
        text = prose(rng, rng.randint(40, 300))
        if d % 4 == 0:
            at = text.index(". ") + 2
            text = text[:at] + passages[d // 4 % 8] + rng.choice([" ", "\n"]) + text[at:]
            planted.setdefault(d // 4 % 8, []).append(d)
        rows.append((d, text))
    got = PG.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {d for v in planted.values() for d in v}
    assert {r.doc_id for r in got if not r.removed} == {min(v) for v in planted.values()}
    assert all(r.first_doc_id == next(min(v) for v in planted.values() if r.doc_id in v) for r in got)
    cut = {r.doc_id: r.text for r in PG.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert (cut[d] == t) if d % 4 or d == min(planted[d // 4 % 8]) else len(PG._WORD.findall(cut[d])) < len(PG._WORD.findall(t)) - 20


def jaccard(a, b):
    grams = lambda t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("block", [3, 256])
def test_clusters_of_near_copies(spark, block):
    """Many variants of a few sentences: clusters are the components of J >= 0.8."""
    rng = random.Random(block)
    rows = []
    for s in range(4):
        base = [f"s{s}w{i}" for i in range(39)]
        for v in range(30):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.choice([0, 1, 37, 38])] = f"x{rng.randint(0, 3)}"
            rows.append((s * 100 + v, " ".join(words)))
    got = {r.doc_id: r.cluster for r in PG.repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, t in rows:
        for b, u in rows:
            if a < b and a // 100 == b // 100 and jaccard(t, u) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    for a, _ in rows:
        for b, _ in rows:
            assert (got.get(a) is not None and got.get(a) == got.get(b)) == (find(a) == find(b) and a in got)


def test_long_sentences_are_cut_by_their_words():
    rng = random.Random(1)
    passage = [f"p{rng.randint(0, 10 ** 6)}" for _ in range(150)]
    a = PG.units(" ".join([f"a{i}" for i in range(77)] + passage + [f"b{i}" for i in range(40)]))
    b = PG.units(" ".join([f"c{i}" for i in range(31)] + passage))
    same = {tuple(w) for _, w in a} & {tuple(w) for _, w in b}
    assert sum(map(len, same)) > 75
    assert [w for _, u in a for w in u] == [f"a{i}" for i in range(77)] + passage + [f"b{i}" for i in range(40)]
    assert [s for s, _ in a] == [sum(len(w) for _, w in a[:i]) for i in range(len(a))]


def test_odd_rows(spark):
    line = prose(random.Random(5), 60)
    rows = [(1, None, 1), (2, "", 1), (None, line, 1), (4, line, 2), (4, line, 2), (5, line + "\n" + line, 3), (6, "a " * 100_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cluster int")
    got = PG.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {4, 5} and all(r.first_doc_id == 4 for r in got)
    assert PG.repeated_passages(docs.limit(0)).count() == 0
    out = PG.without_passages(docs)
    assert out.columns == docs.columns and out.count() == 7
    only = spark.createDataFrame([(1, line), (1, line)], "doc_id long, text string")
    assert PG.repeated_passages(only).count() == 0


def sentences(rng, n):
    """n words in sentences of 6 to 25 words."""
    out, left = [], 0
    for i in range(n):
        if not left:
            left = rng.randint(6, 25)
        left -= 1
        w = "".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8)))
        out.append((w.capitalize() if not out or out[-1].endswith(".") else w) + ("." if not left else ""))
    return out


@pytest.mark.parametrize("length, recall", [(50, 0.95), (60, 0.98), (80, 0.99)])
def test_recall_of_passages_cut_at_any_word(spark, length, recall):
    """Pairs of unlike documents with one passage, cut at any word and set at any word; the
    words reported are those of the passage, give or take a few."""
    rng = random.Random(length)
    rows, spans = [], {}
    for p in range(60):
        whole = sentences(rng, length + 60)
        at = rng.randrange(60)
        passage = whole[at:at + length]
        for side in range(2):
            text = sentences(rng, rng.randint(60, 200))
            cut = rng.randrange(len(text) + 1)
            rows.append((2 * p + side, " ".join(text[:cut] + passage + text[cut:])))
            spans[2 * p + side] = cut
    rows += [(1000 + i, " ".join(sentences(rng, 150))) for i in range(60)]
    got = PG.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {r.doc_id: r for r in got}
    assert not [d for d in found if d >= 1000]
    assert len(found) / 120 >= recall
    # a unit at an edge can be alike with a few words more
    assert all(r.start_word >= spans[d] - 8 and r.start_word + r.n_words <= spans[d] + length + 8 for d, r in found.items())
    exact = [d for d, r in found.items() if (r.start_word, r.n_words) == (spans[d], length)]
    assert length > 50 or len(exact) > 0.3 * len(found)
    assert {r.doc_id for r in got if not r.removed} == {d for d in found if d % 2 == 0}


def test_busy_keys_move_hashes_alone(spark, monkeypatch):
    """Occurrences (documents and places) don't travel with each of a unit's keys, and a member
    of a group of one block comes once; a repeated row of a document counts once."""
    stored, dealt = {}, []
    keep, compare = PG.shared_table, PG._compared
    monkeypatch.setattr(PG, "shared_table", lambda df, name: stored.setdefault(name, keep(df, name)))
    monkeypatch.setattr(PG, "_compared", lambda df: dealt.append(df) or compare(df))
    base = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:29] + ["x"])), (2, " ".join(base[:29] + ["x"])), (3, " ".join(base))]
    got = PG.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_doc) for r in got) == [(1, 1), (2, 1), (3, 1)] and len({r.cluster for r in got}) == 1
    assert sorted(stored["busy-members"].columns) == ["hash", "key"]
    assert dealt[0].count() == stored["mixed-members"].count() > 0


def test_hashes_are_those_of_the_words(monkeypatch):
    words = [f"w{i % 7}" for i in range(50)] + ["ünd", ""]
    want = [PG.xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    for most in (1 << 17, 3):
        monkeypatch.setattr(PG, "HASHES", most)
        held = PG._Hashes()
        assert held.of(words).tolist() == want and len(held) <= most


def test_hot_shingle_has_few_partners():
    """Members that share a frequent shingle alone are not compared; links are those of all pairs."""
    rng = random.Random(4)
    left, right = {}, {}
    for i in range(120):
        base = [f"b{i % 40}w{k}" for k in range(rng.randint(4, 20))] if i < 80 else [f"u{i}w{k}" for k in range(12)]
        words = base + "one two three four five".split() + ([f"x{i}"] if i % 3 else [])
        (left if rng.random() < 0.5 else right)[i] = " ".join(words)
    for a, b in ((left, right), (left, left), (left | right, left | right)):
        sets = {h: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for h, t in (a | b).items()}
        near = {(x, y) for x in a for y in b if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])}
        partners = PG._partners(sets, a, b)
        asked = {(x, y) for x in a for y in partners(x)}
        assert near <= asked and len(asked) < 0.1 * len(a) * len(b)
        u, v, root = [], [], {h: h for h in sets}
        PG._forest(a, b, u, v)
        assert set(zip(u, v)) <= near

        def find(x, root):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in zip(u, v):
            root[find(x, root)] = find(y, root)
        assert all(find(x, root) == find(y, root) for x, y in near)


def test_units_are_those_of_the_sentences():
    """Words and sentence ends are found as by expressions over each sentence, for any characters."""
    rng = random.Random(8)
    chars = [" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", ".", "!", "?", "-", "'", "_", "a", "B", "9", "É", "İ", "Σ", "²", "́", "中", "𝔸"]
    for _ in range(300):
        text = "".join(rng.choices(chars, k=rng.randint(0, 400), weights=[8, 1, *[1] * 21]))
        sentences = [s for s in (PG._WORD.findall(s.lower()) for s in re.split(r"(?<=[.!?])\s+|\n+", text)) if s]
        words, sizes, number = PG._words([text, None, text])
        assert words.to_pylist() == 2 * [w for s in sentences for w in s]
        assert sizes[sizes > 0].tolist() == 2 * [len(s) for s in sentences] and number.sum() == len(sizes)
        assert [w for _, u in PG.units(text) for w in u] == [w for s in sentences for w in s]
        assert all(len(u) >= PG.MIN_WORDS or len(s) < PG.MIN_WORDS or len(s) > PG.LONG
                   for _, u in PG.units(text) for s in sentences if u == s)
