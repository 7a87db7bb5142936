"""Learned sentence ends: planted abbreviations, whole texts back."""

import random
import re

from ragframe.operators import ingest as IG
from ragframe.operators import sentences as SE

ABBR = ["dr.", "prof.", "e.g.", "no.", "inc."]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(300)]
    words = [w for w in words if w + "." not in ABBR]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(3, 12)):
            s = [rng.choice(words) for _ in range(rng.randint(4, 12))]
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(1, len(s))
                s[at:at] = [rng.choice(ABBR), rng.choice(words).capitalize()]
            s[0] = rng.choice(["The", "But", "This", s[0].capitalize()])
            text.append(" ".join(s) + rng.choice([".", ".", ".", "!", "?"]))
        out.append(text)
    return out


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_planted_abbreviations_do_not_split(spark):
    made = corpus()
    model = SE.learn(docs(spark, [" ".join(t) for t in made]).repartition(5))
    assert {a[:-1] for a in ABBR} <= model.abbreviations and len(model.abbreviations) <= len(ABBR) + 3
    assert {"the", "but", "this"} <= model.starters
    plain = sum(len([s for s in IG._SENTENCE.split(" ".join(t)) if s]) for t in made)
    learned = [model.split(" ".join(t)) for t in made]
    right = sum(a == b for a, b in zip(learned, made)) / len(made)
    assert right > 0.97 and plain > 1.2 * sum(map(len, made))
    assert all(" ".join(s) == " ".join(t) for s, t in zip(learned, made))


def test_an_abbreviation_at_a_sentence_end():
    model = SE.SentenceModel(frozenset({"inc", "e.g"}), frozenset({"the"}))
    assert model.split("He left Acme Inc. The end. Use e.g. this one. x") == ["He left Acme Inc.", "The end.", "Use e.g. this one.", "x"]
    assert model.split("It is Inc. the end") == ["It is Inc. the end"]
    assert model.split("") == [] and model.split("a!  b?\nc") == ["a!", "b?", "c"]


def test_splitting_with_a_model(spark):
    """Pieces hold the same text; no piece ends behind a planted abbreviation if room allows."""
    made = corpus(60, 2)
    df = docs(spark, [" ".join(t) for t in made] + [None, ""])
    model = SE.learn(docs(spark, [" ".join(t) for t in corpus()]))
    got = {r["doc_id"]: r["pieces"] for r in IG.split_documents(df, 120, overlap=0, model=model).collect()}
    base = {r["doc_id"]: r["pieces"] for r in IG.split_documents(df, 120, overlap=0).collect()}
    assert got[len(made)] == [] and got[len(made) + 1] == []
    for i, t in enumerate(made):
        assert re.sub(r"\s+", "", "".join(got[i])) == re.sub(r"\s+", "", " ".join(t)) and max(map(len, got[i])) <= 120
    cut = [sum(p.split()[-1].lower() in ABBR for i in range(len(made)) for p in pieces[i]) for pieces in (got, base)]
    assert cut[0] * 4 < cut[1]


def test_odd_tables(spark):
    assert SE.learn(docs(spark, [None, "", " . ", "1. 2."])) == SE.SentenceModel(frozenset(), frozenset())
    assert SE.learn(spark.createDataFrame([], "text string")).abbreviations == frozenset()


def test_tokens_are_counted_before_they_are_looked_at(spark):
    """One row for equal tokens; the one before matters only where it may end a sentence."""
    texts = ["one two. Three two. Three\x0bone"] * 3 + ["a\u2003b end.\u2028 So", None, ""]
    got = {(r["tok"], r["before"]): r["times"] for r in SE.token_counts(docs(spark, texts).repartition(1)).collect()}
    assert got == {("one", None): 6, ("Three", "two."): 6, ("two.", None): 6, ("a\u2003b", None): 1,
                   ("end.\u2028", None): 1, ("So", "end.\u2028"): 1}
