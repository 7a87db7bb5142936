"""Sentence ends learned from the corpus (B2).

A word is an abbreviation if it stands with a period behind it far more often than words
do: a log-likelihood ratio against the corpus's rate of periods, weighed down by its length
and by its uses without a period (the measure of Kiss and Strunk's sentence splitter). A
word starts sentences if it follows sentence ends more often than chance. Both are counts by
word with partial aggregation, and native expressions.

A text ends a sentence at white space behind ``.``, ``!`` or ``?``, but not behind an
abbreviation, unless a capital word follows that starts sentences."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.session import checkpoint

#: The rate of periods behind an abbreviation, and the least scores.
ABBREVIATION_RATE = 0.99
MIN_SCORE, MIN_START = 0.3, 30.0
#: Uses from which a word is judged, and the most entries of each kind that a model holds (the best).
MIN_COUNT = 5
MAX_ENTRIES = 100_000
WORD = r"^[^\p{L}\p{N}]*(\p{L}(?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?)"
STOP = r"[.!?]$"
#: Distinct tokens that a task counts before it hands them on.
HELD = 200_000

_TOKEN, _STOPS = re.compile(r"[^ \t\n\x0b\f\r]+"), frozenset(".!?")
_WORD = re.compile(r"[\W_]*([^\W\d_](?:[\w.-]*[^\W_])?)")


@dataclass
class SentenceModel:
    """Words in lower case, without the last period."""
    abbreviations: frozenset
    starters: frozenset

    def ends(self, token: str, following: str) -> bool:
        """Whether a sentence ends between two neighbouring tokens."""
        if token[-1:] not in (".", "!", "?"):
            return False
        if token[-1] != "." or word_of(token) not in self.abbreviations or not re.search(r"[^\W_]\.$", token):
            return True
        return word_of(following) in self.starters and bool(re.match(r"[\W_]*[^\W\d_]", following)) and \
            re.match(r"[\W_]*(.)", following)[1].isupper()

    def split(self, text: str) -> list[str]:
        """The sentences of a text: its pieces between the white space at sentence ends."""
        out, start = [], 0
        for gap in re.finditer(r"(?<=[.!?])\s+", text):
            before = re.search(r"\S+$", text[max(start, gap.start() - 300):gap.start()])
            after = re.match(r"\S*", text[gap.end():gap.end() + 300])
            if before and self.ends(before[0], after[0]):
                out.append(text[start:gap.start()])
                start = gap.end()
        out.append(text[start:])
        return [s for s in out if s]


def word_of(token: str) -> str:
    found = _WORD.match(token)
    return found[1].lower() if found else ""


def _count_kernel(batches):
    """Counts of a task's tokens, in parts of bounded size."""
    def part() -> pa.RecordBatch:
        keys = [pa.array(c, pa.string()) for c in zip(*counts)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(list(counts.values()), pa.int64())], ["tok", "before", "times"])

    counts: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            toks = _TOKEN.findall(value.as_py() or "")
            # what STOP sees of a token is in its last two characters (the last may be a line separator)
            counts.update(zip(toks, itertools.chain((None,), (t if t[-1] in _STOPS or t[-2:-1] in _STOPS else None for t in toks))))
            if len(counts) > HELD:
                yield part()
                counts.clear()
    if counts:
        yield part()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """tok, the one before it where that may end a sentence (else null), their word and
    ``times``, how often they stand so. Equal ones are counted before any expression looks
    at them: there are far fewer words than places. Stored, so that one reading of the
    texts serves abbreviations and starters."""
    rows = docs.select(text_col).mapInArrow(_count_kernel, "tok string, before string, times long")
    rows = rows.groupBy("tok", "before").agg(F.sum("times").alias("times"))
    word = F.lower(F.regexp_extract("tok", WORD, 1))
    return checkpoint(rows.withColumn("word", word).where("word <> ''"))


def abbreviations(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT, tokens: DataFrame | None = None) -> DataFrame:
    """word, n (uses), n_period and score of every abbreviation. Null texts have no words.
    ``tokens``: the texts' :func:`token_counts`, if they are there already."""
    rows = (token_counts(docs, text_col) if tokens is None else tokens).withColumn("p", F.col("tok").rlike(r"[\p{L}\p{N}]\.$").cast("long"))
    counts = checkpoint(rows.groupBy("word").agg(F.sum("times").alias("n"), F.sum(F.col("p") * F.col("times")).alias("n_period")))
    total = counts.agg(F.sum("n").cast("double").alias("n"), F.sum("n_period").cast("double").alias("p")).select(F.struct("n", "p").alias("t")).scalar()
    rate = F.try_divide(total["p"], total["n"])
    n, p = F.col("n").cast("double"), F.col("n_period").cast("double")
    likely = 2 * (p * F.log(F.lit(ABBREVIATION_RATE)) + (n - p) * F.log(F.lit(1 - ABBREVIATION_RATE)) - p * F.log(rate) - (n - p) * F.log(1 - rate))
    size = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - size + 1
    score = likely * F.exp(-size.cast("double")) * inner * F.pow(size.cast("double"), p - n)
    return (counts.where((F.col("n") >= min_count) & (F.col("n_period") > 0)).withColumn("score", F.round(score, 9))
            .where(F.col("score") >= MIN_SCORE))


def starters(docs: DataFrame, known: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT,
             tokens: DataFrame | None = None) -> DataFrame:
    """word, n, n_start and score of the words that start sentences; ``known``: the abbreviations;
    ``tokens`` as there."""
    rows = (token_counts(docs, text_col) if tokens is None else tokens).withColumn("last", F.lower(F.regexp_extract("before", WORD, 1)))
    rows = rows.withColumn("stop", F.coalesce(F.col("before").rlike(STOP), F.lit(False)) & F.col("tok").rlike(r"^[^\p{L}\p{N}]*\p{Lu}"))
    per = rows.groupBy("word", "last", F.coalesce(F.col("before").rlike(r"[\p{L}\p{N}]\.$"), F.lit(False)).alias("dot"), "stop").agg(F.sum("times").alias("n"))
    abbr = known.select(F.col("word").alias("last"), F.lit(True).alias("abbr"))
    per = per.join(abbr, "last", "left").withColumn("stop", F.col("stop") & ~(F.col("dot") & F.col("abbr").isNotNull()))
    counts = checkpoint(per.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("n_start")))
    total = counts.agg(F.sum("n").cast("double").alias("n"), F.sum("n_start").cast("double").alias("s")).select(F.struct("n", "s").alias("t")).scalar()
    n, s = F.col("n").cast("double"), F.col("n_start").cast("double")

    def part(seen, rows, columns):
        return F.when(seen > 0, seen * F.log(F.try_divide(seen * total["n"], rows * columns))).otherwise(0.0)

    likely = 2 * (part(s, n, total["s"]) + part(n - s, n, total["n"] - total["s"]) + part(total["s"] - s, total["n"] - n, total["s"])
                  + part(total["n"] - n - total["s"] + s, total["n"] - n, total["n"] - total["s"]))
    return (counts.where((F.col("n") >= min_count) & (s * total["n"] > n * total["s"])).withColumn("score", F.round(likely, 6))
            .where(F.col("score") >= MIN_START))


def learn(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT) -> SentenceModel:
    """The model of a corpus: at most ``MAX_ENTRIES`` words of each kind, those with the best scores."""
    tokens = token_counts(docs, text_col)
    known = checkpoint(abbreviations(docs, text_col, min_count, tokens))
    first = starters(docs, known, text_col, min_count, tokens)
    lists = [[r[0] for r in df.orderBy(F.desc("score"), "word").limit(MAX_ENTRIES).select("word").collect()] for df in (known, first)]
    return SentenceModel(*map(frozenset, lists))
