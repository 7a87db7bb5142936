"""The corpus pipeline: five stages over ``documents``, each written and read again.

Part of the optional subpackage :mod:`ragframe.llm`. A stage takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null or empty tables, texts and ids have the results that the operators state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragframe.llm.common import prepare, shared_table, table, vocabulary
from ragframe.llm.decontaminate import drop_contaminated
from ragframe.llm.langid import drop_rejected, fit
from ragframe.llm.packing import pack_documents
from ragframe.llm.pii import pseudonymize
from ragframe.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier, fitted on the labelled
    texts of ``docs``, does not reject."""
    prepare(spark)
    return drop_rejected(docs, fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    prepare(spark)
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms. The key is the session's
    ``spark.ragframe.pii.key``, or one of this file for a session without."""
    return pseudonymize(docs, key=spark.conf.get("spark.ragframe.pii.key", None) or "key of the pipeline", count_col=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    prepare(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("pii", pii), ("packing", packing)]

#: Compressed sizes, random walks and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stored in the shared folder for the next."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
