"""Evaluation (G1): a correctness score per case, pass/fail at a threshold,
and the pass rate of a batch.

The default judge is token-set F1 between the actual and the expected output,
in native expressions (so it runs inside code generation and is checkable in
SQL). A model-based judge can be plugged in as a batch callable; it then runs
in ``mapInPandas`` on Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe import constants as K
from ragframe.functions.text import tokens


def token_f1(actual, expected):
    a = F.array_distinct(tokens(actual))
    e = F.array_distinct(tokens(expected))
    overlap = F.size(F.array_intersect(a, e)).cast("double")
    p = F.when(F.size(a) > 0, overlap / F.size(a))
    r = F.when(F.size(e) > 0, overlap / F.size(e))
    return F.when((overlap > 0) & p.isNotNull() & r.isNotNull(), F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def eval_correctness(cases: DataFrame, judge=None, threshold: float = K.EVAL_THRESHOLD) -> DataFrame:
    """G1: ``score`` in [0, 1] and ``passed = score >= threshold`` per case
    (input, actual_output, expected_output)."""
    if judge is None:
        scored = cases.withColumn("score", F.round(token_f1("actual_output", "expected_output"), 9))
    else:
        schema = T.StructType(cases.schema.fields + [T.StructField("score", T.DoubleType())])

        def run(batches):
            for pdf in batches:
                pdf = pdf.copy()
                pdf["score"] = pd.Series(judge(pdf), index=pdf.index, dtype="float64") if len(pdf) else []
                yield pdf

        scored = cases.mapInPandas(run, schema)
    return scored.withColumn("passed", F.col("score") >= F.lit(threshold))


def pass_rate(scored: DataFrame) -> DataFrame:
    """Batch summary: number of cases, passes, pass rate (one-row aggregate)."""
    return scored.agg(F.count(F.lit(1)).alias("n_cases"),
                      F.sum(F.col("passed").cast("long")).alias("n_passed"),
                      F.round(F.avg(F.col("passed").cast("double")), 9).alias("pass_rate"))
