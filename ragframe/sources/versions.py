"""Versions of a stored table: a small manifest, written last and as a whole. A change
that fails before it leaves no trace; readers take the latest whole one. One writer at a time."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def latest(spark: SparkSession, path: str) -> dict | None:
    """The latest manifest under ``path``; None without one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    whole = [n for n in names if fs.exists(jvm.Path(f"{path}/manifest/{n}/_SUCCESS"))]
    return json.loads(spark.read.text(f"{path}/manifest/{max(whole)}").first()[0]) if whole else None


def commit(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Writes ``manifest`` as the version that follows its own ``version`` number."""
    done = {**manifest, "version": manifest["version"] + 1}
    row = spark.createDataFrame([(json.dumps(done),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/manifest/v{done['version']:09d}")
    return done
