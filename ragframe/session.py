"""Session helpers: a tuned SparkSession for tests/bench, checkpointing, and
size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "ragframe") -> SparkSession:
    """Session for tests and the bench. On a cluster, pass your own session to the
    operators instead: nothing here is required by them."""
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RAGFRAME_DRIVER_MEMORY", _default_driver_memory()))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _default_driver_memory() -> str:
    """Half of the machine's memory, capped at 16g (local mode: the driver is
    the only JVM)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total / 2**30 * 0.5)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session without one (tests) gets a scratch folder; a cluster
    must name a folder that the driver and all executors share."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) session: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        conf_dir = tempfile.mkdtemp(prefix="ragframe-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one):
    cuts lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a side that may be broadcast (as measured, before Spark's own overhead).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``, from file sizes (no job)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - remote (Connect) session: no plan object
        return 1 << 62


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df``: one aggregate, combined in each task, of what its
    values take (strings by their bytes, arrays and maps by their elements)."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            n = F.octet_length(c)
        elif kind == "array" and f.dataType.elementType.typeName() not in ("string", "binary", "struct", "array", "map"):
            n = F.size(c) * 8
        elif kind in ("array", "map", "struct"):
            n = F.octet_length(F.to_json(F.struct(c)))
        else:
            n = F.lit(8)
        size = size + F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)) + 8
    r = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return int(r[0]), int(r[1] or 0)


def fits(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` is proven to have at most ``max_rows`` rows and
    ``max_bytes`` bytes: by the plan's size where that is far below the bound
    (files are compressed), else by one aggregate over it."""
    if plan_bytes(df) * 16 <= min(max_bytes, max_rows * 8):
        return True
    rows, size = measured(df)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint behind a size check in rows and bytes; beyond the bound the
    plain DataFrame is returned and Spark shuffles (AQE may still convert)."""
    return F.broadcast(df) if fits(df, max_rows) else df


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key, str(default)))
    except Exception:  # noqa: BLE001 - malformed user conf falls back to default
        return default


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``ragframe`` package importable on the executors: the Python
    functions of ``mapInPandas`` / pandas UDFs are pickled by reference, so the
    workers must import the package. A zip of it is built once per driver
    process and registered with ``addPyFile`` (``addArtifacts`` on a remote
    session), which distributes it to every executor."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) session
        sc = None
    key = id(sc) if sc is not None else id(spark)
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="ragframe-pkg-"), "ragframe.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(zpath)
    else:
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(key)
