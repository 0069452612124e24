"""Session helpers: local sessions for tests and benchmarks, the shared
checkpoint folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a per-host side table may have and still be broadcast. A row of these
# tables is a host name and a few numbers, so this is tens of megabytes.
BROADCAST_MAX_ROWS_CONF = "logweave.broadcast.maxRows"
BROADCAST_MAX_ROWS_DEFAULT = 500_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "logweave") -> SparkSession:
    """A local session configured the way the tests and the benchmark run."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and state.

    Taken from the session (``spark.checkpoint.dir`` or the context's folder).
    Only a local-mode session without one gets a fresh temporary folder; a
    cluster session without one is an error, since a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; give the session a shared "
                "folder for checkpoints")
        conf_dir = tempfile.mkdtemp(prefix="logweave-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/logweave-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, eager).

    A reliable checkpoint writes its files in a second job after the first
    has run the plan; the rows are kept (memory, then local disk) between the
    two so that the plan runs once. The cached copy is dropped as soon as
    the checkpoint files exist; if an executor is lost before, the cached
    blocks are recomputed from the lineage.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    again, for tables that several outputs read by other columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_max_rows(spark: SparkSession) -> int:
    value = spark.conf.get(BROADCAST_MAX_ROWS_CONF, None)
    return int(value) if value else BROADCAST_MAX_ROWS_DEFAULT


def bounded_broadcast(side: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Hint ``side`` for broadcast only when it provably has few rows.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the side
    is returned unhinted and the planner falls back to a shuffle join (which
    adaptive execution may still turn into a broadcast at run time). The
    answer is kept on the DataFrame object, so a table handed to several
    operators is counted once; :func:`same_size` passes it on to a table
    derived from it row for row.
    """
    small = getattr(side, "_logweave_small", None)
    if small is None:
        limit = broadcast_max_rows(side.sparkSession) if max_rows is None else max_rows
        small = side.limit(limit + 1).count() <= limit
        side._logweave_small = small
    out = F.broadcast(side) if small else side
    out._logweave_small = small
    return out


def same_size(source: DataFrame, derived: DataFrame) -> DataFrame:
    """``derived`` (one row per row of ``source``) inherits the outcome of
    the size check of ``source``, if there was one."""
    small = getattr(source, "_logweave_small", None)
    if small is not None:
        derived._logweave_small = small
    return derived


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A table derived from large data but small itself (one row per host or
    per chunk): materialised in the checkpoint folder first, so that the size
    check and the join read the stored rows instead of running the upstream
    plan twice, then broadcast when it is within the bound."""
    return bounded_broadcast(cut_lineage(df), max_rows)


def spread(df: DataFrame) -> DataFrame:
    """``df`` spread round-robin over the default parallelism when its scan
    has fewer partitions than that (a small table in one file and one row
    group is read by one task). A large input has enough splits already and
    is returned as it is, with no shuffle."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
