"""Session construction and the few cluster-wide settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here is written against: adaptive execution (coalescing,
# skew-join splitting, runtime broadcast conversion), NTZ-stable UTC session
# time, Arrow batches for the few Python functions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # target size of coalesced / split shuffle partitions
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 16,
                  app_name: str = "glossa", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shuffle_partitions_for(input_bytes: int, cores: int, target_bytes: int = 1 << 30,
                           expansion: float = 3.0, cap: int = 200_000) -> int:
    """Initial shuffle partition count for a job reading ``input_bytes``.

    Token tables are about ``expansion`` times the text; partitions are sized
    at ``target_bytes`` of that volume (sorts and aggregations spill
    gracefully beyond executor memory), never fewer than twice the cores, and
    at most ``cap`` (map-status and scheduling costs grow with maps x
    reducers). AQE then coalesces small partitions to
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and splits skewed
    ones. Example: 100 TB of text on 4000 cores -> 200 000 partitions."""
    by_size = int(input_bytes * expansion // target_bytes) + 1
    return min(cap, max(2 * cores, by_size))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used when present. Only a local-mode session with no setting gets a
    private scratch folder (tests, laptops). A non-local session without the
    setting is an error: a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises in some versions
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running glossa jobs")
    path = tempfile.mkdtemp(prefix="glossa-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables a job writes to cut lineage or round-trip files.

    Lives next to the reliable checkpoint data, so it is shared on a cluster.
    """
    base = ensure_checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/glossa-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a scratch folder and read it back: what several steps
    read is then made once, and a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for Python-side file access in local mode."""
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
