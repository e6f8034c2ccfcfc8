"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: lineage is
cut with ``DataFrame.checkpoint()`` into the shared folder the cluster names in
``spark.checkpoint.dir``. Only local test sessions set that folder themselves.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "linkrisk", extra: dict | None = None) -> SparkSession:
    """Session for tests and the local bench (never used on a cluster)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Local test sessions have none, so a fresh temp folder is taken.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="linkrisk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_scan(df: DataFrame) -> DataFrame:
    """Spread a source scan over the cluster when it has fewer input splits
    than task slots (e.g. one Parquet row group feeding CPU-heavy per-row
    work). Cluster-sized inputs have far more splits and are left as they are.
    Only call on a plain scan (its partition count needs no job).
    """
    if df.isStreaming:
        return df
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access: leave the plan as is
        return df
    return df.repartition(2 * slots) if splits < slots else df


#: Rows of one task of CPU-heavy per-row work (features, k-means passes).
TASK_ROWS = 250_000


def spread_rows(df: DataFrame) -> DataFrame:
    """Spread a stored frame so that a partition holds about ``TASK_ROWS`` rows at most:
    coalesced shuffles give as many partitions as there are cores, however large the input
    is. Smaller frames are left as they are."""
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df
