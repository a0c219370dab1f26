"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "cropframe", cores: str | int | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and benchmarks, with the settings the library is tuned for."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("CROPFRAME_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def job_session(app: str) -> SparkSession:
    """Session of a job: master, resources and shared folders are the launcher's."""
    spark = SparkSession.builder.appName(app).getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        apply_cluster_settings(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of a session that does not have it installed."""
    import zipfile

    sc, root = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(sc, "_cropframe_sent", False) or os.path.dirname(root) in known:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cropframe-zip-"), "cropframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("cropframe", os.path.relpath(full, root)))
    sc.addPyFile(path)  # the driver serves it; executors fetch their own copy
    sc._cropframe_sent = True


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged copy, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# Settings for a large cluster (about 100 TB of input, ~1000 executors).
# Start with many shuffle partitions and let AQE coalesce them to ~256 MB;
# scan splits of 256 MB keep task counts reasonable on wide parquet tables;
# skewed join partitions (a key with a third of the rows) are split by AQE.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_settings(spark: SparkSession, overrides: dict[str, str] | None = None) -> None:
    """Set the cluster sizing above on a running session (runtime SQL confs only)."""
    for k, v in {**CLUSTER_SETTINGS, **(overrides or {})}.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.
    Only when it is unset (local tests) a fresh local folder is created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="cropframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint folder for a staged table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
