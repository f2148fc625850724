"""Spark session builder and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build(master: str | None = None, cpus: int | None = None, app: str = "barwise",
          shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every query here relies on.

    * UTC session zone: bar timestamps are zone-naive (TIMESTAMP_NTZ in the scan).
    * AQE on: runtime coalescing of shuffle partitions, skew-join splitting and
      conversion of data-derived small sides (parameter tables, block carries) to
      broadcast joins once their *measured* size is under the threshold.
    * ANSI stays on; every division in the library is ``try_divide``.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    # local: one shuffle partition per core
    parts = shuffle_partitions or (cpus if master.startswith("local") else None)
    b = SparkSession.builder.master(master).appName(app)
    if parts:       # a cluster keeps its own setting unless one is given
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("BARWISE_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder and is
    used as is.  When it is unset, a local master (tests) gets a private folder under the
    system temp dir; any other master is refused.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if not cur:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        cur = tempfile.mkdtemp(prefix="barwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(cur)
    except Exception:  # pragma: no cover - Connect sessions have no SparkContext
        pass
    return cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``barwise`` importable in the Python workers (grouped maps, keyed state and
    UDFs reference its functions): zip the package once per application and add it with
    ``addPyFile``, the programmatic ``--py-files``; Spark distributes it to executors."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # pragma: no cover - Connect sessions ship code with addArtifacts
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import barwise
    root = os.path.dirname(os.path.abspath(barwise.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="barwise-pkg-"), "barwise.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
