"""Session helpers.

The library never creates its own session inside an operator; operators take
DataFrames. ``get_spark`` is for scripts, tests and the bench.

Cluster rules followed here:

* ``spark.checkpoint.dir`` is read from the session. A cluster names a shared
  folder there; we only fill it in when it is unset (tests, local runs).
* No ``localCheckpoint``: lineage is cut with ``DataFrame.checkpoint()`` into
  that shared folder, which survives the loss of an executor.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE re-plans joins at runtime: a side whose
# measured shuffle size is under the adaptive broadcast threshold becomes a
# broadcast join, everything else stays sort-merge; skewed partitions of a
# sort-merge join are split.
#
# Shuffle partitions: set ``spark.sql.shuffle.partitions`` high for the
# cluster (for 100 TB of input, tens of thousands); AQE coalesces small
# ones toward the advisory size, so the same setting also serves small
# inputs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tessera") -> SparkSession:
    """Return (or create) a session with the scale settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir``; only when it is unset on a local master
    (tests, a laptop) a fresh folder is made and registered. Streaming checkpoint locations and
    ``DataFrame.checkpoint()`` both live under it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpoint_subdir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, e.g. for one stream."""
    base = checkpoint_dir(spark)
    if "://" in base:
        return base.rstrip("/") + "/" + name
    return os.path.join(base, name)


def ship_library(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application.

    Python functions of the library run in executor processes, which may not
    have the package installed. The zip is made on the driver and handed out by
    Spark's own file distribution.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-lib-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tessera_shipped = True
