"""Session helpers: one place for the configs every job in this package relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Configs that matter at cluster scale as well as in local tests:
#  - AQE re-plans joins from runtime sizes (a broadcast is only chosen when the
#    measured side is under the threshold; otherwise sort-merge) and splits
#    skewed shuffle partitions.
#  - ANSI mode stays on (Spark 4 default); operators use try_* where a
#    division or cast can fail.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # local mode: the driver JVM is the only JVM (ignored once a JVM is running)
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "assay", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the package's base configuration."""
    master = master or os.environ.get("ASSAY_MASTER", "local[*]")
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; create a scratch one only when unset.

    On a cluster the setting names a shared folder (HDFS/S3/...), which survives
    the loss of any executor. Only local runs (tests, bench) fall back to a
    fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not current:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="assay-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Make ``assay`` importable by the Python workers of this SparkContext.

    The package is zipped once on the driver and added with ``addPyFile``;
    Spark copies it to every executor (pandas UDFs and ``mapInPandas`` bodies
    refer to functions of this package).
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_assay_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="assay-pkg-"), "assay.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    sc._assay_shipped = True
