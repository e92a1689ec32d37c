"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on. AQE gives the runtime size check
# behind every data-dependent join (broadcast only when the measured side is small,
# sort-merge with skew splitting otherwise); LAST_WIN matches "last label wins" for
# duplicate map keys.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

# Runtime SQL settings the jobs rely on, applied to any session (also one the caller made).
# Constraint propagation is off because it infers `isnotnull(key)` filters from joins on
# computed keys and pushes them below the projection, so the 21-regex mask chain would be
# evaluated twice per line (once inside the pushed filter, once in the projection).
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logweave`` importable in the Python workers (pandas UDFs, applyInPandas):
    the package is zipped once and added with ``addPyFile`` (what ``--py-files`` does at
    submit time), once per SparkContext."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="logweave-pyfiles-"), "logweave.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def tune(spark: SparkSession) -> SparkSession:
    for k, v in JOB_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # noqa: BLE001 - a locked conf keeps the session's value
            pass
    ship_package(spark)
    return spark


def get_session(master: str | None = None, app: str = "logweave",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass master=None and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        # local runs only: no UI server, loopback driver address, and a driver heap sized
        # for local mode (the driver is the only JVM; Spark's default is 1 GB)
        b = (b.config("spark.ui.enabled", "false")
             .config("spark.driver.host", "127.0.0.1")
             .config("spark.driver.bindAddress", "127.0.0.1")
             .config("spark.driver.memory", os.environ.get("LOGWEAVE_DRIVER_MEMORY", "8g")))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to a shared file system. Only when it is unset
    (tests, local runs) do we create a scratch folder, so lineage cuts still work.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="logweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Cut lineage by writing the table to the shared checkpoint folder and reading it back.

    One job computes the plan once and writes parquet (columnar, compressed); the returned
    DataFrame reads the files, so later stages and task retries after an executor loss never
    recompute the upstream plan. (``Dataset.checkpoint`` would compute the plan twice: once
    for its eager count and once more to write the checkpoint files.) Never localCheckpoint.
    The schema is known, so no job reads it from the files: jobs cost the driver memory.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
