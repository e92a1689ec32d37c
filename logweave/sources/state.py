"""Saved state as parquet snapshots (S4 load_state, S5 save_state, S6 state_exists).

Layout under ``root`` (any Hadoop file system the cluster shares):
``snapshot_<n>/<table>/`` parquet per table, then ``_pointers/<n>/`` — a one-row JSON
pointer written *last*. Readers take the highest pointer, so a snapshot is visible only
once every table is complete (all-or-nothing publish without renames). Old snapshots
stay readable for audit. Failures are reported (False / None), never raised.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
TABLES = ("templates", "template_versions", "samples", "counts", "classifications")


def _pointers(spark: SparkSession, root: str):
    try:
        p = spark.read.json(f"{root}/_pointers/*")
        return p
    except Exception:  # noqa: BLE001 - no pointer yet
        return None


def state_exists(spark: SparkSession, root: str) -> bool:
    """S6."""
    p = _pointers(spark, root)
    return p is not None and p.limit(1).count() > 0


def save_state(spark: SparkSession, root: str, tables: dict[str, DataFrame], snapshot: int | None = None) -> bool:
    """Write every table of ``tables`` as one snapshot; True on success."""
    try:
        n = snapshot if snapshot is not None else int(time.time() * 1000)
        base = f"{root}/snapshot_{n:015d}"
        for name, df in tables.items():
            df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(f"{base}/{name}")
        ptr = spark.createDataFrame([(n, base, SCHEMA_VERSION, sorted(tables))],
                                    "snapshot long, path string, version int, tables array<string>")
        ptr.coalesce(1).write.mode("overwrite").json(f"{root}/_pointers/{n:015d}")
        return True
    except Exception as exc:  # noqa: BLE001 - reported, not raised (like the reference)
        print(f"[state] save failed: {exc}")
        return False


def load_state(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """Tables of the latest complete snapshot; None when missing, unreadable or of
    another schema version. Tables absent from an older snapshot are simply missing."""
    try:
        p = _pointers(spark, root)
        if p is None:
            return None
        latest = p.orderBy(F.desc("snapshot")).first()
        if latest is None or latest["version"] != SCHEMA_VERSION:
            return None
        out = {}
        for name in latest["tables"]:
            df = spark.read.parquet(f"{latest['path']}/{name}")
            out[name] = df.where(F.col("schema_version") == SCHEMA_VERSION).drop("schema_version")
        return out
    except Exception as exc:  # noqa: BLE001
        print(f"[state] load failed: {exc}")
        return None
