"""Sinks (S8 write_metrics_jsonl, S9 write_results, S10 write_parsed_events)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics_jsonl(counters: DataFrame, path: str, snapshot_ts=None) -> None:
    """Append one JSON object per snapshot: {counter: value, ..., timestamp}."""
    row = counters.groupBy().pivot("counter").agg(F.first("value"))
    ts = F.current_timestamp() if snapshot_ts is None else F.lit(snapshot_ts)
    row = row.withColumn("timestamp", F.unix_seconds(ts.cast("timestamp")))
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(path)


def results_preview(results: DataFrame, n: int = 1000, width: int = 120) -> DataFrame:
    """Preview rows: first ``n`` lines in arrival order, line cut to ``width`` chars."""
    return (results.orderBy("line_id").limit(n)
            .withColumn("line", F.substring("line", 1, width)))


def write_results(results: DataFrame, path: str, preview_rows: int = 1000) -> None:
    """Full per-line results plus the preview next to them."""
    results.write.mode("overwrite").parquet(f"{path}/results")
    results_preview(results, preview_rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/preview")


def write_parsed_events(parsed: DataFrame, path: str) -> None:
    """Parsed records partitioned by OCSF class."""
    parsed.write.mode("append").partitionBy("ocsf_class").parquet(path)
