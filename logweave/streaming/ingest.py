"""Structured Streaming forms.

R1 stream_ingest   readStream lines -> per micro-batch: rules and template snapshot read anew
                   (R8), fast path, masks, mining from the clusters so far, labels -> tables
                   with a partition per micro-batch that a replay replaces, and counters (R6).
R2, R4             keyed state that starts from tables: see ``stateful``.
R3 stream_reservoir keyed state with the k smallest sample ranks per cluster (same rank
                   as the batch sampler, so batch and stream samples agree).
   stream_merge_hits running NONE-line hits per cluster (streaming aggregate).
R5 inflight_dedup  ``dropDuplicatesWithinWatermark`` on the template (admit once per TTL).
R6 stream_metrics  counters per 60 s event-time window with a watermark.
R7 queue_latest    latest status per queue item (``max_by`` over an append-only log).
All sinks and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from logweave.operators.mining import DEFAULT_SIM_TH
from logweave.operators.sampling import DEFAULT_K, DEFAULT_SEED
from logweave.session import checkpoint_dir
from logweave.sources.rules import DEFAULT_RULES, read_rules_file
from logweave.sources.tables import EVENT_LINE_SQL, ensure_parallelism

LINE_SCHEMA = T.StructType([
    T.StructField("line_id", T.LongType()), T.StructField("arrival_ts", T.TimestampType()),
    T.StructField("source", T.StringType()), T.StructField("line", T.StringType()),
])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state (templates per mining key, samples per cluster) grows with the number of
    keys: keep it in RocksDB (off-heap, spills to local disk, checkpointed) rather than the
    in-memory HDFS-backed provider. Only applies to queries started afterwards."""
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    except Exception:  # noqa: BLE001 - locked conf: keep the session's provider
        pass


def stream_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def event_line_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Event rows of ``sf_dir`` read as a stream and rendered as log lines (stand-in)."""
    ev_schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ev = (spark.readStream.schema(ev_schema).option("pathGlobFilter", "events.parquet")
          .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))
    # watermarks need TIMESTAMP (not _NTZ); the job's session time zone is UTC
    return ev.select(F.col("event_id").alias("line_id"), F.col("ts").cast("timestamp").alias("arrival_ts"),
                     F.col("event_type").alias("source"), F.expr(EVENT_LINE_SQL).alias("line"))


def _rank(seed: str, line_id: int) -> str:
    return hashlib.md5(f"{seed}:{line_id}".encode()).hexdigest()


RES_OUT = T.StructType([T.StructField("cluster_id", T.StringType()), T.StructField("line_id", T.LongType()),
                        T.StructField("line", T.StringType()), T.StructField("n", T.LongType())])
RES_STATE = T.StructType([T.StructField("ranks", T.ArrayType(T.StringType())),
                          T.StructField("ids", T.ArrayType(T.LongType())),
                          T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("n", T.LongType())])


def _reservoir_fn(k: int, seed: str):
    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ranks, ids, lines, n = ([], [], [], 0)
        if state.exists:
            r, i, ln, n = state.get
            ranks, ids, lines = list(r), list(i), list(ln)
        for pdf in pdfs:
            n += len(pdf)
            for lid, line in zip(pdf["line_id"], pdf["line"]):
                ranks.append(_rank(seed, int(lid))); ids.append(int(lid)); lines.append(line)
            keep = sorted(range(len(ranks)), key=lambda j: (ranks[j], ids[j]))[:k]
            ranks, ids, lines = [ranks[j] for j in keep], [ids[j] for j in keep], [lines[j] for j in keep]
        state.update((ranks, ids, lines, n))
        order = sorted(range(len(ids)), key=lambda j: ids[j])
        yield pd.DataFrame({"cluster_id": [key[0]] * len(order), "line_id": [ids[j] for j in order],
                            "line": [lines[j] for j in order], "n": [n] * len(order)})
    return run


def stream_reservoir(lines: DataFrame, k: int = DEFAULT_K, seed: str = DEFAULT_SEED) -> DataFrame:
    """Per-cluster bottom-k sample kept in state (update mode: latest sample per
    cluster each micro-batch). The sample equals the batch sampler's on the same lines."""
    return lines.select("cluster_id", "line_id", "line").groupBy("cluster_id").applyInPandasWithState(
        _reservoir_fn(k, seed), RES_OUT, RES_STATE, "update", GroupStateTimeout.NoTimeout)


def stream_merge_hits(results: DataFrame) -> DataFrame:
    """Running count of the mined NONE lines per cluster (what confirms merges, see
    ``stateful.confirm_stream``); lines of the fast path confirm no merge, as in the batch form."""
    fast = F.coalesce(F.col("fast_path"), F.lit(False)) | F.coalesce(F.col("near_match"), F.lit(False))
    return (results.where((F.col("change_type") == "NONE") & ~fast).groupBy("cluster_id")
            .agg(F.count(F.lit(1)).alias("hits")))


def inflight_dedup(items: DataFrame, ttl: str = "30 seconds", key: str = "template",
                   time_col: str = "arrival_ts") -> DataFrame:
    """Admit each template once per TTL of event time."""
    return items.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark([key])


def stream_metrics(lines: DataFrame, interval: str = "60 seconds", delay: str = "60 seconds",
                   time_col: str = "arrival_ts") -> DataFrame:
    """Lines per event-time window (a watermark closes windows for late data)."""
    return (lines.withWatermark(time_col, delay)
            .groupBy(F.window(time_col, interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("logs_ingested")))


def queue_latest(log: DataFrame) -> DataFrame:
    """Latest status per item from an append-only queue log (item_id, status, ts)."""
    return log.groupBy("item_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


#: Clusters that a micro-batch created or changed.
_CLUSTERS = "cluster_id string, template string, created long, batch_id long"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One partition per micro-batch, replaced as a whole: a replay leaves the table as it was."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def clusters_before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """(cluster_id, template, created) of a stream's clusters before a micro-batch (now, without)."""
    c = spark.read.schema(_CLUSTERS).parquet(path)
    if batch_id is not None:
        c = c.where(F.col("batch_id") < batch_id)
    last = F.max_by(F.struct("template", "created"), "batch_id").alias("last")
    return c.groupBy("cluster_id").agg(last).select("cluster_id", "last.template", "last.created")


def stream_ingest(lines: DataFrame, out_path: str, ckpt: str, rules_path: str | None = None,
                  compiled: DataFrame | None = None, state_root: str | None = None, sim_th: float = DEFAULT_SIM_TH,
                  near_threshold: float = 0.85, interval: str = "60 seconds", trigger: dict | None = None):
    """``plans.ingest`` over a stream of lines, one micro-batch after the other.

    Each micro-batch reads anew the rule file (R8) and, with ``state_root``, the latest
    template snapshot behind its pointer (R8; ``compiled`` fixes the registry instead), takes
    the fast path, and mines the rest from the clusters of the micro-batches before it, a
    table (no operator state). It writes three tables, a partition per micro-batch that a
    replay replaces: ``out_path`` (all result columns of ``ingest``), ``out_path``-clusters
    (what it created or changed) and ``out_path``-counters (counters per event-time interval).
    A replayed micro-batch sees the clusters it saw first, so its rows come out equal."""
    from logweave.operators.compile import matchable_templates
    from logweave.operators.reports import interval_counters
    from logweave.plans.ingest import ingest
    from logweave.session import cut_lineage
    from logweave.sources.state import load_state

    spark = lines.sparkSession
    clusters = f"{out_path}-clusters"
    spark.createDataFrame([], _CLUSTERS).write.mode("ignore").partitionBy("batch_id").parquet(clusters)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rules = read_rules_file(rules_path) if rules_path else DEFAULT_RULES
        registry = compiled
        if registry is None and state_root is not None:
            saved = load_state(spark, state_root)
            if saved is not None and "templates" in saved:
                registry = cut_lineage(matchable_templates(saved["templates"], fallback_to_pattern=True))
        # a micro-batch of one file is one task: its lines are dealt out before the masks
        batch = ensure_parallelism(batch, "line_id", F.xxhash64("line"))
        seeds = cut_lineage(clusters_before(spark, clusters, batch_id))
        out = ingest(batch, compiled=registry, rules=rules, sim_th=sim_th, seeds=seeds, near_threshold=near_threshold)
        _write_batch(out.results, out_path, batch_id)
        made = out.versions.groupBy("cluster_id").agg(F.max_by("template", "version").alias("template"), F.min("trigger_line_id").alias("first"))
        made = made.join(seeds.select("cluster_id", "created"), "cluster_id", "left").select("cluster_id", "template", F.coalesce("created", "first").alias("created"))
        _write_batch(made, clusters, batch_id)
        results = spark.read.parquet(out_path).where(F.col("batch_id") == batch_id)
        _write_batch(interval_counters(results, interval), f"{out_path}-counters", batch_id)

    w = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def run_to_completion(df: DataFrame, out_path: str, ckpt: str, mode: str = "append") -> None:
    """Run a streaming query with availableNow into parquet and wait for it."""
    use_rocksdb(df.sparkSession)
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(df: DataFrame, out_path: str, ckpt: str, mode: str = "update") -> None:
    """Run a stateful streaming query (update mode) and append each micro-batch's rows."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)
    use_rocksdb(df.sparkSession)
    q = (df.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
