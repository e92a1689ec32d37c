"""Streams whose state starts from tables: mining, merge confirmation, ingest."""
import tempfile

import pytest
from pyspark.sql import functions as F

from logweave.functions.masks import mask_only
from logweave.operators.lifecycle import confirm_merges
from logweave.operators.mining import change_points, mine_templates
from logweave.plans.ingest import ingest
from logweave.sources.tables import event_log_lines
from logweave.streaming.ingest import LINE_SCHEMA, run_to_completion
from logweave.streaming.stateful import cluster_table, clusters_in_state, confirm_stream, mine_stream


def as_stream(spark, df, parts, order="line_id"):
    """``df`` in ``parts`` files, written in order: one micro-batch each."""
    d = tempfile.mkdtemp(prefix="lw-stateful-")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{d}/in/part{i}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    return src, d


def test_stream_goes_on_where_a_batch_stopped(spark, sf):
    lines = event_log_lines(spark, sf).select(*LINE_SCHEMA.fieldNames())
    masked = mask_only(lines).select("line_id", "line", "processed")
    whole = {r.line_id: r for r in ingest(lines, with_extractions=False).results.collect()}
    cut = 400
    half = mine_templates(masked.where(F.col("line_id") < cut))
    _, vers = change_points(half)
    clusters = cluster_table(half, vers)
    src, d = as_stream(spark, masked.where(F.col("line_id") >= cut), 4)
    run_to_completion(mine_stream(src, clusters=clusters), f"{d}/out", f"{d}/ckpt")
    got = {r.line_id: r for r in spark.read.parquet(f"{d}/out").collect()}
    assert set(got) == {i for i in whole if i >= cut}
    for i, r in got.items():
        assert (r.cluster_id, r.change_type, r.template) == (whole[i].cluster_id, whole[i].change_type, whole[i].template)
    state = {r.cluster_id: r.template for r in clusters_in_state(spark, f"{d}/ckpt").collect()}
    last = {r.cluster_id: r.template for r in ingest(lines, with_extractions=False).cluster_templates.collect()}
    assert state == last


@pytest.mark.parametrize("threshold", [1, 7, 30])
def test_merges_are_confirmed_over_micro_batches(spark, threshold):
    ts = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    results = spark.range(80).select(
        F.col("id").alias("line_id"), ts(F.col("id")).alias("arrival_ts"),
        F.when(F.col("id") % 2 == 0, "t1").when(F.col("id") % 4 == 1, "t2").otherwise("other").alias("cluster_id"),
        F.when(F.col("id") % 10 == 4, "UPDATE").otherwise("NONE").alias("change_type"),
        (F.col("id") % 6 == 0).alias("fast_path"), F.lit(None).cast("boolean").alias("near_match"))
    pending = spark.createDataFrame([("a", "t1", 0, 1_700_000_000), ("b", "t1", 3, 1_700_000_030), ("c", "t2", 0, None), ("d", "none", 99, 0)],
                                    "cluster_id string, merge_target_id string, confirmation_count int, s long").withColumn("staged_at", F.timestamp_seconds("s")).drop("s")
    src, d = as_stream(spark, results, 5)
    run_to_completion(confirm_stream(src, pending, threshold), f"{d}/out", f"{d}/ckpt")
    got = sorted(tuple(r) for r in spark.read.schema("cluster_id string, merge_target_id string, confirmations int, confirmed_by long").parquet(f"{d}/out").collect())
    want = []
    rows = results.orderBy("line_id").collect()
    for c, t, n, s in (("a", "t1", 0, 0), ("b", "t1", 3, 30), ("c", "t2", 0, -1)):
        hits = [r.line_id for r in rows if r.cluster_id == t and r.change_type == "NONE" and not r.fast_path and r.line_id > s]
        if n + len(hits) >= threshold:
            want.append((c, t, threshold, hits[max(threshold - n, 1) - 1]))
    assert got == want
    # the batch form with staging times deletes the same templates
    t = pending.select("cluster_id", F.lit("p").alias("pattern"), F.lit("PENDING_MERGE").alias("status"), "merge_target_id", "confirmation_count",
                       F.current_timestamp().alias("created_at"), *(F.lit(None).cast("string").alias(c) for c in ("labeled_template", "decision", "reasoning")), "staged_at")
    left = {r.cluster_id for r in confirm_merges(t, results, threshold).collect()}
    assert {"a", "b", "c", "d"} - left == {w[0] for w in want}


def _templates(spark, rows):
    none = F.lit(None).cast("string")
    return spark.createDataFrame(rows, "cluster_id string, labeled_template string").select(
        "cluster_id", F.col("labeled_template").alias("pattern"), F.lit("ACTIVE").alias("status"), none.alias("merge_target_id"), F.lit(0).alias("confirmation_count"),
        F.current_timestamp().alias("created_at"), "labeled_template", F.lit("keep").alias("decision"), none.alias("reasoning"))


def test_stream_ingest_reads_new_snapshots_and_replays_alike(spark):
    """A template approved between two micro-batches is matched in the second; a replayed
    micro-batch leaves the tables as they were; counters cover empty intervals."""
    from logweave.operators.reports import COUNTERS, counter_snapshots
    from logweave.sources.state import save_state
    from logweave.streaming.ingest import clusters_before, stream_ingest

    texts = ["job alpha 1 done", "job alpha 2 done", "disk full on node 4", "job alpha 3 done", "job beta 9 done", "disk full on node 5"]
    lines = spark.createDataFrame([(i, 1_700_000_000 + 60 * (i if i < 3 else i + 4), "s", t) for i, t in enumerate(texts)], "line_id long, t long, source string, line string")
    lines = lines.select("line_id", F.timestamp_seconds("t").alias("arrival_ts"), "source", "line")
    _, d = as_stream(spark, lines, 2)
    run = lambda: stream_ingest(src, f"{d}/out", f"{d}/ckpt", state_root=f"{d}/state", trigger={"processingTime": "0 seconds"})
    import shutil

    shutil.copytree(f"{d}/in/part0", f"{d}/live/part0")
    src = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{d}/live")
    run().processAllAvailable()
    [q.stop() for q in spark.streams.active]
    assert save_state(spark, f"{d}/state", {"templates": _templates(spark, [("reg", "job <app.name> <count> done")])})
    shutil.copytree(f"{d}/in/part1", f"{d}/live/part1")
    q = run()
    q.processAllAvailable()
    q.stop()
    got = {r.line_id: r for r in spark.read.parquet(f"{d}/out").collect()}
    assert [got[i].fast_path for i in range(6)] == [False, False, False, True, True, False]
    assert dict(got[4].matched_fields) == {"app.name": "beta", "count": "9"} and got[3].cluster_id == "reg"
    assert got[5].cluster_id == got[2].cluster_id and got[5].change_type in ("NONE", "UPDATE") and got[5].template.startswith("disk full on node")
    assert got[0].extractions is not None and got[0].arrival_ts is not None
    # the last micro-batch again: its commit is lost, as after a failure
    import os

    commits = sorted(f for f in os.listdir(f"{d}/ckpt/commits") if f.isdigit())
    for f in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{d}/ckpt/commits/{f}")
    clusters = sorted(tuple(r) for r in clusters_before(spark, f"{d}/out-clusters").collect())
    q = run()
    q.processAllAvailable()
    q.stop()
    again = {r.line_id: r for r in spark.read.parquet(f"{d}/out").collect()}
    assert again == got and sorted(tuple(r) for r in clusters_before(spark, f"{d}/out-clusters").collect()) == clusters
    snaps = counter_snapshots(spark.read.parquet(f"{d}/out-counters")).collect()
    assert len(snaps) == 10 * len(COUNTERS)         # minutes 0 to 9, four of them without a line
    last = {r.counter: r.value for r in snaps if r.interval_start == max(x.interval_start for x in snaps)}
    assert (last["logs_ingested"], last["fast_path_hits"], last["llm_calls"]) == (6, 2, 0)
    flat = [r.value for r in sorted(snaps, key=lambda r: r.interval_start) if r.counter == "logs_ingested"]
    assert flat == [1, 2, 3, 3, 3, 3, 3, 4, 5, 6]
