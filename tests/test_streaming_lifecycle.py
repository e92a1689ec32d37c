import os
import tempfile

from pyspark.sql import functions as F

from logweave.functions.masks import mask_only
from logweave.operators.lifecycle import (add_templates, apply_decisions, complete_near_match_decisions,
                                          confirm_merges, near_match_enqueue,
                                          near_match_resolve, read_decisions, rollback_merge)
from logweave.plans.ingest import ingest
from logweave.sources.lines import read_log_lines
from logweave.sources.state import load_state, save_state, state_exists
from logweave.sources.tables import event_log_lines
from logweave.streaming.ingest import LINE_SCHEMA, inflight_dedup, queue_latest, run_to_completion
from logweave.streaming.stateful import mine_stream


def test_stream_mining_equals_batch_across_microbatches(spark, sf):
    lines = event_log_lines(spark, sf)
    d = tempfile.mkdtemp(prefix="lw-stream-")
    rows = lines.orderBy("line_id").collect()
    chunk = len(rows) // 4 + 1
    for i in range(4):  # four files in arrival order -> four micro-batches
        part = rows[i * chunk:(i + 1) * chunk]
        spark.createDataFrame(part, LINE_SCHEMA).coalesce(1).write.parquet(f"{d}/in/part{i}")
    src = (spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{d}/in"))
    run_to_completion(mine_stream(mask_only(src)), f"{d}/out", f"{d}/ckpt")
    s = {r.line_id: r for r in spark.read.parquet(f"{d}/out").collect()}
    b = {r.line_id: r for r in ingest(lines, with_extractions=False).results.collect()}
    assert len(s) == len(b) == len(rows)
    for lid, r in b.items():
        assert s[lid].cluster_id == r.cluster_id and s[lid].change_type == r.change_type
        assert s[lid].template == r.template


def test_dedup_and_queue_latest(spark):
    d = tempfile.mkdtemp(prefix="lw-dedup-")
    df = spark.createDataFrame([("t1", 0), ("t1", 5), ("t2", 6)], "template string, s int").select(
        "template", F.timestamp_seconds("s").alias("arrival_ts"))
    df.coalesce(1).write.parquet(f"{d}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{d}/in")
    run_to_completion(inflight_dedup(src), f"{d}/out", f"{d}/ckpt")
    assert sorted(r.template for r in spark.read.parquet(f"{d}/out").collect()) == ["t1", "t2"]
    log = spark.createDataFrame([("a", "pending", 1), ("a", "approved", 2), ("b", "pending", 1)], "item_id string, status string, ts int")
    assert {r.item_id: r.status for r in queue_latest(log).collect()} == {"a": "approved", "b": "pending"}


def _tpl(spark, rows):
    return spark.createDataFrame(rows, "cluster_id string, pattern string").select(
        "cluster_id", "pattern", F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("merge_target_id"),
        F.lit(0).alias("confirmation_count"), F.current_timestamp().alias("created_at"),
        F.lit(None).cast("string").alias("labeled_template"), F.lit(None).cast("string").alias("decision"),
        F.lit(None).cast("string").alias("reasoning"))


def test_split_merge_threshold_rollback(spark):
    t = _tpl(spark, [("5", "a <*> c"), ("6", "x y"), ("7", "q <*>")])
    dec = spark.createDataFrame([
        ("b", "5", "split", None, None, ["a b c", "a d c"], None, None, "r"),
        ("b", "6", "merge", "7", "q <*>", None, None, None, "r"),
        ("b", "9", "keep", None, None, None, None, None, "unknown id"),
    ], "batch_id string, cluster_id string, decision string, merge_into_cluster_id string, merged_template string, "
       "sub_templates array<string>, reset_template string, labeled_template string, reasoning string")
    out = apply_decisions(t, dec)
    got = {r.cluster_id: r for r in out["templates"].collect()}
    assert set(got) == {"6", "7", "split_5_0", "split_5_1"}
    assert got["6"].status == "PENDING_MERGE" and got["6"].merge_target_id == "7"
    assert got["split_5_1"].pattern == "a d c"
    # a split needs two non-blank sub-templates
    bad = spark.createDataFrame([("b", "5", "split", None, None, ["a b c", "  "], None, None, "r")], dec.schema)
    assert {r.cluster_id for r in apply_decisions(t, bad)["templates"].collect()} == {"5", "6", "7"}
    # merge confirmation: deleted at the third hit
    res = spark.createDataFrame([(i, "7", "NONE", False, False) for i in range(3)],
                                "line_id long, cluster_id string, change_type string, fast_path boolean, near_match boolean")
    assert "6" not in {r.cluster_id for r in confirm_merges(out["templates"], res, 3).collect()}
    assert "6" in {r.cluster_id for r in confirm_merges(out["templates"], res.limit(2), 3).collect()}
    rb = {r.cluster_id: r for r in rollback_merge(out["templates"], spark.createDataFrame([("6",)], "cluster_id string")).collect()}
    assert rb["6"].status == "ACTIVE" and rb["6"].merge_target_id is None
    # register is a no-op for an existing id
    again = add_templates(out["templates"], _tpl(spark, [("7", "different")]))
    assert {r.pattern for r in again.where("cluster_id = '7'").collect()} == {"q <*>"}


def test_read_decisions_fences_and_garbage(spark):
    raw = spark.createDataFrame([
        ("b1", '```json\n{"templates": [{"cluster_id": "1", "decision": "keep"}]}\n```'),
        ("b2", "not json at all"),
    ], "batch_id string, response string")
    got = read_decisions(raw).collect()
    assert [(r.batch_id, r.cluster_id, r.decision) for r in got] == [("b1", "1", "keep")]


def test_near_match_queue(spark):
    res = spark.createDataFrame([(1, "line one", "c1", 0.9, True), (2, "line two", "c1", 0.95, True), (3, "x", None, None, False)],
                                "line_id long, line string, cluster_id string, similarity double, near_match boolean") \
        .withColumn("arrival_ts", F.current_timestamp())
    items = near_match_enqueue(res)
    assert items.count() == 2
    ids = [r.item_id for r in items.orderBy("line_id").collect()]
    dec = spark.createDataFrame([(ids[0], "same_template_fix_regex", "line <unknown>", "r")],
                                "item_id string, decision string, corrected_template string, reasoning string")
    full = complete_near_match_decisions(items, dec)
    assert {r.item_id: r.decision for r in full.collect()}[ids[1]] == "new_template_send_to_drain"
    t = _tpl(spark, [("c1", "line <*>")])
    out = near_match_resolve(items, full, t)
    assert out["templates"].first().labeled_template == "line <unknown>"
    assert [r.line_id for r in out["remine_lines"].collect()] == [2]
    assert {r.status for r in out["items"].collect()} == {"approved", "rejected"}


def test_state_roundtrip_and_failures(spark):
    root = tempfile.mkdtemp(prefix="lw-state-")
    assert not state_exists(spark, root) and load_state(spark, root) is None
    t = _tpl(spark, [("1", "a <*>")])
    assert save_state(spark, root, {"templates": t})
    assert state_exists(spark, root)
    back = load_state(spark, root)["templates"]
    assert [r.pattern for r in back.collect()] == ["a <*>"]


def test_read_log_lines_ids_follow_file_order(spark):
    d = tempfile.mkdtemp(prefix="lw-text-")
    with open(os.path.join(d, "a.log"), "w") as fh:
        fh.write("first\n\n  \nsecond\nthird\n")
    with open(os.path.join(d, "b.log"), "w") as fh:
        fh.write("fourth\n")
    rows = read_log_lines(spark, d).orderBy("line_id").collect()
    assert [r.line for r in rows] == ["first", "second", "third", "fourth"]
    assert len({r.line_id for r in rows}) == 4


def test_restart_from_snapshot(spark):
    from logweave.plans.review_cycle import restart

    root = tempfile.mkdtemp(prefix="lw-restart-")
    t = _tpl(spark, [("c1", "service nginx <*>"), ("c2", "DB query executed <*>")]).withColumn(
        "decision", F.when(F.col("cluster_id") == "c1", F.lit("keep"))).withColumn(
        "labeled_template", F.when(F.col("cluster_id") == "c1", F.lit("service nginx <unknown>")))
    samples = spark.createDataFrame([("c1", 1, 10, "service nginx started"), ("c2", 1, 11, "DB query executed x")],
                                    "cluster_id string, slot int, line_id long, line string")
    assert save_state(spark, root, {"templates": t, "samples": samples})
    st = restart(spark, root)
    assert [r.cluster_id for r in st["compiled"].collect()] == ["c1"]      # reviewed + labelled only
    parsed = st["parsed"].collect()
    # the rule runs on the labeled template ("service nginx <unknown>": no class -> fallback),
    # the service name comes straight from the raw line
    assert [(r.cluster_id, r.ocsf_class, r.service) for r in parsed] == [("c1", "Unknown", "nginx")]
    assert restart(spark, tempfile.mkdtemp(prefix="lw-empty-")) is None


def test_restart_compiles_what_approve_compiled(spark):
    """A reset template is compiled on its reset text before and after a restart."""
    from logweave.plans.review_cycle import approve, restart, snapshot

    root = tempfile.mkdtemp(prefix="lw-approve-")
    t = _tpl(spark, [("c1", "a <*> b"), ("c2", "x <*>"), ("c3", "y <*>")])
    results = spark.createDataFrame([(1, "a 1 b", "c1", "a <*> b", "CREATE")], "line_id long, line string, cluster_id string, template string, change_type string") \
        .withColumn("arrival_ts", F.current_timestamp())
    samples = spark.createDataFrame([("c1", 1, 1, "a 1 b")], "cluster_id string, slot int, line_id long, line string")

    def review(requests):
        cols = "batch_id string, cluster_id string, decision string, merge_into_cluster_id string, merged_template string, sub_templates array<string>, reset_template string, labeled_template string, reasoning string"
        return spark.createDataFrame([("b", "c1", "reset", None, None, None, "a <*> <*>", "a <unknown> b", "r"), ("b", "c2", "keep", None, None, None, None, "x <count>", "r")], cols)

    requests = t.where("cluster_id <> 'c3'").select(F.lit("b").alias("batch_id"), "cluster_id", F.col("pattern").alias("template"))
    done = approve(results, t, requests, review_fn=review, samples=samples)
    before = {r.cluster_id: r.labeled_template for r in done["compiled"].collect()}
    versions = spark.createDataFrame([], "cluster_id string, version int, template string, trigger_line_id long")
    assert snapshot(spark, root, done["templates"], versions, samples, samples.groupBy("cluster_id").count())
    after = {r.cluster_id: r.labeled_template for r in restart(spark, root)["compiled"].collect()}
    assert before == after == {"c1": "a <*> <*>", "c2": "x <count>"}
