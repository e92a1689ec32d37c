import difflib
import json
import os
import tempfile

from pyspark.sql import functions as F

from logweave.operators.parse import events_view, flatten_event, template_history, template_samples
from logweave.operators.reports import pipeline_counters
from logweave.operators.review import candidate_templates
from logweave.sources.lines import lines_from_strings
from logweave.sources.sinks import results_preview, write_metrics_jsonl, write_parsed_events, write_results
from logweave.sources.tables import event_log_lines
from logweave.streaming.ingest import LINE_SCHEMA, stream_ingest, stream_merge_hits


def test_candidates_equal_brute_force(spark):
    pats = ["Accepted password for <*> from <*>", "Accepted publickey for <*> from <*>", "service nginx stopped",
            "service nginx started", "DB query executed <*>", "completely different text here", "x"]
    t = spark.createDataFrame([(str(i), p) for i, p in enumerate(pats)], "cluster_id string, pattern string")
    got = {(r.new_id, r.cluster_id): r.similarity for r in candidate_templates(t, t).collect()}
    want = {}
    for i, a in enumerate(pats):
        scored = sorted(((difflib.SequenceMatcher(None, a, b).ratio(), str(j)) for j, b in enumerate(pats)
                         if j != i and difflib.SequenceMatcher(None, a, b).ratio() > 0.5), key=lambda x: (-x[0], x[1]))
        for r, j in scored[:5]:
            want[(str(i), j)] = round(r, 4)
    assert got == want


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="lw-sinks-")
    res = spark.createDataFrame([(i, "x" * 200, "c", "NONE", False, False) for i in range(5)],
                                "line_id long, line string, cluster_id string, change_type string, fast_path boolean, near_match boolean") \
        .withColumn("ocsf", F.lit(None).cast("struct<class_name:string>"))
    write_results(res, f"{d}/r", preview_rows=3)
    prev = spark.read.parquet(f"{d}/r/preview").orderBy("line_id").collect()
    assert [r.line_id for r in prev] == [0, 1, 2] and all(len(r.line) == 120 for r in prev)
    assert spark.read.parquet(f"{d}/r/results").count() == 5
    write_metrics_jsonl(pipeline_counters(res), f"{d}/m")
    write_metrics_jsonl(pipeline_counters(res), f"{d}/m")
    lines = [json.loads(x.value) for x in spark.read.text(f"{d}/m").collect()]
    assert len(lines) == 2 and lines[0]["logs_ingested"] == 5 and "timestamp" in lines[0]
    parsed = flatten_event(lines_from_strings(spark, ["service nginx started"]).withColumn(
        "template", F.lit("service nginx started")).withColumn("cluster_id", F.lit("c")))
    write_parsed_events(parsed, f"{d}/p")
    assert os.path.isdir(f"{d}/p/ocsf_class=Application Lifecycle")
    ev = events_view(parsed).first()
    assert ev.class_name == "Application Lifecycle" and ev.user is None
    assert results_preview(res, 2).count() == 2


def test_samples_and_history(spark):
    s = spark.createDataFrame([("c", i, f"l{i}") for i in range(1, 9)], "cluster_id string, slot int, line string")
    assert [r.slot for r in template_samples(s, "c").collect()] == [1, 2, 3, 4, 5]
    v = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("d", 1, "z")], "cluster_id string, version int, template string")
    assert [r.template for r in template_history(v, "c").collect()] == ["a", "b"]


def test_stream_ingest_hot_reload(spark, sf):
    d = tempfile.mkdtemp(prefix="lw-sing-")
    lines = event_log_lines(spark, sf)
    lines.select([f.name for f in LINE_SCHEMA]).withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp")) \
        .coalesce(1).write.parquet(f"{d}/in")
    rules = os.path.join(d, "rules.yml")
    with open(rules, "w") as fh:
        fh.write('rules:\n  - pattern: "service"\n    ocsf_class_uid: 1\n    ocsf_class_name: "Svc"\n'
                 '    activity_id: 1\n    activity_name: "A"\n    severity_id: 1\n    category_uid: 1\n    category_name: "C"\n')
    src = spark.readStream.schema(LINE_SCHEMA).parquet(f"{d}/in")
    q = stream_ingest(src, f"{d}/out", f"{d}/ckpt", rules_path=rules)
    q.awaitTermination()
    out = spark.read.parquet(f"{d}/out")
    assert out.count() == lines.count()
    classes = {r.c for r in out.select(F.col("ocsf.class_name").alias("c")).distinct().collect()}
    assert classes == {"Svc", None}  # the rule file read at the micro-batch, not the defaults
    hits = stream_merge_hits(out)  # batch form over the stream's output
    assert hits.agg(F.sum("hits")).first()[0] == out.where("change_type = 'NONE'").count()


def test_stream_ingest_fast_path_skips_mining(spark):
    from logweave.operators.compile import compile_templates
    from logweave.sources.lines import lines_from_strings

    d = tempfile.mkdtemp(prefix="lw-sfp-")
    src_rows = lines_from_strings(spark, [
        "Accepted password for alice from 10.0.0.1 port 22 ssh2",
        "service nginx started",
        "Accepted password for bob from 10.0.0.2 port 22 ssh2",
        "service nginx stopped",
    ]).withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp"))
    src_rows.coalesce(1).write.parquet(f"{d}/in")
    tpl = spark.createDataFrame([("ssh", "Accepted <auth_protocol> for <user.name> from <src_endpoint.ip> port <p> ssh2", 0)],
                                "cluster_id string, labeled_template string, registry_seq long")
    src = spark.readStream.schema(LINE_SCHEMA).parquet(f"{d}/in")
    stream_ingest(src, f"{d}/out", f"{d}/ckpt", compiled=compile_templates(tpl)).awaitTermination()
    got = {r.line_id: r for r in spark.read.parquet(f"{d}/out").collect()}
    assert got[0].fast_path and got[2].fast_path and got[0].cluster_id == "ssh" and got[0].change_type == "NONE"
    assert [got[i].change_type for i in (1, 3)] == ["CREATE", "UPDATE"] and got[3].template == "service nginx <*>"
    assert got[1].ocsf.class_name == "Application Lifecycle"


def test_merge_hits_leave_out_fast_path_lines(spark):
    rows = spark.createDataFrame([("c", "NONE", False, False), ("c", "NONE", True, False), ("c", "NONE", None, True), ("c", "NEW", False, False)],
                                 "cluster_id string, change_type string, fast_path boolean, near_match boolean")
    assert [tuple(r) for r in stream_merge_hits(rows).collect()] == [("c", 1)]


def test_registry_after_reset_and_refusals(spark):
    from logweave.operators.compile import matchable_templates

    rows = spark.createDataFrame(
        [("r", "a <*> <*>", "a <unknown> b", "reset", 1), ("m", "x <*>", "x <n>", "merge", 2), ("s", "y <*>", "y <n>", "split", 3), ("k", "z <*>", "z <n>", "keep", 4)],
        "cluster_id string, pattern string, labeled_template string, decision string, registry_seq long").selectExpr(
        "*", "'ACTIVE' as status", "timestamp'2024-01-01 00:00:00' as created_at")
    got = {r.cluster_id: r["__text"] if "__text" in r.asDict() else None for r in matchable_templates(rows, fallback_to_pattern=True).collect()}
    assert set(got) == {"r", "k"}
