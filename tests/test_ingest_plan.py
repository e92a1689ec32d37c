from logweave.operators.compile import compile_templates
from logweave.operators.mining import list_clusters
from logweave.operators.reports import batch_summary
from logweave.plans.ingest import ingest
from logweave.sources.lines import lines_from_strings

SSH_T = "Accepted <auth_protocol> for <user.name> from <src_endpoint.ip> port <dst_endpoint.port> ssh2"


def test_ingest_dispatch_exact_near_none(spark):
    tpl = spark.createDataFrame([("1", SSH_T, 0)], "cluster_id string, labeled_template string, registry_seq long")
    lines = lines_from_strings(spark, [
        "Accepted password for alice from 192.168.1.10 port 22 ssh2",
        "Accepted password for alice from 192.168.1.10 on port 22 ssh2",
        "service nginx started",
        "service nginx started",
        "service nginx stopped",
    ])
    out = ingest(lines, compile_templates(tpl))
    r = {x.line_id: x for x in out.results.collect()}
    assert r[0].fast_path and r[0].change_type == "NONE" and r[0].template == SSH_T
    # the rule is evaluated on the labeled template, where "<auth_protocol>" hides the
    # "accepted password for" phrase: no class, as in the reference
    assert r[0].ocsf is None and dict(r[0].matched_fields)["user.name"] == "alice"
    assert r[1].near_match and r[1].change_type == "NEAR_MATCH" and r[1].template is None and r[1].cluster_id == "1"
    assert [r[i].change_type for i in (2, 3, 4)] == ["CREATE", "NONE", "UPDATE"]
    assert r[4].template == "service nginx <*>" and r[2].template == "service nginx started"
    assert r[2].ocsf.class_name == "Application Lifecycle" and r[4].ocsf is None  # label of the template as of the line
    assert dict(r[2].extractions) == {}
    assert {x.template for x in out.cluster_templates.collect()} == {"service nginx <*>"}
    assert [x.lines for x in out.cluster_lines.collect()] == [3]


def test_list_clusters_and_batch_summary(spark):
    t = spark.createDataFrame([("a", "x <*> y"), ("b", "")], "cluster_id string, template string")
    assert {r.cluster_id: r.token_count for r in list_clusters(t).collect()} == {"a": 3, "b": 0}
    d = spark.createDataFrame([("b1", "a", "keep"), ("b1", "b", "merge"), ("b2", "c", "keep")],
                              "batch_id string, cluster_id string, decision string")
    s = {r.batch_id: r for r in batch_summary(d).collect()}
    assert s["b1"]["count"] == 2 and s["b1"].decisions == "a:keep,b:merge" and s["b1"].approved is False


def test_match_on_processed_and_label_on_masked(spark):
    tpl = spark.createDataFrame([("db", "DB connection established <*> port <PORT> user <USERNAME> db=production", 0)],
                                "cluster_id string, labeled_template string, registry_seq long")
    lines = lines_from_strings(spark, ["DB connection established host=db-1 port=5432 user=app_user db=production"])
    raw = ingest(lines, compile_templates(tpl), with_extractions=False).results.first()
    assert not raw.fast_path  # port=5432 / user=x are one token in the raw line
    proc = ingest(lines, compile_templates(tpl), match_on="processed", with_extractions=False,
                  label_on="masked").results.first()
    assert proc.fast_path and proc.cluster_id == "db" and dict(proc.matched_fields)["USERNAME"] == "<USERNAME>"
    assert proc.ocsf.class_name == "Datastore Activity"
