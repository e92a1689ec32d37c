"""The near-match queue as a query: every step's rows, up to the lines mined again."""

from pyspark.sql import functions as F


def _events(spark, path, n=700):
    ev = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("a").alias("event_type"))
    # two rows of one id: two lines, one item id
    ev.unionByName(ev.where("event_id = 8")).write.parquet(f"{path}/events.parquet")
    return n + 1


def test_lines_sent_back_are_mined_registered_and_sampled(spark, tmp_path, monkeypatch):
    from logweave.operators import review
    from logweave.plans import catalog

    n, texts, real = _events(spark, str(tmp_path)), [], review.near_match_review_requests
    monkeypatch.setattr(review, "near_match_review_requests", lambda ctx: (texts.append(real(ctx)), real(ctx))[1])
    rows = catalog.QUERIES["near_match_queue_events"](spark, str(tmp_path)).collect()
    assert sum(r.lines for r in rows) == n
    near = [r for r in rows if r.match_kind == "NEAR"]
    assert len(near) > 1 and {r.match_kind for r in rows if r.candidate_cluster_id is None} == {"EXACT", "NONE"}
    for r in near:
        assert r.lines == r.items == r.sent_to_mining == r.requests == r.created + r.updated + r.unchanged
        assert r.templates >= 1 and 0 < r.sampled <= r.lines
    got = texts[0].collect()
    assert len(got) == sum(r.items for r in near) and all("    sample: " in r.request for r in got)


def test_a_line_sent_back_may_make_a_template(spark, sf):
    from logweave.operators.lifecycle import (add_templates, complete_near_match_decisions, near_match_enqueue, near_match_resolve,
                                              new_templates_from_results)
    from logweave.plans.ingest import ingest

    res = spark.createDataFrame([(1, "job a done now", "c1", 0.9, True), (1, "job b done now", "c1", 0.9, True), (2, "other words entirely", "c1", 0.9, True), (3, "x", None, None, False)],
                                "line_id long, line string, cluster_id string, similarity double, near_match boolean").withColumn("arrival_ts", F.current_timestamp())
    items = near_match_enqueue(res)
    none = spark.createDataFrame([], "item_id string, decision string, corrected_template string, reasoning string")
    dec = complete_near_match_decisions(items, none)
    assert dec.count() == 2
    t = spark.createDataFrame([("c1", "job <*> done now")], "cluster_id string, pattern string").select(
        "cluster_id", "pattern", F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("merge_target_id"), F.lit(0).alias("confirmation_count"),
        F.current_timestamp().alias("created_at"), *[F.lit(None).cast("string").alias(c) for c in ("labeled_template", "decision", "reasoning")])
    out = near_match_resolve(items, dec, t)
    assert out["items"].count() == 3
    again = ingest(out["remine_lines"], seeds=t.select("cluster_id", F.col("pattern").alias("template")), with_extractions=False).results
    assert {(r.line, r.candidate_cluster_id, r.change_type) for r in again.collect()} == {
        ("job a done now", "c1", "NONE"), ("job b done now", "c1", "NONE"), ("other words entirely", "c1", "CREATE")}
    known = add_templates(out["templates"], new_templates_from_results(again))
    assert {r.pattern for r in known.collect()} == {"job <*> done now", "other words entirely"}
