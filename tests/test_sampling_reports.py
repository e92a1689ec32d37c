from pyspark.sql import functions as F

from logweave.operators import reports as R
from logweave.operators.sampling import request_chunks, reservoir_sample, split_round_robin


def test_reservoir_keeps_all_when_small_and_k_when_large(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("line_id"), (F.col("id") % 3).alias("cluster_id"),
                                     F.col("id").cast("string").alias("line"))
    s = reservoir_sample(df.where("line_id < 6"), k=10)
    assert s.count() == 6
    s = reservoir_sample(df, k=10)
    counts = {r.cluster_id: r["count"] for r in s.groupBy("cluster_id").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 10}
    slots = sorted(r.slot for r in s.where("cluster_id = 0").collect())
    assert slots == list(range(1, 11))


def test_reservoir_uniform(spark):
    # k/N survival per item (reference model: Algorithm R keeps each item with prob k/N)
    n, k, seeds = 100, 10, 300
    df = spark.range(0, n).select(F.col("id").alias("line_id"), F.lit(0).alias("cluster_id"))
    hits = [0] * n
    for s in range(seeds):
        for r in reservoir_sample(df, k=k, seed=f"s{s}").select("line_id").collect():
            hits[r.line_id] += 1
    assert abs(sum(hits) / (n * seeds) - k / n) < 1e-9
    assert all(abs(h / seeds - k / n) < 0.07 for h in hits)


def test_split_round_robin(spark):
    df = spark.createDataFrame([(i + 1, f"s{i}") for i in range(5)], "slot int, line string")
    got = {}
    for r in split_round_robin(df, 2).collect():
        got.setdefault(r.sub_index, []).append(r.line)
    assert sorted(got[0]) == ["s0", "s2", "s4"] and sorted(got[1]) == ["s1", "s3"]


def test_request_chunks_size(spark):
    df = spark.range(0, 20).select(F.col("id").cast("string").alias("cluster_id"))
    c = request_chunks(df, 3, buckets=2)
    assert max(r["count"] for r in c.groupBy("chunk_id").count().collect()) <= 3


def _results(spark, rows):
    return spark.createDataFrame(rows, "line_id long, cluster_id string, template string, change_type string, "
                                       "has_label boolean, fast_path boolean, near_match boolean").select(
        "*", F.when(F.col("has_label"), F.struct(F.lit("X").alias("class_name"))).alias("ocsf"))


def test_upload_report_rounding_half_even(spark):
    # (1 - 1/8) * 100 = 87.5 exactly; 3/16 -> 81.25 -> 81.2 (half even, like Python's round)
    rows = [(i, "c" if i < 7 else "d", "t", "NONE", i % 2 == 0, False, False) for i in range(8)]
    rep = R.upload_report(_results(spark, rows)).first()
    assert rep.total_logs == 8 and rep.unique_templates == 2 and rep.compression_pct == 75.0
    rows = [(i, str(i % 3), "t", "NONE", False, False, False) for i in range(16)]
    assert R.upload_report(_results(spark, rows)).first().compression_pct == round((1 - 3 / 16) * 100, 1)


def test_status_counts_include_zeros(spark):
    t = spark.createDataFrame([("a", "ACTIVE"), ("b", "ACTIVE"), ("c", "PENDING_MERGE")], "cluster_id string, status string")
    got = {r.status: r.templates for r in R.status_counts(t).collect()}
    assert got == {"ACTIVE": 2, "PENDING_MERGE": 1, "MERGED": 0, "NEAR_MATCH_REVIEW": 0}


def test_page_and_tail(spark):
    df = spark.range(0, 25).select(F.col("id").alias("line_id"))
    assert [r.line_id for r in R.page(df, 10, 0).collect()] == list(range(15, 25))
    assert [r.line_id for r in R.page(df, 10, 20).collect()] == list(range(0, 5))
    assert [r.line_id for r in R.tail(df, 3).collect()] == [22, 23, 24]
    kept, stats = R.bounded_queue(df.withColumnRenamed("line_id", "seq"), 3)
    assert [r.seq for r in kept.collect()] == [22, 23, 24] and stats.first().dropped == 22


def test_counters_count_only_valid_merges_and_splits(spark):
    res = spark.createDataFrame([(1, "c", "t", "CREATE", True, False, False)],
                                "line_id long, cluster_id string, template string, change_type string, has_label boolean, "
                                "fast_path boolean, near_match boolean").select(
        "*", F.when(F.col("has_label"), F.struct(F.lit("X").alias("class_name"))).alias("ocsf"))
    dec = spark.createDataFrame([
        ("a", "merge", "b", None), ("a", "merge", "a", None), ("a", "split", None, ["x", "y"]), ("a", "split", None, ["x"]),
    ], "cluster_id string, decision string, merge_into_cluster_id string, sub_templates array<string>")
    got = {r.counter: r.value for r in R.pipeline_counters(res, dec).collect()}
    assert got["templates_merged"] == 1 and got["templates_split"] == 1 and got["templates_created"] == 1
    assert got["ocsf_matched"] == 1 and got["logs_ingested"] == 1
