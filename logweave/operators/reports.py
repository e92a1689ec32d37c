"""Reports and counters over ingest results.

``ingest_results`` columns used here: ``line_id, cluster_id, template, change_type,
ocsf (label struct or null), fast_path, near_match``. Every report is one grouped
aggregate (partial aggregation map-side, so a hot cluster never lands whole in one task)
or a bounded top-k (``orderBy().limit(k)`` = per-partition top-k then merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("ACTIVE", "PENDING_MERGE", "MERGED", "NEAR_MATCH_REVIEW")

# FIXED VALUES — counter names of the reference's metrics, preset order, then the two
# counters it creates on demand.
COUNTERS = ("logs_ingested", "templates_created", "templates_updated", "templates_merged",
            "templates_split", "llm_calls", "llm_errors", "llm_fallback_keep", "queue_drops",
            "ocsf_matched", "ocsf_unmatched", "fast_path_hits", "near_match_queued")


def _has_cluster(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def upload_report(results: DataFrame) -> DataFrame:
    """A4: total lines, distinct templates, compression %, OCSF matched / unmatched.

    compression_pct = round_half_even((1 - unique/max(total,1)) * 100, 1).
    """
    cid = F.col("cluster_id")
    agg = results.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_distinct(F.when(_has_cluster(cid), cid)).alias("unique_templates"),
        F.count_if(F.col("ocsf").isNotNull()).alias("ocsf_matched"),
        F.count_if(F.col("ocsf").isNull()).alias("ocsf_unmatched"),
    )
    return agg.select(
        "total_logs", "unique_templates",
        F.bround((F.lit(1.0) - F.col("unique_templates") / F.greatest(F.col("total_logs"), F.lit(1)))
                 * F.lit(100.0), 1).alias("compression_pct"),
        "ocsf_matched", "ocsf_unmatched")


def change_type_breakdown(results: DataFrame) -> DataFrame:
    """A5: lines per change type."""
    return results.groupBy("change_type").agg(F.count(F.lit(1)).alias("lines"))


def class_breakdown(results: DataFrame, label_col: str = "ocsf") -> DataFrame:
    """Lines per OCSF class name (labelled lines only)."""
    return (results.where(F.col(label_col).isNotNull() & F.col(f"{label_col}.class_name").isNotNull())
            .groupBy(F.col(f"{label_col}.class_name").alias("ocsf_class"))
            .agg(F.count(F.lit(1)).alias("lines")))


def unmatched_templates(results: DataFrame, k: int = 5) -> DataFrame:
    """Top-k unlabelled clusters by lines, ties by first appearance; template is the
    one seen on the cluster's first line."""
    cid = F.col("cluster_id")
    g = (results.where(F.col("ocsf").isNull() & _has_cluster(cid))
         .groupBy("cluster_id")
         .agg(F.count(F.lit(1)).alias("count"),
              F.min("line_id").alias("first_line_id"),
              F.min_by(F.coalesce(F.col("template"), F.lit("")), F.col("line_id")).alias("template")))
    return g.orderBy(F.desc("count"), F.asc("first_line_id")).limit(k)


def status_counts(templates: DataFrame) -> DataFrame:
    """Templates per status, every status present (zeros included)."""
    spark = templates.sparkSession
    st = spark.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "status string, status_order int")
    counts = templates.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # st has one row per status value (4 rows): broadcast is bounded
    return (F.broadcast(st).join(counts, "status", "left")
            .select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("templates"), "status_order")
            .orderBy("status_order").drop("status_order"))


def coverage(results: DataFrame, label_col: str = "ocsf") -> DataFrame:
    """Matched / total and the integer percentage (floor)."""
    a = results.agg(F.count_if(F.col(label_col).isNotNull()).alias("matched"),
                    F.count(F.lit(1)).alias("total"))
    return a.select("matched", "total",
                    (F.col("total") - F.col("matched")).alias("unmatched"),
                    F.when(F.col("total") > 0, F.floor(F.col("matched") * 100 / F.col("total")))
                    .otherwise(F.lit(0)).cast("bigint").alias("coverage_pct"))


def class_coverage(results: DataFrame, label_col: str = "ocsf") -> DataFrame:
    """A6 + A9 in one table: per class (``<unmatched>`` for no rule) lines and floor % of
    all lines. The per-class aggregate has at most (rules + 1) rows, so the total is a
    window over that bounded result."""
    lab = F.col(label_col)
    g = (results.groupBy(
            F.when(lab.isNull(), F.lit("<unmatched>")).otherwise(lab.class_name).alias("ocsf_class"),
            F.when(lab.isNull(), F.lit("")).otherwise(lab.activity_name).alias("activity"),
            lab.rule_order.cast("bigint").alias("rule_order"))
         .agg(F.count(F.lit(1)).alias("lines")))
    total = F.sum("lines").over(Window.partitionBy(F.lit(0)))
    return g.select("ocsf_class", "activity", "rule_order", "lines",
                    F.floor(F.col("lines") * 100 / total).cast("bigint").alias("pct"))


def _long(agg: DataFrame, names) -> DataFrame:
    """One-row aggregate -> (counter, value) rows."""
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("bigint").alias("value"))
                                          for c in names])).alias("kv")).select("kv.counter", "kv.value")


def pipeline_counters(results: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """A10: counters in long form (counter, value). OCSF counters count only the mining
    path (not fast-path or near-match lines), like the reference. Counters of the outside
    reviewer (calls, errors, fallbacks) and of the unused queue are 0 here."""
    mining = ~F.coalesce(F.col("fast_path"), F.lit(False)) & ~F.coalesce(F.col("near_match"), F.lit(False))
    res_names = ["logs_ingested", "templates_created", "templates_updated", "ocsf_matched", "ocsf_unmatched",
                 "fast_path_hits", "near_match_queued"]
    out = _long(results.agg(
        F.count(F.lit(1)).alias("logs_ingested"),
        F.count_if(F.col("change_type") == "CREATE").alias("templates_created"),
        F.count_if(F.col("change_type") == "UPDATE").alias("templates_updated"),
        F.count_if(mining & F.col("ocsf").isNotNull()).alias("ocsf_matched"),
        F.count_if(mining & F.col("ocsf").isNull()).alias("ocsf_unmatched"),
        F.count_if(F.coalesce(F.col("fast_path"), F.lit(False))).alias("fast_path_hits"),
        F.count_if(F.coalesce(F.col("near_match"), F.lit(False))).alias("near_match_queued"),
    ), res_names)
    dec_names = ["templates_merged", "templates_split"]
    if decisions is not None:
        from logweave.operators.lifecycle import valid_split

        tgt = F.col("merge_into_cluster_id")
        # only merges with a real target and accepted splits count, like the reference
        out = out.unionByName(_long(decisions.agg(
            F.count_if((F.col("decision") == "merge") & tgt.isNotNull() & (tgt != "") & (tgt != F.col("cluster_id")))
            .alias("templates_merged"),
            F.count_if((F.col("decision") == "split") & valid_split(F.col("sub_templates"))).alias("templates_split")),
            dec_names))
    rest = [c for c in COUNTERS if c not in res_names and (decisions is None or c not in dec_names)]
    zeros = results.sparkSession.createDataFrame([(c, 0) for c in rest], "counter string, value bigint")
    return out.unionByName(zeros)


def interval_counters(results: DataFrame, interval: str = "60 seconds", time_col: str = "arrival_ts") -> DataFrame:
    """(interval_start, counter, value): the counters of ``pipeline_counters`` that results
    give, per event-time interval; lines without a time have a null interval."""
    fast, near = F.coalesce(F.col("fast_path"), F.lit(False)), F.coalesce(F.col("near_match"), F.lit(False))
    mining = ~fast & ~near
    sums = {
        "logs_ingested": F.count(F.lit(1)),
        "templates_created": F.count_if(F.col("change_type") == "CREATE"),
        "templates_updated": F.count_if(F.col("change_type") == "UPDATE"),
        "ocsf_matched": F.count_if(mining & F.col("ocsf").isNotNull()),
        "ocsf_unmatched": F.count_if(mining & F.col("ocsf").isNull()),
        "fast_path_hits": F.count_if(fast),
        "near_match_queued": F.count_if(near),
    }
    # two aggregates: `window` drops rows without a time
    at = results.withColumn("interval_start", F.window(F.col(time_col).cast("timestamp"), interval)["start"])
    untimed = results.where(F.col(time_col).isNull()).withColumn("interval_start", F.lit(None).cast("timestamp"))
    by = at.unionByName(untimed).groupBy("interval_start").agg(*(v.alias(k) for k, v in sums.items()))
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("bigint").alias("value")) for c in sums])
    return by.select("interval_start", F.explode(pairs).alias("kv")).select("interval_start", "kv.counter", "kv.value")


def counter_snapshots(counters: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """(interval_start, counter, value) with the running value of all counters at the end
    of every interval from the first to the last one, also of those without lines. Counters of
    the reviewer's side stay 0 here."""
    timed = counters.where("interval_start is not null")
    sums = timed.groupBy("interval_start", "counter").agg(F.sum("value").alias("value"))
    # one row per interval
    span = timed.agg(F.min("interval_start").alias("a"), F.max("interval_start").alias("b")).where("a is not null")
    spine = span.select(F.explode(F.expr(f"sequence(a, b, interval {interval})")).alias("interval_start"))
    every = spine.select("interval_start", F.explode(F.lit(list(COUNTERS))).alias("counter"))
    w = Window.partitionBy("counter").orderBy("interval_start")
    return (every.join(sums, ["interval_start", "counter"], "left")
            .withColumn("value", F.sum(F.coalesce("value", F.lit(0))).over(w).cast("bigint")).select("interval_start", "counter", "value"))


def cluster_sizes(results: DataFrame) -> DataFrame:
    """Lines seen per cluster (reservoir counts): exact and mining paths."""
    return (results.where(_has_cluster(F.col("cluster_id")) & ~F.coalesce(F.col("near_match"), F.lit(False)))
            .groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")))


def remine_stats(results: DataFrame) -> DataFrame:
    """Lines re-mined, creates, updates."""
    return results.agg(F.count(F.lit(1)).alias("logs_reparsed"),
                       F.count_if(F.col("change_type") == "CREATE").alias("new_creates"),
                       F.count_if(F.col("change_type") == "UPDATE").alias("new_updates"))


def batch_summary(decisions: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """Per batch the decision count, approved flag and the cluster ids decided.
    Cluster ids are sorted; a batch is one review round (bounded by the templates sent)."""
    g = decisions.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "cluster_id", "decision"))), ",").alias("decisions"))
    if approved is None:
        return g.withColumn("approved", F.lit(False))
    return g.join(approved.select("batch_id", "approved"), "batch_id", "left").withColumn(
        "approved", F.coalesce("approved", F.lit(False)))


def page(records: DataFrame, n: int = 100, offset: int = 0, order_col: str = "line_id") -> DataFrame:
    """T4: newest-first paging, ascending inside the page. n in 1..1000, offset >= 0.
    Top-(offset+n) per partition then merge; never a global sort of all rows."""
    n = min(max(int(n), 1), 1000)
    offset = max(int(offset), 0)
    newest = records.orderBy(F.desc(order_col)).limit(offset + n)
    return newest.orderBy(F.desc(order_col)).offset(offset).orderBy(F.asc(order_col))


def page_total(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"))


def tail(records: DataFrame, n: int = 30, order_col: str = "line_id") -> DataFrame:
    """T5: last n records (n capped at 100), oldest first."""
    n = min(int(n), 100)
    return records.orderBy(F.desc(order_col)).limit(max(n, 0)).orderBy(order_col)


def latest_n(records: DataFrame, n: int = 10_000, order_col: str = "line_id") -> DataFrame:
    """Newest n records (bounded window of recent parsed records)."""
    return records.orderBy(F.desc(order_col)).limit(n)


def bounded_queue(items: DataFrame, maxsize: int = 500, order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Newest ``maxsize`` items kept, plus (queued, dropped) counts."""
    kept = items.orderBy(F.desc(order_col)).limit(maxsize).orderBy(order_col)
    stats = items.agg(F.count(F.lit(1)).alias("n")).select(
        F.least(F.col("n"), F.lit(maxsize)).cast("bigint").alias("queued"),
        F.greatest(F.col("n") - F.lit(maxsize), F.lit(0)).cast("bigint").alias("dropped"))
    return kept, stats
