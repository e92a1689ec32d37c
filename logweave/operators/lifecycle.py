"""Template life cycle as table -> table operators.

Tables
------
templates(cluster_id, pattern, status, merge_target_id, confirmation_count, created_at,
          labeled_template, decision, reasoning)
decisions(batch_id, cluster_id, decision, merge_into_cluster_id, merged_template,
          sub_templates ARRAY<STRING>, reset_template, labeled_template, reasoning)
near_match_queue(item_id, line_id, line, candidate_cluster_id, similarity, status,
                 decision, corrected_template, added_at)

Every operator returns new tables (snapshots), never mutates. Joins are on cluster ids:
the template table has one row per template, decisions one per reviewed template.

Documented differences from the reference (see README): a merge also updates the
target's stored pattern; a split's original template retires at once (it would otherwise
wait for confirmations on an id the miner never emits); reset compiles the reset text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.tokens import apply_label, unknown_label

STATUS_ACTIVE, STATUS_PENDING, STATUS_MERGED, STATUS_NEAR = "ACTIVE", "PENDING_MERGE", "MERGED", "NEAR_MATCH_REVIEW"

TEMPLATE_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.StringType()), T.StructField("pattern", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("merge_target_id", T.StringType()),
    T.StructField("confirmation_count", T.IntegerType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("labeled_template", T.StringType()), T.StructField("decision", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])

DECISION_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()), T.StructField("cluster_id", T.StringType()),
    T.StructField("decision", T.StringType()), T.StructField("merge_into_cluster_id", T.StringType()),
    T.StructField("merged_template", T.StringType()),
    T.StructField("sub_templates", T.ArrayType(T.StringType())),
    T.StructField("reset_template", T.StringType()), T.StructField("labeled_template", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])

TEMPLATE_COLS = [f.name for f in TEMPLATE_SCHEMA]


def empty_templates(spark) -> DataFrame:
    return spark.createDataFrame([], TEMPLATE_SCHEMA)


def new_templates_from_results(results: DataFrame) -> DataFrame:
    """Templates created by an ingest run: one ACTIVE row per CREATE line."""
    return (results.where(F.col("change_type") == "CREATE")
            .select("cluster_id", F.col("template").alias("pattern"), F.lit(STATUS_ACTIVE).alias("status"),
                    F.lit(None).cast("string").alias("merge_target_id"),
                    F.lit(0).cast("int").alias("confirmation_count"),
                    F.col("arrival_ts").cast("timestamp").alias("created_at"),
                    F.lit(None).cast("string").alias("labeled_template"),
                    F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("reasoning")))


def add_templates(templates: DataFrame, new: DataFrame) -> DataFrame:
    """Register new templates; an id that already exists is left untouched."""
    fresh = new.select(*TEMPLATE_COLS).join(templates.select("cluster_id"), "cluster_id", "left_anti")
    return templates.select(*TEMPLATE_COLS).unionByName(fresh.dropDuplicates(["cluster_id"]))


def delete_templates(templates: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove templates whose id is in ``ids(cluster_id)``."""
    return templates.join(ids.select("cluster_id"), "cluster_id", "left_anti")


def rollback_merge(templates: DataFrame, ids: DataFrame) -> DataFrame:
    """PENDING_MERGE -> ACTIVE with the target cleared (count kept)."""
    m = ids.select("cluster_id", F.lit(True).alias("__rb"))
    t = templates.join(m, "cluster_id", "left")
    hit = F.col("__rb").isNotNull() & (F.col("status") == STATUS_PENDING)
    return t.select(*[F.when(hit, F.lit(STATUS_ACTIVE)).otherwise(F.col("status")).alias("status") if c == "status"
                      else F.when(hit, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) if c == "merge_target_id"
                      else F.col(c) for c in TEMPLATE_COLS])


def valid_split(subs: Column) -> Column:
    """At least two sub-templates, none blank."""
    return F.coalesce((F.size(subs) >= 2) & F.forall(subs, lambda s: s.isNotNull() & s.rlike(r"\S")), F.lit(False))


def apply_decisions(templates: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Apply reviewed decisions to the template table.

    Returns ``templates`` (new snapshot), ``seeds(cluster_id, template)`` for the next
    mining run (merge targets take the merged template, reset templates the reset text,
    the first split sub-template takes the original's slot), ``split_children``
    (original_id, sub_index, cluster_id, pattern) and ``compiled_ids`` (templates that
    stay ACTIVE after keep / reset and enter the match registry).
    Decisions for unknown clusters are ignored.
    """
    d = decisions.dropDuplicates(["cluster_id"]).select(
        "cluster_id", F.col("decision").alias("d_decision"), "merge_into_cluster_id", "merged_template",
        "sub_templates", "reset_template", F.col("labeled_template").alias("d_label"),
        F.col("reasoning").alias("d_reason"), F.lit(True).alias("__has"))
    t = templates.join(d, "cluster_id", "left")
    has = F.coalesce(F.col("__has"), F.lit(False))
    dec = F.coalesce(F.col("d_decision"), F.lit("keep"))
    is_merge = has & (dec == "merge") & F.col("merge_into_cluster_id").isNotNull() & \
        (F.col("merge_into_cluster_id") != "") & (F.col("merge_into_cluster_id") != F.col("cluster_id"))
    is_split = has & (dec == "split") & valid_split(F.col("sub_templates"))
    is_reset = has & (dec == "reset") & F.col("reset_template").isNotNull() & (F.col("reset_template") != "")

    # merged templates replace the target's pattern (one merge per target: the last by id wins)
    merged_into = (d.where((F.col("d_decision") == "merge") & F.col("merged_template").isNotNull()
                           & (F.col("merged_template") != "")
                           & (F.col("merge_into_cluster_id") != F.col("cluster_id")))
                   .join(templates.select("cluster_id"), "cluster_id", "left_semi")
                   .groupBy(F.col("merge_into_cluster_id").alias("cluster_id"))
                   .agg(F.max_by("merged_template", "cluster_id").alias("__merged")))
    t = t.join(merged_into, "cluster_id", "left")

    out = t.select(
        "cluster_id",
        F.when(is_reset, F.col("reset_template")).when(F.col("__merged").isNotNull(), F.col("__merged"))
        .otherwise(F.col("pattern")).alias("pattern"),
        F.when(is_merge, F.lit(STATUS_PENDING)).otherwise(F.col("status")).alias("status"),
        F.when(is_merge, F.col("merge_into_cluster_id")).otherwise(F.col("merge_target_id")).alias("merge_target_id"),
        "confirmation_count", "created_at",
        F.when(has, F.col("d_label")).otherwise(F.col("labeled_template")).alias("labeled_template"),
        F.when(has, dec).otherwise(F.col("decision")).alias("decision"),
        F.when(has, F.coalesce(F.col("d_reason"), F.lit(""))).otherwise(F.col("reasoning")).alias("reasoning"),
        is_split.alias("__split"), "sub_templates",
    )
    children = (out.where("__split")
                .select(F.col("cluster_id").alias("original_id"), "created_at",
                        F.posexplode("sub_templates").alias("sub_index", "pattern"))
                .select("original_id", "sub_index",
                        F.concat(F.lit("split_"), F.col("original_id"), F.lit("_"), F.col("sub_index").cast("string")).alias("cluster_id"),
                        "pattern", "created_at"))
    kept = out.where(~F.col("__split")).select(*TEMPLATE_COLS)
    child_rows = children.select("cluster_id", "pattern", F.lit(STATUS_ACTIVE).alias("status"),
                                 F.lit(None).cast("string").alias("merge_target_id"),
                                 F.lit(0).cast("int").alias("confirmation_count"), "created_at",
                                 F.lit(None).cast("string").alias("labeled_template"),
                                 F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("reasoning"))
    new_templates = add_templates(kept, child_rows)
    seeds = (t.where(is_reset).select("cluster_id", F.col("reset_template").alias("template"))
             .unionByName(merged_into.select("cluster_id", F.col("__merged").alias("template")))
             .unionByName(children.where(F.col("sub_index") == 0).select(
                 F.col("original_id").alias("cluster_id"), F.col("pattern").alias("template"))))
    compiled_ids = t.where(has & ~is_merge & ~is_split & dec.isin("keep", "reset")).select("cluster_id")
    return {"templates": new_templates, "seeds": seeds, "split_children": children,
            "compiled_ids": compiled_ids}


def confirm_merges(templates: DataFrame, results: DataFrame, threshold: int = 100) -> DataFrame:
    """Every mining-path NONE line of target T adds one confirmation to each template
    pending into T; a pending template reaching ``threshold`` is deleted. Where the table has
    a ``staged_at`` time, only lines that arrived after it count.
    Hits are counted per target with a partial aggregate (a hot target is combined
    map-side), then joined to the pending templates; with staging times, per target and
    template over the lines of the pending targets alone."""
    mined = ((F.col("change_type") == "NONE") & ~F.coalesce(F.col("fast_path"), F.lit(False))
             & ~F.coalesce(F.col("near_match"), F.lit(False)))
    pending = F.col("status") == STATUS_PENDING
    if "staged_at" in templates.columns:
        waits = templates.where(pending).select(F.col("cluster_id").alias("__p"), F.col("merge_target_id").alias("__t"), F.col("staged_at").alias("__s"))
        hits = (results.where(mined).join(waits, (F.col("cluster_id") == F.col("__t")) & (F.col("__s").isNull() | (F.col("arrival_ts") > F.col("__s"))))
                .groupBy(F.col("__p").alias("cluster_id")).agg(F.count(F.lit(1)).alias("__hits")))
        t = templates.join(hits, "cluster_id", "left")
    else:
        hits = results.where(mined).groupBy(F.col("cluster_id").alias("merge_target_id")).agg(F.count(F.lit(1)).alias("__hits"))
        t = templates.join(hits, "merge_target_id", "left")
    cnt = F.when(pending, F.col("confirmation_count") + F.coalesce(F.col("__hits"), F.lit(0))).otherwise(
        F.col("confirmation_count")).cast("int")
    # as in the stream, a merge is confirmed by a line: counts alone delete nothing
    done = pending & (cnt >= threshold) & F.col("__hits").isNotNull()
    return t.where(~F.coalesce(done, F.lit(False))).withColumn("confirmation_count", cnt).select(*TEMPLATE_COLS)


# ---------------------------------------------------------------------------
# decisions from reviewers
# ---------------------------------------------------------------------------

# fixed value: the fence of a reply
_FENCE = r"(?is)```(?:json)?\s*([\s\S]*?)```"


def strip_fences(text: Column) -> Column:
    """Body of the first ```...``` block, else the trimmed text."""
    body = F.regexp_extract(text, _FENCE, 1)
    return F.trim(F.when(text.rlike(_FENCE), body).otherwise(text))


def read_decisions(raw: DataFrame, text_col: str = "response", batch_col: str = "batch_id") -> DataFrame:
    """Parse reviewer replies ``{"templates": [ ... ]}`` (fences allowed) into decision
    rows; unparseable replies give no rows (the completion step J10 falls back to keep)."""
    item = T.StructType([f for f in DECISION_SCHEMA if f.name != "batch_id"])
    schema = T.StructType([T.StructField("templates", T.ArrayType(item))])
    parsed = raw.select(F.col(batch_col).alias("batch_id"),
                        F.from_json(strip_fences(F.col(text_col)), schema).alias("__j"))
    return parsed.select("batch_id", F.explode_outer("__j.templates").alias("__d")).where(
        F.col("__d").isNotNull()).select("batch_id", "__d.*")


def complete_decisions(requests: DataFrame, returned: DataFrame) -> DataFrame:
    """Keep only decisions for requested templates, add 'keep / not_returned' rows for
    omitted ones, and replace invalid labels by the '<unknown>' fallback (P8).
    ``requests(batch_id, cluster_id, template)``."""
    r = requests.select("batch_id", "cluster_id", F.col("template").alias("__orig"))
    got = returned.join(r, ["batch_id", "cluster_id"], "inner").withColumn(
        "labeled_template", apply_label(F.col("__orig"), F.col("labeled_template")))
    missing = r.join(returned.select("batch_id", "cluster_id"), ["batch_id", "cluster_id"], "left_anti").select(
        "batch_id", "cluster_id", F.lit("keep").alias("decision"), F.lit(None).cast("string").alias("merge_into_cluster_id"),
        F.lit(None).cast("string").alias("merged_template"), F.lit(None).cast("array<string>").alias("sub_templates"),
        F.lit(None).cast("string").alias("reset_template"), unknown_label(F.col("__orig")).alias("labeled_template"),
        F.lit("not_returned_by_llm").alias("reasoning"))
    cols = [f.name for f in DECISION_SCHEMA]
    return got.select(*cols).unionByName(missing.select(*cols))


def fallback_decisions(requests: DataFrame, reason: str = "llm_error") -> DataFrame:
    """F4 default hook: every template kept with '<unknown>' labels (the reference's
    behaviour when the reviewer is unreachable)."""
    return requests.select(
        "batch_id", "cluster_id", F.lit("keep").alias("decision"), F.lit(None).cast("string").alias("merge_into_cluster_id"),
        F.lit(None).cast("string").alias("merged_template"), F.lit(None).cast("array<string>").alias("sub_templates"),
        F.lit(None).cast("string").alias("reset_template"), unknown_label(F.col("template")).alias("labeled_template"),
        F.lit(reason).alias("reasoning"))


def override_decisions(decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """Fields present in ``updates(batch_id, cluster_id, ...)`` replace the decision's."""
    upd_cols = [c for c in updates.columns if c not in ("batch_id", "cluster_id")]
    u = updates.select("batch_id", "cluster_id", *[F.col(c).alias("__u_" + c) for c in upd_cols])
    j = decisions.join(u, ["batch_id", "cluster_id"], "left")
    return j.select(*[F.coalesce(F.col("__u_" + c), F.col(c)).alias(c) if c in upd_cols else F.col(c)
                      for c in decisions.columns])


def response_override(decisions: DataFrame, responses: DataFrame, timeout_s: int = 300) -> DataFrame:
    """``responses(batch_id, cluster_id, action, edited_decision, edited_reasoning,
    responded_after_s)``: accept keeps the decision, reject -> keep / user_rejected, edit with
    a body -> the edited decision, edit without one -> keep / user_rejected, no answer within
    ``timeout_s`` -> keep / web_timeout."""
    r = responses.select("batch_id", "cluster_id", "action", "edited_decision", "edited_reasoning", "responded_after_s")
    j = decisions.join(r, ["batch_id", "cluster_id"], "left")
    timed_out = F.col("action").isNull() | (F.col("responded_after_s") > timeout_s)
    accept = ~timed_out & (F.col("action") == "accept")
    edit = ~timed_out & (F.col("action") == "edit") & F.col("edited_decision").isNotNull()
    new_dec = F.when(accept, F.col("decision")).when(edit, F.col("edited_decision")).otherwise(F.lit("keep"))
    new_reason = (F.when(accept, F.col("reasoning")).when(edit, F.col("edited_reasoning"))
                  .when(timed_out, F.lit("web_timeout")).otherwise(F.lit("user_rejected")))
    return j.select(*[new_dec.alias(c) if c == "decision" else new_reason.alias(c) if c == "reasoning" else F.col(c)
                      for c in decisions.columns])


# ---------------------------------------------------------------------------
# near-match queue
# ---------------------------------------------------------------------------

def near_match_enqueue(results: DataFrame) -> DataFrame:
    """One pending item per NEAR line; item id = md5 of the line id (replay-safe)."""
    return (results.where(F.coalesce(F.col("near_match"), F.lit(False)))
            .select(F.md5(F.concat(F.lit("nm:"), F.col("line_id").cast("string"))).alias("item_id"),
                    "line_id", "line", F.col("cluster_id").alias("candidate_cluster_id"), "similarity",
                    F.lit("pending").alias("status"), F.lit(None).cast("string").alias("decision"),
                    F.lit(None).cast("string").alias("corrected_template"),
                    F.col("arrival_ts").cast("timestamp").alias("added_at")))


def complete_near_match_decisions(items: DataFrame, returned: DataFrame) -> DataFrame:
    """One decision per pending item; missing -> new_template_send_to_drain."""
    it = items.where(F.col("status") == "pending").select("item_id").distinct()
    j = it.join(returned.dropDuplicates(["item_id"]), "item_id", "left")
    return j.select("item_id", F.coalesce("decision", F.lit("new_template_send_to_drain")).alias("decision"),
                    "corrected_template", F.coalesce("reasoning", F.lit("not_returned_by_llm")).alias("reasoning"))


def near_match_resolve(items: DataFrame, decisions: DataFrame, templates: DataFrame) -> dict[str, DataFrame]:
    """same_template_fix_regex with a corrected template relabels the candidate (it is
    recompiled); new_template_send_to_drain sends the line back to mining. Items keep a
    status (approved / rejected) for audit instead of being removed."""
    d = decisions.select("item_id", F.col("decision").alias("__d"), F.col("corrected_template").alias("__c"))
    j = items.join(d, "item_id", "left")
    fix = F.col("__d") == "same_template_fix_regex"
    redo = F.col("__d") == "new_template_send_to_drain"
    new_items = j.select(*[F.when(fix, F.lit("approved")).when(redo, F.lit("rejected")).otherwise(F.col("status")).alias(c)
                           if c == "status" else F.when(fix, F.col("__d")).otherwise(F.col("decision")).alias(c)
                           if c == "decision" else F.when(fix, F.col("__c")).otherwise(F.col(c)).alias(c)
                           if c == "corrected_template" else F.col(c) for c in items.columns])
    relabel = (j.where(fix & F.col("__c").isNotNull() & (F.col("__c") != ""))
               .groupBy(F.col("candidate_cluster_id").alias("cluster_id"))
               .agg(F.max_by("__c", "item_id").alias("__label")))
    t = templates.join(relabel, "cluster_id", "left")
    new_templates = t.select(*[F.coalesce(F.col("__label"), F.col(c)).alias(c) if c == "labeled_template" else F.col(c)
                               for c in TEMPLATE_COLS])
    remine = j.where(redo).select("line_id", F.col("added_at").alias("arrival_ts"), "line", "candidate_cluster_id")
    return {"items": new_items, "templates": new_templates, "remine_lines": remine,
            "recompile_ids": relabel.select("cluster_id")}


def trace_predicates(templates: DataFrame, which: str) -> DataFrame:
    """P29: 'active', 'pending' (near-match items use status 'pending') or 'reviewed'."""
    if which == "active":
        return templates.where(F.col("status") == STATUS_ACTIVE)
    if which == "pending":
        return templates.where(F.col("status") == "pending")
    if which == "reviewed":
        return templates.where((F.col("status") == STATUS_ACTIVE) & F.col("decision").isNotNull())
    raise ValueError(which)
