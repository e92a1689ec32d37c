"""E1 ingest: raw lines -> one result row per line (U1 dispatch, R1 batch form).

lines --fast_path (broadcast template lookup, no shuffle)--> EXACT / NEAR / NONE
NONE lines --mask--> --mine (A1)--> --change_points (W3/W4)--> template as of each line
labels (J4) are computed once per template version / compiled template, never per line.

Result columns (``ingest_results``): line_id, arrival_ts, source, line, processed,
cluster_id, template, change_type (CREATE / UPDATE / NONE / NEAR_MATCH), extractions
(mask extraction map, mining path), matched_fields (exact path), ocsf (rule label or
NULL), fast_path, near_match, similarity.

Also returns the new template versions and the final template per mined cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.masks import mask_lines, mask_only
from logweave.operators.matching import DEFAULT_NEAR_THRESHOLD, fast_path
from logweave.operators.mining import DEFAULT_GROUP_LINES, DEFAULT_SIM_TH, change_points, mine_templates
from logweave.operators.normalize import label_column
from logweave.session import cut_lineage
from logweave.sources.rules import DEFAULT_RULES


@dataclass
class IngestOutput:
    results: DataFrame
    versions: DataFrame         # (cluster_id, version, template, trigger_line_id)
    cluster_templates: DataFrame  # (cluster_id, key, template): latest version per cluster
    cluster_lines: DataFrame      # (cluster_id, lines): mining-path lines per cluster, from distinct counts


def ingest(lines: DataFrame, compiled: DataFrame | None = None, rules=DEFAULT_RULES,
           sim_th: float = DEFAULT_SIM_TH, seeds: DataFrame | None = None,
           near_threshold: float = DEFAULT_NEAR_THRESHOLD, with_extractions: bool = True,
           group_lines: int = DEFAULT_GROUP_LINES, match_on: str = "raw",
           label_on: str = "template", mask_once: bool = False) -> IngestOutput:
    """``match_on``: 'raw' (default, as the reference) or 'processed' (match the masked
    line, so masks that change the token count cannot defeat the fast path).
    ``label_on``: 'template' (default, as the reference), 'masked' or 'line' (per line).
    ``mask_once``: the masked lines are written and read for both passes, not masked in each;
    for callers that need the results (with extractions the copy costs more than the masks)."""
    if match_on not in ("raw", "processed") or label_on not in ("template", "masked", "line"):
        raise ValueError("match_on in {raw, processed}, label_on in {template, masked, line}")
    if compiled is not None:
        comp = compiled.withColumn("ocsf", label_column(F.col("labeled_template"), rules))
        if match_on == "processed":
            fp = fast_path(mask_only(lines, out_col="__m"), comp, line_col="__m",
                           threshold=near_threshold).drop("__m")
        else:
            fp = fast_path(lines, comp, threshold=near_threshold)
        lookup = comp.select(F.col("cluster_id").alias("__cid"), F.col("labeled_template").alias("__tpl"),
                             F.col("ocsf").alias("__tocsf"))
    else:
        fp = lines.select("*", F.lit("NONE").alias("match_kind"), F.lit(None).cast("string").alias("cluster_id"),
                          F.lit(None).cast("map<string,string>").alias("matched_fields"),
                          F.lit(None).cast("double").alias("similarity"))
        lookup = None

    none = F.col("match_kind") == "NONE"
    # only lines the fast path did not take are masked (the reference skips the masks for
    # them too); the regex chain is guarded by the match kind
    guard = none if compiled is not None and label_on != "masked" else None
    masked = (mask_lines(fp, only_when=guard) if with_extractions else mask_only(fp, only_when=guard))
    if mask_once:
        masked = cut_lineage(masked)
    mined_in = masked.where(none).select("line_id", "processed")
    # the assignment (one row per distinct masked line) feeds several branches: write it
    # once to the shared checkpoint folder so the fold never re-runs, even after an
    # executor loss
    mined = cut_lineage(mine_templates(mined_in, sim_th=sim_th, seeds=seeds, group_lines=group_lines))
    line_changes, versions = change_points(mined, seeds)
    # one label per template version; the per-cluster version list is bounded by token count
    asof_versions = versions
    if seeds is not None:
        # a seeded cluster's lines before its first change here have the seed's template
        known = seeds.select("cluster_id", F.lit(0).alias("version"), "template", F.lit(-1 << 62).alias("trigger_line_id"))
        asof_versions = versions.unionByName(known.join(mined.select("cluster_id").distinct(), "cluster_id", "left_semi"))
    vl = asof_versions.withColumn("ocsf", label_column(F.col("template"), rules))
    vs = vl.groupBy("cluster_id").agg(F.array_sort(F.collect_list(
        F.struct("trigger_line_id", "template", "ocsf"))).alias("__vers"))
    lc = (line_changes.select(F.col("text").alias("__text"), F.col("cluster_id").alias("__mcid"),
                              F.col("first_line_id").alias("__first"), F.col("change_type").alias("__ct"))
          .join(vs.withColumnRenamed("cluster_id", "__mcid"), "__mcid", "left"))

    r = masked.join(lc, (F.col("processed") == F.col("__text")) & none, "left")
    asof = F.filter("__vers", lambda v: v["trigger_line_id"] <= F.col("line_id"))
    cur = F.get(asof, F.size(asof) - 1)
    if lookup is not None:
        r = r.join(lookup, F.col("cluster_id") == F.col("__cid"), "left")
        exact_tpl, exact_ocsf = F.col("__tpl"), F.col("__tocsf")
    else:
        exact_tpl, exact_ocsf = F.lit(None).cast("string"), F.lit(None)
    kind = F.col("match_kind")
    out = r.select(
        *[c for c in lines.columns],
        F.when(none, F.col("processed")).otherwise(F.col("line")).alias("processed"),
        F.when(none, F.col("__mcid")).otherwise(F.col("cluster_id")).alias("cluster_id"),
        F.when(none, cur["template"]).when(kind == "EXACT", exact_tpl).alias("template"),
        F.when(none, F.when(F.col("line_id") == F.col("__first"), F.col("__ct")).otherwise(F.lit("NONE")))
        .when(kind == "EXACT", F.lit("NONE")).otherwise(F.lit("NEAR_MATCH")).alias("change_type"),
        (F.when(none, F.col("extractions")) if with_extractions else F.lit(None).cast("map<string,array<string>>")).alias("extractions"),
        F.when(kind == "EXACT", F.col("matched_fields")).alias("matched_fields"),
        (F.when(none, cur["ocsf"]).when(kind == "EXACT", exact_ocsf) if label_on == "template" else
         label_column(F.col("processed") if label_on == "masked" else F.col("line"), rules)).alias("ocsf"),
        (kind == "EXACT").alias("fast_path"),
        (kind == "NEAR").alias("near_match"),
        F.col("similarity"),
    )
    latest = vl.groupBy("cluster_id").agg(F.max_by("template", "version").alias("template"))
    keys = mined.select("cluster_id", "key").distinct()
    lines_per = mined.groupBy("cluster_id").agg(F.sum("n").alias("lines"))
    return IngestOutput(out, versions, latest.join(keys, "cluster_id", "left"), lines_per)
