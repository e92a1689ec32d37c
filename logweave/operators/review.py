"""Review inputs: which templates to review and the request texts for an outside
reviewer (J3, J7, J8, J9, J13, J14, P24-P28, W8, F4 hook).

The reviewer itself (a person or a service) is outside Spark; a review function is any
``DataFrame -> DataFrame`` that turns requests into decisions (see
``lifecycle.fallback_decisions`` for the default: keep, with '<unknown>' labels).
Request texts are built with column functions; every list inside a text is bounded
(3 templates per request, 3 / 5 / 10 samples, 5 candidates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.similarity import char_similarity
from logweave.functions.tokens import wildcard_ratio
from logweave.operators.sampling import request_chunks, samples_array

DEGRADED_RATIO = 0.4


def _review_items(t: DataFrame, samples: DataFrame | None, k: int = 3) -> DataFrame:
    x = t.select("cluster_id", F.col("pattern").alias("template"), wildcard_ratio(F.col("pattern")).alias("wildcard_ratio"))
    if samples is None:
        return x.withColumn("samples", F.array().cast("array<string>"))
    s = samples_array(samples, k)
    return x.join(s, "cluster_id", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def review_new_or_changed(results: DataFrame, templates: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """J13 (+U4): each template touched by a CREATE / UPDATE line that exists in the store,
    once, with its wildcard ratio and first three samples."""
    touched = results.where(F.col("change_type").isin("CREATE", "UPDATE")).select("cluster_id").distinct()
    t = templates.join(touched, "cluster_id", "left_semi")
    return _review_items(t, samples)


def review_all_active(templates: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Every ACTIVE template."""
    return _review_items(templates.where(F.col("status") == "ACTIVE"), samples)


def attach_prior_decisions(items: DataFrame, prior: DataFrame) -> DataFrame:
    """Earlier decision / template / reasoning per cluster (left join)."""
    p = prior.select("cluster_id", F.col("decision").alias("prior_decision"),
                     F.col("template").alias("prior_template"), F.col("reasoning").alias("prior_reasoning"))
    return items.join(p, "cluster_id", "left")


def unclassified_templates(templates: DataFrame, classifications: DataFrame) -> DataFrame:
    """Reviewed ACTIVE templates (label else pattern) with no cached classification."""
    t = (templates.where((F.col("status") == "ACTIVE") & F.col("decision").isNotNull())
         .select("cluster_id", F.coalesce(F.nullif(F.col("labeled_template"), F.lit("")), F.col("pattern")).alias("template")))
    return t.join(classifications.select("template"), "template", "left_anti")


def near_match_context(items: DataFrame, templates: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Pending near-match items with their candidate template (label else pattern) and
    three samples; a missing template is tolerated (NULLs)."""
    t = templates.select(F.col("cluster_id").alias("candidate_cluster_id"), "pattern",
                         F.coalesce(F.nullif(F.col("labeled_template"), F.lit("")), F.col("pattern")).alias("labeled_template"))
    x = items.where(F.col("status") == "pending").join(t, "candidate_cluster_id", "left")
    if samples is not None:
        s = samples_array(samples, 3).withColumnRenamed("cluster_id", "candidate_cluster_id")
        x = x.join(s, "candidate_cluster_id", "left")
    else:
        x = x.withColumn("samples", F.lit(None).cast("array<string>"))
    return x


def _sample_block(samples: Column, k: int, width: int) -> Column:
    return F.array_join(F.transform(F.slice(F.coalesce(samples, F.array().cast("array<string>")), 1, k),
                                    lambda s: F.concat(F.lit("    sample: "), F.substring(s, 1, width))), "\n")


def label_review_requests(items: DataFrame, prior: DataFrame | None = None, size: int = 3) -> DataFrame:
    """P24 + W8: one request text per group of ``size`` templates: pattern, wildcard share
    in percent, up to three samples (cut to 120 chars) and any prior decision."""
    x = attach_prior_decisions(items, prior) if prior is not None else items.withColumn(
        "prior_decision", F.lit(None).cast("string"))
    block = F.concat_ws("\n",
                        F.concat(F.lit("- cluster "), F.col("cluster_id")),
                        F.concat(F.lit("    pattern: "), F.col("template")),
                        F.format_string("    wildcards: %.0f%%", F.col("wildcard_ratio") * 100),
                        F.when(F.col("prior_decision").isNotNull(),
                               F.concat(F.lit("    earlier decision: "), F.upper("prior_decision"))),
                        _sample_block(F.col("samples"), 3, 120))
    c = request_chunks(x.withColumn("__block", block), size)
    g = c.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "__block"))).alias("__b"))
    return g.select(F.col("chunk_id").alias("batch_id"), F.transform("__b", lambda b: b["cluster_id"]).alias("cluster_ids"),
                    F.concat(F.lit("Review each template: keep, merge, split or reset; label every <*>.\n"),
                             F.array_join(F.transform("__b", lambda b: b["__block"]), "\n")).alias("request"))


def degraded_review_requests(items: DataFrame, threshold: float = DEGRADED_RATIO) -> DataFrame:
    """Over-general templates (wildcard share above ``threshold``), up to 10 samples."""
    d = items.where(F.col("wildcard_ratio") > threshold)
    return d.select("cluster_id", F.concat_ws(
        "\n", F.lit("Template looks over-general: split, reset or keep?"),
        F.concat(F.lit("pattern: "), F.col("template")),
        F.format_string("wildcard share: %.2f", F.col("wildcard_ratio")),
        _sample_block(F.col("samples"), 10, 1 << 20)).alias("request"))


def near_match_review_requests(context: DataFrame) -> DataFrame:
    """Per pending item: the line (first 200 chars), similarity, candidate template
    and three of its samples."""
    return context.select("item_id", F.concat_ws(
        "\n", F.concat(F.lit("item "), F.col("item_id")),
        F.format_string("  line (similarity %.2f): %s", F.col("similarity"), F.substring("line", 1, 200)),
        F.concat(F.lit("  candidate "), F.coalesce("candidate_cluster_id", F.lit("")), F.lit(": "),
                 F.coalesce("labeled_template", F.lit(""))),
        _sample_block(F.col("samples"), 3, 120)).alias("request"))


def classify_requests(unclassified: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One request per unclassified template with up to three samples (120 chars)."""
    x = unclassified
    if samples is not None:
        x = x.join(samples_array(samples, 3), "cluster_id", "left")
    else:
        x = x.withColumn("samples", F.lit(None).cast("array<string>"))
    return x.select("cluster_id", "template", F.concat_ws(
        "\n", F.lit("Classify this log template into an OCSF class; give fields and a regex."),
        F.concat(F.lit("template: "), F.col("template")), _sample_block(F.col("samples"), 3, 120)).alias("request"))


def candidate_templates(new: DataFrame, existing: DataFrame, min_ratio: float = 0.5, top: int = 5,
                        text_col: str = "pattern") -> DataFrame:
    """J3 + F2 + T2: for each new template, up to ``top`` existing templates whose
    ``SequenceMatcher`` ratio is above ``min_ratio``, best first, rounded to 4 places.

    ``new`` is a review batch (bounded); each of its templates is compared with every
    existing template of a compatible length, nothing more. ratio = 2*M/(la+lb) <=
    2*min(la,lb)/(la+lb), so a pair can qualify only when the shorter text is more than
    ``r/(2-r)`` of the longer. Lengths are bucketed on a geometric grid with that factor
    as step, so every qualifying pair lies in the same or a neighbouring bucket: the join
    is an equi-join on the bucket, then the exact length bound prunes, and only the
    survivors reach the Arrow UDF. All qualifying pairs are scored before the top-k.
    """
    import math
    step = math.log((2 - min_ratio) / min_ratio)

    def bucket(col):
        ln = F.greatest(F.length(col), F.lit(1)).cast("double")
        return F.floor(F.log(ln) / F.lit(step)).cast("bigint")

    n = new.select(F.col("cluster_id").alias("new_id"), F.col(text_col).alias("new_t")).withColumn(
        "__b", bucket(F.col("new_t")))
    e = existing.select("cluster_id", F.col(text_col).alias("template")).withColumn("__b0", bucket(F.col("template")))
    e = e.withColumn("__b", F.explode(F.array(F.col("__b0") - 1, F.col("__b0"), F.col("__b0") + 1))).drop("__b0")
    la, lb = F.length("new_t"), F.length("template")
    pairs = (n.join(e, "__b").where(F.col("new_id") != F.col("cluster_id"))
             .where(2 * F.least(la, lb) > min_ratio * (la + lb)))
    scored = (pairs.withColumn("__r", char_similarity(F.col("new_t"), F.col("template")))
              .where(F.col("__r") > min_ratio)
              .withColumn("similarity", F.round("__r", 4)))
    w = Window.partitionBy("new_id").orderBy(F.desc("__r"), F.asc("cluster_id"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("new_id", "cluster_id", "template", "similarity", "rank"))


def merge_review_requests(new_items: DataFrame, candidates: DataFrame) -> DataFrame:
    """P25: new template vs up to five candidates, up to ten samples."""
    c = candidates.groupBy("new_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "cluster_id", "template", "similarity"))).alias("__c"))
    x = new_items.join(c, new_items.cluster_id == c.new_id, "left")
    cand = F.array_join(F.transform(F.coalesce("__c", F.array()), lambda k: F.format_string(
        "    candidate %s (%.4f): %s", k["cluster_id"], k["similarity"], k["template"])), "\n")
    return x.select("cluster_id", F.concat_ws(
        "\n", F.lit("New template: merge into a candidate or keep?"), F.concat(F.lit("template: "), F.col("template")),
        _sample_block(F.col("samples"), 10, 1 << 20), cand).alias("request"))
