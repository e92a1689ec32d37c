"""E2 review and approve, E3 near-match review, E4 restart — composed from operators.

E2: ingest results -> templates touched (J13) -> request texts (P24, W8) -> review_fn
    (outside reviewer; default keep with '<unknown>' labels) -> completed decisions (J10)
    -> apply (L1-L5) -> registry (L2/L8) -> classification requests for new templates (J8,
    P28) -> parsed records (L14) -> snapshot (S5).
E4: snapshot (S4) -> registry of reviewed templates (L8) -> parsed records of samples (L14).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.compile import matchable_templates
from logweave.operators.lifecycle import apply_decisions, complete_decisions, fallback_decisions
from logweave.operators.parse import parse_events
from logweave.operators.review import classify_requests, label_review_requests, review_new_or_changed, \
    unclassified_templates
from logweave.session import cut_lineage
from logweave.sources.rules import DEFAULT_RULES
from logweave.sources.state import load_state, save_state

ReviewFn = Callable[[DataFrame], DataFrame]


def review_batch(results: DataFrame, templates: DataFrame, samples: DataFrame | None = None,
                 batch_id: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Templates to review (J13) and their request texts."""
    items = review_new_or_changed(results, templates, samples)
    requests = items.withColumn("batch_id", F.lit(batch_id))
    return requests, label_review_requests(items)


def approve(results: DataFrame, templates: DataFrame, requests: DataFrame,
            review_fn: ReviewFn = fallback_decisions, rules=DEFAULT_RULES,
            classifications: DataFrame | None = None, samples: DataFrame | None = None) -> dict[str, DataFrame]:
    """E2 from requests to the new template table, registry and parsed records."""
    decisions = cut_lineage(complete_decisions(requests.select("batch_id", "cluster_id", "template"),
                                               review_fn(requests)))
    applied = apply_decisions(templates, decisions)
    # the new template snapshot is a table of its own: written once, so the registry and
    # later runs do not carry this run's whole lineage
    new_t = cut_lineage(applied["templates"])
    compiled = cut_lineage(matchable_templates(new_t, fallback_to_pattern=True))
    cls = classifications if classifications is not None else \
        new_t.sparkSession.createDataFrame([], "template string, classification string")
    to_classify = classify_requests(unclassified_templates(new_t, cls), samples)
    parsed = parse_events(results.drop("template"), new_t, rules, cls, samples)
    return {"decisions": decisions, "templates": new_t, "compiled": compiled, "seeds": applied["seeds"],
            "split_children": applied["split_children"], "classify_requests": to_classify, "parsed": parsed}


def restart(spark, root: str, rules=DEFAULT_RULES) -> dict[str, DataFrame] | None:
    """Latest snapshot -> match registry and parsed records of the saved samples."""
    st = load_state(spark, root)
    if st is None:
        return None
    templates = st["templates"]
    out = dict(st)
    # the registry that `approve` compiled: a reset template by its reset text
    out["compiled"] = matchable_templates(templates, fallback_to_pattern=True)
    if "samples" in st:
        out["parsed"] = parse_events(None, templates, rules, st.get("classifications"), st["samples"])
    return out


def snapshot(spark, root: str, templates: DataFrame, versions: DataFrame, samples: DataFrame,
             counts: DataFrame, classifications: DataFrame | None = None) -> bool:
    tables = {"templates": templates, "template_versions": versions, "samples": samples, "counts": counts}
    if classifications is not None:
        tables["classifications"] = classifications
    return save_state(spark, root, tables)
